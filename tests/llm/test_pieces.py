import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece

from tidewatch.llm import pieces as p
from tidewatch.llm.queries import op7_sentencepiece


@pytest.fixture(scope="module")
def vocabulary():
    return p.read_pieces(p.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def pieces(vocabulary):
    return p.Pieces(vocabulary)


def slow_best(pieces, vocabulary, word):
    """Score of the best split of a marked word, from a plain dictionary."""
    score = {t: s for t, s in zip((vocabulary[i][0] for i in pieces.ids), pieces.scores)}
    best = [0.0] + [-math.inf] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - 48), e):
            part = word[s:e]
            got = score.get(part, pieces.unknown if e - s == 1 else -math.inf)
            best[e] = max(best[e], best[s] + got)
    return best[-1]


def score_of(pieces, ids):
    index = {int(i): k for k, i in enumerate(pieces.ids)}
    total, pending = 0.0, b""
    for i in ids:
        if i in index:
            total += pieces.scores[index[i]]
        else:
            pending += pieces.spelled[i]
    return total + pieces.unknown * len(pending.decode())


WORDS = ["▁information", "▁the", "▁▁▁▁x", "Überraschung", "▁élève", "漢字かな交じり文", "aaaaaaaaaaaaaaaaaaaa", "😀👍", "x" * 100, "▁don't.", "é" * 50]


def test_best_paths_match_a_dictionary(pieces, vocabulary):
    random.seed(5)
    words = WORDS + ["".join(random.choice("theanior▁édsx") for _ in range(random.randint(1, 24))) for _ in range(300)]
    solved = pieces.solve_many([w.encode() for w in words])
    for word, ids in zip(words, solved):
        assert ids == pieces.solve_one(word.encode())
        assert score_of(pieces, np.frombuffer(ids, np.int32).tolist()) == pytest.approx(slow_best(pieces, vocabulary, word))


def test_scores_match_the_library_with_a_unigram_model(spark, sf_dir, pieces, vocabulary):
    """The same vocabulary with our scores, run by the public library as a unigram model."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def block(field, data):
        return varint(field << 3 | 2) + varint(len(data)) + data

    scores = dict(zip(pieces.ids.tolist(), pieces.scores))
    import struct

    model = b"".join(block(1, block(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", scores.get(i, 0.0)) + varint(3 << 3) + varint(kind)) for i, (t, _, kind) in enumerate(vocabulary))
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)  # unigram, byte fallback
    normal = block(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model + block(2, trainer) + block(3, normal))
    for text in ["The information of the nation", "Überraschung  und  élève", "a漢字 😀 x\ny", "ththeandor anding erst"]:
        ours = pieces.encode([text], {})[0].tolist()
        theirs = library.encode(text)
        assert score_of(pieces, ours) == pytest.approx(score_of(pieces, theirs), abs=1e-3)
        assert library.decode(ours) == text


    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():  # whole texts
        theirs, ours = library.encode(row.text or ""), pieces.encode([row.text or ""], {})[0].tolist()
        assert score_of(pieces, ours) == pytest.approx(score_of(pieces, theirs), rel=1e-5), row.doc_id
        assert library.decode(ours) == (row.text or "")


def test_round_trip_of_odd_texts(pieces, edge):
    texts = ["", "x", " lead", "trail ", "two  spaces", "▁ mark ▁▁", "a\n\n b\tc\r\n", "\x00", "漢字😀", " ", "\n", "a" * 3000, *(r.text for r in edge.collect())]
    for text, ids in zip(texts, pieces.encode(texts, {})):
        assert pieces.decode(ids.tolist()) == (text or "")


def test_a_full_cache_changes_nothing(pieces, monkeypatch):
    texts = [f"word{i} and {i * 7919} more" for i in range(200)]
    want = [x.tolist() for x in pieces.encode(texts, {})]
    monkeypatch.setattr(p, "CACHE", 10)
    monkeypatch.setattr(p, "TOGETHER", 50)
    assert [x.tolist() for x in pieces.encode(texts, {})] == want


def test_frames(spark, edge, empty):
    rows = p.encode_texts(spark, edge, decoded=True).collect()
    assert all(r.decoded == r.text for r in rows)
    assert all((r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) for r in rows)
    assert p.encode_texts(spark, empty).count() == 0
    back = p.decode_ids(spark, p.encode_texts(spark, edge)).collect()
    assert all(r.decoded == r.text for r in back)


def test_query(spark, sf_dir, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in op7_sentencepiece(spark, sf_dir).collect():
        ids = pieces.encode([texts[row.doc_id]], {})[0].tolist()
        assert row.round_trip and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
