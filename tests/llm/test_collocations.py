from collections import Counter, defaultdict
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import collocations as c


def brute(rows, least, top=2000, covered=50):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    count[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in count.items():
        kept = [p for p in f if len(p) > 1 and f[p] >= least]
        longer = [p for p in kept if len(p) == 3]
        hidden = {q for p in longer for q in (p[:2], p[1:]) if 100 * f[p] >= covered * f[q]}
        found = []
        for p in kept:
            if p not in hidden:
                score, k = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df, **options):
    rows = c.ranked_collocations(df, **options)
    return sorted(tuple(r) for r in rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard_words", [50, c.SHARD_WORDS])
@pytest.mark.parametrize("filter_bits", [64, c.FILTER_BITS])
def test_against_plain_counting_for_any_shard_and_filter(spark, sf_dir, shard_words, filter_bits):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).repartition(3).select("lang", "text").cache()
    assert got(df, least=3, top=40, shard_words=shard_words, filter_bits=filter_bits) == brute([tuple(r) for r in df.collect()], 3, 40)


def test_random_words_with_ties_and_every_mark(spark):
    rng = np.random.default_rng(5)
    words = np.array(["a", "B", "Éa", "ß", "a b", "x\x00y", "😀", "\x1f"])
    marks = np.array([" ", "\t", "  ", ".", ",", ";\n", ": ", "! ", "?\r\n", "\x0b", "\x0c", " \t "])
    texts = ["".join(w + m for w, m in zip(rng.choice(words, 300), rng.choice(marks, 300, p=[0.7] + [0.3 / 11] * 11))) for _ in range(12)]
    rows = [(lang, t) for lang, t in zip([None, "und", "en", "de"] * 3, texts)]
    assert got(spark.createDataFrame(rows, "lang string, text string"), least=4) == brute(rows, 4)


def test_transforms_give_each_pair_and_triple_once():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(1, 6, rng.integers(1, 9)) for _ in range(200)]
    ids = np.concatenate([np.r_[0, p] for p in pieces] + [[0]])
    before, after = c.transforms(ids)
    starts = np.r_[0, np.cumsum(np.bincount(ids[ids > 0], minlength=6)[1:])]
    first, second, count, row = c.pairs(before, starts)
    want = Counter((a, b) for p in pieces for a, b in zip(p, p[1:]))
    assert {(a, b): n for a, b, n in zip(first, second, count)} == want
    which, third, times = c.extended(after, row, count)
    want = Counter(t for p in pieces for t in zip(p, p[1:], p[2:]))
    assert {(first[w], second[w], z): n for w, z, n in zip(which, third, times)} == want


def test_tokens_of_bytes():
    words, begins = c.tokens(pa.array(["One  two. THREE", "", " four\tfive", "ÄÖ,x"]))
    assert words.to_pylist() == ["one", "two", "three", "four", "five", "ÄÖ", "x"]
    assert begins.tolist() == [True, False, True, True, False, True, True]
    assert c.tokens(pa.array(["", " . "]))[0].to_pylist() == []


def test_defined_cases(spark, edge, empty):
    rows = [(r.lang, r.text) for r in edge.collect()]
    assert got(edge, least=2) == brute(rows, 2)
    assert got(empty) == []
    nothing = spark.createDataFrame([(None, None), ("en", ""), ("en", " .\n")], "lang string, text string")
    assert got(nothing, least=1) == []


def test_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(4_000_000_000_000_003, 4_000_000_000_000_007, 4_000_000_000_000_011)], "a long, b long, c long")
    cut = rows.select(c._cut("a", "b", "c", 1).alias("cut")).first().cut
    assert cut.score == 1000000 * 4_000_000_000_000_003**2 // (4_000_000_000_000_007 * 4_000_000_000_000_011)


def test_a_common_key_is_refused(spark, monkeypatch):
    seeds = []
    original = c._key

    def key(seed, *columns):
        seeds.append(seed)
        return original(seed, *columns) if seed else original(seed, c.F.lit("same"))

    monkeypatch.setattr(c, "_key", key)
    df = spark.createDataFrame([("en", "a b a b a b")], "lang string, text string")
    assert [r.phrase for r in c.ranked_collocations(df, least=2).collect()] == [p[2] for p in brute([("en", "a b a b a b")], 2)]
    assert set(seeds) == {0, 1}


@pytest.mark.parametrize("many", [1, c.Bucket.MANY])
def test_packed_counts_are_unpacked(monkeypatch, many):
    monkeypatch.setattr(c.Bucket, "MANY", many)
    rng = np.random.default_rng(2)
    cells = (rng.integers(0, 3, 5000) << c.CELL_BITS | rng.integers(0, 3000, 5000)).astype(np.uint32)
    counts = rng.choice([1, 2, 255, 256, 10_000], 5000)
    want, buckets = Counter(), {}
    for cell, n in zip(cells.tolist(), counts.tolist()):
        want[cell] += n
    for part in (slice(0, 2000), slice(2000, None)):
        for bucket, data in c.packed(cells[part], counts[part]):
            buckets.setdefault(bucket, c.Bucket()).add(data)
    for least in (1, 300, 20_000):
        got = {(b << c.CELL_BITS) + at for b, held in buckets.items() for at in held.reaching(least).tolist()}
        assert got == {cell for cell, n in want.items() if n >= least}
    assert not list(c.packed(cells[:0], counts[:0]))


@pytest.mark.parametrize("many", [1, c.Phrases.MANY])
def test_blocks_add_up_to_the_counts_of_their_phrases(monkeypatch, many):
    monkeypatch.setattr(c.Phrases, "MANY", many)
    rng = np.random.default_rng(8)
    want, rows = Counter(), []
    for _ in range(4):
        pairs = np.unique(rng.integers(-9, 9, (60, 2)), axis=0)
        f2, n = rng.integers(1, 9, len(pairs)), rng.integers(0, 4, len(pairs))
        third = np.concatenate([rng.choice(20, k, replace=False) for k in n]).astype(np.int64)
        f3 = rng.integers(1, 9, len(third))
        which = np.repeat(np.arange(len(pairs)), n)
        want.update({(*p, None): int(f) for p, f in zip(pairs.tolist(), f2)})
        want.update({(*pairs[w].tolist(), int(z)): int(f) for w, z, f in zip(which, third, f3)})
        rows += [r for b in c.blocks(pairs[:, 0].copy(), pairs[:, 1].copy(), f2, which, third, f3) for r in (b.slice(i, 1) for i in range(b.num_rows))]
    rows.sort(key=lambda r: r.column("bucket")[0].as_py())
    got = {(r["k1"], r["k2"], r["k3"]): r["f"] for b in c._summed(iter(rows), 5) for r in b.to_pylist()}
    assert got == {k: f for k, f in want.items() if f >= 5}
