"""SentencePiece-style encoding: unigram Viterbi over a double-array trie, and decoding.

The pieces come from a public model file; its path is a parameter. The best path
is found for each distinct chunk (a run of spaces and the word after it), which is
exact because no piece goes on past a word's end, and chunks are kept in a bounded
cache. Unseen chunks of a batch are solved together, one numpy step for each place
and depth; long chunks are solved one at a time.

Characters without a piece become byte pieces. A marker character in the text is
spelled in bytes too, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh

MARK = "▁"
DEFAULT_MODEL = os.path.join(os.environ.get("TOKENIZER_FILES", "/opt/tokenizers"), "piece_bpe_32k.model")
# Fixed values of the public model format: field numbers and kinds of pieces.
PIECE_FIELD, TEXT_FIELD, SCORE_FIELD, KIND_FIELD = 1, 1, 2, 3
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks kept for each task; chunks over LONG bytes are solved alone.
CACHE, LONG, GROUP = 1 << 16, 64, 8192
#: Characters of text whose unseen chunks are solved together.
TOGETHER = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(text, stored score, kind) of every piece of a model file, by id."""
    pieces = []
    for field, value in _fields(Path(path).read_bytes()):
        if field == PIECE_FIELD:
            one = dict(_fields(value))
            pieces.append((one[TEXT_FIELD].decode(), struct.unpack("<f", one[SCORE_FIELD])[0], one.get(KIND_FIELD, NORMAL)))
    return pieces


def zipf_scores(n: int) -> np.ndarray:
    """Log probabilities of n pieces in order of rank under Zipf's law.

    A merge-built vocabulary stores ranks, not probabilities; this turns them into
    log scores whose sums can be compared.
    """
    return -np.log(np.arange(1, n + 1)) - math.log(sum(1 / r for r in range(1, n + 1)))


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: the child of s by byte c is base[s] + c, if its check is s."""
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    todo, free, wide = [(0, 0, 0, len(order))], 1, 1  # wide: nodes of several children search from here
    check[0] = -2
    while todo:
        node, depth, lo, hi = todo.pop()
        if len(keys[order[lo]]) == depth:
            value[node] = order[lo]
            lo += 1
        if lo == hi:
            continue
        groups, start = [], lo
        for i in range(lo + 1, hi + 1):
            if i == hi or keys[order[i]][depth] != keys[order[start]][depth]:
                groups.append((keys[order[start]][depth], start, i))
                start = i
        codes = np.array([g[0] for g in groups])
        while check[free] != -1 or free <= codes[0]:
            free += 1
        at = free - int(codes[0]) if len(codes) == 1 else max(wide, 1)
        while True:
            if at + 512 > len(check):
                base, check, value = (np.concatenate((x, np.full(len(x), f, np.int32))) for x, f in ((base, 0), (check, -1), (value, -1)))
            if (check[at + codes] == -1).all():
                break
            at += 1
        if len(codes) > 1:
            wide = at
        base[node], check[at + codes] = at, node
        todo += [(at + c, depth + 1, a, b) for c, a, b in groups]
    return base, check, value


class _Either(dict):
    """A view of the cache for one batch, with more entries beside it."""

    more: dict

    def __missing__(self, key):
        return self.more[key]


class Pieces:
    """Tables of one vocabulary: trie, scores, byte pieces, and the bytes of every id."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: str = "zipf"):
        used = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
        ranked = zipf_scores(len(used)) if scores == "zipf" else np.array([pieces[i][1] for i in used])
        self.ids = np.array(used, np.int32)
        self.scores = ranked.astype(float)
        self.unknown = float(ranked.min()) - UNKNOWN_PENALTY
        texts = [pieces[i][0] for i in used]
        self.base, self.check, self.value = double_array([t.encode() for t in texts])
        self.longest = max(len(t.encode()) for t in texts)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        self.spelled = [bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"" for t, _, kind in pieces]
        alphabet = set().union(*texts)
        inner = any(MARK in t.lstrip(MARK) for t in texts)
        alone = "".join(c for c in "\n\t\r" if c not in alphabet)
        stop = f" {MARK}{alone}"
        self.chunk = re.compile("(?s:.+)" if inner else f" *[^{stop}]+| +|[{MARK}{alone}]")

    # -------------------------------------------------------------- best paths

    def _spell(self, word: bytes, back: list[tuple[int, int]]) -> bytes:
        out, at = [], len(word)
        while at:
            size, piece = back[at]
            out += [self.ids[piece]] if piece >= 0 else self.byte_ids[np.frombuffer(word, np.uint8)[at - size : at]][::-1].tolist()
            at -= size
        return np.array(out[::-1], np.int32).tobytes()

    def solve_one(self, word: bytes) -> bytes:
        """Ids of the best path as int32 bytes, one place at a time."""
        n, base, check, value, scores = len(word), self.base, self.check, self.value, self.scores
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == -math.inf:
                continue
            width = 1 + (word[s] >= 0xC0) + (word[s] >= 0xE0) + (word[s] >= 0xF0)
            state, single = 0, False
            for d in range(1, min(self.longest, n - s) + 1):
                to = base[state] + word[s + d - 1]
                if check[to] != state:
                    break
                state = to
                if (v := value[state]) >= 0:
                    single |= d == width
                    if (got := best[s] + scores[v]) > best[s + d]:
                        best[s + d], back[s + d] = got, (d, int(v))
            if not single and (got := best[s] + self.unknown) > best[s + width]:
                best[s + width], back[s + width] = got, (width, -1)
        return self._spell(word, back)

    def solve_many(self, words: list[bytes]) -> list[bytes]:
        """The same for words of similar length, all at once."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        n = int(length.max())
        text = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(-1, n)
        best = np.full((len(words), n + 1), -np.inf)
        sizes, picks = np.zeros((len(words), n + 1), np.int32), np.full((len(words), n + 1), -1, np.int32)
        best[:, 0] = 0
        for s in range(n):
            start = np.flatnonzero((best[:, s] > -np.inf) & (length > s))
            lead = text[start, s]
            width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            single, at = np.zeros(len(start), bool), np.arange(len(start))
            state = np.zeros(len(start), np.int32)
            for d in range(1, min(self.longest, n - s) + 1):
                more = length[start[at]] >= s + d
                at, state = at[more], state[more]
                to = self.base[state] + text[start[at], s + d - 1]
                ok = self.check[to] == state
                at, state = at[ok], to[ok]
                if not len(at):
                    break
                v = self.value[state]
                got = np.flatnonzero(v >= 0)
                rows, v = start[at[got]], v[got]
                single[at[got]] |= width[at[got]] == d
                sums = best[rows, s] + self.scores[v]
                up = sums > best[rows, s + d]
                best[rows[up], s + d], sizes[rows[up], s + d], picks[rows[up], s + d] = sums[up], d, v[up]
            bare = np.flatnonzero(~single)
            rows, to = start[bare], s + width[bare]
            up = best[rows, s] + self.unknown > best[rows, to]
            rows, to = rows[up], to[up]
            best[rows, to], sizes[rows, to], picks[rows, to] = best[rows, s] + self.unknown, to - s, -1
        return self._spell_many(words, length, sizes, picks)

    def _spell_many(self, words, length, sizes, picks) -> list[bytes]:
        """Follow the paths of all words back at once; words with byte pieces one by one."""
        n = picks.shape[1] - 1
        ids, filled = np.zeros((len(words), n), np.int32), np.zeros(len(words), np.int64)
        rows, at, in_bytes = np.arange(len(words)), length.copy(), np.zeros(len(words), bool)
        while len(rows):
            pick = picks[rows, at]
            in_bytes[rows[pick < 0]] = True
            filled[rows] += 1
            ids[rows, n - filled[rows]] = self.ids[pick]
            at = at - sizes[rows, at]
            more = at > 0
            rows, at = rows[more], at[more]
        flat = ids[np.arange(n)[None, :] >= (n - filled)[:, None]].tobytes()
        ends = (4 * np.cumsum(filled)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(in_bytes):
            k = int(length[i]) + 1
            out[i] = self._spell(words[i], list(zip(sizes[i, :k].tolist(), picks[i, :k].tolist(), strict=True)))
        return out

    def solve(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of every distinct chunk; a lone marker is spelled in bytes."""
        words = [c.replace(" ", MARK).encode("utf-8", "surrogatepass") for c in chunks]
        order = sorted(range(len(chunks)), key=lambda i: len(words[i]))
        out = {}
        for i in range(0, len(order), GROUP):
            part = order[i : i + GROUP]
            short = [j for j in part if len(words[j]) <= LONG]
            if short:
                out.update(zip([chunks[j] for j in short], self.solve_many([words[j] for j in short]), strict=True))
            out.update((chunks[j], self.solve_one(words[j])) for j in part[len(short) :])
        if MARK in out:
            out[MARK] = self.byte_ids[list(MARK.encode())].tobytes()
        return out

    # ------------------------------------------------------------------- texts

    def encode(self, texts: list[str | None], cache: dict[str, bytes]) -> list[np.ndarray]:
        """Ids of every text; the unseen chunks of about TOGETHER characters are solved at once.

        The cache takes chunks until it is full; frequent ones come early. Later ones
        are solved for the texts at hand only.
        """
        out, at = [], 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size < TOGETHER):
                split.append(self.chunk.findall(" " + texts[at]) if texts[at] else [])
                size += len(texts[at] or "")
                at += 1
            new = set().union(*split).difference(cache)
            known = cache
            if new:
                solved = self.solve(list(new))
                if len(cache) + len(solved) <= CACHE:
                    cache.update(solved)
                else:
                    known = _Either(cache)
                    known.more = solved
            look = known.__getitem__
            out += [np.frombuffer(b"".join(map(look, chunks)), np.int32) for chunks in split]
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.spelled.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


ENCODED = "ids array<int>, n_tokens long, n_byte_tokens long, decoded string"


def encode_texts(spark: SparkSession, docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL, scores: str = "zipf", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``n_byte_tokens`` and, if asked for, ``decoded``.

    ``decoded`` is the text that the ids give back, made in the same pass. Columns of
    these names are replaced. ``scores`` are Zipf log scores by rank, or ``"stored"``:
    the file's own.

    Defined cases: a null text has null ids and no tokens, an empty one no ids; ties
    go to the path found first (earlier start, then shorter piece); texts of any
    length are encoded whole; repeated rows are encoded alike; an empty table stays
    empty.
    """
    shared = spark.sparkContext.broadcast(Pieces(read_pieces(model), scores))  # bounded by the vocabulary

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, cache = shared.value, {}
        is_byte = np.zeros(len(pieces.spelled), bool)
        is_byte[pieces.byte_ids] = True
        for texts in batches:
            texts = texts.tolist()
            got = pieces.encode(texts, cache)
            ids = [None if t is None else x for t, x in zip(texts, got, strict=True)]
            back = [None if x is None or not decoded else pieces.decode(x.tolist()) for x in ids]
            yield pd.DataFrame({"ids": ids, "n_tokens": [len(x) for x in got], "n_byte_tokens": [int(is_byte[x].sum()) for x in got], "decoded": pd.Series(back, dtype=object)})
            del texts, got, ids, back
            pa.default_memory_pool().release_unused()

    held = fresh("encoded", docs)
    names = ["ids", "n_tokens", "n_byte_tokens", *["decoded"] * decoded]
    rest = [c for c in docs.columns if c.lower() not in names]
    return docs.withColumn(held, run(F.col(text))).select(*rest, *(f"{held}.{n}" for n in names))


def decode_ids(spark: SparkSession, encoded: DataFrame, ids: str = "ids", out: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with the text of each id list in column ``out`` (null ids: null)."""
    shared = spark.sparkContext.broadcast(Pieces(read_pieces(model)))

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(x.tolist()) for x in lists], dtype=object)

    return encoded.withColumn(out, run(F.col(ids)))
