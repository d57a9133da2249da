"""Collocations: phrases of two and three words, counted on one FM-index a shard.

A shard is some millions of words of one language from one task's rows. Its index is the
Burrows-Wheeler transform of the word ids, forwards (the word before each suffix) and
backwards (the word after each reversed prefix), over orders of limited depth, which is all
that phrases of limited length need. The index is written once and read twice: extending the
intervals of single words to the left gives every phrase of two words, and extending the
synchronised backward intervals to the right every phrase of three. Counts add up across
shards by key.

What is extended is kept small by filters of a fixed size that never lose a candidate: words,
and then pairs, that reach the least count. A filter may let others through; they are
counted too and fall out at the end, so filters decide how much is shuffled, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

#: Words of a shard, at most (a piece of text stays whole), and bits of a filter: 8 MB.
SHARD_WORDS, FILTER_BITS = 2_000_000, 1 << 26
#: Bits of a cell's place in its bucket; a cell has 32.
CELL_BITS = 22


# ------------------------------------------------------------------ one shard


def transforms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of word ids from 1, with 0 between and around pieces.

    Rows of ``before`` are the suffixes in order of their first two words, rows of ``after`` the
    reversed prefixes in order of their last two; an entry is the word that comes before, or
    after. Both have all suffixes of a word in one interval, at the same rows.
    """
    base = int(words.max(initial=0)) + 1
    at = np.flatnonzero(words)
    word, previous, following = words[at].astype(np.int64), words[at - 1], words[at + 1]
    before = previous[np.argsort(word * base + following)]
    after = following[np.argsort(word * base + previous)]
    return before.astype(np.int32), after.astype(np.int32)


def pairs(before: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count, row): every pair of words, by extending each word's interval to the left.

    ``starts`` are the first rows of the words, and the end. ``row`` is the first row of the
    pair in the backward order: words that come before in the interval shift it.
    """
    second = np.repeat(np.arange(1, len(starts)), np.diff(starts))
    key = np.sort(second.astype(np.int64) * len(starts) + before)
    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[run, len(key)])
    first, second = key[run] % len(starts), key[run] // len(starts)
    real = first > 0
    return first[real], second[real], count[real], run[real]


def extended(after: np.ndarray, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, third, count): the words that follow each backward interval, and how often."""
    which = np.repeat(np.arange(len(row)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(row, count)
    base = int(after.max(initial=0)) + 1
    key = np.sort(which.astype(np.int64) * base + after[place])
    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    which, third, count = key[run] // base, key[run] % base, np.diff(np.r_[run, len(key)])
    real = third > 0
    return which[real], third[real], count[real]


_BYTES = np.arange(256, dtype=np.uint8)
_CUTS = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_CUTS & ~np.isin(_BYTES, np.frombuffer(b" \t", np.uint8))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def tokens(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of texts, A-Z lower-cased, and for each whether a piece begins with it.

    Bytes that part words and pieces are ASCII, so that texts are cut as bytes.
    """
    data = np.frombuffer("\n".join(texts.to_pylist()).encode(), np.uint8)
    inside = np.r_[False, _WORD[data], False]
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside[1:-1]]]))
    piece = np.cumsum(_CUTS[data])[starts] if len(starts) else starts
    return words, np.r_[True, piece[1:] != piece[:-1]][: len(starts)]


def index_row(parts: list[tuple[pa.StringArray, np.ndarray]]) -> tuple:
    """(words, counts, before, after) of the words of one language; ids follow the order of first occurrence."""
    coded = pa.chunked_array([w for w, _ in parts]).combine_chunks().dictionary_encode()
    begins = np.concatenate([b for _, b in parts])
    codes = coded.indices.to_numpy()
    ids = np.zeros(len(codes) + int(begins.sum()) + 1, dtype=np.int32)
    ids[np.arange(len(codes)) + np.cumsum(begins)] = codes + 1
    return coded.dictionary.cast(pa.string()), np.bincount(codes, minlength=len(coded.dictionary)), *transforms(ids)


_INDEX = "lang string, words array<string>, counts array<bigint>, before array<int>, after array<int>"


def _index_rows(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    open_, pending = {}, 0

    def close() -> Iterator[pa.RecordBatch]:
        for lang, parts in sorted(open_.items()):
            words, counts, before, after = index_row(parts)
            lists = [pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words), *(pa.array([v], pa.list_(t)) for v, t in ((counts, pa.int64()), (before, pa.int32()), (after, pa.int32())))]
            yield pa.RecordBatch.from_arrays(lists, ["lang", "words", "counts", "before", "after"])
        open_.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            langs, texts = batch.column(0).slice(start, 256), batch.column(1).slice(start, 256)
            for lang in pc.unique(langs).to_pylist():
                words, begins = tokens(texts.filter(pc.equal(langs, lang)))
                if len(words):
                    open_.setdefault(lang, []).append((words, begins))
                    pending += len(words)
            if pending >= shard_words:
                yield from close()
                pending = 0
    yield from close()


# --------------------------------------------------------------- all shards


def _bits(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A filter of keys modulo ``bits``, a power of two: ``bits / 8`` bytes, however many keys there are."""
    at = F.pmod(F.col(key), F.lit(bits))
    return _collected(keys.select(F.shiftright(at, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")), bits)


def _collected(words: DataFrame, bits: int) -> np.ndarray:
    """The filter of (w, b), 64 bits each, that tasks have found."""
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def _has(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.uint64) & np.uint64(len(filter_) * 64 - 1)
    return (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _cells(*keys: np.ndarray) -> np.ndarray:
    """32 bits for each phrase of word keys; phrases that share a cell are counted together, so that none is undercounted."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        mixed = (mixed ^ key.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def packed(cells: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of cells and their counts: sorted, as differences of three bytes, with a count of one byte.

    Bytes of a kind stand together, so that Spark's compression of shuffles leaves about two
    a cell. Larger counts take several entries.
    """
    many = -(-counts // 255)
    cells, counts = np.repeat(cells, many), np.minimum(np.repeat(counts, many) - 255 * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)), 255)
    order = np.argsort(cells)
    cells, counts = cells[order], counts[order].astype(np.uint8)
    cuts = np.r_[0, np.flatnonzero(np.diff(cells >> CELL_BITS)) + 1, len(cells)]
    for low, high in zip(cuts[:-1], cuts[1:]):
        if high > low:
            steps = np.diff(cells[low:high] & np.uint32((1 << CELL_BITS) - 1), prepend=np.uint32(0)).astype("<u4")
            yield int(cells[low] >> CELL_BITS), steps.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes() + counts[low:high].tobytes()


class Bucket:
    """The counts of one bucket's cells: a list while they are few, then an array of 32 MB."""

    MANY = 1 << 20

    def __init__(self):
        self.total, self.parts, self.size = None, [], 0

    def add(self, data: bytes) -> None:
        """Add what ``packed`` has made of a shard's cells."""
        planes = np.frombuffer(data, np.uint8).reshape(4, -1).astype(np.int64)
        self.parts.append((np.cumsum(planes[0] + (planes[1] << 8) + (planes[2] << 16)), planes[3]))
        self.size += planes.shape[1]
        if self.size >= self.MANY:
            self._fold()

    def _fold(self) -> None:
        self.total = np.zeros(1 << CELL_BITS, np.int64) if self.total is None else self.total
        for at, n in self.parts:
            np.add.at(self.total, at, n)
        self.parts, self.size = [], 0

    def reaching(self, least: int) -> np.ndarray:
        """The cells that add up to ``least``."""
        if self.total is not None:
            self._fold()
            return np.flatnonzero(self.total >= least)
        at, place = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
        return at[np.bincount(place, np.concatenate([n for _, n in self.parts])) >= least]


def _common(shards: DataFrame, columns: list[str], phrases: callable, least: int, bits: int) -> np.ndarray:
    """A filter of the cells whose phrases, ``phrases`` of a shard, add up to the count.

    Each of 1024 buckets of cells is added up as its rows stream by.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(packed(*phrases(batch, i)))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in found], pa.int32()), "data": pa.array([d for _, d in found], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, Bucket()

        def words() -> pa.RecordBatch:
            at = ((now << CELL_BITS) + cells.reaching(least)) & (bits - 1)
            held, place = np.unique(at >> 6, return_inverse=True)
            out = np.zeros(len(held), np.uint64)
            np.bitwise_or.at(out, place, np.uint64(1) << (at & 63).astype(np.uint64))
            return pa.RecordBatch.from_pydict({"w": pa.array(held, pa.int32()), "b": pa.array(out.view(np.int64))})

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now:
                    if now is not None:
                        yield words()
                    now, cells = bucket, Bucket()
                cells.add(data)
        if now is not None:
            yield words()

    parts = shards.select(*columns).mapInArrow(send, "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return _collected(parts.mapInArrow(add, "w int, b bigint"), bits)


def _frequent_pairs(batch: pa.RecordBatch, i: int, frequent: np.ndarray) -> tuple:
    """(keys, first, second, count, row) of the pairs of one shard whose words both pass the filter."""
    keys, counts, before = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("keys", "counts", "before"))
    first, second, count, row = pairs(before, np.r_[0, np.cumsum(counts)])
    alive = np.r_[False, _has(frequent, keys)]
    kept = alive[first] & alive[second]
    return keys, first[kept], second[kept], count[kept], row[kept]


def _key(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _all_words(index: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, f), and a seed for which the keys of no two words of any languages agree."""
    each = index.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = materialize(each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")), "words")
    for seed in range(64):
        if words.groupBy(_key(seed, "lang", "word")).count().where("count > 1").isEmpty():
            return words, seed
    raise ValueError("no seed keeps the words apart")


def counted_phrases(docs: DataFrame, least: int = 10, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples) of (lang, text): all words (lang, word, f, key), and the phrases of at
    least that count (k1, k2, f) and (k1, k2, k3, f), by the keys of their words.

    Three filters of ``filter_bits / 8`` bytes go to the tasks, whatever the corpus: one of the
    words that reach the count, one each of the pairs and triples whose cells do. None loses a
    candidate, and what they let through is counted exactly.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    index = materialize(rows.mapInArrow(lambda batches: _index_rows(batches, shard_words), _INDEX), "phrase-index", maxRecordsPerFile=4)
    words, seed = _all_words(index)
    keyed = index.withColumn("keys", F.transform("words", lambda w: _key(seed, "lang", w)))
    words = words.withColumn("key", _key(seed, "lang", "word"))
    frequent = spark.sparkContext.broadcast(_bits(words.where(F.col("f") >= least), "key", filter_bits))

    def two(batch: pa.RecordBatch, i: int) -> tuple:
        keys, first, second, count, _ = _frequent_pairs(batch, i, frequent.value)
        return _cells(keys[first - 1], keys[second - 1]), count

    common = spark.sparkContext.broadcast(_common(keyed, ["keys", "counts", "before"], two, least, filter_bits))

    def kept_pairs(batch: pa.RecordBatch, i: int) -> tuple:
        keys, *found = _frequent_pairs(batch, i, frequent.value)
        kept = _has(common.value, _cells(keys[found[0] - 1], keys[found[1] - 1]))
        return keys, *(v[kept] for v in found)

    def triples(batch: pa.RecordBatch, i: int, found: tuple) -> tuple:
        keys, _, second, count, row = found
        which, third, times = extended(batch.column("after")[i].values.to_numpy(zero_copy_only=False), row, count)
        kept = _has(common.value, _cells(keys[second[which] - 1], keys[third - 1]))
        return which[kept], third[kept], times[kept]

    def three(batch: pa.RecordBatch, i: int) -> tuple:
        keys, first, second, *_ = found = kept_pairs(batch, i)
        which, third, times = triples(batch, i, found)
        return _cells(keys[first[which] - 1], keys[second[which] - 1], keys[third - 1]), times

    long = spark.sparkContext.broadcast(_common(keyed, ["keys", "counts", "before", "after"], three, least, filter_bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, first, second, count, row = kept_pairs(batch, i)
                which, third, times = triples(batch, i, (keys, first, second, count, row))
                kept = _has(long.value, _cells(keys[first[which] - 1], keys[second[which] - 1], keys[third - 1]))
                yield from blocks(keys[first - 1], keys[second - 1], count, which[kept], keys[third[kept] - 1], times[kept])

    sent = keyed.select("keys", "counts", "before", "after").mapInArrow(send, BLOCK)
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    phrases = materialize(dealt.mapInArrow(lambda batches: _summed(batches, least), "k1 bigint, k2 bigint, k3 bigint, f bigint"), "phrases")
    return words, phrases.where("k3 IS NULL").drop("k3"), phrases.where("k3 IS NOT NULL")


#: The pairs of a shard whose cells share a bucket, ``n`` triples of each, and the triples' third words.
BLOCK = "bucket int, k1 array<bigint>, k2 array<bigint>, f2 array<int>, n array<int>, k3 array<bigint>, f3 array<int>"


def blocks(k1: np.ndarray, k2: np.ndarray, f2: np.ndarray, which: np.ndarray, k3: np.ndarray, f3: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCK``: phrases by keys, triples after their pair, ``which`` in order."""
    bucket = _cells(k1, k2) >> CELL_BITS
    order = np.argsort(bucket, kind="stable")
    n = np.bincount(which, minlength=len(k1))
    starts = np.cumsum(n) - n
    held, firsts = np.unique(bucket[order], return_index=True)
    firsts = np.r_[firsts, len(order)]
    at = np.repeat(starts[order], n[order]) + np.arange(n.sum()) - np.repeat(np.cumsum(n[order]) - n[order], n[order])
    ends = np.r_[0, np.cumsum(n[order])][firsts]
    lists = lambda values, cuts, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))
    columns = [
        pa.array(held, pa.int32()), lists(k1[order], firsts, pa.int64()), lists(k2[order], firsts, pa.int64()), lists(f2[order], firsts, pa.int32()), lists(n[order], firsts, pa.int32()),
        lists(k3[at], ends, pa.int64()), lists(f3[at], ends, pa.int32()),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "k1", "k2", "f2", "n", "k3", "f3"])


def _merged(keys: list[np.ndarray], f: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of key columns as one, with the sum of their counts."""
    order = np.lexsort(keys)
    keys, f = [k[order] for k in keys], f[order]
    new = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(f) else np.empty(0, np.int64)
    return [k[new] for k in keys], np.add.reduceat(f, new) if len(new) else f


class Phrases:
    """The counts of one bucket's phrases, of pairs and of triples; what has come is merged whenever it has grown by a million."""

    MANY = 1 << 20

    def __init__(self):
        self.held = {2: ([np.empty(0, np.int64)] * 2, np.empty(0, np.int64)), 3: ([np.empty(0, np.int64)] * 3, np.empty(0, np.int64))}
        self.parts, self.size = {2: [], 3: []}, 0

    def add(self, k1: np.ndarray, k2: np.ndarray, f2: np.ndarray, n: np.ndarray, k3: np.ndarray, f3: np.ndarray) -> None:
        self.parts[2].append(([k1, k2], f2.astype(np.int64)))
        self.parts[3].append(([np.repeat(k1, n), np.repeat(k2, n), k3], f3.astype(np.int64)))
        self.size += len(k1) + len(k3)
        if self.size >= self.MANY:
            self._merge()

    def _merge(self) -> None:
        for size, parts in self.parts.items():
            every = [self.held[size], *parts]
            self.held[size] = _merged([np.concatenate([k[j] for k, _ in every]) for j in range(size)], np.concatenate([f for _, f in every]))
        self.parts, self.size = {2: [], 3: []}, 0

    def reaching(self, least: int) -> Iterator[pa.RecordBatch]:
        self._merge()
        for size, (keys, f) in self.held.items():
            kept = f >= least
            found = [pa.array(k[kept]) for k in keys]
            third = found[2] if size == 3 else pa.nulls(int(kept.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*found[:2], third, pa.array(f[kept])], ["k1", "k2", "k3", "f"])


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases that reach the count, from rows of ``BLOCK`` in order of their buckets."""
    now, phrases = None, Phrases()
    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now:
                if now is not None:
                    yield from phrases.reaching(least)
                now, phrases = bucket, Phrases()
            phrases.add(*(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("k1", "k2", "f2", "n", "k3", "f3")))
    if now is not None:
        yield from phrases.reaching(least)


def _cut(a: str, left: str, right: str, k: int) -> Column:
    """(score, k, l, r) of one cut, in decimals."""
    wide = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    score = F.expr(f"(1000000 * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of (lang, text): the candidates that no longer one covers.

    Everything is per language; a null one is ``und``, a null text empty. ``a`` counts the phrase,
    ``n`` all words. Cut after its first word or words, a phrase has ``l`` and ``r`` occurrences of its
    two parts; the cut with the lowest score floor(1000000 a a / (l r)) counts, on a tie the
    first. A candidate goes where a longer one around it has at least ``covered`` percent of its
    occurrences. Arithmetic is exact: decimals, for counts of up to 16 digits. Repeated rows
    count each; an empty table gives no phrase; texts are whole, of any length, and a piece of
    text is never parted; other columns are not read.
    """
    words, two, three = counted_phrases(docs.select("lang", "text"), least, shard_words, filter_bits)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = materialize(words.where(F.col("f") >= least), "frequent-words")
    word = lambda i: frequent.select(F.col("key").alias(f"k{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))
    pair = lambda i, j: two.select(F.col("k1").alias(f"k{i}"), F.col("k2").alias(f"k{j}"), F.col("f").alias(f"f{i}{j}"))
    inner = three.select("k1", "k2", "f").unionByName(three.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "f"))
    longest = inner.groupBy("k1", "k2").agg(F.max("f").alias("longest"))
    free = two.join(longest, ["k1", "k2"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("f") * covered, F.lit(True)))
    short = free.join(word(1), "k1").join(word(2), "k2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "f", _cut("f", "f1", "f2", 1).alias("cut"))
    parts = three.join(pair(1, 2), ["k1", "k2"]).join(pair(2, 3), ["k2", "k3"]).join(word(1), "k1").join(word(2), "k2").join(word(3), "k3")
    lowest = F.array_min(F.array(_cut("f", "f1", "f23", 1), _cut("f", "f12", "f3", 2)))
    long = parts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "f", lowest.alias("cut"))
    return short.unionByName(long).join(sizes, "lang").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def ranked_collocations(docs: DataFrame, top: int = 2000, **options: int) -> DataFrame:
    """The first ``top`` collocations of each language with their rank: by score and count, falling, then by phrase.

    Parts of a language are ranked first, so that one task never ranks all phrases of one.
    """
    found = collocations(docs, **options)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    parts = best(found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "part")
    return best(parts.drop("rank", "part"), "lang")
