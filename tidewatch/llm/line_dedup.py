"""Drop lines that many documents share, through sharded minimal perfect hashes.

1. Every document yields the 128-bit hashes of its distinct line keys; the different
   documents of each are counted, partially before the shuffle.
2. All distinct hashes go to shards. Each shard is one row: a minimal perfect hash
   (bit levels with ranks), and the arrays it indexes - 64-bit fingerprints, document
   counts, last document.
3. Documents send bare hashes, not lines, to the shards and probe the arrays in a
   stream: a line goes where its fingerprint agrees, its count reaches the threshold
   and a later document holds it. Rows are dealt by (shard, salt) and sorted so that a
   shard's arrays come first. Memory is one shard and one batch; a shard has as many
   salts as its counts ask for, so a line that a third of all rows holds is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checked_broadcast, fresh, materialize

STRIPPED = b" \t\n\x0b\x0c\r"
#: Bits of a level for each key that is left, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 24
#: Keys of a shard, and rows that probe one copy of it; a shard has SALTS copies at least.
KEYS_PER_SHARD, PROBES_PER_COPY, SALTS = 1 << 18, 1 << 22, 8


def line_key(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass").strip(STRIPPED).lower()


def hash_key(key: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of the key's hash: place and fingerprint."""
    h = xxhash.xxh3_128_intdigest(key)
    lo, hi = h & (2**64 - 1), h >> 64
    return lo - (lo >> 63 << 64), hi - (hi >> 63 << 64)


def countable(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars


def key_hashes(text: str | None, min_chars: int) -> set[tuple[int, int]]:
    keys = {line_key(x) for x in (text or "").split("\n")}
    return {hash_key(k) for k in keys if countable(k, min_chars)}


# ------------------------------------------------------- minimal perfect hash


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def build_mph(hashes: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash over distinct uint64 ``hashes``.

    A key whose place in a level no other key takes sets that bit; the others go
    on to the next, smaller level. A key's slot is the number of set bits before
    its own. What is left after the last level is listed, sorted.
    """
    levels, left = [], hashes
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(len(left) * GAMMA) + 63 & ~63)
        at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[at]]
    return [*levels, np.sort(left)]


class Mph:
    def __init__(self, levels: list[np.ndarray]):
        self.rest = levels[-1]
        self.levels, base = [], 0
        for bits in levels[:-1]:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.levels.append((bits, base + np.concatenate(([0], ones[:-1]))))
            base += int(ones[-1])
        self.base = base

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or any slot, for what is not a key."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, ranks) in enumerate(self.levels):
            if not len(todo):
                return out
            at = (_mix(h[todo], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit & 1).astype(bool)
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[todo[hit]] = (ranks[at >> 3] + below)[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[todo]), len(self.rest) - 1)
            hit = self.rest[at] == h[todo]
            out[todo[hit]] = self.base + at[hit]
        return out


def pack(levels: list[np.ndarray]) -> bytes:
    sizes = np.array([len(levels), *(x.nbytes for x in levels)], np.int64)
    return sizes.tobytes() + b"".join(x.tobytes() for x in levels)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, np.int64, n, 8))
    parts = [data[e - s : e] for e, s in zip(ends, np.frombuffer(data, np.int64, n, 8), strict=True)]
    return [np.frombuffer(p, np.uint8) for p in parts[:-1]] + [np.frombuffer(parts[-1], np.uint64)]


_ROW = np.dtype([("h1", "<u8"), ("h2", "<i8"), ("n", "<i8"), ("last", "<i8")])


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One index row from the (h1, h2, n, last) rows of a shard; of keys with the same h1 all but one are listed in ``rest``."""
    rows = np.zeros(len(pdf), _ROW)
    for name in _ROW.names:
        rows[name] = pdf[name].to_numpy(np.int64).view(np.uint64) if name == "h1" else pdf[name].to_numpy(np.int64)
    h, first = np.unique(rows["h1"], return_index=True)
    levels = build_mph(h)
    slot, one = Mph(levels).slots(h), rows[first]
    arrays = []
    for name, kind in (("h2", np.int64), ("n", np.int64), ("last", np.int64)):
        out = np.zeros(len(h), kind)
        out[slot] = one[name]
        arrays.append(out.tobytes())
    rest = np.delete(rows, first).tobytes()
    return pd.DataFrame([[int(pdf["shard"].iloc[0]), pack(levels), *arrays, rest]], columns=["shard", *PARTS])


PARTS = ("mph", "prints", "counts", "lasts", "rest")
INDEX = "shard int, " + ", ".join(f"{p} binary" for p in PARTS)


class Shard:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, mph: bytes, prints: bytes, counts: bytes, lasts: bytes, rest: bytes):
        self.mph = Mph(unpack(mph))
        self.prints, self.counts, self.lasts = (np.frombuffer(x, np.int64) for x in (prints, counts, lasts))
        self.rest = {(int(r["h1"]), int(r["h2"])): (int(r["n"]), int(r["last"])) for r in np.frombuffer(rest, _ROW)}

    def look_up(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each key, and the last of them; 0 for a key that is not in the shard."""
        slot = self.mph.slots(h1)
        count, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        hit = slot >= 0
        hit[hit] = self.prints[slot[hit]] == h2[hit]
        count[hit], last[hit] = self.counts[slot[hit]], self.lasts[slot[hit]]
        if self.rest:
            for i in np.flatnonzero(~hit):
                count[i], last[i] = self.rest.get((int(h1[i]), int(h2[i])), (0, 0))
        return count, last


# ------------------------------------------------------------------ the stages


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc) for the distinct countable line keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids = [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in key_hashes(body, min_chars):
                    h1.append(a)
                    h2.append(b)
                    ids.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, ids)], ["h1", "h2", "doc"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc long")


def counted_lines(hashes: DataFrame) -> DataFrame:
    """(h1, h2, n, last) of all distinct line hashes: different documents that hold each, and the largest id."""
    return hashes.where("doc IS NOT NULL").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))


def build_index(lines: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, DataFrame, int]:
    """The index table, one row a shard; the shards with more than the usual copies; the number of shards."""
    shards = max(32, -(-lines.count() // keys_per_shard))
    dealt = lines.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int"))
    copies = F.ceil(F.sum("n") / PROBES_PER_COPY).cast("int")
    many = dealt.groupBy("shard").agg(copies.alias("salts")).where(F.col("salts") > SALTS)
    index = dealt.select("shard", "h1", "h2", "n", "last").groupBy("shard").applyInPandas(build_shard, INDEX)
    return materialize(index, "line-index"), materialize(many, "wide-shards"), shards


def prober(min_docs: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (shard, salt, arrays first): the arrays, then hashes to look up."""
        shard, index = None, None
        for batch in batches:
            at = batch.column("shard").to_numpy()
            salt = batch.column("salt").to_numpy()
            is_index = batch.column("mph").is_valid().to_numpy(zero_copy_only=False)
            h1 = batch.column("h1").fill_null(0).to_numpy().view(np.uint64)
            h2 = batch.column("h2").fill_null(0).to_numpy()
            doc = batch.column("doc").fill_null(0).to_numpy()
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(salt) != 0) | is_index[1:] | is_index[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if lo == hi:
                    continue
                if is_index[lo]:
                    shard, index = int(at[lo]), Shard(*(batch.column(k)[int(lo)].as_py() for k in PARTS))
                elif index is not None and shard == at[lo]:
                    count, last = index.look_up(h1[lo:hi], h2[lo:hi])
                    lost = (count >= min_docs) & (last > doc[lo:hi])
                    if lost.any():
                        yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][lost]), pa.array(h1[lo:hi][lost].view(np.int64)), pa.array(h2[lo:hi][lost])], ["doc", "h1", "h2"])

    return probe


def dropped_lines(hashes: DataFrame, index: DataFrame, many: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(doc, h1, h2) of the line keys that a document loses."""
    empty = {k: F.lit(None).cast("binary").alias(k) for k in PARTS}
    wide = checked_broadcast(many, 1 << 20)  # a wide shard stands for SALTS * PROBES_PER_COPY rows at least
    salts = F.coalesce("salts", F.lit(SALTS))
    asked = hashes.where("doc IS NOT NULL").withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).join(wide, "shard", "left")
    probes = asked.select("shard", F.pmod(F.xxhash64("doc"), salts).cast("int").alias("salt"), *empty.values(), "h1", "h2", "doc")
    copies = index.join(wide, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *empty, *(F.lit(None).cast("long").alias(k) for k in ("h1", "h2", "doc")))
    rows = probes.unionByName(copies).repartition("shard", "salt")
    return rows.sortWithinPartitions("shard", "salt", F.col("mph").isNull()).mapInArrow(prober(min_docs), "doc long, h1 long, h2 long")


def _cut(text: str | None, lost, min_chars: int) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if lost is None or not len(lost):
        return len(lines), 0, text or ""
    gone, kept = {(int(a), int(b)) for a, b in lost}, []
    for line in lines:
        key = line_key(line)
        if not (countable(key, min_chars) and hash_key(key) in gone):
            kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with columns ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A line's key is the line stripped of ASCII white space, with A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose
    all their lines but those of the largest document id that holds them. Columns
    of ``docs`` with the names of the added ones are replaced; other columns stay.

    Defined cases: a null or empty text is one empty line; texts and lines of any length
    are read whole; a text that loses all its lines becomes empty; lines that tie are equal and go alike; a row without an id
    does not count and is left whole; rows that repeat an id are one document, and each
    of them is cut; an empty table stays empty.
    """
    hashes = line_hashes(docs, doc_id, text, min_chars)
    index, many, shards = build_index(materialize(counted_lines(hashes), "distinct-lines"))
    lost = fresh("lost_lines", docs)
    key = fresh("lost_doc", docs)
    found = dropped_lines(hashes, index, many, shards, min_docs).groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.array("h1", "h2")).alias(lost))
    cut = fresh("cut_lines", docs)

    @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
    def cut_text(texts: pd.Series, losses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, g, min_chars) for t, g in zip(texts, losses, strict=True)], columns=["n_lines", "n_dropped", "kept_text"])

    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    joined = docs.join(found, docs[doc_id].cast("long") == F.col(key), "left").withColumn(cut, cut_text(F.col(text), F.col(lost)))
    return joined.select(*rest, f"{cut}.n_lines", f"{cut}.n_dropped", f"{cut}.kept_text")
