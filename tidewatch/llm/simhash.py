"""SimHash near-duplicates by an index on the bytes of the fingerprint.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of
their 8 bytes, so they share at least 4 bytes at the same places. Single bytes
are poor index keys (256 values), so postings are kept for triples of places: the
20 triples below meet every set of 4 places, hence each such pair shares at least
one posting list. In a list the shared positional bytes of a pair are tallied,
pairs under the guaranteed 4 are left, and the rest is verified bit by bit. The
pairs that pass are those that a tally over eight lists of single bytes would pass:
a pair with four shared bytes or more is in a list of some triple, and in every list
the tally counts all eight places, not only those of the list.

Copies collapse to one fingerprint first. A list gives a spanning forest of its
links, never all its pairs; long lists are dealt out as pairs of blocks. Classes
are then merged by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checked_broadcast, discard, materialize

BITS, PLACES = 64, 8
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Triples within one group of places, or with two places in a group and one in the next.
TRIPLES = tuple(
    t
    for t in combinations(range(PLACES), 3)
    if any(sum(p in g for p in t) == 3 or (sum(p in g for p in t) == 2 and sum(p in n for p in t) == 1) for g, n in zip(_GROUPS, _GROUPS[1:] + _GROUPS[:1], strict=True))
)
#: Fingerprints of a list that are compared within one cell.
BLOCK = 8192
#: Runs up to this length are compared by shifting whole batches.
SHORT = 32


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n, k = b" ".join(words), len(words), words_per_shingle
    if n <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, total, ones = xxhash.xxh64_intdigest, n - k + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, 65536):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """(doc, copy, fp) with the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).cast("long").alias("doc"), _copy(text).alias("copy"), simhash(F.col(text)).alias("fp"))


def _copy(text: str) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def postings(prints: DataFrame) -> DataFrame:
    """(key, fp): a row for each triple of places, keyed by triple and its three bytes."""
    byte = [F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(PLACES)]
    keys = [F.lit(i << 24) + byte[a] * 65536 + byte[b] * 256 + byte[c] for i, (a, b, c) in enumerate(TRIPLES)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def cells(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """Posting lists with a pair, dealt to cells (key, a, b) of at most two blocks."""
    size = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = index.join(size, "key").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.select("key", "fp", "own", other.alias("other")).select("key", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _links(x: np.ndarray, max_bits: int, min_bytes: int) -> np.ndarray:
    """Which XORs stand for linked pairs: enough equal bytes, then few enough bits."""
    near = (x.view(np.uint8).reshape(-1, PLACES) == 0).sum(axis=1) >= min_bytes
    near[near] = np.bitwise_count(x[near]) <= max_bits
    return near


class _Forest:
    """Union-find over the few fingerprints that have a link."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def root(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = self.up.get(b, b)
            a = b
        return a


def _short_runs(run: np.ndarray, fp: np.ndarray, longest: int, max_bits: int, min_bytes: int) -> list[tuple[int, int]]:
    found = []
    for d in range(1, longest):
        same = np.flatnonzero(run[d:] == run[:-d])
        if not len(same):
            break
        hit = same[_links(fp[same] ^ fp[same + d], max_bits, min_bytes)]
        found += zip(fp[hit].tolist(), fp[hit + d].tolist(), strict=True)
    forest = _Forest()
    return [p for p in found if forest.join(*p)]


def _long_run(fp: np.ndarray, max_bits: int, min_bytes: int) -> list[tuple[int, int]]:
    """Breadth-first: each fingerprint is compared once with all not yet reached."""
    left, edges, queue = fp, [], []
    while len(left) or queue:
        if not queue:
            if len(left) < 2:
                break
            queue, left = [left[0]], left[1:]
        a = queue.pop()
        if len(left):
            near = _links(left ^ a, max_bits, min_bytes)
            if near.any():
                got = left[near]
                edges += [(int(a), int(b)) for b in got]
                queue += list(got)
                left = left[~near]
    return edges


def spanning_links(max_bits: int, min_bytes: int):
    """Edges that span the linked fingerprints of each cell; rows come sorted by cell."""

    def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        ends = np.append(starts[1:], len(fp))
        length, edges = ends - starts, []
        run = np.repeat(np.arange(len(starts)), length)
        short = (length > 1) & (length <= SHORT)
        if short.any():
            keep = short[run]
            edges += _short_runs(run[keep], fp[keep], int(length[short].max()), max_bits, min_bytes)
        for i in np.flatnonzero(length > SHORT):
            edges += _long_run(np.unique(fp[starts[i] : ends[i]]), max_bits, min_bytes)
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")], axis=1)))
            fp = np.concatenate((fp, batch.column("fp").to_numpy().view(np.uint64)))
            open_from = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if open_from:
                yield emit(key[:open_from], fp[:open_from])
                key, fp = key[open_from:], fp[open_from:]
        if len(fp):
            yield emit(key, fp)

    return run


def links(prints: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that span every class of distinct fingerprints ``prints(fp)``."""
    rows = cells(postings(prints), block).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return rows.mapInArrow(spanning_links(max_bits, PLACES - max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the least node reached.

    Large-star and small-star steps alternate until the edges are stars. Each round
    is written to the shared folder; only two numbers reach the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        down = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, materialize(down.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = now


def grouped(docs: DataFrame, doc_id: str, text: str, max_bits: int, words_per_shingle: int, block: int) -> DataFrame:
    """(doc, copy, fp, component_id): one row for each row of ``docs``."""
    if not 0 <= max_bits <= PLACES - 4:
        raise ValueError("the index on triples of bytes guarantees hits up to 4 bits")
    prints = materialize(fingerprints(docs, doc_id, text, words_per_shingle), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), max_bits, block))
    named = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 4, words_per_shingle: int = 4, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    ``fp`` is the fingerprint as 16 hex digits, ``component_id`` the smallest
    document id that links of at most ``max_bits`` differing bits reach.

    Defined cases: null and empty texts have fingerprint zero and link like others;
    a text of fewer words than a shingle is one shingle; a row without an id takes
    part but is never a component's name (null if there is no other); repeated rows
    stay; an empty table gives an empty table; extra columns are ignored.
    """
    groups = grouped(docs, doc_id, text, max_bits, words_per_shingle, block)
    return groups.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 4) -> DataFrame:
    """``docs`` without the documents that are not the first of their group.

    Defined cases: of texts that tie, the smallest id stays; rows are told apart by id and
    text, so of rows that repeat an id only those go whose own text repeats an earlier
    document; rows without an id stay, whatever they repeat; an empty table stays empty.
    """
    groups = grouped(docs, doc_id, text, max_bits, 4, BLOCK).where("component_id < doc")
    later = materialize(groups.select("doc", "copy").distinct(), "later-copies")
    return docs.join(checked_broadcast(later, 1 << 20), (docs[doc_id].cast("long") == later["doc"]) & (_copy(text) == later["copy"]), "left_anti")
