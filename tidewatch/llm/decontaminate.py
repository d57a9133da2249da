"""Benchmark decontamination by a distributed positional inverted index; DataFrame operations only.

1. Corpus frequencies of the benchmark's terms, over all documents.
2. Every window of a benchmark item names its two rarest terms, and every item its
   rarest ones. Neighbouring windows share them, so the index holds far fewer postings
   than tokens: only (term, document, position) of terms that are asked for.
3. Exact phrases: postings meet the places of their term in the items; position less
   place in the item is the offset of an alignment. A window is a candidate of an
   alignment where the lists of both its terms agree on the offset. Candidates are
   compared word for word with the text of their document; other texts are not moved.
4. Proximity: the lists of an item's rarest terms are swept by position.

Terms travel as 64-bit hashes; step 3 compares the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, checked_broadcast, fresh, materialize

#: Characters between words: ASCII but digits and letters. Capitals are lowered after the split.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows up to which a table of benchmark terms, of two or three longs, is broadcast.
BROADCAST_ROWS = 1 << 20


def raw_words(text: Column) -> Column:
    """Words before lowering; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def lowered(words: Column) -> Column:
    return F.transform(words, ascii_lower)


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, key, words) of items that have an id and a word, each distinct item once."""
    words = F.filter(lowered(raw_words(F.col(text))), lambda w: w != "")
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), words.alias("words")).where(F.size("words") > 0)
    return rows.distinct().withColumn("key", F.xxhash64("item", F.array_join("words", " ")))


def _tokens(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    tokens = docs.select(*keep, F.posexplode(raw_words(F.col(text))).alias("at", "word"))
    return tokens.select(*(c for c in tokens.columns if c != "word"), F.xxhash64(ascii_lower(F.col("word"))).alias("term"))


def frequencies_of(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all of ``docs`` of the hashed ``terms(term)``; counted before the shuffle."""
    few = checked_broadcast(terms, BROADCAST_ROWS)
    if few is not terms:
        return _tokens(docs, text).join(few, "term").groupBy("term").agg(F.count("*").alias("n"))
    return _tokens(docs, text).groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def item_terms(items: DataFrame) -> DataFrame:
    """(key, place, word, term) of every word of the items."""
    return items.select("key", F.posexplode("words").alias("place", "word")).withColumn("term", F.xxhash64("word"))


def windows(items: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """(key, start, size, rare, second): windows with the places of their two rarest terms."""
    size = F.least(F.lit(n), F.size("words"))
    starts = items.select("key", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("start"))
    inside = starts.select("key", "start", "size", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("place"))
    known = item_terms(items).join(frequencies, "term", "left").select("key", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    by_rarity = inside.join(known, ["key", "place"]).groupBy("key", "start", "size").agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("t"))
    others = F.filter("t", lambda x: x["term"] != F.col("t")[0]["term"])
    # A window with a term that no document has occurs nowhere.
    return by_rarity.where(F.col("t")[0]["n"] > 0).select("key", "start", "size", F.col("t")[0]["place"].alias("rare"), F.coalesce(F.try_element_at(others, F.lit(1))["place"], F.col("t")[0]["place"]).alias("second"))


class Index:
    """Postings of the terms that the windows and the proximity queries of ``items`` ask for."""

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str, text: str, n: int, terms: int):
        places = item_terms(items)
        wanted = materialize(places.select("term").distinct(), "benchmark-terms")
        frequencies = materialize(frequencies_of(docs, text, wanted), "term-frequencies")
        self.windows = materialize(windows(items, frequencies, n), "windows")
        ends = self.windows.select("key", F.explode(F.array("rare", "second")).alias("place")).distinct()
        self.anchors = materialize(places.select("key", "place", "term").join(ends, ["key", "place"]), "anchors")
        ranked = places.select("key", "word", "term").distinct().join(frequencies, "term")
        rarest = ranked.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word", "term"))), 1, terms).alias("t"))
        self.rare = materialize(rarest.select("key", F.size("t").alias("needed"), F.posexplode("t").alias("slot", "t")).select("key", "needed", "slot", "t.term"), "rare-terms")
        asked = self.anchors.select("term").unionByName(self.rare.select("term")).distinct()
        found = _tokens(docs.where(F.col(doc_id).isNotNull()), text, F.col(doc_id).alias("doc"))
        self.postings = materialize(found.join(checked_broadcast(asked, BROADCAST_ROWS), "term"), "postings")


def candidates(index: Index) -> DataFrame:
    """(doc, key, start, size, offset): windows both of whose rarest terms stand where the alignment asks for them."""
    met = index.postings.join(checked_broadcast(index.anchors, BROADCAST_ROWS), "term")
    hits = materialize(met.select("doc", "key", (F.col("at") - F.col("place")).alias("offset"), "place").distinct(), "alignments")
    asked = hits.withColumnRenamed("place", "rare").join(checked_broadcast(index.windows, BROADCAST_ROWS), ["key", "rare"])
    inside = asked.where(F.col("offset") + F.col("start") >= 0)
    return inside.join(hits.withColumnRenamed("place", "second"), ["doc", "key", "offset", "second"], "left_semi").select("doc", "key", "start", "size", "offset")


def _copy(text: str) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def verified(docs: DataFrame, items: DataFrame, found: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc, copy, item, at, size): the candidates that agree word for word. Only texts with a candidate are moved."""
    found = materialize(found, "candidates")
    by_doc = found.groupBy("doc").agg(F.collect_set(F.struct("key", "start", "size", "offset")).alias("asked"))
    some = docs.select(F.col(doc_id).alias("doc"), _copy(text).alias("copy"), F.col(text).alias("body")).join(checked_broadcast(found.select("doc").distinct(), BROADCAST_ROWS), "doc", "left_semi")
    texts = some.join(by_doc, "doc").select("doc", "copy", "asked", lowered(raw_words(F.col("body"))).alias("held"))
    first_empty = F.when(F.col("held")[0] == "", 1).otherwise(0)

    def cut(w: Column) -> Column:
        at = w["offset"] + w["start"]
        return F.struct(w["key"].alias("key"), w["start"].alias("start"), (at - first_empty).cast("int").alias("at"), F.slice(F.col("held"), at + 1, w["size"]).alias("phrase"))

    cuts = texts.select("doc", "copy", F.explode(F.transform("asked", cut)).alias("w")).select("doc", "copy", "w.*")
    size = F.least(F.lit(n), F.size("words"))
    starts = items.select("key", "item", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("start"))
    phrases = starts.select("key", "item", "start", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("phrase"))
    return cuts.join(phrases, ["key", "start", "phrase"]).select("doc", "copy", "item", "at", "size")


def near_places(index: Index, items: DataFrame, slop: int, terms: int) -> DataFrame:
    """(doc, item, at, end): see ``proximity_matches``."""
    met = index.postings.join(checked_broadcast(index.rare, BROADCAST_ROWS), "term")
    so_far = "(PARTITION BY doc, key ORDER BY at, slot ROWS UNBOUNDED PRECEDING)"
    lasts = [F.expr(f"max(CASE WHEN slot = {i} THEN at END) OVER {so_far}").alias(f"last{i}") for i in range(terms)]
    seen = met.select("doc", "key", "at", "needed", *lasts)
    latest = F.array(*(F.when(F.col("needed") > i, F.coalesce(f"last{i}", F.lit(-slop - 1))) for i in range(terms)))
    starts = seen.select("doc", "key", F.array_min(F.filter(latest, lambda x: x.isNotNull())).alias("at"), F.col("at").alias("end"))
    near = starts.where((F.col("at") >= 0) & (F.col("end") - F.col("at") < slop)).join(items.select("key", "item"), "key")
    return near.select("doc", "item", "at", "end").distinct()


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, terms: int = 3, slop: int = 20) -> tuple[DataFrame, DataFrame]:
    """Exact phrases (doc, copy, item, at, size) and places of proximity (doc, item, at, end), from one index."""
    texts = materialize(item_words(items, item_id, item_text), "benchmark-items")
    index = Index(docs, texts, doc_id, text, n, terms)
    return verified(docs, texts, candidates(index), doc_id, text, n), near_places(index, texts, slop, terms)


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, terms: int = 3, slop: int = 20) -> DataFrame:
    """``docs`` with ``n_words``, ``matches`` and ``near``.

    ``matches`` is an array of (item, at, size), exact windows of ``n`` item words; ``at``
    counts words of the document from 0. An item of fewer than ``n`` words is one window.
    ``near`` are the items whose ``terms`` rarest terms lie within ``slop`` words of the
    document, in any order (``proximity_matches`` has the places). Columns of these names
    are replaced.

    Defined cases: null and empty texts have no words and no matches; texts of any length
    are compared whole; items without id or words are ignored; repeated items count once;
    of terms as rare as each other the first by spelling is taken; a row without id is
    never matched; rows that repeat an id are each compared with their own text (``near``
    is that of all of them); an empty benchmark matches nothing.
    """
    exact, near = search(docs, items, doc_id, text, item_id, item_text, n, terms, slop)
    doc, copy, near_doc = fresh("matched_doc", docs), fresh("matched_copy", docs), fresh("near_doc", docs)
    by_doc = exact.groupBy(F.col("doc").alias(doc), F.col("copy").alias(copy)).agg(F.collect_set(F.struct("item", "at", "size")).alias("matches"))
    by_near = near.groupBy(F.col("doc").alias(near_doc)).agg(F.collect_set("item").alias("near"))
    by_doc, by_near = materialize(by_doc, "matches"), materialize(by_near, "near")
    words = raw_words(F.col(text))
    count = F.size(words) - F.when(words[0] == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "matches", "near")]
    own, counted = fresh("own_copy", docs), fresh("counted_words", docs)
    left = docs.select(*rest, _copy(text).alias(own), count.cast("long").alias(counted))
    joined = left.join(by_doc, (left[doc_id] == F.col(doc)) & (left[own] == F.col(copy)), "left").join(by_near, left[doc_id] == F.col(near_doc), "left")
    none = lambda c, df: F.coalesce(c, F.array().cast(dict(df.dtypes)[c])).alias(c)
    return joined.select(*(left[c] for c in rest), F.col(counted).alias("n_words"), none("matches", by_doc), none("near", by_near))


def words_hit(matches: Column) -> Column:
    """Words inside any match: the length of the union of the matched intervals."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["at"].alias("at"), (m["at"] + m["size"]).alias("end"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["at"]))).cast("long").alias("n"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def proximity_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", terms: int = 3, slop: int = 20) -> DataFrame:
    """(doc, item, at, end): places where the ``terms`` rarest terms of an item lie within ``slop`` words, in any order.

    One row for each last word of such a place; ``at`` is the latest start. Terms that no
    document has are not asked for; items with fewer distinct terms ask for those they
    have. Postings of the rare terms only.

    Defined cases: null and empty texts have no words; items without id or words are
    ignored; a row without id is never matched; rows that repeat an id are one document;
    an empty benchmark or corpus gives an empty table.
    """
    texts = materialize(item_words(items, item_id, item_text), "benchmark-items")
    return near_places(Index(docs, texts, doc_id, text, 10, terms), texts, slop, terms)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, with the columns of ``docs``.

    Defined cases are those of ``phrase_matches``; rows without an id stay.
    """
    exact, _ = search(docs, items, doc_id, text, **options)
    hit = materialize(exact.select("doc", "copy").distinct(), "contaminated")
    return docs.join(checked_broadcast(hit, BROADCAST_ROWS), (docs[doc_id] == hit["doc"]) & (_copy(text) == hit["copy"]), "left_anti")
