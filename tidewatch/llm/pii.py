"""Personal data: fixed patterns, then terms that reveal what the patterns protect.

The patterns give protected entities (an e-mail address, an IP address, a card or a
phone number), and each of them the class it belongs to (the domain, the subnet, the
issuer, the country code), which is protected as well: a value found once can still be
narrowed down by a term that always goes with its class. From the corpus the operator
estimates how strongly a term in a text reveals an entity of that text: pointwise mutual
information over the entity's own information content, log(N n_et / (n_e n_t)) /
log(N / n_e), which is 1 for a term that is only ever found with the entity. All four are
numbers of different texts: exact copies count once, and so do near copies among the
texts that hold an entity (five-word shingles, banded min-hashes). For n_et the lower bound of
its 95 % interval is taken, so that a few chance meetings do not pass for knowledge.
Terms over the disclosure threshold, found with the entity in enough different texts,
are generalised or removed wherever they stand in a text that holds the entity.

Texts go through Python twice: once for the patterns, once to count terms. The terms of
texts that hold an entity, and of those that have copies, are shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checked_broadcast, materialize
from tidewatch.llm.simhash import components

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so runs are entered once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_COUNTRY = re.compile(r"\+([0-9]{1,3})[^0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL_END.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> int:
    """Signed 64-bit name of an entity: its kind and its value in normal form."""
    normal = value.lower() if kind < 2 else _digits(value)
    h = xxhash.xxh64_intdigest(f"{kind}:{normal}")
    return h - (h >> 63 << 64)


def entity_class(kind: int, value: str) -> str | None:
    """The class of an entity: domain, first three parts of an IP, six digits of a card, country code (None: not told apart)."""
    if kind == 0:
        return value.rpartition("@")[2].lower()
    if kind == 1:
        return ".".join(p.lstrip("0") for p in value.split(".")[:3])
    if kind == 2:
        return _digits(value)[:6]
    code = _COUNTRY.match(value)
    return code[1] if code else None


def names_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """Sorted names of the different entities of a text and of their classes."""
    out = set()
    for kind, a, b in spans:
        out.add(entity(kind, text[a:b]))
        if group := entity_class(kind, text[a:b]):
            h = xxhash.xxh64_intdigest(f"{kind} class:{group}")
            out.add(h - (h >> 63 << 64))
    return sorted(out)


def union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, sorted."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _lower(term: str) -> str:
    return term if term.islower() else term.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def places(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all terms of a lower-case text that touch none of its ``spans``."""
    starts, ends = union(spans)
    for m in _TERM.finditer(text):
        before = bisect.bisect_left(starts, m.end()) - 1  # the last span that starts before the term's end
        if before < 0 or ends[before] <= m.start():
            yield m[0], m.start(), m.end()


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Lower-case terms of three characters or more, with a letter, that stand outside of the spans."""
    return {t for t, _, _ in places(_lower(text), spans) if len(t) > 2 and any(c.isalpha() for c in t)}


#: One-sided 95 % of the normal law.
SIGMAS = 1.645
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<kind:int,start:int,end:int>>"


def _copy(text: str) -> Column:
    """Name of a text, the same for all of its copies."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy")


def _tuples(spans: list[dict]) -> list[tuple[int, int, int]]:
    return [(s["kind"], s["start"], s["end"]) for s in spans]


def scan(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """(row, copy, body, base, names, *keep): one row for each row of ``docs``; ``row`` numbers them.

    ``names`` are the different entities of a text and their classes; texts without one are left out of ``body``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _copy(text), F.col(text).alias("body"), *keep)
    kept = rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, bases, names = [], [], []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text) if text else []
                bodies.append(text if spans else None)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                names.append(names_of(text or "", spans))
            columns = [batch.column(0), batch.column(1), pa.array(bodies, pa.string()), pa.array(bases, pa.list_(_SPAN)), pa.array(names, pa.list_(pa.int64())), *(batch.column(i) for i in range(3, batch.num_columns))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "copy", "body", "base", "names", *kept])

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(run, f"row long, copy long, body string, base {SPANS}, names array<long>" + kinds)


def documents_with(docs: DataFrame, text: str, terms: DataFrame, repeated: DataFrame, most_terms: int = 1 << 18, most_copies: int = 1 << 20) -> DataFrame:
    """(term, n_t): different texts without an entity that hold each term.

    ``repeated(copy)`` names the texts that have copies. Up to ``most_terms`` terms and
    ``most_copies`` names go to every task. It sends one sum for each term, and the terms
    of repeated texts by name, which are then counted once. Beyond these numbers all
    terms, or the terms of all texts, are sent by name.
    """
    context = docs.sparkSession.sparkContext
    few = terms.limit(most_terms + 1).count() <= most_terms
    wanted = context.broadcast(frozenset(r.term for r in terms.collect())) if few else None
    named = context.broadcast(frozenset(r.copy for r in repeated.collect())) if repeated.limit(most_copies + 1).count() <= most_copies else None

    def terms_in(body: str) -> set[str]:
        found = terms_of(body, []) if wanted is None else wanted.value.intersection(_TERM.findall(_lower(body)))
        return set() if found and base_spans(body) else found

    def rows(copies: list, terms: list, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(sums, pa.int64())], ["copy", "terms", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sent = Counter(), set()
        for batch in batches:
            copies, terms = [], []
            for copy, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body or copy in sent:
                    continue
                if wanted is not None and named is not None and copy not in named.value:
                    seen.update(terms_in(body))
                    continue
                sent.add(copy)
                copies.append(copy)
                terms.append(list(terms_in(body)))
            yield rows(copies, terms, [1] * len(terms))
        yield rows([None] * len(seen), [[t] for t in seen], list(seen.values()))

    found = materialize(docs.select(_copy(text), text).mapInArrow(run, "copy long, terms array<string>, n long"), "term-counts")
    texts = found.where("copy IS NOT NULL").dropDuplicates(["copy"]).unionByName(found.where("copy IS NULL"))
    counted = texts.select(F.explode("terms").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted.join(terms, "term", "left_semi") if wanted is None else counted


#: Bands of min-hashes, and min-hashes in each: texts of similarity 0.8 meet with probability 0.99, those of 0.3 with 0.03.
BANDS, ROWS = 12, 5
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def near_marks(text: str) -> list[int]:
    """One signed 64-bit mark for each band; near copies share some, other texts hardly any."""
    words = _lower(text).encode("utf-8", "surrogatepass").split()
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
    with np.errstate(over="ignore"):
        least = np.array([int(((h ^ (h >> np.uint64(29))) * m).min()) for m in _MULTIPLIERS], np.uint64).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64).tolist()


def entity_contexts(found: DataFrame) -> DataFrame:
    """(context, names, terms) of each different text that holds an entity; near copies have the same context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            terms = [list(terms_of(body, _tuples(base))) for body, base in zip(bodies, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string())), pa.array(map(near_marks, bodies), pa.list_(pa.int64()))], ["copy", "names", "terms", "marks"])

    texts = found.where(F.size("names") > 0).select("copy", "names", "body", "base").dropDuplicates(["copy"])
    texts = materialize(texts.mapInArrow(run, "copy long, names array<long>, terms array<string>, marks array<long>"), "entity-texts")
    near = components(texts.select(F.col("copy").alias("a"), F.explode("marks").alias("b")))
    return texts.join(near.select(F.col("node").alias("copy"), F.col("root").alias("context")), "copy").select("context", "names", "terms")


def at_least(n: Column) -> Column:
    """Lower end of the 95 % interval of a Poisson count (Wilson and Hilferty's cube)."""
    return n * F.pow(1 - 1 / (9 * n) - SIGMAS / (3 * F.sqrt(n)), F.lit(3.0))


def disclosing_terms(docs: DataFrame, text: str, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or over the threshold, from counts of different texts over all of ``docs``."""
    texts = materialize(found.groupBy("copy").agg(F.count("*").alias("copies"), F.max(F.size("names") > 0).alias("held")), "texts")
    held = materialize(entity_contexts(found), "contexts")
    n = F.lit(float(max(texts.where("NOT held").count() + held.select("context").distinct().count(), 1)))
    # A pair is in no more contexts than its entity, so rarer entities have no pair with enough support.
    entities = held.select("context", F.explode("names").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    entities = materialize(entities, "entities")
    met = held.select("context", F.explode("names").alias("entity"), "terms").join(checked_broadcast(entities.select("entity"), 1 << 18), "entity")
    met = met.select("context", "entity", F.explode("terms").alias("term")).distinct()
    pairs = materialize(met.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support).join(entities, "entity"), "entity-terms")
    terms = pairs.select("term").distinct()
    inside = held.select("context", F.explode("terms").alias("term")).join(checked_broadcast(terms, 1 << 18), "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    outside = documents_with(docs, text, terms, texts.where("copies > 1").select("copy"))
    counted = inside.unionByName(outside).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    ratio = F.log(n * at_least(F.col("n_et")) / (F.col("n_e") * F.col("n_t"))) / F.greatest(F.log(n / F.col("n_e")), F.lit(1e-9))
    return pairs.join(counted, "term").select("entity", "term", ratio.alias("disclosure")).where(F.col("disclosure") >= threshold)


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, hits): spans of all places of the ``terms(row, terms)`` outside of the fixed patterns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for body, base, wanted in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                some = frozenset(wanted)
                hits.append([{"kind": 4, "start": a, "end": b} for t, a, b in places(_lower(body), _tuples(base)) if t in some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(_SPAN))], ["row", "hits"])

    held = found.where(F.size("names") > 0).select("row", "body", "base").join(terms, "row")
    return held.mapInArrow(run, f"row long, hits {SPANS}")


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.6, support: int = 3) -> DataFrame:
    """(*keep, base, spans): one row for each row of ``docs``.

    ``base`` are the spans (kind, start, end) of the fixed patterns, ``spans`` those and
    the disclosing terms; kinds count along ``KINDS``, places are code points, and both
    are sorted by kind and start.

    Defined cases: a null or empty text has no spans; texts of any length are searched
    whole; repeated rows are searched alike, but copies of a text count once; a term that
    discloses two entities of a text is one span; an empty table stays empty; extra
    columns are ignored; columns of ``keep`` may have any name, but ``base`` and ``spans``
    are replaced.
    """
    kept = [c for c in keep if c.lower() not in ("base", "spans")]
    found = materialize(scan(docs, text, *(F.col(c).alias(f"kept{i}") for i, c in enumerate(kept))), "personal-data")
    bad = materialize(disclosing_terms(docs, text, found, threshold, support), "disclosing-terms")
    hits = found.select("row", F.explode("names").alias("entity")).join(checked_broadcast(bad.select("entity", "term"), 1 << 18), "entity")
    per_row = hits.groupBy("row").agg(F.collect_set("term").alias("terms"))
    base = F.array_sort("base")
    spans = F.concat("base", F.coalesce("hits", F.array().cast(SPANS)))
    names = [F.col(f"kept{i}").alias(c) for i, c in enumerate(kept)]
    return found.join(term_spans(found, per_row), "row", "left").select(*names, base.alias("base"), F.array_sort(spans).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc, text): entities become ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; disclosing terms ``[NAME]``, ``[CODE]``, or nothing.

    A term with a digit is generalised to a code, a capitalised one to a name, others
    are removed. Of overlapping spans the first one names the mask. Defined cases are
    those of ``find_personal_data``; a null text stays null.
    """
    picked = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("kept_body"))
    found = find_personal_data(picked, "kept_body", ("doc", "kept_body"), **options)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    body = F.col("kept_body")

    def step(acc: Column, s: Column) -> Column:
        part = F.substr(body, s["start"] + 1, s["end"] - s["start"])
        term = F.when(F.rlike(part, F.lit("[0-9]")), "[CODE]").when(F.rlike(part, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("")
        mask = F.when(s["kind"] == 4, term).otherwise(F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1))
        joined = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), mask)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), joined.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(by_start, start, step, lambda a: F.concat(a["out"], F.substr(body, a["at"] + 1)))
    return found.select("doc", clean.alias("text"))
