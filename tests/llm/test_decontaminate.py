import hashlib
import re
from collections import Counter

from tidewatch.llm import decontaminate as dc
from tidewatch.llm.queries import op3_benchmark_decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, n=10):
    w, found = words(text), []
    for item, t in items:
        v = words(t)
        size = min(n, len(v))
        if item is None or not v:
            continue
        for window in {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}:
            found += [(item, i, size) for i in range(len(w) - size + 1) if tuple(w[i : i + size]) == window]
    return w, set(found)


def test_matches_brute_force(spark, edge, empty):
    passage = "one two three four five six seven eight nine ten eleven twelve one two three four five six seven eight nine ten"
    items = [(1, passage), (2, "Shared LINE"), (3, "wort"), (4, None), (5, "..."), (None, "the"), (6, "é€ end"), (2, "Shared LINE"), (7, "nowhere to be found in any text at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(20, "x, " + passage + ". " + passage, "en", "z"), (21, passage[4:60], "en", "z"), (22, "ONE-two three: four five six seven eight nine ten!", "en", "z")]
    from tests.llm.conftest import edge_frame

    docs = edge.unionByName(edge_frame(spark, extra))
    got = dc.phrase_matches(docs, bench).select("doc_id", "text", "n_words", "matches", dc.words_hit(dc.F.col("matches")).alias("hit")).collect()
    assert len(got) == docs.count()
    for row in got:
        w, want = brute(row.text, items) if row.doc_id is not None else (words(row.text), set())
        assert row.n_words == len(w)
        assert {tuple(m) for m in row.matches} == want
        assert row.hit == len({p for _, i, n in want for p in range(i, i + n)})
    assert dc.phrase_matches(empty, bench).count() == 0
    assert all(not r.matches for r in dc.phrase_matches(edge, bench.limit(0)).collect())
    clean = dc.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and 20 not in [r.doc_id for r in clean.collect()]


def test_proximity_in_any_order(spark):
    bench = spark.createDataFrame([(1, "apple banana cherry")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "cherry x banana y apple"), (2, "apple " + "z " * 30 + "banana cherry"), (3, "apple banana")], "doc_id long, text string")
    got = {(r.doc, r.item, r["at"], r.end) for r in dc.proximity_matches(docs, bench, slop=8).collect()}
    assert got == {(1, 1, 0, 4)}


def near_by(held, asked, slop=20):
    return any(asked <= set(held[max(0, i - slop + 1) : i + 1]) for i, w in enumerate(held) if w in asked)


def test_query_on_whole_table(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = Counter(w for t in texts.values() for w in words(t))
    rare = {i: sorted((counts[w], w) for w in set(words(t)) if counts[w])[:3] for i, t in items}
    near = {d: sum(near_by(words(t), {w for _, w in rare[i]}) for i in rare if rare[i]) for d, t in texts.items()}
    assert any(near.values())
    for row in op3_benchmark_decontamination(spark, sf_dir).collect():
        w, hits = brute(texts[row.doc_id], items)
        names = ",".join(sorted({str(i) for i, _, _ in hits}))
        assert (row.n_words, row.n_hit, row.contaminated) == (len(w), len({p for _, i, n in hits for p in range(i, i + n)}), bool(hits))
        assert row.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert row.n_near == near[row.doc_id]
