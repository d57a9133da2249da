import re
from collections import Counter

import numpy as np

from tidewatch.llm import quality as q
from tidewatch.llm.queries import op9_quality_rules


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_counts(edge, spark, sf_dir):
    for row in [*edge.collect(), *spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]:
        assert q.measure(row.text)[0] == slow_counts(row.text)


def walk(model, x):
    total = float(model["start"])
    for at in model["roots"]:
        for _ in range(int(model["depth"])):
            at = model["left"][at] if x[model["feature"][at]] <= model["threshold"][at] else model["right"][at]
        total += model["value"][at]
    return total


def test_trees_fit_are_monotonic_and_flat_arrays_agree_with_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(q.FEATURES)))
    symbols = q.FEATURES.index("symbols")
    y = ((x[:, symbols] < 0.5) & (x[:, 0] > 0.3) ^ (rng.random(600) < 0.05)).astype(float)
    model = q.fit(x, y)
    score = q.raw_score(model, x)
    assert ((score > 0) == (y > 0)).mean() > 0.93
    assert np.allclose(score[:50], [walk(model, r) for r in x[:50]])
    for f in q.DECREASING:
        moved = x.copy()
        moved[:, q.FEATURES.index(f)] += rng.random(600)
        assert (q.raw_score(model, moved) <= score + 1e-9).all()


def test_no_labels_and_one_sided_labels_give_the_prior():
    for y in (np.empty(0), np.ones(5)):
        model = q.fit(np.zeros((len(y), len(q.FEATURES))), y)
        assert (q.raw_score(model, np.ones((3, len(q.FEATURES)))) > 0).all()


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    judged = q.judge(edge, q.train(edge, labels)).collect()
    assert len(judged) == edge.count()
    assert all(not r.kept for r in judged if r.doc_id in (4, 5, 6))
    assert q.keep_good(empty, labels.limit(0)).count() == 0
    assert q.keep_good(edge, labels).columns == edge.columns


def test_held_out_half_and_repeated_ids(spark, sf_dir):
    """Fitted on half of the labels, the trees judge the other half; rows that repeat an id do not add to the sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = q.F.crc32(labels.doc_id.cast("string").cast("binary")) % 2 == 0
    model = q.train(docs, labels.where(half))
    again = q.train(docs.unionByName(docs), labels.where(half))
    assert all(np.array_equal(model[k], again[k]) for k in model)
    rest = {r.doc_id: r.quality for r in labels.where(~half).collect()}
    judged = [(r.kept, rest[r.doc_id]) for r in q.judge(docs, model).collect() if r.doc_id in rest and not r.base_failed]
    assert np.mean([k == bool(y) for k, y in judged]) > 0.9


def test_query_agrees_with_labels(spark, sf_dir):
    rows = op9_quality_rules(spark, sf_dir).collect()
    assert {r.base_failed for r in rows} == {True, False}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    checked = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == bool(y) for k, y in checked]) > 0.95
