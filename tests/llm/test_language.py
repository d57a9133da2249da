import math
import unicodedata
import zlib
from collections import Counter

import numpy as np

from tidewatch.llm import language as lg
from tidewatch.llm.queries import op1_language_id


def test_machines_form_a_hierarchy():
    plan = lg.machines(["en", "de", "fr", "es", "xx"])
    assert [p[:2] for p in plan if p[0] == "family"] == [("family", "germanic"), ("family", "romance"), ("family", "xx")]
    assert {(p[1], p[2]) for p in plan if p[0] == "pair"} == {("de", "en"), ("es", "fr")}
    assert lg.machines(["en"]) == [] and lg.machines([]) == []


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + x[:, 1] > 0, 1, -1).astype(np.float32)
    w = lg.fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_edges(spark, edge, empty):
    model = lg.train(edge, lg.F.lit(True))
    rows = lg.identify(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) and 0 <= r.lang_score <= 1
    assert lg.identify(empty, model).count() == 0
    nothing = lg.train(empty, lg.F.lit(True))
    assert {r.lang_pred for r in lg.identify(edge, nothing).collect()} == {"und"}
    one = lg.train(edge.where("lang = 'de'"), lg.F.lit(True))
    assert {r.lang_pred for r in lg.identify(edge, one).collect()} == {"de", "und"}


def slow_features(text):
    chars = [b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text or ''} ".lower().encode("utf-8", "surrogatepass")]
    b = [c for i, c in enumerate(chars) if not i or c != 32 or chars[i - 1] != 32]
    counts = Counter()
    for i in range(len(b)):
        counts[((b[i] + (1 << 24)) * 2654435761 % 2**32) >> 20] += 1
        if i + 1 < len(b):
            counts[((b[i] * 257 + b[i + 1] + (1 << 20)) * 2654435761 % 2**32) >> 20] += 1
        if i + 2 < len(b):
            counts[((b[i] * 257 + b[i + 1]) * 8191 + b[i + 2]) % 2**32 * 2654435761 % 2**32 >> 20] += 1
    norm = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(v) / norm for k, v in counts.items()}


def slow_language(model, text):
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und"
    x = slow_features(text)
    margin = {p: float(w[-1]) + sum(float(w[k]) * v for k, v in x.items()) for p, w in zip(model["plan"], model["weights"])}
    families = sorted({lg.family_of(x) for x in model["langs"]})
    if len(families) == 2:
        best = families[margin["family", *families] < 0]
    else:
        best = max(families, key=lambda f: margin.get(("family", f, ""), 0))
    members = sorted(x for x in model["langs"] if lg.family_of(x) == best)
    votes = Counter({m: 0 for m in members})
    for (kind, a, b), m in margin.items():
        if kind == "pair" and a in members:
            votes[a if m >= 0 else b] += 1
    return max(members, key=lambda m: votes[m])


def test_predictions_follow_from_the_weights(spark, sf_dir, edge):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = lg.train(docs, ~lg.held_out(lg.F.col("doc_id")))
    rows = lg.identify(docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text")), model).collect()
    assert [r.lang_pred for r in rows] == [slow_language(model, r.text) for r in rows]


def test_sample_is_bounded_in_rows_and_ties_go_to_the_first(spark):
    rows = [(i % 3, f"{'der die das' if i % 2 else 'the of and'} {i}", "de" if i % 2 else "en") for i in range(60)] + [(1, "der die das 1", "de")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = lg.train(docs, lg.F.lit(True), max_rows=5)
    again = lg.train(docs.dropDuplicates().repartition(2), lg.F.lit(True), max_rows=5)
    assert model["langs"] == ["de", "en"] and (model["weights"] == again["weights"]).all()
    model["weights"] = model["weights"] * 0
    assert [r.lang_pred for r in lg.identify(docs.limit(1), model).collect()] == ["de"]


def test_query_is_right_on_held_out_documents(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_language_id(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean(held) > 0.95
