import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as cut_lines
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tidewatch.llm import pieces, quality


def test_stages_are_named_and_ordered():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_whole_pipeline_against_a_slow_version(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    model = quality.train(read("documents"), read("labels"))
    docs = [(r.doc_id, r.text) for r in quality.judge(read("documents"), model).where("kept").collect()]
    docs = [(d, t) for d, _, _, t in cut_lines(docs)]
    first = slow_components([(d, slow_fingerprint(t)) for d, t in docs])
    docs = [row for row, c in zip(docs, first) if row[0] == c]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    docs = [(d, t) for d, t in docs if not leaks(t, items)[1]]
    one = pieces.Pieces(pieces.read_pieces(pieces.DEFAULT_MODEL))
    want = {d: one.encode([t], {})[0].tolist() for d, t in docs}
    got = {r.doc_id: r.ids for r in cp.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_the_columns_and_bear_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_stages_bear_nulls_repeats_clashing_names_and_long_texts(spark, sf_dir):
    """Every column that an operator makes is a column of the user's here, and comes back as it was."""
    names = "kept n_words quality_score n_lines n_dropped kept_text row judged base_failed cut_lines lost_lines fp component_id matches near h1 doc".split()
    shared = "A line of some length that many documents share."
    rows = [(i, f"{shared}\n" + " ".join(f"word{(i * 31 + j * 7) % 997}" for j in range(90)), "en") for i in range(6)]
    rows += [(6, None, None), (7, "", "en"), (None, shared + " and more " * 30, "en"), (8, "long " * 60_000, "de"), (3, rows[3][1], "en"), (3, "other text under the same id " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("source", F.lit(None).cast("string"))
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for r in got for n in names), name
        assert 0 < len(got) <= len(rows) and len(got) == {"line_dedup": len(rows), "benchmark_decontamination": len(rows)}.get(name, len(got))
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)


def test_entry_works_without_the_subpackage(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries()
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert "pipeline" not in entry.queries() and not any(q.startswith("op1_") for q in entry.queries())


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_for_each_operator(n):
    entry = importlib.import_module("__spark_entry__")
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1
