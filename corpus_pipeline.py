"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes what a stage returns to the
shared folder and gives it to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, materialize, table
from tidewatch.llm.decontaminate import drop_contaminated
from tidewatch.llm.line_dedup import drop_shared_lines
from tidewatch.llm.pieces import encode_texts
from tidewatch.llm.quality import keep_good
from tidewatch.llm.simhash import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the boosted trees reject go.

    Defined cases as for ``judge``: null, empty and short texts go; without labels only the
    limits decide; repeated rows are judged alike; texts of any length are judged whole; extra columns stay, whatever their names.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only.

    Defined cases as for ``drop_shared_lines``: no row goes; a text that loses all lines, and
    a null text, becomes empty; rows that repeat an id are one document; ``n_chars`` follows
    the text; other columns stay, whatever their names.
    """
    row = fresh("row", docs)
    cut = drop_shared_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias(row)))
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*(changed.get(c, F.col(row)[c]).alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Defined cases as for ``keep_one_of_each``: texts without words are one group; texts of
    any length count whole; rows without an id stay; rows that repeat an id are told apart
    by their text.
    """
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Defined cases as for ``phrase_matches``: texts without words and rows without an id
    stay; an empty benchmark drops nothing.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of the texts that are left.

    Defined cases as for ``encode_texts``: a null text has null ids, an empty one none;
    repeated rows are encoded alike; an empty table stays empty.
    """
    return encode_texts(spark, docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids")


STAGES = [(f.__name__, f) for f in (quality_rules, line_dedup, simhash_near_dedup, benchmark_decontamination, sentencepiece)]
#: Trees and pieces have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
