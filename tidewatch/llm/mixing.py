"""Mixing sources to target weights, in whole blocks of words.

The sources' targets become numbers of equal blocks, a source's number is dealt among its
shards, and each shard takes so many of its blocks in a seeded order. Both deals are
Sainte-Lague's: one block after the other goes to the highest quotient. Everything is
DataFrame functions; documents travel as ids and sizes, and a source of any size is cut
into shards by hash, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE_CLASS, materialize

WEIGHTS = (5, 2, 1)
#: The mix has this part of all words, and a source gives its words so many times at most.
SHARE, MOST = 1.5, 2
BLOCK, SHARD, SEED = 32, 1 << 19, "13"


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, size): weights go to the sources by name, null last, and repeat.

    Targets share ``share`` times all words by weight; none is over ``most`` times its
    source's size, and what is cut off goes to the others by weight. With the sources in the
    order in which they fill up, this is one running sum. One row a source is sorted in one task.
    """
    if share > most:
        raise ValueError("the sources cannot fill the mix")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("*", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    full_first = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = full_first.rowsBetween(Window.unboundedPreceding, -1), full_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) * float(share) - given) / (F.sum("w").over(whole) - used)
    levels = totals.withColumn("level", level).withColumn("over", F.col("cap") > F.col("level") * F.col("w"))
    # the first source that does not fill up sets the level of all that follow
    settled = F.first(F.when(F.col("over"), F.col("level")), ignorenulls=True).over(full_first.rowsBetween(Window.unboundedPreceding, 0))
    return levels.withColumn("target", F.coalesce(settled * F.col("w"), "cap")).select("source", "source_size", "target")


def apportion(df: DataFrame, keys: list[str], votes: str, seats: str, most: str, order: str) -> DataFrame:
    """``df`` with ``quota``: the ``seats`` of each group, dealt to its rows by the highest quotients votes / (2 k + 1).

    A row takes no more than ``most``; ties go to the lower ``order``. Rows are given at once
    what any divisor that is surely too high gives them; only the seats that are left, fewer
    than a group has rows, are dealt by ranked quotients. ``votes`` add up to something
    positive where there are seats.
    """
    group = Window.partitionBy(*keys)
    number, all_votes = F.count("*").over(group), F.sum(votes).over(group)
    high, low = F.greatest(F.col(seats) - number / 2, F.lit(0.0)), F.col(seats) + number / 2 + 1
    rounded = lambda part: F.when(all_votes > 0, F.floor(F.col(votes) * part / all_votes + 0.5)).otherwise(F.lit(0)).cast("long")
    bounded = df.withColumns({"sure_": F.least(rounded(high), F.col(most)), "upper_": F.least(rounded(low) + 1, F.col(most))})
    left = bounded.withColumn("left_", F.col(seats) - F.sum("sure_").over(group)).where("upper_ > sure_")
    tries = left.select("*", F.explode(F.sequence("sure_", F.col("upper_") - 1)).alias("k_")).withColumn("q_", F.col(votes) / (2 * F.col("k_") + 1))
    ranked = tries.withColumn("rank_", F.row_number().over(group.orderBy(F.desc("q_"), order, "k_"))).where("rank_ <= left_ AND q_ > 0")
    more = ranked.groupBy(*(F.col(c).alias(f"{c}_") for c in [*keys, order])).agg(F.count("*").alias("more_"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*keys, order]]
    out = bounded.join(more, same, "left").withColumn("quota", F.col("sure_") + F.coalesce("more_", F.lit(0)))
    return out.drop("sure_", "upper_", "more_", *(f"{c}_" for c in [*keys, order]))


def _draw(*parts: Column | str) -> Column:
    """A seeded, even draw that any engine can repeat: the MD5 of the parts."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of (doc_id, source, text), a row for each row.

    A source's documents are dealt by hash into shards of about ``shard`` words, laid end to
    end in a seeded order, and cut into blocks of ``block`` words, so that long documents
    span many blocks and short ones share one. A block is taken as often as its shard's quota
    says; over the quota's whole rounds, blocks come in a seeded order. ``taken`` counts the
    document's words in taken blocks, repeats included: at most ``most`` times its size. A
    source misses its target by less than a block for each shard and one for the source.

    Null texts have size 0 and take 0. A null source is a source; its weight comes last. Null
    and repeated ids are told apart by numbering equal rows, which take the same words in any
    run up to their order. Ties of quotients go to the first source. An empty table stays empty.
    Other columns are not read.
    """
    sizes = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    sources = source_targets(sizes, weights, share, most)
    copies = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    placed = copies.join(sources.withColumnsRenamed({"source": "of_"}), F.col("source").eqNullSafe(F.col("of_")), "left").drop("of_")
    shards = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1))
    rows = placed.select("source", "doc_id", "size", "source_size", "target", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    empty = rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    drawn = rows.where("size > 0").withColumn("draw", _draw("doc_id", "copy")).withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), shards))
    within = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = materialize(drawn.withColumn("start", F.sum("size").over(within) - F.col("size")), "laid")

    parts = laid.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size")).withColumn("blocks", F.ceil(F.col("shard_size") / block).cast("long"))
    by_source = parts.groupBy("source", "source_size", "target").agg((F.sum("blocks") * most).alias("room"))
    whole = Window.partitionBy(F.lit(1))
    seats = F.floor(F.sum("source_size").over(whole) * float(share) / block + 0.5).cast("long")
    named = by_source.withColumns({"seats": seats, "order_": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())), "all_": F.lit(1)})
    dealt = apportion(named, ["all_"], "target", "seats", "room", "order_").select(F.col("source").alias("of_"), F.col("quota").alias("source_quota"))
    room = parts.join(dealt, F.col("source").eqNullSafe(F.col("of_"))).drop("of_").withColumn("room", F.col("blocks") * most)
    quotas = materialize(apportion(room, ["source"], "shard_size", "source_quota", "room", "shard").select("source", "shard", "blocks", "quota"), "quotas")

    rounds = F.floor(F.col("quota") / F.col("blocks"))
    # few rows become many blocks: they are spread first, and the join must not take them for a small side
    every = quotas.repartition("source", "shard").select("source", "shard", (F.col("quota") - rounds * F.col("blocks")).alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    drawn_blocks = Window.partitionBy("source", "shard").orderBy(_draw("shard", "block"), "block")
    chosen = every.where("rest > 0").withColumn("rank", F.row_number().over(drawn_blocks)).where("rank <= rest").select(F.col("source").alias("of_"), F.col("shard").alias("in_"), "block")
    cut = laid.select("source", "shard", "doc_id", "copy", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("at_"))
    hit = cut.join(chosen.hint("merge"), F.col("source").eqNullSafe(F.col("of_")) & (F.col("shard") == F.col("in_")) & (F.col("at_") == F.col("block")), "left_semi")
    inside = F.least(F.col("start") + F.col("size"), (F.col("at_") + 1) * block) - F.greatest(F.col("start"), F.col("at_") * block)
    keys = ["source", "shard", "doc_id", "copy", "size"]
    extra = hit.groupBy(*keys).agg(F.sum(inside).alias("extra"))
    base = quotas.select(F.col("source").alias("of_"), F.col("shard").alias("in_"), rounds.alias("rounds"))
    told = laid.join(base, F.col("source").eqNullSafe(F.col("of_")) & (F.col("shard") == F.col("in_")), "left")
    other = extra.select(*(F.col(c).alias(f"{c}_") for c in keys), "extra")
    full = told.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys], "left")
    taken = (F.col("rounds") * F.col("size") + F.coalesce("extra", F.lit(0))).cast("long").alias("taken")
    return full.select("doc_id", "source", "size", "source_size", "target", taken).unionByName(empty)
