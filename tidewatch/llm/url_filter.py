"""URL block lists as a sort-merge range join; DataFrame operations only.

A host is written with its labels reversed, so that a rule for a host and a path
becomes a prefix: the interval of keys that start with ``reversed host + path``.
A page has one key for each ancestor of its host. Rules and pages are sorted
together and swept: each rule that opens carries the stack of the rules around it,
and a page takes the innermost rule of the last stack whose interval holds its key.
(Intervals of prefixes nest or are disjoint, so whatever has closed since is on top
of what is still open.)

The sweep is dealt out by the reversed host and a salt of the page. Pages of a host
are counted first, and a host gets as many salts as keep a sweep under ``per_sweep``
pages, however many it has; only its few rules are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, checked_broadcast, materialize

ALLOW, BLOCK = "allow", "block"
RULES = "host string, path string, action string"


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(site, key, stack): each distinct rule with the rules whose interval holds its own, itself last.

    A rule given with both actions blocks.
    """
    one = rules.where("host is not null").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").groupBy("host", "path").agg(F.max("action").alias("action"))
    keyed = one.select(F.array_join(_reversed(F.col("host")), ".").alias("site"), "path", F.concat("host", "path").alias("rule"), "action")
    prefixes = keyed.select("site", F.col("path").alias("of"), F.explode(F.sequence(F.lit(0), F.char_length("path"))).alias("n")).select("site", "of", F.expr("left(of, n)").alias("path"))
    around = prefixes.join(keyed, ["site", "path"]).groupBy("site", "of")
    stack = F.array_sort(F.collect_list(F.struct(F.char_length("rule").alias("length"), "path", "rule", "action")))
    return around.agg(stack.alias("stack")).select("site", F.concat("site", "of").alias("key"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW, salts: int = 64, per_sweep: int = 1 << 17) -> DataFrame:
    """(page, host, path, rule, verdict): one row for each row of ``pages``.

    ``rules`` has host, path, action (``allow`` or ``block``). A rule fits its host and
    all subdomains where the page's path starts with its path; the longest wins (of two
    as long, the one for the longer host). Without a rule, ``rule`` is null and
    ``default`` the verdict. ``salts`` is the least number of sweeps of a host.

    Defined cases: a null url, or one without ``://``, has an empty host and path;
    repeated rows give as many rows; an empty table or rule list is no error; extra
    columns are ignored.
    """
    stacks = rule_stacks(rules)
    known = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url")).groupBy("page", "url").agg(F.count("*").cast("int").alias("copies"))
    known = known.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = known.withColumn("labels", _reversed(F.col("host")))
    each = labels.select("page", "url", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth"))
    keys = each.select("page", "url", "depth", F.array_join(F.slice("labels", 1, F.col("depth")), ".").alias("site"), "path").withColumn("key", F.concat("site", "path"))
    asked = keys.join(checked_broadcast(stacks.select("site").distinct(), 1 << 16), "site", "left_semi")
    parts = F.greatest(F.lit(salts), F.ceil(F.count("*") / per_sweep)).cast("int")
    sizes = materialize(asked.groupBy("site").agg(parts.alias("parts")), "site-sizes")
    salted = asked.join(checked_broadcast(sizes, 1 << 16), "site").select("site", F.pmod(F.xxhash64("page", "url"), F.col("parts")).cast("int").alias("salt"), "key", F.lit(1).alias("kind"), "page", "url", "depth", F.lit(None).cast(dict(stacks.dtypes)["stack"]).alias("stack"))
    copies = stacks.join(sizes, "site").select("site", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "key", F.lit(0).alias("kind"), *(F.lit(None).cast(dict(salted.dtypes)[c]).alias(c) for c in ("page", "url", "depth")), "stack")
    sweep = Window.partitionBy("site", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = salted.unionByName(copies).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1 and open is not null")
    inside = F.filter("open", lambda r: F.startswith(F.col("key"), F.concat(F.col("site"), r["path"])))
    innermost = F.try_element_at(inside, F.lit(-1))
    best = F.when(innermost.isNotNull(), F.struct(innermost["length"].alias("length"), "depth", innermost["rule"].alias("rule"), innermost["action"].alias("action")))
    found = swept.select("page", "url", best.alias("best")).where("best is not null")
    nothing = {c: F.lit(None).cast(dict(known.dtypes)[c]).alias(c) for c in ("host", "path", "copies")}
    rows = known.withColumn("best", F.lit(None).cast(dict(found.dtypes)["best"])).unionByName(found.select("*", *nothing.values()))
    judged = rows.groupBy("page", "url").agg(F.max("host").alias("host"), F.max("path").alias("path"), F.max("copies").alias("copies"), F.max("best").alias("best"))
    out = judged.select("page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)
