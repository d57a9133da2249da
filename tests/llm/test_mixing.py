from collections import Counter, defaultdict
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing
from tidewatch.llm.queries import OP13_SQL, op13_source_mix


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / max(sum(weight[s] for s in rest), 1)
        over = {s for s in rest if weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def seats_of(votes, seats, most):
    """Sainte-Lague by giving one seat after the other to the highest quotient."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        open_ = [k for k in votes if got[k] < most[k] and votes[k] > 0]
        if not open_:
            break
        best = max(open_, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


def slow_mix(rows, block, shard, most=2):
    """[(doc_id, size, target, taken)] by laying every word out."""
    md5 = lambda *p: hashlib.md5("|".join(["13", *map(str, p)]).encode()).hexdigest()
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    targets, names, copies, shards = slow_targets(sizes), sorted(sizes, key=lambda s: (s is None, s)), Counter(), defaultdict(list)
    out = [(d, 0, targets[s], 0) for d, s, n in sized if not n]
    for d, s, n in sized:
        if n:
            copies[d, s, n] += 1
            draw = md5("-" if d is None else d, copies[d, s, n])
            shards[s, int(draw[:8], 16) % max(-(-sizes[s] // shard), 1)].append((draw, d if d is not None else -1, n, d))
    blocks = {k: -(-sum(x[2] for x in v) // block) for k, v in shards.items()}
    room = {names.index(s): most * sum(b for (t, _), b in blocks.items() if t == s) for s in names if sizes[s]}
    quota = seats_of({i: targets[names[i]] for i in room}, int(sum(sizes.values()) * 1.5 / block + 0.5), room)
    for s in names:
        own = {j: sum(x[2] for x in v) for (t, j), v in shards.items() if t == s}
        dealt = seats_of(own, quota.get(names.index(s), 0), {j: most * blocks[s, j] for j in own})
        for j in own:
            whole, rest = divmod(dealt[j], blocks[s, j])
            order = sorted(range(blocks[s, j]), key=lambda b: (md5(j, b), b))
            times = [whole + (b in set(order[:rest])) for b in range(blocks[s, j])]
            at = 0
            for draw, _, n, d in sorted(shards[s, j]):
                out.append((d, n, targets[s], sum(times[p // block] for p in range(at, at + n))))
                at += n
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


@pytest.mark.parametrize("block, shard", [(32, 1 << 19), (7, 3000)])
def test_the_mix_against_a_slow_version(spark, sf_dir, block, shard):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = mixing.mix(docs, block=block, shard=shard).select("doc_id", "size", "target", "taken").collect()
    same(map(tuple, got), slow_mix([tuple(r) for r in docs.collect()], block, shard))


def test_sources_come_near_their_targets_and_documents_stay_within_twice(spark, sf_dir):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    assert rows.where("taken > 2 * size OR taken < 0").count() == 0
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 2 * mixing.BLOCK
    whole = rows.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(whole[0] - 1.5 * whole[1]) <= 0.01 * whole[1]


def test_hot_sources_repeated_rows_and_nulls(spark):
    rows = [(i, "hot", "w " * (i % 40)) for i in range(400)] + [(5, "b", "x y z")] * 30 + [(None, None, "one two")] * 20 + [(None, "b", None), (7, None, ""), (8, "tiny", "a")]
    rows += [(9, "hot", "v " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    docs = docs.withColumns({c: F.lit(1) for c in ("size", "taken", "shard", "copy", "draw", "target", "quota")})
    first = mixing.mix(docs, block=4, shard=500).select("doc_id", "size", "target", "taken").collect()
    same(map(tuple, first), slow_mix(rows, 4, 500))
    again = mixing.mix(docs.repartition(2), block=4, shard=500).select("doc_id", "size", "target", "taken").collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_empty_tables_and_tables_without_words(spark, empty):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [tuple(r) for r in mixing.mix(blank).orderBy("doc_id").select("size", "source_size", "target", "taken").collect()] == [(0, 0, 0.0, 0)] * 2


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 1, "b": 1000, "c": 3, None: 50}, {"a": 0, "b": 7}, {"a": 5}, {f"s{i}": i * i for i in range(12)}])
def test_targets_are_those_of_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


@pytest.mark.parametrize("seats", [0, 1, 3, 17, 1000])
def test_apportionment_is_that_of_highest_quotients(spark, seats):
    votes = {i: v for i, v in enumerate([5, 5, 5, 1, 0, 1000, 333, 17, 17, 2], 1)}
    df = spark.createDataFrame([(g, i, v, seats, 10_000) for g in ("x", None) for i, v in votes.items()], "g string, i int, v long, seats long, most long")
    got = mixing.apportion(df, ["g"], "v", "seats", "most", "i").collect()
    want = seats_of(votes, seats, dict.fromkeys(votes, 10_000))
    assert all(r.quota == want[r.i] for r in got) and len(got) == 20


def test_the_query_runs_without_python_workers(spark, sf_dir):
    plan = op13_source_mix(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "documents" in OP13_SQL
