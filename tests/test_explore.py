from pyspark.sql import functions as F

from tidewatch.functions import predicates as P
from tidewatch.operators import explore, services
from tidewatch.plans import traces
from tidewatch.sources import bind, tables

SPAN = "trace_id string, span_id string, parent_span_id string, ts_ns bigint, duration_ns bigint, service_name string, status string, http_status_code int, attributes map<string,string>"


def spans(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def test_trees_with_orphans_zero_parents_and_two_roots(spark):
    rows = [("t", "a", "", 1), ("t", "b", "a", 3), ("t", "c", "a", 2), ("t", "d", "c", 4), ("t", "x", "missing", 5), ("t", "r", "0000", 6), ("u", "a", "", 1)]
    df = spans(spark, [(t, s, p, n, 1, "s", "OK", 200, {}) for t, s, p, n in rows])
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in services.span_tree(df).collect()}
    assert {k: d for k, (d, _) in got.items()} == {("t", "a"): 0, ("t", "b"): 1, ("t", "c"): 1, ("t", "d"): 2, ("t", "r"): 0, ("u", "a"): 0}
    assert got["t", "c"][1] < got["t", "d"][1] < got["t", "b"][1]


def test_deep_chain(spark):
    df = spans(spark, [("t", f"s{i}", f"s{i - 1}" if i else "", i, 1, "s", "OK", 200, {}) for i in range(40)])
    assert max(r.depth for r in services.span_tree(df).collect()) == 39


def test_chains_of_any_depth_and_cycles(spark):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else "", i) for i in range(1100)]
    stray = [("t", "c1", "c3", 1), ("t", "c2", "c1", 2), ("t", "c3", "c2", 3), ("t", "d", "c1", 4), ("t", "o1", "missing", 5), ("t", "o2", "o1", 6)]
    df = spans(spark, [(t, s, p, n, 1, "s", "OK", 200, {}) for t, s, p, n in chain + stray])
    assert {r.span_id: r.depth for r in services.span_tree(df).collect()} == {f"s{i}": i for i in range(1100)}
    assert services.span_tree(spans(spark, [(t, s, p, n, 1, "s", "OK", 200, {}) for t, s, p, n in stray])).count() == 0


def test_replay_query_joins_all_chunks(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(1)
    events.drop("event_id").crossJoin(spark.range(10_050).withColumnRenamed("id", "event_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.events for r in traces.rum_replay(spark, str(tmp_path)).collect()] == [2 * 10_050]


def test_filters_search_and_cursor(spark):
    df = spans(spark, [("t", "a", "", 2, 5, "api", "ERROR", 500, {"k": "7", "x.y": "Gateway timeout"}), ("t", "b", "", 2, 6, "db", "OK", 200, {"k": "x"}), ("t", "c", "", 1, 7, "api", "OK", 404, None)])
    ids = lambda cond: sorted(r.span_id for r in df.where(cond).collect())
    assert ids(P.where([("http_status_code", ">=", 404), ("service_name", "IN", ["api", "web"])])) == ["a", "c"]
    assert ids(P.where([("attributes.k", ">", 5)])) == ["a"] and ids(P.where([("level", "=", "error")])) == ["a"]
    assert ids(P.where([("service_name", "NOT IN", "api, web")])) == ["b"] and ids(P.where([("nope", "=", "1")])) == []
    text = [F.col("service_name"), F.lower(F.to_json("attributes"))]
    assert ids(P.text_search([["gate*out"], ["DB"]], text, ["attributes"])) == ["a", "b"]
    assert ids(P.text_search([["k=x"]], text, ["attributes"])) == ["b"] and ids(P.text_search([["api", "timeout"]], text, ["attributes"])) == ["a"]
    assert ids(P.text_search([["100%"]], text, ["attributes"])) == [] and ids(P.text_search([], text, [])) == ["a", "b", "c"]
    assert ids(P.before((2, "b"))) == ["a", "c"]


def test_pages_follow_each_other(spark, sf_dir):
    rows = bind.spans(spark, sf_dir)
    seen, cursor = [], None
    for _ in range(3):
        page = explore.keyset_page(rows, 7, cursor)
        seen += [(r.ts_ns, r.span_id) for r in page.collect()]
        cursor = explore.next_cursor(page, 7)
    assert seen == [(r.ts_ns, r.span_id) for r in explore.newest(rows, 21).collect()]


def test_funnel_in_order(spark):
    rows = [("t1", "a", "", 1, 1, "x", "OK", 200, {}), ("t1", "b", "", 2, 1, "y", "OK", 200, {}), ("t2", "c", "", 5, 1, "x", "OK", 200, {}), ("t2", "d", "", 3, 1, "y", "OK", 200, {})]
    steps = [("x", F.col("service_name") == "x"), ("y", F.col("service_name") == "y")]
    assert [r.traces for r in services.funnel(spans(spark, rows), steps).orderBy("step").collect()] == [2, 2]
    assert [r.traces for r in services.funnel(spans(spark, rows), steps, ordered=True).orderBy("step").collect()] == [2, 1]
    assert [r.pct_first for r in services.funnel(spans(spark, rows[:0]), steps).collect()] == [0.0, 0.0]


def test_latest_rows_drop_tombstones(spark):
    df = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (2, 1, 0, "c"), (2, 3, 1, "d")], "id int, version int, is_deleted int, name string")
    assert [(r.id, r.name) for r in explore.latest_rows(df).collect()] == [(1, "b")]


def test_pushdown_reaches_the_scan(spark, tmp_path, sf_dir):
    rows = bind.spans(spark, sf_dir)
    tables.append(rows, str(tmp_path), "spans")
    plan = tables.scan(spark, str(tmp_path), "spans", tenant="t1").where("http_status_code >= 500").select("service_name")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tenant_id), IsNotNull(http_status_code)" in text and "trace_id" not in text.split("ReadSchema")[1]
    assert plan.count() == rows.where("tenant_id = 't1' AND http_status_code >= 500").count()


def test_exports(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS ts, 'a\"b' AS name, 1 AS n")
    tables.export_csv(df, str(tmp_path / "c"), ["ts", "name"], note={"q": 1})
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first() == ("2024-01-01T00:00:00.000000Z", 'a"b')
    tables.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().n == 1


def test_dotted_attributes_are_looked_up_whole_then_by_path(spark):
    from tidewatch.functions.predicates import span_field

    rows = spark.sql("""SELECT 'ok' AS status, map('a.b', 'flat', 'x', '{"y":{"z":7},"w":"v"}', 'plain', '1') AS attributes""")
    names = ("attributes.a.b", "attributes.x.y.z", "attributes.x.w", "attributes.x.none", "attributes.plain", "attributes.plain.q", "attributes.gone.q", "level", "nonsense")
    assert list(rows.select(*(span_field(n).alias(str(i)) for i, n in enumerate(names))).first()) == ["flat", "7", "v", "", "1", "", "", "ok", None]
