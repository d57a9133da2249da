import random
from collections import defaultdict

import numpy as np

from tidewatch.llm import line_dedup as ld
from tidewatch.llm.queries import OP4_SQL, op4_line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= min_chars and doc is not None and len(ids := set(holders[k]) - {None}) >= min_docs and doc < max(ids) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        mph = ld.Mph(ld.unpack(ld.pack(ld.build_mph(keys))))
        assert sorted(mph.slots(keys)) == list(range(len(keys)))


def test_matches_brute_force_on_edges_and_random_lines(spark, edge):
    random.seed(4)
    lines = [f"line number {i} with enough characters" for i in range(40)] + ["short", "", "É shared line with an accent"]
    rows = [(i, "\n".join(random.choices(lines, k=random.randint(0, 9)))) for i in range(300)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (edge, more):
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in ld.drop_shared_lines(frame).collect()]
        want = brute([(r.doc_id, r.text) for r in frame.collect()])
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeated_ids_are_one_document_as_in_sql(spark, tmp_path):
    import duckdb

    line, other = "a line that is long enough to count", "another line that is long enough"
    rows = [(1, f"{line}\n{other}"), (1, line), (2, line), (3, other), (4, f"x\n{other}"), (4, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in ld.drop_shared_lines(frame).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (3, 1, 1), (4, 1, 0), (4, 2, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({d}, '{t}')" for d, t in rows) + ") t(doc_id, text)")
    assert sorted((d, n) for d, _, n, _ in con.sql(OP4_SQL).fetchall()) == [(1, 1), (2, 0), (3, 1), (4, 0)]


def test_keys_with_the_same_first_half_are_all_found():
    import pandas as pd

    rows = pd.DataFrame({"shard": 3, "h1": [5, 5, 5, -7], "h2": [1, 2, 3, 4], "n": [10, 20, 30, 40], "last": [1, 2, 3, 4]})
    built = ld.build_shard(rows).iloc[0]
    shard = ld.Shard(*(built[p] for p in ld.PARTS))
    count, last = shard.look_up(np.array([5, 5, 5, -7, 5, 8], np.int64).view(np.uint64), np.array([1, 2, 3, 4, 9, 1]))
    assert (count.tolist(), last.tolist()) == ([10, 20, 30, 40, 0, 0], [1, 2, 3, 4, 0, 0])


def test_wide_shards_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ld, "PROBES_PER_COPY", 20)
    rows = [(i, f"one line that every document holds\nown line number {i} of some length\n{'x' * 30_000 if i % 50 == 0 else ''}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in ld.drop_shared_lines(frame).collect())
    assert got == sorted(brute(rows))


def test_empty_table_and_columns(spark, edge, empty):
    assert ld.drop_shared_lines(empty).count() == 0
    assert set(ld.drop_shared_lines(edge).columns) == set(edge.columns) | {"n_dropped"}


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in op4_line_dedup(spark, sf_dir).collect()}
    assert got == {d: (n, k) for d, n, k, _ in brute(docs)}
