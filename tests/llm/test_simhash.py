import random
import re
from itertools import combinations

import numpy as np
import xxhash

from tidewatch.llm import simhash as sh
from tidewatch.llm.queries import op2_simhash_near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(pairs, max_bits=4):
    """{index: least id reachable} for (id, fingerprint) rows."""
    name = list(range(len(pairs)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, j in combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= max_bits:
            name[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(pairs))]


def test_every_four_places_hold_a_triple():
    assert len(sh.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in sh.TRIPLES) for four in combinations(range(8), 4))


def test_fingerprints(edge):
    for row in edge.collect():
        assert sh.fingerprint(row.text) == slow_fingerprint(row.text)


def test_groups_on_edges(edge, empty):
    got = sorted(((r.doc_id, int(r.fp, 16), r.component_id) for r in sh.near_duplicate_groups(edge).collect()), key=repr)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in edge.collect()]
    assert got == sorted(((d, f, c) for (d, f), c in zip(rows, slow_components(rows))), key=repr)
    assert sh.near_duplicate_groups(empty).count() == 0
    assert sh.keep_one_of_each(edge).columns == edge.columns


def test_dense_cluster_split_in_blocks_keeps_every_link(spark):
    rng, rows = random.Random(7), []
    for centre in [rng.getrandbits(64) for _ in range(3)] + [(1 << 64) - 1, 0]:
        walk = centre
        for _ in range(120):
            walk ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            rows.append(walk if rng.random() < 0.5 else centre ^ (1 << rng.randrange(64)))
    rows = sorted(set(rows))
    signed = [x - (x >> 63 << 64) for x in rows]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (8192, 16):
        roots = {r.node: r.root for r in sh.components(sh.links(frame, block=block)).collect()}
        want = slow_components(list(zip(range(len(rows)), rows)))
        for i, j in combinations(range(len(rows)), 2):
            assert (want[i] == want[j]) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))


def test_long_run_spans_without_all_pairs():
    rng = np.random.default_rng(2)
    fp = np.unique(np.bitwise_xor(np.uint64(12345), np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    assert len(sh._long_run(fp, 4, 4)) == len(fp) - 1


def test_rows_that_repeat_an_id_are_kept_by_their_own_text(spark):
    a, b = "one text about some thing or other", "quite another text that nothing else is like"
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, a, "x")], "doc_id long, text string, copy string")
    assert sorted(sh.keep_one_of_each(docs).collect(), key=repr) == sorted([(1, a, "x"), (2, b, "x"), (None, a, "x")], key=repr)


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op2_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {d: (f, c) for (d, f), c in zip(docs, slow_components(docs))}
