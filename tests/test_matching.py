import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import compare as K
from skyloom.operators import graph


def nearest_first(pairs):
    taken, a, b = [], set(), set()
    for d2, x, y in sorted(pairs):
        if x not in a and y not in b:
            taken.append((x, y))
            a.add(x)
            b.add(y)
    return sorted(taken)


def chain(n):
    """Rows in a line, each a little nearer to the next one than that is to the one after it: a pair waits for all pairs after it."""
    at, x = [], 0.0
    for k in range(2 * n):
        at.append((k // 2, x))
        x += 0.9 - 0.0008 * k
    rows = lambda side: [(k, x, 0.0, 0.0, 1.0) for j, (k, x) in enumerate(at) if j % 2 == side]
    return rows(0), rows(1)


def brute(a, b, tol):
    return nearest_first((sum((p[i] - q[i]) ** 2 for i in (1, 2, 3)), p[0], q[0]) for p in a for q in b if all(abs(p[i] - q[i]) < tol for i in (1, 2, 3)))


SCHEMA = "tag long, x double, y double, z double, mass double"


def jobs(spark, make):
    """The result, and how many jobs it took."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = make()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_chains_take_as_many_jobs_whatever_their_length(spark):
    counts = []
    for n in (25, 500):
        a, b = chain(n)
        fa, fb = (spark.createDataFrame(r, SCHEMA).repartition(4) for r in (a, b))
        got, count = jobs(spark, lambda fa=fa, fb=fb: sorted((r.a_key, r.b_key) for r in K.match_remainder(fa, fb, tol=1.0).collect()))
        counts.append(count)
        assert got == brute(a, b, 1.0)
    assert len(brute(*chain(500), 1.0)) > 400 and abs(counts[0] - counts[1]) <= 8, counts


@pytest.mark.parametrize("one_task", [1_000_000, 20])
def test_dense_places_with_ties(spark, one_task):
    rng = random.Random(6)
    a, b = ([(k, *[rng.randint(0, 12) / 4 for _ in range(3)], 1.0) for k in range(150)] for _ in range(2))
    fa, fb = (spark.createDataFrame(r, SCHEMA) for r in (a, b))
    got = K.match_remainder(fa, fb, tol=0.6, one_task=one_task)
    assert sorted((r.a_key, r.b_key) for r in got.collect()) == brute(a, b, 0.6)


@pytest.mark.parametrize("one_task", [2_000_000, 3])
def test_components_over_ranges(spark, one_task):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(300) if k % 50] + [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(80)]
    df = spark.createDataFrame(edges, "a_key long, b_key long")
    want = graph.united(iter(edges))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = graph.components(df, ("a_key",), bipartite=False, one_task=one_task).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(rows) == len(edges)
    seen = {(r.component, want[r.a_key]) for r in rows}
    assert len(seen) == len({c for c, _ in seen}) == len({w for _, w in seen})
    both = graph.components(df.where(F.col("a_key") < 10), ("a_key",)).collect()
    assert len({r.component for r in both}) == len(both)  # 1-2 and 2-3 share no node: an a_key is no b_key


def test_nothing_to_match(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.match_remainder(empty, empty, tol=1.0).count() == 0


def test_bags_by_digests(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 300) or None, rng.choice(["x", "y", None])) for _ in range(2000)]
    a = spark.createDataFrame(rows, "k long, s string").cache()
    for other in (rows, rows[:-1], [*rows, rows[0]], [(None, "x"), *rows], [(r[1] and r[0], r[1]) for r in rows], []):
        b = spark.createDataFrame(other, "k long, s string").repartition(3).cache()
        want = K.bag_diff_count(a, b, ("k", "s")).first()
        for buckets in (1, 7, 4096) if len(other) == len(rows) + 1 else (7,):
            assert K.bag_diff_by_digests(a, b, ("k", "s"), buckets).first() == want
    # null and a value that hashes as if it were passed over are not the same
    assert K.bag_diff_by_digests(spark.createDataFrame([(None, "1")], "k string, s string"), spark.createDataFrame([("1", None)], "k string, s string"), ("k", "s")).first() == (1, 1)


def test_rows_go_to_few_cubes(spark):
    rng = np.random.RandomState(3)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.uniform(-20, 20, (2000, 3)))], "k long, x double, y double, z double")
    assert K.in_cubes(rows, "", 4.0).count() == 2000 < K.in_cubes(rows, "", 4.0, 1.0).count() < 3.6 * 2000


def test_pairs_of_near_partners_only_are_made(spark, monkeypatch):
    """Rows with a partner near and many others within reach: the matching is that of a plain greedy one, and few pairs are made."""
    rng = np.random.RandomState(4)
    place = rng.uniform(0, 6, (600, 3))
    a = [(i, *map(float, p), 1.0) for i, p in enumerate(place)]
    b = [(1000 + i, *map(float, p + (rng.uniform(-0.02, 0.02, 3) if i % 10 else 0.5)), 1.0 + 0.001 * (i % 4)) for i, p in enumerate(place) if i % 29]
    made, plain = [], K.near_pairs

    def counted(*args, **options):
        made.append(plain(*args, **options).count())
        return plain(*args, **options)

    monkeypatch.setattr(K, "near_pairs", counted)
    fa, fb = (spark.createDataFrame(r, "tag long, x double, y double, z double, mass double") for r in (a, b))
    got = sorted((r.a_key, r.b_key) for r in K.match_remainder(fa, fb, tol=2.5, two_sided=True).collect())
    every = [
        (sum((p[k] - q[k]) * (p[k] - q[k]) for k in (1, 2, 3)), p[0], q[0]) for p in a for q in b if all(abs(p[k] - q[k]) < 2.5 for k in (1, 2, 3)) and abs((p[4] - q[4]) / p[4]) < 0.05
    ]
    assert got == nearest_first(every)
    assert sum(made) < 6 * len(a) < len(every) / 10


def test_bins_are_cut_once(spark):
    """The second table of bins is not cut by the tags again: one semi join for the statistics, and the counts are still those of these tags."""
    a = spark.createDataFrame([(t, k, float(t + k + 1)) for t in range(6) for k in range(3)], "tag long, bin int, m double")
    b = a.where("tag <> 2 OR bin = 0").withColumn("m", F.col("m") * 1.5).unionByName(spark.createDataFrame([(1, 9, 1.0), (5, 9, 1.0)], a.schema))
    tags = spark.createDataFrame([(1,), (2,), (2,), (77,)], "t long")
    stats, counts = K.compare_bins(a, b, tags, ("m",), 1e-3, ("tag", "bin"))
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    row = stats.first()
    assert row.n == 4 and not row.passed and abs(row.mean_diff + 0.5 * (2 + 3 + 4 + 3) / 4) < 1e-12
    assert tuple(counts.first()) == (4, 2, 1)
