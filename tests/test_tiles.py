"""Maps at large nside: summed by tiles of sky, and made dense without a shuffle of what is generated."""

import pytest
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators import maps as M


@pytest.fixture(scope="module")
def rays(spark):
    """Directions all over the sky, the poles and the borders of rings among them."""
    some = spark.range(4000).select(F.col("id"), *[F.randn(7 + k).alias(c) for k, c in enumerate("xyz")])
    exact = spark.createDataFrame([(-1, 0.0, 0.0, 1.0), (-2, 0.0, 0.0, -1.0), (-3, 1.0, 0.0, 0.0), (-4, 0.0, 0.0, 0.0), (-5, 1e-9, -1e-9, 1.0), (-6, -1.0, 0.0, 2 / 3)], "id long, x double, y double, z double")
    rows = some.unionByName(exact)
    return rows.withColumns({"step": (F.col("id") % 2).cast("int"), "phi": F.lit(2.0), "vx": F.lit(1.0), "vy": F.col("x"), "vz": F.lit(0.5)}).cache()


def rounded(df):
    return {(r.step, r.idx): tuple(round(r[c], 6) for c in ("rho", "phi", "vel")) for r in df.where("phi > 1e-9").collect()}


@pytest.mark.parametrize(("nside", "rings"), [(1, 1), (2, 3), (8, 4), (64, 16), (1024, 32)])
def test_same_map(rays, nside, rings):
    want = rounded(M.interp_map(rays, nside))
    assert rounded(M.interp_map(rays, nside, tile_rings=rings)) == want
    assert abs(sum(v[1] for v in want.values()) - 2.0 * rays.where("x <> 0 OR y <> 0 OR z <> 0").count()) < 1e-2


def test_hot_tiles_take_the_other_way(spark, rays):
    crowd = rays.unionByName(spark.range(3000).select("id", F.lit(0).alias("step"), F.lit(2.0).alias("phi"), *[F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 0.3), ("z", 0.2), ("vx", 1.0), ("vy", 1.0), ("vz", 0.5))]), allowMissingColumns=True)
    assert rounded(M.interp_map(crowd, 64, tile_rings=16, hot_rows=1000)) == rounded(M.interp_map(crowd, 64))


def test_rows_are_shuffled_about_once(rays):
    tiled = G.interpolation_tiles(M.off_centre(rays), "x", "y", "z", 1024, ["id"], 32)
    n = rays.where("x <> 0 OR y <> 0 OR z <> 0").count()
    assert n < tiled.count() < 1.15 * n
    assert tiled.select("id", F.inline("near")).groupBy("id").agg(F.sum("w").alias("w"), F.count("*").alias("n")).where("abs(w - 1) > 1e-9 OR n <> 4").count() == 0
    # a pixel belongs to one tile
    assert tiled.select("tile", F.inline("near")).select("tile", "pix").distinct().groupBy("pix").count().where("count > 1").count() == 0
    assert tiled.select("tile").distinct().count() > 2000
    near = G.with_tile(rays, "x", "y", "z", 1024, 32).join(tiled.select("id", F.col("tile").alias("t")), "id")
    assert near.where("tile = t").select("id").distinct().count() > 0.99 * n


def test_one_exchange(rays):
    plan = M.interp_map(rays, 1024, tile_rings=32)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def joined(df, nside):
    """Dense maps by a join with all pixels."""
    have = {}
    for r in df.collect():
        have.setdefault((r.step, r.idx), []).append(r.v or 0.0)
    steps = {r.step for r in df.collect() if r.step is not None}
    return sorted((s, p, v) for s in steps for p in range(12 * nside * nside) for v in have.get((s, p), [0.0]))


@pytest.mark.parametrize("block", [M.BLOCK, 1, 7, 64])
@pytest.mark.parametrize("in_order", [False, True])
def test_gaps_are_filled(spark, block, in_order):
    rows = [(1, 0, 5.0), (1, 1, 6.0), (1, 7, 1.0), (1, 7, 2.0), (1, 47, None), (2, 13, 3.0), (4, 900, 1.0), (5, -1, 1.0), (None, 3, 1.0), (6, None, 2.0), (2, 0, 1.5), (2, 0, 2.5)]
    df = spark.createDataFrame(rows, "step int, idx long, v double")
    got = M.densify(df, 2, in_order=in_order, block=block)
    assert sorted(tuple(r) for r in got.collect()) == joined(df, 2)
    flat = M.densify(df.where("step = 2").select("idx", "v"), 2, None, block=block)
    assert sorted(tuple(r) for r in flat.collect()) == [(p, v) for _, p, v in joined(df.where("step = 2"), 2)]
    assert M.densify(df.where("step > 9"), 2).count() == 0


def test_generated_pixels_are_not_shuffled(spark):
    df = spark.range(50).select((F.col("id") % 2).cast("int").alias("step"), (F.col("id") * 37).alias("idx"), F.lit(1.0).alias("v"))
    lines = M.densify(df, 64)._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert not any("Exchange" in line or "Join" in line for line in lines[:made])
    assert M.densify(df, 64).groupBy("step").agg(F.count("*").alias("n"), F.sum("v").alias("v")).where("n <> 49152 OR v <> 25").count() == 0
