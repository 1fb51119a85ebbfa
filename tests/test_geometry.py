import pytest
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators import catalog as C


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_centres_and_orders(spark, nside):
    df = G.with_direction_of_ring(spark.range(12 * nside * nside), "id", nside)
    df = G.with_ring_pixel(df, "vx", "vy", "vz", nside, "back")
    df = G.with_ring_of_nest(G.with_nest_of_ring(df, "id", nside), "nest", nside, "again")
    df = G.with_interpolation(df, "vx", "vy", "vz", nside)
    own = F.expr("aggregate(near, 0D, (a, e) -> a + if(e.pix = id, e.w, 0D))")
    r = df.agg(F.count_if(F.expr("back <> id")), F.count_if(F.expr("again <> id")), F.countDistinct("nest"), F.count_if(F.abs(own - 1) > 1e-9)).first()
    assert tuple(r) == (0, 0, 12 * nside * nside, 0)


def test_random_directions(spark):
    df = spark.range(5000).select(F.randn(1).alias("x"), F.randn(2).alias("y"), F.randn(3).alias("z"))
    df = G.with_interpolation(df, "x", "y", "z", 8)
    df = G.with_nest_pixel(G.with_nest_pixel(df, "x", "y", "z", 8, "p8"), "x", "y", "z", 16, "p16")
    df = G.with_ring_pixel(df, "x", "y", "z", 8, "r8")
    df = G.with_ring_of_nest(df, "p8", 8, "rr")
    w = F.expr("aggregate(near, 0D, (a, e) -> a + e.w)")
    r = df.agg(
        F.count_if(F.abs(w - 1) > 1e-9), F.count_if(F.expr("exists(near, e -> e.w < -1e-12 OR e.pix < 0 OR e.pix >= 768)")), F.count_if(F.expr("shiftright(p16, 2) <> p8")),
        F.count_if(F.expr("rr <> r8")), F.count_if(F.expr("NOT exists(near, e -> e.pix = r8)")),
    ).first()
    assert tuple(r) == (0, 0, 0, 0, 0)


def test_no_direction(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    r = G.with_interpolation(G.with_ring_pixel(df, "x", "y", "z", 4), "x", "y", "z", 4).first()
    assert r["pix"] is None and r["near"] is None


def test_filter_on_a_pixel_stays_above_the_formula(spark):
    df = G.with_ring_pixel(spark.range(10).selectExpr("id + 1D AS x", "1D AS y", "2D AS z"), "x", "y", "z", 8).where("pix > 3")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "atan2" not in next(line for line in plan.lower().splitlines() if "filter" in line)


@pytest.mark.parametrize(("nside", "octant", "edge"), [(1, 0, 1e-12), (4, 1, 1e-12), (16, 0, 0.1), (32, 1, 1e-12), (32, 0, 1e-12)])
def test_octants_by_splitting_border_pixels(spark, nside, octant, edge):
    blocks = C.octant_blocks(spark, nside, octant, edge).collect()
    got = sorted(p for b in blocks for p in range(b.lo, b.hi))
    mask = G.with_nest_of_ring(G.with_direction_of_ring(spark.range(12 * nside * nside).withColumnRenamed("id", "pix"), "pix", nside), "pix", nside)
    up = "vz" if octant == 0 else "-vz"
    inside = mask.where(f"vx >= -{edge} AND vy >= -{edge} AND {up} >= {-edge if edge > 1e-9 else 0.0}")
    assert got == sorted(r.nest for r in inside.select("nest").collect())
    assert len(blocks) < 40 * nside
