import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.functions import physics as P
from skyloom.operators import catalog as C
from skyloom.operators import compare as K
from skyloom.operators import harmonics as S
from skyloom.operators import histograms as H
from skyloom.operators import maps as M
from skyloom.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_bag_difference_with_next_step(spark):
    rows = [(1, 1, 0), (1, 1, 0), (1, 2, 0), (2, 1, 0), (3, 3, 0)]
    df = spark.createDataFrame(rows, "step int, id long, replication int")
    got = sorted(tuple(r) for r in C.drop_repeated_next_step(df, ("id", "replication")).collect())
    assert got == [(1, 1, 0), (1, 2, 0), (2, 1, 0), (3, 3, 0)]
    report = {r.step: (r.total, r.repeated) for r in C.repeat_report(df).collect()}
    assert report == {1: (3, 1), 2: (1, 0), 3: (1, 0)}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(2000).selectExpr("id", "cast(id % 3 as int) AS step").repartition(parts)
    exact = C.exact_sample(df, 0.1, ("id",))
    assert {r.step: r["count"] for r in exact.groupBy("step").count().collect()} == {0: 67, 1: 67, 2: 67}
    assert exact.agg(F.sum("id")).first()[0] == C.exact_sample(df.repartition(3), 0.1, ("id",)).agg(F.sum("id")).first()[0]
    assert C.hash_sample(df, ("id",), 10).agg(F.sum("id")).first()[0] == C.hash_sample(df.repartition(5), ("id",), 10).agg(F.sum("id")).first()[0]


def test_maps_conserve_weight(spark):
    p = view(spark, SF, "particles")
    total = M.with_motion(p).agg(F.sum("phi"), F.sum("_v"), F.count("*")).first()
    area = 4 * math.pi / 768
    for m in (M.ngp_map(p, 8), M.interp_map(p, 8)):
        r = m.agg(F.sum("phi"), F.sum("vel"), F.sum("rho") * area).first()
        assert [round(float(a), 3) for a in r] == [round(float(b), 3) for b in total]
    gas = M.tsz_totals(p).first()
    hydro = M.hydro_maps(p, 8, quantities=("rho", "tsz"), factors={"tsz": 1.0}).agg(F.sum("tsz")).first()[0]
    assert hydro == pytest.approx(gas.adiabatic, rel=1e-9)
    assert M.sz_map(p, 8).agg(F.sum("tsz")).first()[0] == pytest.approx(gas.adiabatic, rel=1e-9)


def test_power_spectrum_of_one_harmonic(spark):
    n = 16
    df = G.with_direction_of_ring(spark.range(12 * n * n), "id", n)
    # Y_20 is sqrt(5 / 16 pi) (3 z^2 - 1): all power at l = 2, with c_2 = 1 / 5.
    y = df.select(F.col("id").alias("idx"), (F.lit(math.sqrt(5 / (16 * math.pi))) * (3 * F.col("vz") * F.col("vz") - 1)).alias("delta"))
    c = {r.l: r.c_l for r in S.power_spectrum(y, n, 8).collect()}
    assert c[2] == pytest.approx(0.2, rel=1e-2) and max(v for k, v in c.items() if k != 2) < 1e-3
    # Y_21 real part turns with longitude.
    y = df.select(F.col("id").alias("idx"), (F.lit(math.sqrt(15 / (4 * math.pi))) * F.col("vx") * F.col("vz")).alias("delta"))
    c = {r.l: r.c_l for r in S.power_spectrum(y, n, 8).collect()}
    assert c[2] == pytest.approx(0.2, rel=1e-2) and max(v for k, v in c.items() if k != 2) < 1e-3


def test_bins_at_edges(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (9.99,), (10.0,), (float("nan"),), (None,), (-1.5,)], "v double")
    got = [r.b for r in df.select(P.linear_bin(F.col("v"), 0, 10, 10).alias("b")).collect()]
    assert got == [0, 0, 9, None, None, None, None]
    h = H.histogram(df, F.col("v"), 10, 0, 10).collect()
    assert sum(r.n for r in h) == 3 and h[0].fraction == 2 / 7
    edge = [r.b for r in df.select(H.edge_bin(F.col("v"), 0, 10, 10).alias("b")).collect()]
    assert edge == [None, 0, 9, 9, None, None, None]


def test_quality_figures_leave_out_bad_values(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("nan")), (1, 2, float("inf")), (1, 3, 0.0)], "step int, idx long, v double")
    r = M.map_qa(df, ("v",), 1).first()
    assert (r.least, r.most, r.n_zero, r.n_bad, r.pixels_ok) == (0.0, 1.0, 1, 2, False)


def test_repeated_tags_all_go(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 3.0), (2, 4.0)], "t long, v double")
    assert [tuple(r) for r in K.drop_duplicated_keys(df, ("t",)).collect()] == [(1, 1.0)]


def test_nan_verdicts(spark):
    s = spark.createDataFrame([("a", float("nan"), 0.0, 0.0, 1.0, 1.0, 3)], "var string, mean_diff double, std_diff double, max_frac double, mean_q double, std_q double, n long")
    assert K.verdicts(s, 0.1).first().passed is False and K.verdicts(s, 0.1, nan_fails=False).first().passed is True


def test_positions_at_cell_borders(spark):
    a = spark.createDataFrame([(1, 10.0, 0.0499, 0.0, 0.0), (2, 10.0, 1.0, 1.0, 1.0)], "tag long, mass double, x double, y double, z double")
    b = spark.createDataFrame([(7, 10.0, 0.0501, -0.01, 0.02), (8, 20.0, 1.0, 1.0, 1.0), (9, 5.0, 1.01, 1.0, 1.0)], a.schema)
    assert sorted((r.a_key, r.b_key) for r in K.match_by_position(a, b).collect()) == [(1, 7), (2, 8)]
    assert [(r.a_key, r.b_key) for r in K.match_by_position(a, b, two_sided=True).collect()] == [(1, 7)]


@pytest.mark.parametrize("packed_bytes", [M.PACKED_BYTES, 0])
def test_grid_lookup_outside_and_missing(spark, packed_bytes):
    table = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(3) for j in range(2) if (i, j) != (2, 1)], "i int, j int, v double")
    table = table.unionByName(table.where("i = 0"))  # a grid point that is there twice
    nan = float("nan")
    rows = [(1, 0.5, 0.5), (2, -4.0, 9.0), (3, 1.5, 0.5), (4, None, 0.5), (5, 0.5, nan), (6, nan, None), (7, 2.0, 0.0), (8, 1.0, 1.0), (8, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    out = M.grid_interpolate(df, table, {"i": (F.col("x"), 0, 2, 3), "j": (F.col("y"), 0, 1, 2)}, ("v",), ("k",), packed_bytes)
    want = [(1, 5.5), (2, 10.0), (3, None), (4, None), (5, None), (6, None), (7, 2.0), (8, 11.0), (8, 11.0)]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == want
    assert out.where("v > 2 AND k = 1").count() == 1


@pytest.mark.parametrize("packed_bytes", [M.PACKED_BYTES, 0])
def test_grid_lookup_in_five_axes_against_numpy(spark, packed_bytes):
    rng, sizes = np.random.default_rng(3), (3, 2, 4, 3, 5)
    grids = {v: rng.normal(size=sizes) for v in ("v", "w")}
    names = tuple("abcde")
    table = spark.createDataFrame([(*map(int, at), *(float(g[at]) for g in grids.values())) for at in np.ndindex(*sizes)], "a int, b int, c int, d int, e int, v double, w double")
    points = rng.uniform(-0.2, 1.2, (200, 5))
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "k int, " + ", ".join(f"x{n} double" for n in names))
    out = M.grid_interpolate(df, table, {n: (F.col(f"x{n}"), 0.0, 1.0, s) for n, s in zip(names, sizes, strict=True)}, ("v", "w"), ("k",), packed_bytes)
    at = np.clip(points, 0, 1) * (np.array(sizes) - 1)
    low = np.minimum(at.astype(int), np.array(sizes) - 2)
    for r in out.collect():
        f = at[r.k] - low[r.k]
        for v, g in grids.items():
            want = sum(np.prod([x if u else 1 - x for x, u in zip(f, up, strict=True)]) * g[tuple(low[r.k] + up)] for up in np.ndindex(2, 2, 2, 2, 2))
            assert r[v] == pytest.approx(want, abs=1e-12)
    assert out.count() == 200


def test_luminosities_cost_one_exchange(spark):
    names = [*"xyz", "vx", "vy", "vz", "phi", "a", "mass", "uu", "mu", "rho", "zmet", "yhe"]
    df = spark.range(8).select(*[F.lit(1.0 + k).alias(n) for k, n in enumerate(names)], F.lit(0.5).alias("a2"), F.lit(4).alias("mask"), F.lit(1).alias("step")).drop("a").withColumnRenamed("a2", "a")
    axes = {"a": (0.0, 1.0, 3), "t": (2.0, 9.0, 4)}
    table = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(4)], "a int, t int, xray4 double")
    lum = M.with_luminosities(df, table, axes, ("xray4",))
    assert "Exchange" not in [w for line in lum._jdf.queryExecution().executedPlan().toString().split("Broadcast")[0].splitlines() for w in line.split() if w == "Exchange"]
    # nothing but gas of a positive temperature has one
    for change in ({"mask": F.lit(3)}, {"uu": F.lit(0.0)}, {"mu": F.lit(-1.0)}):
        assert M.with_luminosities(df.withColumns(change), table, axes, ("xray4",)).where("xray4 IS NOT NULL").count() == 0
    assert lum.where("xray4 > 0").count() == 8


def test_wide_steps(spark):
    rules = spark.createDataFrame([(9, 1, 0.5, None)], "target int, source int, lo double, hi double")
    df = spark.createDataFrame([(1, 0.4), (1, 0.6), (2, 0.9)], "step int, a double")
    assert sorted(tuple(r) for r in C.substitute_steps(df, rules).collect()) == [(1, 0.4), (2, 0.9), (9, 0.6)]


def test_repeated_halos_are_paired_once(spark):
    columns = ["tag", "sod_halo_mass", "sod_halo_cdelta", "sod_halo_radius", *[f"fof_halo_center_{c}" for c in "xyz"]]
    a = spark.createDataFrame([(1, 2e12, 5.0, 1.0, 0.0, 0.0, 0.0)] * 2 + [(2, 3e12, 4.0, 1.0, 9.0, 9.0, 9.0)], columns)
    b = spark.createDataFrame([(1, 2e12, 5.0, 1.0, 0.0, 0.0, 0.0)] * 2 + [(2, 6e12, 4.0, 1.0, 9.0, 9.0, 9.0)], columns)
    got = {r["var"]: (r.n, r.n_above, r["mean"]) for r in K.ratio_stats(a, b, 1e12, tag="tag").collect()}
    assert got["mass"] == (3, 1, pytest.approx(1 / 3)) and got["shift"][0] == 3
    place = "tag long, x double, y double, z double, mass double"
    a = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)] * 2 + [(5, 7.0, 7.0, 7.0, 1.0)], place)
    # 3 and 4 are as far from 5, and 3 stands twice
    b = spark.createDataFrame([(4, 7.03125, 7.0, 7.0, 1.0), (3, 6.96875, 7.0, 7.0, 1.0), (3, 6.96875, 7.0, 7.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0)], place)
    assert sorted(tuple(r)[:2] for r in K.match_by_position(a, b).collect()) == [(1, 2), (5, 3)]


def test_remainder_is_matched_too(spark):
    place = "tag long, x double, y double, z double, mass double"
    # 1 and 2 both have 11 as their nearest; 2 loses it and takes 12
    a = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1.0), (2, 1.02, 0.0, 0.0, 1.0), (3, 9.0, 9.0, 9.0, 1.0)], place)
    b = spark.createDataFrame([(11, 1.005, 0.0, 0.0, 1.0), (12, 1.04, 0.0, 0.0, 1.0), (13, 5.0, 5.0, 5.0, 1.0)], place)
    assert [tuple(r)[:2] for r in K.match_by_position(a, b).collect()] == [(1, 11)]
    assert sorted(tuple(r)[:2] for r in K.match_remainder(a, b).collect()) == [(1, 11), (2, 12)]
    stats, counts = K.match_report(a, b, ("x", "mass"), 0.1)
    assert tuple(counts.first()) == (2, 1, 1)
    assert {r["var"]: (r.n, round(r.mean_diff, 4)) for r in stats.collect()} == {"x": (2, -0.0125), "mass": (2, 0.0)}
    assert K.match_remainder(a.limit(0), b).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 5001])
def test_median_is_exact(spark, n):
    rows = spark.range(n).selectExpr("1 AS step", "id AS idx", "cast((id * 7919) % 104729 AS double) AS v", "cast(id % 3 AS double) AS w", "cast(null AS double) AS none")
    got = {r["map"]: r["median"] for r in M.map_median(rows, ("v", "w", "none")).collect()}
    want = rows.agg(F.median("v"), F.median("w")).first()
    assert got == {"v": want[0], "w": want[1]}


def test_offsets_over_blocks(spark):
    rows = spark.range(1000).selectExpr("id * id % 97 AS pix", "cast(id % 2 AS int) AS step")
    assert sorted(map(tuple, C.pixel_offsets(rows, block_pixels=5).collect())) == sorted(map(tuple, C.pixel_offsets(rows).collect()))
    last = C.pixel_offsets(rows, block_pixels=5).groupBy("step").agg(F.max(F.col("start_idx") + F.col("count_idx"))).collect()
    assert sorted(tuple(r) for r in last) == [(0, 500), (1, 500)]


def test_luminosity_by_a_table(spark):
    table = spark.createDataFrame([(i, j, -23.0 + i + 2 * j) for i in range(2) for j in range(2)], "nh int, t int, band double")
    row = spark.createDataFrame([(1e11, 1e6, 0.01, 0.24, 0.5, 1e5, 0.6, 4)], "mass double, rho double, zmet double, yhe double, a double, uu double, mu double, mask int")
    got = M.with_luminosities(row, table, {"nh": (-12.0, -8.0, 2), "t": (4.0, 8.0, 2)}, ("band",)).first()
    k = P.Constants()
    n_h = 1e6 * k.solar_mass / k.megaparsec**3 * k.hubble**2 / 0.125 * 0.75 / k.proton_mass
    t = 2 / 3 * k.proton_mass / k.boltzmann * 1e10 * 0.6 * 1e5 * 0.25
    log = -23 + (math.log10(n_h) + 12) / 4 + 2 * (math.log10(t) - 4) / 4
    assert got.band == pytest.approx(1e5 * k.megaparsec**3 / k.hubble**3 * 0.125 * n_h**2 * 10**log, rel=1e-9)
