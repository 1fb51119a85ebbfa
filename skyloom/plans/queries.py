"""Queries by name: (function of (spark, sf_dir), DuckDB SQL). Names start with the operators they show."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import physics as P
from ..operators import catalog as C
from ..operators import compare as K
from ..operators import harmonics as S
from ..operators import histograms as H
from ..operators import maps as M
from .fixtures import view, with_views
from .sql import AREA, NSIDE, centres, interpolation, nest, rings, ring, sig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sig(with_views(sql, *ctes))
        return f

    return add


def single(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in single precision: sums of doubles depend on their order only far below it."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


KEYS = ("id", "replication")
LC = ("x", "y", "z", "vx", "vy", "vz", "a", "phi")
TIE = ("phi", "x", "y", "z", "vx", "vy", "vz", "mass", "mask")
MAP = ("rho", "vel", "phi")

# Particle rows less those that stand in the next step, as a bag.
KEPT = f"""kept AS (SELECT p.* EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY step, id, replication ORDER BY {", ".join(TIE)}) AS nth FROM $particles) p
  LEFT JOIN (SELECT step - 1 AS s, id AS i, replication AS r, count(*) AS again FROM $particles GROUP BY 1, 2, 3) n ON p.step = n.s AND p.id = n.i AND p.replication = n.r
  WHERE nth > coalesce(again, 0))"""
VLOS = "(vx*x + vy*y + vz*z)/sqrt(x*x + y*y + z*z)"


@query(
    f"""SELECT s.step, p.idx, SIG(coalesce(rho, 0)) AS rho, SIG(coalesce(m.phi, 0)) AS phi, SIG(coalesce(vel, 0)) AS vel, coalesce(n, 0)::BIGINT AS n
FROM (SELECT DISTINCT step FROM m) s CROSS JOIN range({12 * NSIDE * NSIDE}) p(idx) LEFT JOIN m ON m.step = s.step AND m.idx = p.idx""",
    KEPT,
    ring("kept", "px", NSIDE),
    f"m AS (SELECT step, ring AS idx, count(*)/{AREA} AS rho, sum(phi) AS phi, sum({VLOS}) AS vel, count(*) AS n FROM px GROUP BY 1, 2)",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense nearest-pixel maps for each step, particles that come again in the next step left out."""
    kept = C.drop_repeated_next_step(view(spark, sf_dir, "particles"), KEYS, TIE)
    return single(M.densify(M.ngp_map(kept, NSIDE), NSIDE), "rho", "phi", "vel")


@query("SELECT * FROM kept", KEPT)
def j7_drop_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed bag difference with the next step."""
    return C.drop_repeated_next_step(view(spark, sf_dir, "particles"), KEYS, TIE)


@query(
    """SELECT a.step, sum(n)::BIGINT AS total, sum(least(n, coalesce(m, 0)))::BIGINT AS repeated, sum(least(n, coalesce(m, 0)))::DOUBLE/sum(n)::DOUBLE AS fraction
FROM c a LEFT JOIN (SELECT step - 1 AS step, id, replication, n AS m FROM c) b USING (step, id, replication) GROUP BY a.step""",
    "c AS (SELECT step, id, replication, count(*) AS n FROM $particles GROUP BY ALL)",
)
def a32_repeat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a step stand in the next one again."""
    return C.repeat_report(view(spark, sf_dir, "particles"))


@query(
    f"""SELECT id, replication, step, SIG(x*x + y*y + z*z) AS d2, SIG({VLOS}) AS vlos, SIG(sqrt(vx*vx + vy*vy + vz*vz)) AS speed,
SIG((2e0/3*1.672621637e-24/1.3806488e-16*1e10)*mu*uu*a*a) AS temperature, SIG(mass/rho*3.085677581e24^3*(a*a*a)/0.6766e0^3/1e70) AS volume, SIG(1 - yhe - zmet) AS hydrogen, SIG(yhe/(1 - yhe - zmet)/(1 + yhe/(1 - yhe - zmet))) AS helium_ratio,
SIG(rho*(1.98892e33/3.085677581e24^3*0.6766e0^2)/(a*a*a)*(1 - yhe - zmet)/1.672621637e-24) AS n_h,
SIG(mass*mu*uu/(x*x + y*y + z*z)) AS tsz, SIG(mass*{VLOS}/((x*x + y*y + z*z)*a)) AS ksz, SIG(2*mass*mu*uu/(x*x + y*y + z*z)) AS tsz_ne,
SIG(1e44*a*a*0.6766e0^2/((x*x + y*y + z*z)*3.085677581e24^2)) AS flux, -z AS mirrored, CAST(CAST(phi AS FLOAT) AS DOUBLE) AS phi32, mask & 4 <> 0 AS gas
FROM $particles""",
)
def p_particle_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of one particle."""
    df = M.with_motion(C.mirrored(view(spark, sf_dir, "particles")).withColumn("mirrored", F.col("z")).withColumn("z", -F.col("z")))
    c = F.col
    state = P.gas_state(c("mass"), c("rho"), c("zmet"), c("yhe"), c("a"))
    args = [c(n) for n in ("mass", "mu", "uu", "a", "_d2", "_v")]
    tsz, ksz = P.sz_weights(*args)
    out = df.select(
        *KEYS, "step", c("_d2").alias("d2"), c("_v").alias("vlos"), P.speed(c("vx"), c("vy"), c("vz")).alias("speed"),
        P.gas_temperature(c("uu"), c("mu"), c("a")).alias("temperature"), (state["volume"] / F.lit(1e70)).alias("volume"), *[state[n].alias(n) for n in ("hydrogen", "helium_ratio", "n_h")],
        tsz.alias("tsz"), ksz.alias("ksz"), P.sz_weights(*args, mode="ne", electrons=F.lit(2.0))[0].alias("tsz_ne"),
        P.xray_flux(F.lit(1e44), c("_d2"), c("a")).alias("flux"), "mirrored", c("phi").cast("float").cast("double").alias("phi32"), P.has_bit(c("mask")).alias("gas"),
    )
    return single(out, "d2", "vlos", "speed", "temperature", "volume", "hydrogen", "helium_ratio", "n_h", "tsz", "ksz", "tsz_ne", "flux")


@query(
    """SELECT k, CASE WHEN fof_halo_tag < 0 THEN (-fof_halo_tag) & 281474976710655 ELSE fof_halo_tag END AS tag,
SIG(sqrt(fof_halo_angmom_x^2 + fof_halo_angmom_y^2 + fof_halo_angmom_z^2)/fof_halo_mass) AS spin,
SIG(sqrt(fof_halo_angmom_x^2 + fof_halo_angmom_y^2 + fof_halo_angmom_z^2)/sqrt(fof_halo_center_x^2 + fof_halo_center_y^2 + fof_halo_center_z^2)) AS ratio1,
SIG(sqrt(fof_halo_com_vx^2 + fof_halo_com_vy^2 + fof_halo_com_vz^2)/sqrt(fof_halo_center_x^2 + fof_halo_center_y^2 + fof_halo_center_z^2)) AS ratio2,
nullif(sod_halo_mass, -101e0) AS sod_mass, fof_halo_center_x AS x, fof_halo_mass AS mass FROM $halos_a""",
)
def p_halo_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, spin, axis ratios, missing values and short names of halos."""
    from ..sources.schema import SHORT

    h = view(spark, sf_dir, "halos_a")
    eig = {f"e{i}{c}": F.col(n) for i, names in ((1, "angmom_{}"), (2, "com_v{}"), (3, "center_{}")) for c in "XYZ" for n in [f"fof_halo_{names.format(c.lower())}"]}
    r1, r2 = P.axis_ratios("e")
    h = h.withColumns(eig).select(
        "k", P.decode_tag(F.col("fof_halo_tag")).alias("tag"), P.spin(*[F.col(f"fof_halo_angmom_{c}") for c in "xyz"], F.col("fof_halo_mass")).alias("spin"),
        r1.alias("ratio1"), r2.alias("ratio2"), P.null_if_fill(F.col("sod_halo_mass")).alias("sod_mass"), "fof_halo_center_x", "fof_halo_mass",
    )
    return single(h.withColumnsRenamed(SHORT), "spin", "ratio1", "ratio2")


@query(
    f"""SELECT p.id, p.replication, p.step, p.ring, q.nest, q.nest // 16 AS parent,
CASE WHEN gx = 150e0 THEN 0 ELSE CAST(floor(gx/(150e0/256)) AS BIGINT) END % 256 * 256 + CAST(floor(gy/(150e0/256)) AS BIGINT) % 256 AS grid,
CAST(floor(p.x/0.05e0) AS BIGINT) AS cx FROM (SELECT *, CASE WHEN x < 0 THEN x + 150e0 ELSE x END AS gx, CASE WHEN y < 0 THEN y + 150e0 ELSE y END AS gy FROM rn) p
JOIN nn q ON p.row = q.row""",
    "src AS (SELECT *, row_number() OVER () AS row FROM (SELECT DISTINCT id, replication, step, x, y, z FROM $particles))",
    ring("src", "rn", NSIDE),
    nest("src", "nn", NSIDE),
)
def p_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and cells of a position, in both orders and on the flat grid."""
    df = view(spark, sf_dir, "particles").select(*KEYS, "step", "x", "y", "z").distinct()
    df = G.with_ring_pixel(df, "x", "y", "z", NSIDE, "ring")
    df = G.with_nest_of_ring(df, "ring", NSIDE, "nest")
    return df.select(*KEYS, "step", "ring", "nest", G.parent_pixel("nest", 2).alias("parent"), G.grid_pixel(F.col("x"), F.col("y"), 150.0, 256).alias("grid"), G.cell3d(F.col("x"), F.col("y"), F.col("z"), 0.05)["cx"].alias("cx"))


@query(
    "SELECT pix, round(px, 9) + 0 AS px, round(py, 9) + 0 AS py, round(pz, 9) + 0 AS pz, nest, pix AS again, n FROM nn JOIN (SELECT ring AS pix, count(*) AS n FROM rn GROUP BY 1) USING (pix)",
    rings(NSIDE),
    centres(NSIDE),
    nest("pixels", "nn", NSIDE, "px", "py", "pz"),
    ring("$particles", "rn", NSIDE),
)
def p15_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre of every pixel that holds particles, and the way from RING to NESTED and back."""
    pixels = G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", NSIDE).groupBy("pix").agg(F.count("*").alias("n"))
    df = G.with_direction_of_ring(pixels, "pix", NSIDE, ("px", "py", "pz"))
    df = G.with_ring_of_nest(G.with_nest_of_ring(df, "pix", NSIDE), "nest", NSIDE, "again")
    return df.select("pix", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("px", "py", "pz")], "nest", "again", "n")


@query(
    f"SELECT step, pix AS idx, SIG(sum(w)/{AREA}/2) AS rho, SIG(sum(w*phi)/2) AS phi, SIG(sum(w*{VLOS})/2) AS vel FROM it GROUP BY ALL HAVING sum(w) > 1e-9",
    rings(NSIDE),
    interpolation("$particles", "it", NSIDE),
)
def a14_interp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gravity-only maps over four pixels."""
    out = M.interp_map(view(spark, sf_dir, "particles"), NSIDE, 2.0)
    return single(out.where(F.col("rho") * (4 * math.pi / (12 * NSIDE * NSIDE)) * 2 > 1e-9), "rho", "phi", "vel")


#: A map with many more pixels than a task has rows, and the bands of rings by which its rows are dealt out.
FINE, RINGS = 1024, 32


def fine(df: DataFrame, **units: tuple[float, int]) -> DataFrame:
    """Columns in these units, to so many digits. At this nside a weight is the small difference of two large numbers, so its error is absolute and single precision would show it."""
    return df.withColumns({c: F.round(F.col(c) / F.lit(u), n) + F.lit(0.0) for c, (u, n) in units.items()})


@query(
    "SELECT step, pix AS idx, round(sum(w), 5) + 0e0 AS rho, round(sum(w*phi)/1e4, 5) + 0e0 AS phi, round(sum(w*{v})/1e2, 5) + 0e0 AS vel FROM it GROUP BY ALL HAVING sum(w) > 1e-6".format(v=VLOS),
    rings(FINE),
    interpolation("$particles", "it", FINE),
)
def a14_fine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gravity-only maps over four pixels at nside 1,024, each particle shuffled once to the tile of its pixels."""
    area = 4 * math.pi / (12 * FINE * FINE)
    out = M.interp_map(view(spark, sf_dir, "particles"), FINE, tile_rings=RINGS)
    return fine(out.where(F.col("rho") * area > 1e-6), rho=(1 / area, 5), phi=(1e4, 5), vel=(1e2, 5))


@query(
    f"SELECT step, nest AS idx, SIG(count(*)*4/{AREA}) AS rho, SIG(sum(phi)) AS phi, SIG(sum({VLOS})) AS vel, count(*) AS n FROM nn GROUP BY ALL",
    nest("$particles", "nn", 2 * NSIDE),
)
def a12_nested_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-pixel maps in NESTED order."""
    return single(M.ngp_map(view(spark, sf_dir, "particles"), 2 * NSIDE, order="nest"), "rho", "phi", "vel")


HYDRO_SQL = """SIG(sum(w*mass)/{area}) AS rho, SIG(sum(w*mass*phi)) AS phi, SIG(sum(w*mass*{v})) AS vel,
SIG(sum(CASE WHEN mask & 4 <> 0 THEN w*mass*mu*uu/(x*x + y*y + z*z) ELSE 0 END)) AS tsz, SIG(sum(CASE WHEN mask & 4 <> 0 THEN w*mass*{v}/((x*x + y*y + z*z)*a) ELSE 0 END)) AS ksz"""
UNIT = {"tsz": 1.0, "ksz": 1.0, "xray": 1.0}


@query(
    f"""SELECT step, pix AS idx, {HYDRO_SQL.format(area=AREA, v=VLOS)},
SIG(sum(CASE WHEN mask & 4 <> 0 THEN w*1e44*mu*a*a*0.6766e0^2/((x*x + y*y + z*z)*3.085677581e24^2) ELSE 0 END)) AS xray4,
SIG(sum(CASE WHEN mask & 4 <> 0 THEN w*1e44*mu*a*a*0.6766e0^2/((x*x + y*y + z*z)*3.085677581e24^2)*(2e0/3*1.672621637e-24/1.3806488e-16*1e10)*mu*uu*a*a ELSE 0 END)) AS temp
FROM it GROUP BY ALL HAVING sum(w) > 1e-9""",
    rings(NSIDE),
    interpolation("$particles", "it", NSIDE),
)
def a15_hydro_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hydro maps with a bolometric band given as a Column."""
    q = ("rho", "phi", "vel", "tsz", "ksz", "xray4", "temp")
    p = view(spark, sf_dir, "particles")
    return single(M.hydro_maps(p, NSIDE, quantities=q, factors=UNIT, bands={"xray4": F.lit(1e44) * F.col("mu")}, least=1e-9), *q)


@query(
    f"""SELECT step, pix AS idx, round(sum(w*mass)/1e11, 5) + 0e0 AS rho, round(sum(CASE WHEN mask & 4 <> 0 THEN w*mass*mu*uu/(x*x + y*y + z*z) ELSE 0 END)/1e14, 5) + 0e0 AS tsz,
round(sum(CASE WHEN mask & 4 <> 0 THEN w*mass*{VLOS}/((x*x + y*y + z*z)*a) ELSE 0 END)/1e11, 5) + 0e0 AS ksz FROM it GROUP BY ALL HAVING sum(w) > 1e-6""",
    rings(FINE),
    interpolation("$particles", "it", FINE),
)
def a15_fine_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydro maps at nside 1,024 by tiles."""
    out = M.hydro_maps(view(spark, sf_dir, "particles"), FINE, quantities=("rho", "tsz", "ksz"), factors=UNIT, least=1e-6, tile_rings=RINGS)
    return fine(out, rho=(1e11 / (4 * math.pi / (12 * FINE * FINE)), 5), tsz=(1e14, 5), ksz=(1e11, 5))


#: A grid of log10(L / nH^2): range and points of each axis, and the slopes over the indices of each band.
GRID5 = {"a": (0.4, 1.1, 3), "yp": (0.2, 0.4, 3), "r": (0.0, 2.0, 3), "nh": (-12.0, -8.0, 4), "t": (2.0, 8.0, 4)}
SLOPES = {"xray1": (1, 2, 3, 4, 5), "xray2": (5, 4, 3, 2, 1), "xray3": (2, 0, 1, 0, 4), "xray4": (3, 1, 4, 1, 5)}
AT5 = {"a": "a", "yp": "yy/(1 + yy)", "r": "0.7381e0/0.0134e0*zmet/xh", "nh": "log10(nh)", "t": "log10(tk)"}


def log_table_sql(band: str) -> str:
    parts = [f"{w}e-1*least(greatest(({AT5[n]} - ({lo!r}))/(({hi!r} - ({lo!r}))/{k - 1}e0), 0e0), {k - 1}e0)" for w, (n, (lo, hi, k)) in zip(SLOPES[band], GRID5.items(), strict=True)]
    return f"pow(10e0, -23e0 + {' + '.join(parts)})"


#: Of a pixel and a sampled share of 1/2; Thomson cross-section, electron mass and light speed in CGS; helium mass share 0.24, fully ionised.
ELECTRONS = f"(6.6524587158e-25/(2e0/(2 - 0.24e0))*1.98892e33/3.085677581e24^2*0.6766e0/(0.5e0*{AREA}))"
FLUX = "aa*0.6766e0^2/(d2*3.085677581e24^2)"


@query(
    f"""SELECT step, pix AS idx, SIG(sum(w*mass)/{AREA}) AS rho, SIG(sum(w*gas*mass*mu*uu/d2)*(2e0/3)*{ELECTRONS}/(9.10938356e-28*2.99792458e10^2)*1e10) AS tsz,
SIG(0 - sum(w*gas*mass*{VLOS}/(d2*a))*{ELECTRONS}/1.672621637e-24*1e5/2.99792458e10) AS ksz,
{", ".join(f"SIG(sum(w*gas*l_{b}*{FLUX})/(0.5e0*{AREA}*4*pi())) AS {b}" for b in SLOPES)}, SIG(sum(w*gas*tk*l_xray4*{FLUX})) AS temp
FROM it GROUP BY ALL HAVING sum(w) > 1e-9""",
    """st AS (SELECT *, CASE WHEN mask & 4 <> 0 THEN 1e0 ELSE 0e0 END AS gas, a*a AS aa, x*x + y*y + z*z AS d2, 1 - yhe - zmet AS xh, yhe/(1 - yhe - zmet) AS yy, (2e0/3*1.672621637e-24/1.3806488e-16*1e10)*mu*uu*a*a AS tk,
  rho*(1.98892e33/3.085677581e24^3*0.6766e0^2)/(a*a*a)*(1 - yhe - zmet)/1.672621637e-24 AS nh, mass/rho*3.085677581e24^3*(a*a*a)/0.6766e0^3 AS vol FROM $particles)""",
    f"lum AS (SELECT *, {', '.join(f'vol*nh*nh*{log_table_sql(b)} AS l_{b}' for b in SLOPES)} FROM st)",
    rings(NSIDE),
    interpolation("lum", "it", NSIDE),
)
def a15_xray_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bands from a table of five axes, with the real unit factors; the table is linear in its indices, so the luminosities are known."""
    table = spark.range(1)
    for n, (_, _, k) in GRID5.items():
        table = table.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    table = table.select(*GRID5, *[(F.lit(-23.0) + sum(F.lit(w / 10) * F.col(n) for n, w in zip(GRID5, SLOPES[b], strict=True))).alias(b) for b in SLOPES])
    p = M.with_luminosities(view(spark, sf_dir, "particles"), table, GRID5, tuple(SLOPES))
    q = ("rho", "tsz", "ksz", *SLOPES, "temp")
    return single(M.hydro_maps(p, NSIDE, sample_rate=0.5, quantities=q, bands={b: F.col(b) for b in SLOPES}, least=1e-9), *q)


CUT = """cut AS (SELECT p.* FROM $particles p JOIN (
  SELECT fof_halo_tag AS t, max(struct_pack(m := sod_halo_mass, x := fof_halo_center_x, y := fof_halo_center_y, z := fof_halo_center_z, r := sod_halo_radius)) AS h
  FROM $halos_a WHERE sod_halo_mass > 5e11 GROUP BY 1) h ON p.fof_halo_tag = h.t
  WHERE sqrt((x - h.x)^2 + (y - h.y)^2 + (z - h.z)^2) >= 300*h.r)"""


@query("SELECT id, replication, step, x, y, z FROM cut", CUT)
def j8_halo_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles in the outskirts of heavy halos."""
    return C.halo_cut(view(spark, sf_dir, "particles"), view(spark, sf_dir, "halos_a"), 5e11, 300.0).select(*KEYS, "step", "x", "y", "z")


@query(f"SELECT step, pix AS idx, {HYDRO_SQL.format(area=AREA, v=VLOS)} FROM it GROUP BY ALL HAVING sum(w) > 1e-9", rings(NSIDE), CUT, interpolation("cut", "it", NSIDE))
def a19_halo_cut_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydro maps of the halo cut."""
    q = ("rho", "phi", "vel", "tsz", "ksz")
    cut = C.halo_cut(view(spark, sf_dir, "particles"), view(spark, sf_dir, "halos_a"), 5e11, 300.0)
    return single(M.hydro_maps(cut, NSIDE, quantities=q, factors=UNIT, least=1e-9), *q)


T_K = "(2e0/3*1.672621637e-24/1.3806488e-16*1e10)*mu*uu*a*a"


@query(
    f"""SELECT SIG(avg(a)) AS mean_a, min(a) AS min_a, max(a) AS max_a, SIG(avg({T_K})) AS mean_temperature, SIG(min({T_K})) AS min_temperature, SIG(max({T_K})) AS max_temperature,
SIG(avg(mu)) AS mean_mu, min(mu) AS min_mu, max(mu) AS max_mu, count(*) AS n FROM $particles WHERE mask & 4 <> 0""",
)
def a20_gas_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the gas."""
    return single(M.gas_summary(view(spark, sf_dir, "particles")), "mean_a", "mean_temperature", "min_temperature", "max_temperature", "mean_mu")


@query(
    f"""SELECT SIG(avg(a)) AS mean_a, min(a) AS min_a, max(a) AS max_a, SIG(avg({T_K})) AS mean_temperature, SIG(min({T_K})) AS min_temperature, SIG(max({T_K})) AS max_temperature,
SIG(avg(mu)) AS mean_mu, min(mu) AS min_mu, max(mu) AS max_mu, count(*) AS n FROM cut WHERE mask & 4 <> 0""",
    CUT,
)
def a20_halo_gas_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the gas in the outskirts of heavy halos."""
    cut = C.halo_cut(view(spark, sf_dir, "particles"), view(spark, sf_dir, "halos_a"), 5e11, 300.0)
    return single(M.gas_summary(cut), "mean_a", "mean_temperature", "min_temperature", "max_temperature", "mean_mu")


@query(
    """SELECT SIG(sum(mass*mu*uu/(x*x + y*y + z*z))) AS adiabatic, SIG(sum(mass*0.59e0*uu/(x*x + y*y + z*z))) AS constant_mu, SIG(sum(2*mass*mu*uu/(x*x + y*y + z*z))) AS ne
FROM $particles WHERE mask & 4 <> 0""",
)
def a37_tsz_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particle totals of the thermal effect."""
    return single(M.tsz_totals(view(spark, sf_dir, "particles"), electrons=F.lit(2.0)), "adiabatic", "constant_mu", "ne")


@query(
    f"SELECT ring AS idx, SIG(sum(mass*mu*uu/(x*x + y*y + z*z))) AS tsz, SIG(sum(mass*{VLOS}/((x*x + y*y + z*z)*a))) AS ksz FROM rn GROUP BY 1",
    "gas AS (SELECT * FROM $particles WHERE mask & 4 <> 0)",
    ring("gas", "rn", NSIDE),
)
def a22_sz_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SZ map over all steps."""
    return single(M.sz_map(view(spark, sf_dir, "particles"), NSIDE), "tsz", "ksz")


GRID = """g AS (SELECT CAST(floor((CASE WHEN x < 0 THEN x + 150e0 ELSE x END)/(150e0/64)) AS BIGINT) % 64 * 64 + CAST(floor((CASE WHEN y < 0 THEN y + 150e0 ELSE y END)/(150e0/64)) AS BIGINT) % 64 AS idx, *
  FROM $particles WHERE mask & 4 <> 0)"""


@query("SELECT idx, SIG(sum(mass*mu*uu)/3) AS tsz, SIG(sum(mass*vz/a)/3) AS ksz FROM g GROUP BY 1", GRID)
def a23_sz_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SZ map on the flat periodic grid."""
    return single(M.sz_grid(view(spark, sf_dir, "particles"), 150.0, 64, {"tsz": 1 / 3, "ksz": 1 / 3}), "tsz", "ksz")


@query(
    """SELECT step, min(a) AS min_a, max(a) AS max_a, min(mu) AS min_mu, max(mu) AS max_mu, min(mass) AS min_mass, max(mass) AS max_mass, min(uu) AS min_uu, max(uu) AS max_uu,
SIG(min(x*x + y*y + z*z)) AS min_d2, SIG(max(x*x + y*y + z*z)) AS max_d2 FROM $particles GROUP BY 1""",
)
def a25_step_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the input of each step."""
    return single(M.step_ranges(view(spark, sf_dir, "particles")), "min_d2", "max_d2")


UNPIVOT = "u AS (SELECT step, unnest(['rho', 'vel', 'phi']) AS map, unnest([rho, vel, phi]::DOUBLE[]) AS v FROM $map_sparse)"
DENSE = """dense AS (SELECT s.step, p.idx, coalesce(rho, 0)::DOUBLE AS rho, coalesce(vel, 0)::DOUBLE AS vel, coalesce(phi, 0)::DOUBLE AS phi
  FROM (SELECT DISTINCT step FROM $map_sparse) s CROSS JOIN range(768) p(idx) LEFT JOIN $map_sparse m ON m.step = s.step AND m.idx = p.idx)"""


@query("SELECT step, idx, SIG(rho) AS rho, SIG(vel) AS vel, SIG(phi) AS phi FROM dense", DENSE)
def a13_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of every step."""
    return single(M.densify(view(spark, sf_dir, "map_sparse"), NSIDE), *MAP)


@query("SELECT map, SIG(sum(v)) AS total, SIG(min(v)) AS least, SIG(max(v)) AS most, count(*) FILTER (v <> 0) AS n_nonzero FROM u GROUP BY 1", UNPIVOT)
def a16_map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and ranges of maps."""
    return single(M.map_summary(view(spark, sf_dir, "map_sparse"), MAP), "total", "least", "most")


@query("SELECT step, count(*) AS n, count(*) FILTER (mask & 4 <> 0) AS n_gas FROM $particles GROUP BY 1")
def a16_particle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles and gas particles of each step."""
    return M.particle_counts(view(spark, sf_dir, "particles"))


@query(
    """SELECT step, map, SIG(min(v)) AS least, SIG(max(v)) AS most, SIG(avg(v)) AS mean, SIG(stddev_pop(v)) AS std, count(*) FILTER (v = 0) AS n_zero, 0::BIGINT AS n_bad,
count(*) = 768 AS pixels_ok FROM (SELECT step, unnest(['rho', 'vel', 'phi']) AS map, unnest([rho, vel, phi]) AS v FROM dense) GROUP BY ALL""",
    DENSE,
)
def a17_map_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of each step and map."""
    return single(M.map_qa(M.densify(view(spark, sf_dir, "map_sparse"), NSIDE), MAP, NSIDE), "least", "most", "mean", "std")


@query("SELECT idx, SIG(sum(rho)) AS rho, SIG(sum(vel)) AS vel, SIG(sum(phi)) AS phi FROM $map_sparse GROUP BY 1")
def a18_stack_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps summed over steps."""
    return single(M.stack_maps(view(spark, sf_dir, "map_sparse"), MAP), *MAP)


@query("SELECT CAST((step > 1993)::INT + (step > 1995)::INT AS INT) AS slice, idx, SIG(sum(rho)) AS rho, SIG(sum(vel)) AS vel, SIG(sum(phi)) AS phi FROM $map_sparse GROUP BY ALL")
def a36_sliced_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps summed over slices of steps."""
    return single(M.stack_maps(view(spark, sf_dir, "map_sparse"), MAP, [1993, 1995]), *MAP)


@query("SELECT map, SIG(median(v)) AS median FROM u GROUP BY 1", UNPIVOT)
def a35_map_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of maps."""
    return single(M.map_median(view(spark, sf_dir, "map_sparse"), MAP), "median")


@query("SELECT map, SIG(sqrt(sum(v*v))/768) AS rms FROM u GROUP BY 1", UNPIVOT)
def a24_map_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of the sum of squares over the number of pixels."""
    return single(M.map_rms(view(spark, sf_dir, "map_sparse"), MAP, 768), "rms")


@query("SELECT CAST(idx // 48 AS INT) AS block, SIG(sum(rho)) AS rho, SIG(sum(vel)) AS vel, SIG(sum(phi)) AS phi FROM $map_sparse GROUP BY 1")
def a24_block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in 16 equal blocks of pixels."""
    return single(M.block_sums(view(spark, sf_dir, "map_sparse"), MAP, 768), *MAP)


@query(
    """SELECT m.step, (count(*) - count(b.idx) + (SELECT count(*) FROM f) - count(b.idx))::BIGINT AS n_mismatch FROM $map_sparse m LEFT JOIN f b USING (idx) GROUP BY 1""",
    "f AS (SELECT DISTINCT idx FROM $map_sparse WHERE step = (SELECT min(step) FROM $map_sparse))",
)
def j13_pixel_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that a step and the first one do not share."""
    return M.pixel_mismatch(view(spark, sf_dir, "map_sparse"))


@query("SELECT s::INT AS step FROM range(1990, 2001) r(s) WHERE s NOT IN (SELECT step FROM $map_sparse)")
def s10_missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without rows."""
    return C.missing_steps(view(spark, sf_dir, "map_sparse"), 1990, 2000)


@query(
    f"""SELECT step, idx, SIG(CASE WHEN rho > 0 THEN rho*2.5e0 ELSE rho END) AS rho, SIG(CASE WHEN rho > 0 THEN vel/rho/{AREA} ELSE vel END) AS vel,
SIG(CASE WHEN rho > 0 THEN phi/rho/{AREA} ELSE phi END) AS phi FROM $map_sparse""",
)
def p21_rescale_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gravity-only maps in physical terms."""
    return single(M.rescale_map(view(spark, sf_dir, "map_sparse"), "go", NSIDE, 2.5), *MAP)


@query(
    f"""SELECT step, idx, SIG(rho) AS rho, SIG(CASE WHEN rho > 0 THEN vel/rho/{AREA} ELSE vel END) AS vel, SIG(CASE WHEN rho > 0 THEN phi/rho/{AREA} ELSE phi END) AS phi,
SIG(vel) AS xray4, SIG(coalesce(CASE WHEN vel <> 0 THEN rho/(vel/2e0) END, rho)) AS temp FROM $map_sparse""",
)
def p22_rescale_hydro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydro maps in physical terms."""
    m = view(spark, sf_dir, "map_sparse").withColumn("xray4", F.col("vel")).withColumn("temp", F.col("rho"))
    return single(M.rescale_map(m, "hydro", NSIDE, xray_scaling=2.0), *MAP, "xray4", "temp")


@query("SELECT id, replication, step, x, y, z FROM $particles WHERE (x - 5e0)^2 + (y - 3e0)^2 + (z - 1e0)^2 <= 400")
def f6_sphere_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inside of a sphere."""
    return C.sphere_cut(view(spark, sf_dir, "particles"), 5.0, 3.0, 1.0, 20.0).select(*KEYS, "step", "x", "y", "z")


@query("SELECT id, replication, step FROM $particles WHERE x*x + y*y + z*z < 2500 AND step <> 1995 AND uu*mu > 0 AND mask & 4 <> 0")
def f7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance limit, skipped step, gas of positive temperature."""
    df = C.skip_steps(C.distance_limit(view(spark, sf_dir, "particles"), 2500.0), [1995])
    hot = P.gas_temperature(F.col("uu"), F.col("mu"), F.col("a")) > 0
    return df.where(hot & P.has_bit(F.col("mask"))).select(*KEYS, "step")


@query(
    """SELECT k, fof_halo_mass > 1e11 AND fof_halo_mass < 2e12 AS strict, fof_halo_mass >= 1e11 AND fof_halo_mass < 2e12 AS half_open, fof_halo_mass > 1e12 AS above FROM $halos_a""",
)
def f1_mass_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass windows and cuts."""
    m = F.col("fof_halo_mass")
    return view(spark, sf_dir, "halos_a").select("k", P.mass_window(m, 1e11, 2e12).alias("strict"), P.mass_window(m, 1e11, 2e12, "left").alias("half_open"), P.mass_window(m, 1e12).alias("above"))


OCT = f"""oct AS (SELECT pix, px >= -1e-12 AND py >= -1e-12 AND pz >= 0 AS inside FROM pixels)"""


@query("SELECT p.id, p.replication, p.step, p.ring AS pix FROM rn p JOIN oct o ON p.ring = o.pix WHERE o.inside", rings(NSIDE), centres(NSIDE), OCT, ring("$particles", "rn", NSIDE))
def f8_octant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles on the pixels of an octant."""
    mask = C.octant_mask(spark, NSIDE).where("inside").select("pix")
    df = G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", NSIDE, "pix")
    return C.keep_pixels(df, mask).select(*KEYS, "step", "pix")


@query(
    """SELECT l.step, p.pix, p.part, count(*) AS n FROM rn l JOIN (SELECT q AS pix, CASE WHEN q IN (SELECT ring FROM lo) THEN 0 ELSE 1 END AS part FROM range(48) r(q)) p ON l.ring = p.pix GROUP BY ALL""",
    rings(NSIDE),
    centres(NSIDE),
    "near AS (SELECT px AS x, py AS y, pz AS z FROM pixels WHERE px >= -0.1e0 AND py >= -0.1e0 AND pz >= -0.1e0)",
    ring("near", "lo", 2),
    ring("$particles", "rn", 2),
)
def f9_octant_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on low-resolution pixels, those that touch the octant first."""
    ranked = C.octant_first(C.octant_pixels(spark, 2, NSIDE))
    df = G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", 2, "p")
    return df.join(ranked, F.col("p") == F.col("pix")).groupBy("step", "pix", "part").agg(F.count("*").alias("n"))


@query(
    "SELECT n.id, n.replication, n.step, n.nest AS pix FROM nn n WHERE n.nest IN (SELECT c.nest FROM cn c WHERE c.x >= -1e-12 AND c.y >= -1e-12 AND c.z >= 0)",
    rings(64),
    centres(64),
    nest("$particles", "nn", 64),
    nest("(SELECT px AS x, py AS y, pz AS z FROM pixels)", "cn", 64),
)
def f8_octant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles of an octant by ranges of NESTED pixels, found by splitting border pixels only."""
    df = G.with_nest_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", 64, "pix")
    return C.keep_blocks(df, C.octant_blocks(spark, 64), "pix", 64).select(*KEYS, "step", "pix")


RULES = [(1991, 1992, None, 0.505), (1998, 1997, 0.6, None)]


@query(
    """SELECT id, replication, CASE WHEN step = 1992 AND a <= 0.505e0 THEN 1991 WHEN step = 1997 AND a > 0.6e0 THEN 1998 ELSE step END AS step, a FROM $particles""",
)
def f10_substitute_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """missing steps filled from others by scale factor."""
    rules = spark.createDataFrame(RULES, "target int, source int, lo double, hi double")
    return C.substitute_steps(view(spark, sf_dir, "particles"), F.broadcast(rules)).select(*KEYS, "step", "a")


PROPS = ["fof_halo_count", "fof_halo_mass", "sod_halo_mass"]


@query(
    """SELECT l.id, l.replication, l.fof_halo_tag, h.p.c AS fof_halo_count, h.p.m AS fof_halo_mass, h.p.s AS sod_halo_mass, h.t IS NOT NULL AS matched
FROM (SELECT DISTINCT id, replication, fof_halo_tag FROM $particles UNION ALL SELECT -1, 0, -7) l LEFT JOIN (
  SELECT CASE WHEN fof_halo_tag < 0 THEN (-fof_halo_tag) & 281474976710655 ELSE fof_halo_tag END AS t, max(struct_pack(c := fof_halo_count, m := fof_halo_mass, s := sod_halo_mass)) AS p
  FROM $halos_a WHERE fof_halo_mass > 1e12 GROUP BY 1) h ON CASE WHEN l.fof_halo_tag < 0 THEN (-l.fof_halo_tag) & 281474976710655 ELSE l.fof_halo_tag END = h.t""",
)
def j6_match_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lightcone row with the properties of its halo, where that is above the mass cut."""
    lc = view(spark, sf_dir, "particles").select(*KEYS, "fof_halo_tag").distinct()
    lc = lc.unionByName(spark.createDataFrame([(-1, 0, -7)], lc.schema))
    return C.match_properties(lc, view(spark, sf_dir, "halos_a").where(P.mass_window(F.col("fof_halo_mass"), 1e12)).select("fof_halo_tag", *PROPS))


@query("SELECT p.id, p.replication, p.step, p.fof_halo_tag FROM $particles p SEMI JOIN $id_list i ON p.step = i.step AND p.fof_halo_tag = i.fof_halo_tag")
def j9_select_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an id list for each step."""
    return C.select_ids(view(spark, sf_dir, "particles"), view(spark, sf_dir, "id_list")).select(*KEYS, "step", "fof_halo_tag")


@query("SELECT 'lineitem.parquet' AS file, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT fof_halo_tag FROM $id_list) HAVING count(*) > 0")
def j10_locate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that hold rows with listed ids, and how many; a table of several files counts by its own name."""
    ids = view(spark, sf_dir, "id_list").select(F.col("fof_halo_tag").alias("l_orderkey"))
    found = C.locate_ids(view(spark, sf_dir, "lineitem"), ids, "l_orderkey")
    return found.groupBy(F.regexp_extract("file", r"([^/]*\.parquet)(?:/[^/]*)?$", 1).alias("file")).agg(F.sum("n").alias("n"))


@query(
    """SELECT step, pixel_id, coalesce(sum(n) OVER (PARTITION BY step ORDER BY pixel_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_idx, n AS count_idx
FROM (SELECT step, ring AS pixel_id, count(*) AS n FROM rn GROUP BY ALL)""",
    ring("$particles", "rn", NSIDE),
)
def a21_pixel_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each pixel and where they start."""
    return C.pixel_offsets(G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", NSIDE))


@query("SELECT step, lead(step) OVER (ORDER BY step) AS next_step FROM (SELECT DISTINCT step FROM $map_sparse)")
def w4_next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that follows each one."""
    return C.next_steps(view(spark, sf_dir, "map_sparse"))


def md5_draw(*columns: str) -> Column:
    """A number in [0, 1) from an MD5 digest, which other engines have as well."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


DRAW = "(('0x' || substr(md5(concat_ws('/', k::VARCHAR, fof_halo_tag::VARCHAR)), 1, 8))::BIGINT::DOUBLE/4294967296e0)"


@query(
    f"""SELECT k, step FROM (SELECT k, step, row_number() OVER (PARTITION BY step ORDER BY u, k) AS nth, count(*) OVER (PARTITION BY step) AS n
FROM (SELECT k, k % 4 AS step, {DRAW} AS u FROM $halos_a)) WHERE nth <= round(n*0.1e0)""",
)
def o3_exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact share of each step, repeated halos and their equal draws included."""
    h = view(spark, sf_dir, "halos_a").withColumn("step", F.col("k") % 4)
    return C.exact_sample(h, 0.1, ("k",), draw=md5_draw("k", "fof_halo_tag")).select("k", "step")


@query(f"SELECT k FROM $halos_a WHERE {DRAW}*10 < 1")
def o2_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: about one row in ten."""
    return C.hash_sample(view(spark, sf_dir, "halos_a"), ("k",), 10, draw=md5_draw("k", "fof_halo_tag")).select("k")


def lc_pairs(columns: tuple[str, ...]) -> str:
    names, a, b = (", ".join(f(c) for c in columns) for f in (lambda c: f"'{c}'", lambda c: f"p.{c}", lambda c: f"q.{c}"))
    return f"""pr AS (SELECT unnest([{names}]) AS var, unnest([{a}]::DOUBLE[]) AS a, unnest([{b}]::DOUBLE[]) AS b FROM $lightcone_a p JOIN $lightcone_b q USING (id, replication))"""


STATS = """st AS (SELECT var, avg(a - b) AS mean_diff, stddev_samp(a - b) AS std_diff, max(CASE WHEN abs(a) > {guard} THEN abs(b - a)/abs(a) END) AS max_frac, avg(a) AS mean_q, stddev_samp(a) AS std_q, count(*) AS n
  FROM pr GROUP BY 1)"""
VERDICT = """SELECT var, SIG(round(mean_diff, 9)) AS mean_diff, SIG(round(std_diff, 9)) AS std_diff, SIG(round(max_frac, 12)) AS max_frac, SIG(mean_q) AS mean_q, SIG(std_q) AS std_q, n,
coalesce(max_frac < {limit} OR (abs(std_diff/nullif(std_q, 0)) < {limit} AND abs(mean_diff/nullif(mean_q, 0)) < {limit}), false) AS passed FROM st"""


def rounded(stats: DataFrame) -> DataFrame:
    stats = stats.withColumn("mean_diff", F.round("mean_diff", 9)).withColumn("std_diff", F.round("std_diff", 9)).withColumn("max_frac", F.round("max_frac", 12))
    return single(stats, "mean_diff", "std_diff", "max_frac", "mean_q", "std_q")


@query(VERDICT.format(limit="1e-3"), lc_pairs(LC), STATS.format(guard="0"))
def j1_compare_lightcones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference statistics and verdicts of two lightcones aligned by key."""
    return rounded(K.compare_by_key(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS, LC, 1e-3)[0])


@query(
    """SELECT count(*) FILTER (p.id IS NOT NULL AND q.id IS NOT NULL) AS n_pairs, count(*) FILTER (q.id IS NULL) AS only_a, count(*) FILTER (p.id IS NULL) AS only_b
FROM $lightcone_a p FULL JOIN $lightcone_b q ON p.id = q.id AND p.replication = q.replication""",
)
def j1_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched rows."""
    return K.compare_by_key(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS, LC, 1e-3)[1]


@query("SELECT count(*) FILTER (NOT passed) AS n_failing, count(*) AS n_columns FROM (" + VERDICT.format(limit="1e-3") + ")", lc_pairs(LC), STATS.format(guard="0"))
def a2_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: number of columns that fail."""
    return K.failing(K.compare_by_key(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS, LC, 1e-3)[0])


HC = ("fof_halo_mass", "fof_halo_center_x", "fof_halo_center_y", "sod_halo_mass", "sod_halo_cdelta")
CLEAN = ", ".join(f"c{s} AS (SELECT * FROM $halos_{s} WHERE fof_halo_mass > 1e11 AND fof_halo_mass < 4e12 QUALIFY count(*) OVER (PARTITION BY fof_halo_tag) = 1)" for s in "ab")
HPAIRS = f"""pr AS (SELECT unnest([{", ".join(f"'{c}'" for c in HC)}]) AS var, unnest([{", ".join(f"p.{c}" for c in HC)}]::DOUBLE[]) AS a, unnest([{", ".join(f"q.{c}" for c in HC)}]::DOUBLE[]) AS b
  FROM ca p JOIN cb q USING (fof_halo_tag))"""


@query(VERDICT.format(limit="1e-2"), CLEAN, HPAIRS, STATS.format(guard="1e-6"))
def j2_compare_halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halos by tag, without repeated tags, in a mass window."""
    return rounded(K.compare_halos(view(spark, sf_dir, "halos_a"), view(spark, sf_dir, "halos_b"), HC, 1e-2, 1e11, 4e12)[0])


@query("SELECT count(*) FILTER (p.k IS NOT NULL AND q.k IS NOT NULL) AS n_pairs, count(*) FILTER (q.k IS NULL) AS only_a, count(*) FILTER (p.k IS NULL) AS only_b FROM ca p FULL JOIN cb q USING (fof_halo_tag)", CLEAN)
def j2_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched halos."""
    return K.compare_halos(view(spark, sf_dir, "halos_a"), view(spark, sf_dir, "halos_b"), HC, 1e-2, 1e11, 4e12)[1]


@query("SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicate_rows FROM (SELECT count(*) AS n FROM $halos_a GROUP BY fof_halo_tag)")
def w1_duplicated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tags that stand more than once."""
    return K.duplicated_keys(view(spark, sf_dir, "halos_a"), ("fof_halo_tag",))


BINS = ("sod_halo_bin_mass", "sod_halo_bin_radius", "sod_halo_bin_rho")


@query(
    VERDICT.format(limit="1e-3"),
    CLEAN,
    "s AS (SELECT * FROM $sod_bins WHERE fof_halo_bin_tag IN (SELECT fof_halo_tag FROM ca))",
    f"""pr AS (SELECT unnest([{", ".join(f"'{c}'" for c in BINS)}]) AS var, unnest([{", ".join(f"p.{c}" for c in BINS)}]::DOUBLE[]) AS a,
  unnest([p.sod_halo_bin_mass*1.00047e0, p.sod_halo_bin_radius, p.sod_halo_bin_rho + 1e-2]::DOUBLE[]) AS b FROM s p)""",
    STATS.format(guard="0"),
)
def j3_compare_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All profile bins of the halos that passed the first table's mass window."""
    tags = K.drop_duplicated_keys(view(spark, sf_dir, "halos_a").where(P.mass_window(F.col("fof_halo_mass"), 1e11, 4e12)).select("fof_halo_tag"), ("fof_halo_tag",))
    a = view(spark, sf_dir, "sod_bins")
    b = a.withColumn("sod_halo_bin_mass", F.col("sod_halo_bin_mass") * 1.00047).withColumn("sod_halo_bin_rho", F.col("sod_halo_bin_rho") + 1e-2)
    return rounded(K.compare_bins(a, b, tags, BINS, 1e-3)[0])


@query("SELECT (SELECT count(*) FROM (FROM $membership_a EXCEPT ALL FROM $membership_b)) AS only_a, (SELECT count(*) FROM (FROM $membership_b EXCEPT ALL FROM $membership_a)) AS only_b")
def j4_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that two catalogues do not share, as bags."""
    return K.bag_diff_count(view(spark, sf_dir, "membership_a"), view(spark, sf_dir, "membership_b"), ("fof_halo_tag", "id"))


@query(SQL["j4_membership"])
def j4_by_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, of the buckets whose digests differ."""
    return K.bag_diff_by_digests(view(spark, sf_dir, "membership_a"), view(spark, sf_dir, "membership_b"), ("fof_halo_tag", "id"))


@query(
    """SELECT a_key, b_key, SIG(d2) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY d2, b_key) AS ra, row_number() OVER (PARTITION BY b_key ORDER BY d2, a_key) AS rb FROM (
  SELECT p.k AS a_key, q.k AS b_key, min((p.fof_halo_center_x - q.fof_halo_center_x)^2 + (p.fof_halo_center_y - q.fof_halo_center_y)^2 + (p.fof_halo_center_z - q.fof_halo_center_z)^2) AS d2
  FROM $halos_a p JOIN $halos_b q ON abs(p.fof_halo_center_x - q.fof_halo_center_x) < 0.05e0 AND abs(p.fof_halo_center_y - q.fof_halo_center_y) < 0.05e0
    AND abs(p.fof_halo_center_z - q.fof_halo_center_z) < 0.05e0 AND (p.fof_halo_mass - q.fof_halo_mass)/p.fof_halo_mass < 0.05e0 GROUP BY 1, 2)) WHERE ra = 1 AND rb = 1""",
)
def j5_match_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halos by place and mass, one to one, copies of a halo as one."""
    short = {"fof_halo_center_x": "x", "fof_halo_center_y": "y", "fof_halo_center_z": "z", "fof_halo_mass": "mass", "k": "tag"}
    a, b = (view(spark, sf_dir, f"halos_{s}").select(*short).withColumnsRenamed(short) for s in "ab")
    return single(K.match_by_position(a, b), "d2")


# Rounds of mutual nearest pairs among what is left; no view has any left after four.
NEAR_HALOS = """c0 AS MATERIALIZED (SELECT p.k AS a_key, q.k AS b_key, min((p.fof_halo_center_x - q.fof_halo_center_x)^2 + (p.fof_halo_center_y - q.fof_halo_center_y)^2 + (p.fof_halo_center_z - q.fof_halo_center_z)^2) AS d2
  FROM $halos_a p JOIN $halos_b q ON abs(p.fof_halo_center_x - q.fof_halo_center_x) < 2.5e0 AND abs(p.fof_halo_center_y - q.fof_halo_center_y) < 2.5e0
    AND abs(p.fof_halo_center_z - q.fof_halo_center_z) < 2.5e0 AND abs((p.fof_halo_mass - q.fof_halo_mass)/p.fof_halo_mass) < 0.05e0 GROUP BY 1, 2)"""
ROUND = """m{k} AS MATERIALIZED (SELECT a_key, b_key FROM (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY d2, b_key) AS ra, row_number() OVER (PARTITION BY b_key ORDER BY d2, a_key) AS rb FROM c{k}) WHERE ra = 1 AND rb = 1),
c{n} AS MATERIALIZED (SELECT * FROM c{k} WHERE a_key NOT IN (SELECT a_key FROM m{k}) AND b_key NOT IN (SELECT b_key FROM m{k}))"""
ROUNDS = 8
MATCHED = [NEAR_HALOS, *[ROUND.format(k=k, n=k + 1) for k in range(ROUNDS)], f"pairs AS MATERIALIZED ({' UNION ALL '.join(f'FROM m{k}' for k in range(ROUNDS))})"]
PLACES = ("fof_halo_mass", "fof_halo_center_x", "fof_halo_center_y", "fof_halo_center_z", "sod_halo_mass")
FIRST_HALOS = [f"h{s} AS (SELECT k, min(struct_pack({', '.join(f'{c} := {c}' for c in PLACES)})) AS r FROM $halos_{s} GROUP BY k)" for s in "ab"]


def halo_match_report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    named = {"k": "tag", "fof_halo_mass": "mass", **{f"fof_halo_center_{c}": c for c in "xyz"}}
    a, b = (view(spark, sf_dir, f"halos_{s}").select(F.col("k"), *PLACES).withColumns({v: F.col(n) for n, v in named.items()}) for s in "ab")
    return K.match_report(a, b, PLACES, 1e-2, tol=2.5, two_sided=True)


@query(
    """SELECT count(*) AS n_pairs, (SELECT count(DISTINCT k) FROM $halos_a) - count(*) AS only_a, (SELECT count(DISTINCT k) FROM $halos_b) - count(*) AS only_b FROM pairs""",
    *MATCHED,
)
def j5_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by place and mass, also among what the nearest ones left, and the halos of both sides without one."""
    return halo_match_report(spark, sf_dir)[1]


@query(
    VERDICT.format(limit="1e-2"),
    *MATCHED,
    *FIRST_HALOS,
    f"pr AS (SELECT unnest([{', '.join(repr(c) for c in PLACES)}]) AS var, unnest([{', '.join(f'p.r.{c}' for c in PLACES)}]::DOUBLE[]) AS a, unnest([{', '.join(f'q.r.{c}' for c in PLACES)}]::DOUBLE[]) AS b FROM pairs JOIN ha p ON p.k = a_key JOIN hb q ON q.k = b_key)",
    STATS.format(guard="0"),
)
def j5_match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts over the pairs."""
    return rounded(halo_match_report(spark, sf_dir)[0])


@query(
    """SELECT var, SIG(avg(v) FILTER (src = 'a')) AS mean_a, SIG(stddev_samp(v) FILTER (src = 'a')) AS std_a, SIG(max(abs(v)) FILTER (src = 'a')) AS max_a, SIG(avg(v) FILTER (src = 'b')) AS mean_b,
SIG(stddev_samp(v) FILTER (src = 'b')) AS std_b, SIG(max(abs(v)) FILTER (src = 'b')) AS max_b, (count(*) FILTER (src = 'a') - count(*) FILTER (src = 'b'))::BIGINT AS row_difference,
coalesce(abs(avg(v) FILTER (src = 'b')/nullif(avg(v) FILTER (src = 'a'), 0) - 1) < 1e-2 AND abs(stddev_samp(v) FILTER (src = 'b')/nullif(stddev_samp(v) FILTER (src = 'a'), 0) - 1) < 1e-2, false) AS passed
FROM u GROUP BY 1""",
    f"u AS ({' UNION ALL '.join(f'''SELECT '{s}' AS src, unnest([{", ".join(f"'{c}'" for c in HC)}]) AS var, unnest([{", ".join(HC)}]::DOUBLE[]) AS v FROM $halos_{s}''' for s in 'ab')})",
)
def a3_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues without pairing rows."""
    out = K.compare_distributions(view(spark, sf_dir, "halos_a"), view(spark, sf_dir, "halos_b"), HC, 1e-2)
    return single(out, "mean_a", "std_a", "max_a", "mean_b", "std_b", "max_b")


LC_LIST = ", ".join(("id", "replication", "x", "y", "z", "vx", "vy", "vz", "a", "phi"))


@query(
    " UNION ALL ".join(
        f"SELECT '{s}' AS side, {LC_LIST} FROM $lightcone_{s} p WHERE NOT EXISTS (SELECT 1 FROM $lightcone_{t} q WHERE q.id = p.id AND q.replication = p.replication)" for s, t in ("ab", "ba")
    ),
)
def j11_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key the other side lacks."""
    return K.missing_rows(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS)


@query(
    """SELECT side, SIG(avg(d)) AS mean, SIG(max(d)) AS most, SIG(min(d)) AS least, count(*) AS n FROM (
  SELECT 'a' AS side, sqrt(x*x + y*y + z*z) AS d FROM $lightcone_a p ANTI JOIN $lightcone_b q USING (id, replication)
  UNION ALL SELECT 'b', sqrt(x*x + y*y + z*z) FROM $lightcone_b q ANTI JOIN $lightcone_a p USING (id, replication)) GROUP BY 1""",
)
def a29_missing_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the unmatched rows are."""
    return single(K.missing_distance_stats(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS), "mean", "most", "least")


@query(
    """SELECT NOT EXISTS (SELECT fof_halo_tag FROM $halos_a EXCEPT ALL SELECT fof_halo_tag FROM $halos_b) AND NOT EXISTS (SELECT fof_halo_tag FROM $halos_b EXCEPT ALL SELECT fof_halo_tag FROM $halos_a) AS tags,
NOT EXISTS (SELECT fof_halo_tag FROM $halos_a EXCEPT ALL SELECT fof_halo_tag FROM $halos_a) AS itself""",
)
def j12_same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two catalogues hold the same tags."""
    a, b = view(spark, sf_dir, "halos_a"), view(spark, sf_dir, "halos_b")
    return K.same_keys(a, b, "fof_halo_tag").withColumnRenamed("same", "tags").crossJoin(K.same_keys(a, a, "fof_halo_tag").withColumnRenamed("same", "itself"))


@query(
    """SELECT var, count(*) FILTER (a IS DISTINCT FROM b) = 0 AS identical, count(*) FILTER (a IS DISTINCT FROM b) AS n_different, SIG(round(max(b - a), 9)) AS max_diff, SIG(round(min(b - a), 9)) AS min_diff,
SIG(round(max((b - a)/nullif(a, 0)), 12) + 0e0) AS max_rel, SIG(round(min((b - a)/nullif(a, 0)), 12) + 0e0) AS min_rel FROM pr GROUP BY 1""",
    lc_pairs(LC),
)
def a26_exact_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of each column."""
    out = K.exact_compare(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS, LC)
    for c, k in (("max_diff", 9), ("min_diff", 9), ("max_rel", 12), ("min_rel", 12)):
        out = out.withColumn(c, F.round(c, k) + F.lit(0.0))
    return single(out, "max_diff", "min_diff", "max_rel", "min_rel")


@query(
    """SELECT var, SIG(100*avg((r < 0.01e0)::INT)) AS pct_within, SIG(100*avg((abs(r) < 0.01e0)::INT)) AS pct_within_abs, SIG(100*avg((r = 0)::INT)) AS pct_zero, SIG(round(avg(r), 12)) AS mean, SIG(round(stddev_pop(r), 12)) AS std,
count(*) FILTER (r > 0) AS n_above, count(*) FILTER (r < 0) AS n_below, count(*) AS n FROM (
  SELECT unnest(['mass', 'concentration', 'shift']) AS var, unnest([(q.sod_halo_mass - p.sod_halo_mass)/p.sod_halo_mass, (q.sod_halo_cdelta - p.sod_halo_cdelta)/p.sod_halo_cdelta,
    sqrt((q.fof_halo_center_x - p.fof_halo_center_x)^2 + (q.fof_halo_center_y - p.fof_halo_center_y)^2 + (q.fof_halo_center_z - p.fof_halo_center_z)^2)/p.sod_halo_radius]) AS r
  FROM na p JOIN nb q USING (k, nth) WHERE p.sod_halo_mass > 1e12) GROUP BY 1""",
    *[f"n{s} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sod_halo_mass, sod_halo_cdelta, sod_halo_radius, fof_halo_center_x, fof_halo_center_y, fof_halo_center_z) AS nth FROM $halos_{s})" for s in "ab"],
)
def a27_ratio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative changes of all halos, a halo's copies paired in order."""
    out = K.ratio_stats(*(view(spark, sf_dir, f"halos_{s}") for s in "ab"), 1e12, tag="k")
    out = out.withColumn("mean", F.round("mean", 12)).withColumn("std", F.round("std", 12))
    return single(out, "pct_within", "pct_within_abs", "pct_zero", "mean", "std")


@query(
    """SELECT rule, violations, n AS rows FROM (SELECT count(*) AS n, count(*) FILTER (NOT fof_halo_count >= 20) AS a, count(*) FILTER (NOT fof_halo_mass > 0) AS b,
  count(*) FILTER (NOT ((sod_halo_mass = -101e0) = (fof_halo_count < 500))) AS c, count(*) FILTER (NOT abs(fof_halo_mass/(fof_halo_count*1.1e9) - 1) < 0.5e0) AS d,
  count(*) FILTER (NOT sqrt((fof_halo_center_x - 128.3e0)^2 + (fof_halo_center_y - 128.3e0)^2 + (fof_halo_center_z - 128.3e0)^2) < 300*sod_halo_radius) AS e,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM $halos_a GROUP BY fof_halo_tag HAVING count(*) > 1)) AS f FROM $halos_a)
UNPIVOT (violations FOR rule IN (a AS 'minimum count', b AS 'positive mass', c AS 'fill below 500', d AS 'mass by count', e AS 'near the middle', f AS 'tag stands once'))""",
)
def a34_catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break rules of sanity; the view's masses follow no count, so that rule is broken often."""
    x, y, z = (F.col(f"fof_halo_center_{c}") - 128.3 for c in "xyz")
    rules = {
        "minimum count": F.col("fof_halo_count") >= 20, "positive mass": F.col("fof_halo_mass") > 0, "fill below 500": (F.col("sod_halo_mass") == -101) == (F.col("fof_halo_count") < 500),
        "mass by count": F.abs(F.col("fof_halo_mass") / (F.col("fof_halo_count") * 1.1e9) - 1) < 0.5, "near the middle": P.distance(x, y, z) < 300 * F.col("sod_halo_radius"),
    }
    h = view(spark, sf_dir, "halos_a")
    found = K.catalog_rules(h, rules)
    twice = K.duplicated_keys(h.select("fof_halo_tag"), ("fof_halo_tag",)).select(F.lit("tag stands once").alias("rule"), F.col("n_duplicate_rows").alias("violations"))
    return found.unionByName(twice.crossJoin(h.agg(F.count("*").alias("rows"))))


def hist_sql(bin_: str, n: int, src: str, where: str = "true") -> str:
    return f"""SELECT r.b::INT AS bin, coalesce(h.n, 0)::BIGINT AS n, coalesce(h.n, 0)::DOUBLE/(SELECT count(*) FROM {src}) AS fraction, SIG((SELECT avg(v) FROM {src})) AS mean
FROM range({n}) r(b) LEFT JOIN (SELECT b, count(*) AS n FROM (SELECT trunc({bin_})::BIGINT AS b FROM {src} WHERE {where}) GROUP BY 1) h ON r.b = h.b"""


@query(hist_sql("(v - 10e0)/(390e0/30)", 30, "$values"))
def a4_linear_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear histogram as fractions of all rows."""
    return single(H.histogram(view(spark, sf_dir, "values"), F.col("v"), 30, 10.0, 400.0), "mean")


@query(hist_sql("(v - 10e0)/(390e0/30)", 30, "$values", "m >= 100 AND m < 400"))
def a5_window_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 A5: linear histogram inside a mass window."""
    return single(H.histogram(view(spark, sf_dir, "values"), F.col("v"), 30, 10.0, 400.0, where=P.mass_window(F.col("m"), 100, 400, "left")), "mean")


@query(hist_sql("(log10(v) - log10(0.013e0))/((log10(490e0) - log10(0.013e0))/25)", 25, "$values"))
def a6_log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithmic histogram."""
    return single(H.histogram(view(spark, sf_dir, "values"), F.col("v"), 25, 0.013, 490.0, "log"), "mean")


@query(
    """SELECT i::INT AS i, j::INT AS j, count(*) AS n, count(*)/(SELECT count(*) FROM $values)::DOUBLE AS fraction FROM (SELECT trunc((log10(v) - log10(0.013e0))/((log10(490e0) - log10(0.013e0))/12)) AS i,
  trunc((log10(m) - log10(1.3e0))/((log10(5000e0) - log10(1.3e0))/12)) AS j FROM $values WHERE m > 0) WHERE i BETWEEN 0 AND 11 AND j BETWEEN 1 AND 11 GROUP BY ALL""",
)
def a7_histogram2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over value and mass in logarithmic bins, and what part they are of all rows."""
    return H.histogram2d_log(view(spark, sf_dir, "values"), F.col("v"), F.nullif(F.col("m"), F.lit(0.0)), 12, (0.013, 490.0), (1.3, 5000.0))


SPEC = {f"center_{c}": (f"fof_halo_center_{c}", 0.0, 256.0, 16) for c in "xyz"} | {f"velocity_{c}": (f"fof_halo_com_v{c}", -1000.0, 1000.0, 20) for c in "xyz"}
SPEC |= {"spin": ("sqrt(fof_halo_angmom_x*fof_halo_angmom_x + fof_halo_angmom_y*fof_halo_angmom_y + fof_halo_angmom_z*fof_halo_angmom_z)/fof_halo_mass", 1.3e-3, 9.17e-2, 20)}
SPEC |= {f"angmom_{c}": (f"fof_halo_angmom_{c}", -2.71e11, 2.73e11, 20) for c in "xyz"}


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS var, b::INT AS bin, count(*) AS n, count(*)::DOUBLE/(SELECT count(*) FROM $halos_a) AS fraction FROM (SELECT trunc(({c} - {lo!r}::DOUBLE)/({hi - lo!r}::DOUBLE/{n})) AS b FROM $halos_a) WHERE b BETWEEN 0 AND {n - 1} GROUP BY b"
        for k, (c, lo, hi, n) in SPEC.items()
    ),
)
def a8_halo_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, velocities, angular momenta and spins of a catalogue in one pass."""
    return H.halo_histograms(view(spark, sf_dir, "halos_a"), {k: (F.expr(c), lo, hi, n, "linear") for k, (c, lo, hi, n) in SPEC.items()})


@query(
    f"""SELECT i::INT AS i, j::INT AS j, count(*) AS n, count(*)/(SELECT count(*) FROM $halos_a)::DOUBLE AS fraction FROM (SELECT trunc((log10(s) - log10(1.3e-3))/((log10(9.17e-2) - log10(1.3e-3))/12)) AS i,
  trunc((log10(m) - log10(1.3e10))/((log10(7e12) - log10(1.3e10))/12)) AS j FROM (SELECT {SPEC["spin"][0]} AS s, fof_halo_mass AS m FROM $halos_a)) WHERE i BETWEEN 0 AND 11 AND j BETWEEN 1 AND 11 GROUP BY ALL""",
)
def a8_spin_by_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spin over mass in logarithmic bins."""
    return H.histogram2d_log(view(spark, sf_dir, "halos_a"), F.expr(SPEC["spin"][0]), F.col("fof_halo_mass"), 12, (1.3e-3, 9.17e-2), (1.3e10, 7e12))


def plane_sql(src: str) -> str:
    b = {c: f"CASE WHEN {c} BETWEEN -60.5e0 AND 60.5e0 THEN least(11, floor(({c} + 60.5e0)/(121e0/12)))::INT END" for c in "xyz"}
    planes = " UNION ALL ".join(f"SELECT '{p}{q}' AS plane, {b[p]} AS i, {b[q]} AS j FROM {src}" for p, q in ("xy", "yz", "xz"))
    return f"(SELECT plane, i, j, count(*) AS n FROM ({planes}) WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL)"


@query(f"SELECT plane, i, j, (coalesce(p.n, 0) - coalesce(q.n, 0))::BIGINT AS difference FROM {plane_sql('$lightcone_a')} p FULL JOIN {plane_sql('$lightcone_b')} q USING (plane, i, j)")
def a9_projected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of counts on three planes."""
    return H.diff_counts(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), -60.5, 60.5, 12)


@query(
    " UNION ALL ".join(
        f"SELECT '{s}' AS src, b AS bin, count(*) AS n FROM (SELECT CASE WHEN sqrt(vx*vx + vy*vy + vz*vz) BETWEEN 0.5e0 AND 100.7e0 THEN least(19, floor((sqrt(vx*vx + vy*vy + vz*vz) - 0.5e0)/(100.2e0/20)))::INT END AS b FROM $lightcone_{s}) WHERE b IS NOT NULL GROUP BY b"
        for s in "ab"
    ),
)
def a10_speed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds of two tables."""
    return H.speed_histogram(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), 0.5, 100.7, 20)


AXES = {"i0": ("a", 0.4, 1.1, 5), "i1": ("yhe", 0.2, 0.4, 4), "i2": ("mu", 0.5, 0.8, 4)}
LINEAR = " + ".join(f"{w}*least(greatest(({c} - {lo})/(({hi} - {lo})/{n - 1}e0), 0e0), {n - 1}e0)" for w, (c, lo, hi, n) in zip((3, 5, 7), AXES.values(), strict=True))


@query(f"SELECT id, replication, step, SIG(1 + {LINEAR}) AS low, SIG(100 - ({LINEAR})) AS high FROM (SELECT DISTINCT id, replication, step, a, yhe, mu FROM $particles)")
def j14_grid_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gridded table at each particle; the table is linear in its indices, so the result is known."""
    df = view(spark, sf_dir, "particles").select(*KEYS, "step", "a", "yhe", "mu").distinct().withColumn("row", F.xxhash64(*KEYS, "step", "a", "yhe", "mu"))
    table = spark.range(5 * 4 * 4).select((F.col("id") % 5).cast("int").alias("i0"), F.expr("cast(id div 5 % 4 as int)").alias("i1"), F.expr("cast(id div 20 as int)").alias("i2"))
    v = 3 * F.col("i0") + 5 * F.col("i1") + 7 * F.col("i2")
    table = table.withColumn("low", (1 + v).cast("double")).withColumn("high", (100 - v).cast("double"))
    out = M.grid_interpolate(df, table, {n: (F.col(c), lo, hi, k) for n, (c, lo, hi, k) in AXES.items()}, ("low", "high"), (*KEYS, "step", "row"))
    return single(out.drop("row"), "low", "high")


@query(
    """SELECT pix AS idx, SIG(CASE WHEN inside THEN (n - m)/m ELSE 0e0 END) AS delta FROM d, (SELECT avg(n) AS m FROM d WHERE inside)""",
    rings(NSIDE),
    centres(NSIDE),
    OCT,
    "dirs AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)",
    ring("dirs", "rn", NSIDE),
    "d AS (SELECT o.pix, o.inside, count(r.ring) AS n FROM oct o LEFT JOIN rn r ON o.pix = r.ring GROUP BY ALL)",
)
def a30_overdensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overdensity inside an octant."""
    return single(M.overdensity(directions(spark, sf_dir, NSIDE), C.octant_mask(spark, NSIDE)), "delta")


def directions(spark: SparkSession, sf_dir: str, nside: int) -> DataFrame:
    """(idx, n): counts of the vectors' first three components as directions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = e.select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return G.with_ring_pixel(d, "x", "y", "z", nside, "idx").groupBy("idx").agg(F.count("*").alias("n"))


LMAX = 2 * NSIDE
#: Legendre polynomials of t by their recursion, each from the two columns before.
LEGENDRE = ", ".join(["1e0 AS p0", "t AS p1", *[f"({2 * k - 1}*t*p{k - 1} - {k - 1}*p{k - 2})/{k}e0 AS p{k}" for k in range(2, LMAX + 1)]])


@query(
    f"""SELECT l::INT AS l, SIG(a) AS c_a, SIG(b) AS c_b, SIG(abs(b - a)/a) AS change FROM (SELECT unnest(range(1, {LMAX + 1})) AS l,
  unnest([{", ".join(f"sum(u*v*p{k})*{AREA}^2/(4*pi())" for k in range(1, LMAX + 1))}]) AS a, unnest([{", ".join(f"sum(u*v*h*p{k})*{AREA}^2/(4*pi())" for k in range(1, LMAX + 1))}]) AS b FROM leg)""",
    rings(NSIDE),
    centres(NSIDE),
    "dirs AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)",
    ring("dirs", "rn", NSIDE),
    "cnt AS (SELECT pix, px, py, pz, count(r.ring) AS n FROM pixels o LEFT JOIN rn r ON o.pix = r.ring GROUP BY ALL)",
    "dlt AS MATERIALIZED (SELECT pix, px, py, pz, (n - m)/m AS d FROM cnt, (SELECT avg(n) AS m FROM cnt))",
    f"two AS (SELECT p.d AS u, q.d AS v, CASE WHEN p.pix < {6 * NSIDE * NSIDE} AND q.pix < {6 * NSIDE * NSIDE} THEN 1e0 ELSE 0e0 END AS h, p.px*q.px + p.py*q.py + p.pz*q.pz AS t FROM dlt p, dlt q)",
    f"leg AS (SELECT u, v, h, {LEGENDRE} FROM two)",
)
def a31_power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angular power spectra of all directions and of a part of them, and their change."""
    everywhere = spark.range(12 * NSIDE * NSIDE).select(F.col("id").alias("pix"), F.lit(True).alias("inside"))
    dense = M.overdensity(directions(spark, sf_dir, NSIDE), everywhere)
    upper = dense.withColumn("delta", F.when(F.col("idx") < 6 * NSIDE * NSIDE, F.col("delta")).otherwise(0.0))
    found = M.compare_spectra(*[S.power_spectrum(m, NSIDE, 2 * NSIDE) for m in (dense, upper)])
    # the mean is taken off, so there is nothing at l = 0
    return single(found.where("l > 0").select("l", "c_a", "c_b", "change"), "c_a", "c_b", "change")


@query(
    f"""SELECT l::INT AS l, round(CASE l WHEN 0 THEN 4*pi()*mean*mean WHEN 2 THEN 8*pi()/75*(norm - 3*mean*mean) ELSE 0e0 END, 9) + 0e0 AS c_l
FROM range({2 * NSIDE + 1}) t(l), (SELECT (xx + yy + zz)/3 AS mean, xx*xx + yy*yy + zz*zz + 2*(xy*xy + xz*xz + yz*yz) AS norm FROM moments)""",
    """moments AS (SELECT avg(x*x) AS xx, avg(y*y) AS yy, avg(z*z) AS zz, avg(x*y) AS xy, avg(x*z) AS xz, avg(y*z) AS yz FROM (
  SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings))""",
)
def a31_iterated_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum, in six rounds, of the map p' M p with the second moments M of all vectors; only l = 0 and 2 have power, in closed form."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = e.select(*[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    pairs = [(p, q) for k, p in enumerate("xyz") for q in "xyz"[k:]]
    moments = d.agg(*[F.avg(F.col(p) * F.col(q)).alias(f"{p}{q}") for p, q in pairs])
    pixels = G.with_direction_of_ring(spark.range(12 * NSIDE * NSIDE).withColumnRenamed("id", "idx"), "idx", NSIDE, ("px", "py", "pz"))
    value = sum(F.col(f"{p}{q}") * F.col(f"p{p}") * F.col(f"p{q}") * (1 if p == q else 2) for p, q in pairs)
    m = pixels.crossJoin(F.broadcast(moments)).select("idx", value.alias("delta"))
    found = S.power_spectrum(m, NSIDE, 2 * NSIDE, rounds=6).select("l", "c_l")
    return found.withColumn("c_l", F.round("c_l", 9) + F.lit(0.0))
