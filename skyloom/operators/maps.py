"""Sky maps: making, filling, checking, stacking and rescaling tables of (step, idx, values)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import physics as P
from ..sources.folders import checkpointed

#: Of each map quantity, the weight of a particle: columns of particle tables.
GRAVITY = {"rho": "1D", "phi": "phi", "vel": "_v"}
#: Bytes that the packed form of a table may take, of which each executor holds a copy.
PACKED_BYTES = 1 << 30


def with_motion(df: DataFrame) -> DataFrame:
    """Adds _d2, the distance squared, and _v, the velocity along the line of sight."""
    x, y, z, vx, vy, vz = (F.col(c) for c in ("x", "y", "z", "vx", "vy", "vz"))
    return df.withColumn("_d2", P.dist2(x, y, z)).withColumn("_v", F.try_divide(vx * x + vy * y + vz * z, F.sqrt(F.col("_d2"))))


def off_centre(df: DataFrame) -> DataFrame:
    """Rows that have a direction. A filter on the pixel itself would be pushed down as the whole formula."""
    return df.where("x <> 0 OR y <> 0 OR z <> 0")


def ngp_map(df: DataFrame, nside: int, keys: tuple[str, ...] = ("step",), order: str = "ring") -> DataFrame:
    """(keys, idx, rho, phi, vel, n): each particle on the pixel that holds it; rho is counts for each unit of solid angle."""
    pixel = G.with_ring_pixel if order == "ring" else G.with_nest_pixel
    area = 4 * math.pi / (12 * nside * nside)
    # sealed, so that the formula and what made df are not one method, too large for the JVM to compile
    out = pixel(with_motion(G.sealed(off_centre(df), x="x", y="y", z="z")), "x", "y", "z", nside, "idx").groupBy(*keys, "idx")
    return out.agg((F.count("*") / F.lit(area)).alias("rho"), F.sum("phi").alias("phi"), F.sum("_v").alias("vel"), F.count("*").alias("n"))


def spread_over_pixels(df: DataFrame, nside: int, columns: tuple[str, ...]) -> DataFrame:
    """Four rows for each particle, one for each interpolation pixel, with idx and w; only the columns asked for go on."""
    near = G.interpolation_rows(off_centre(df), "x", "y", "z", nside, list(columns))
    return near.withColumnRenamed("pix", "idx")


#: Rows of one tile that are too many for one task.
HOT_ROWS = 20_000_000


def summed_over_pixels(df: DataFrame, nside: int, keys: tuple[str, ...], sums: dict[str, str], tile_rings: int | None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, idx, sums): rows of df (keys, x, y, z, ...) dealt over four pixels each; sums are expressions of w and df's columns.

    Without tile_rings the four rows of each row meet a partial aggregation before they are shuffled, which suits maps that
    have few pixels beside the rows of a task. With it a row is shuffled once to the tile of sky that holds its pixels, about
    a twentieth of them twice, and summed there without another exchange. Tiles with more than hot_rows rows are counted
    before and take the first way, in which no key is too large; there are at most rows / hot_rows of them.
    """
    columns = [*keys, *[c for c in df.columns if c not in (*keys, "x", "y", "z")]]
    total = [F.sum(F.expr(e)).alias(n) for n, e in sums.items()]
    if tile_rings is None:
        return spread_over_pixels(df, nside, tuple(columns)).groupBy(*keys, "idx").agg(*total)
    tiled = G.interpolation_tiles(off_centre(df), "x", "y", "z", nside, columns, tile_rings)
    near = G.with_tile(off_centre(df).select(*keys, "x", "y", "z"), "x", "y", "z", nside, tile_rings)
    hot = checkpointed(near.groupBy(*keys, "tile").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*[F.col(c).alias(f"_hot_{c}") for c in (*keys, "tile")]))
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in (*keys, "tile")])
    dealt = lambda rows: rows.select(*columns, "tile", F.inline("near")).withColumnRenamed("pix", "idx")
    if hot.isEmpty():
        return dealt(tiled.repartition(*keys, "tile")).groupBy(*keys, "tile", "idx").agg(*total).drop("tile")
    cold = dealt(tiled.join(F.broadcast(hot), here, "left_anti").repartition(*keys, "tile")).groupBy(*keys, "tile", "idx").agg(*total).drop("tile")
    return cold.unionByName(dealt(tiled.join(F.broadcast(hot), here, "left_semi")).groupBy(*keys, "idx").agg(*total))


def interp_map(df: DataFrame, nside: int, sample_rate: float = 1.0, keys: tuple[str, ...] = ("step",), tile_rings: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, idx, rho, phi, vel): each particle dealt over four pixels by interpolation weights; tile_rings as for summed_over_pixels."""
    area = 4 * math.pi / (12 * nside * nside)
    rows = with_motion(df).select(*keys, "x", "y", "z", "phi", "_v")
    out = summed_over_pixels(rows, nside, keys, {"rho": "w", "phi": "w * phi", "vel": "w * _v"}, tile_rings, hot_rows)
    rate = F.lit(float(sample_rate))
    return out.select(*keys, "idx", (F.col("rho") / F.lit(area) / rate).alias("rho"), (F.col("phi") / rate).alias("phi"), (F.col("vel") / rate).alias("vel"))


HYDRO = ("rho", "phi", "vel", "tsz", "ksz", "xray1", "xray2", "xray3", "xray4", "temp")


def hydro_maps(
    df: DataFrame, nside: int, k: P.Constants = P.Constants(), sample_rate: float = 1.0, is_gas: Column | None = None, bands: dict[str, Column] | None = None,
    mode: str = "adiabatic", electrons: Column | None = None, quantities: tuple[str, ...] = HYDRO, keys: tuple[str, ...] = ("step",), factors: dict[str, float] | None = None,
    least: float | None = None, tile_rings: int | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(keys, idx, quantities): mass, potential and momentum of all particles, the rest of gas only, by interpolation weights.

    bands gives the luminosities xray1 to xray4 (from grid_interpolate, or any Column); without them the X-ray maps are 0.
    temp is the flux-weighted temperature sum: temperature times the weight of xray4, which has no unit factor. factors replaces the unit factors.
    With least, pixels whose weights add up to no more are left out. tile_rings as for summed_over_pixels.
    """
    area = 4 * math.pi / (12 * nside * nside)
    df = with_motion(df)
    gas = P.has_bit(F.col("mask")) if is_gas is None else is_gas
    tsz, ksz = P.sz_weights(*[F.col(c) for c in ("mass", "mu", "uu", "a", "_d2", "_v")], mode=mode, electrons=electrons)
    unit = P.sz_factors(k, sample_rate, area) | (factors or {})
    flux = {n: P.xray_flux(bands[n], F.col("_d2"), F.col("a"), k) if bands and n in bands else F.lit(0.0) for n in ("xray1", "xray2", "xray3", "xray4")}
    weights = {"rho": F.col("mass") / F.lit(area), "phi": F.col("mass") * F.col("phi"), "vel": F.col("mass") * F.col("_v")}
    of_gas = {"tsz": tsz * F.lit(unit["tsz"]), "ksz": ksz * F.lit(unit["ksz"])} | {n: c * F.lit(unit["xray"]) for n, c in flux.items()}
    of_gas["temp"] = P.gas_temperature(F.col("uu"), F.col("mu"), F.col("a"), k) * flux["xray4"]
    weights |= {n: F.when(gas, c).otherwise(0.0) for n, c in of_gas.items()}
    slim = df.select(*keys, "x", "y", "z", *[weights[q].alias(f"q_{q}") for q in quantities])
    sums = {q: f"w * q_{q}" for q in quantities} | ({} if least is None else {"_w": "w"})
    out = summed_over_pixels(slim, nside, keys, sums, tile_rings, hot_rows)
    return out if least is None else out.where(F.col("_w") > least).drop("_w")


def gas_summary(df: DataFrame, k: P.Constants = P.Constants(), is_gas: Column | None = None) -> DataFrame:
    """(mean, least and most of a, temperature and mu, n): over gas particles."""
    gas = df.where(P.has_bit(F.col("mask")) if is_gas is None else is_gas)
    t = gas.select("a", "mu", P.gas_temperature(F.col("uu"), F.col("mu"), F.col("a"), k).alias("temperature"))
    return t.agg(*[f(c).alias(f"{n}_{c}") for c in ("a", "temperature", "mu") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def tsz_totals(df: DataFrame, mu: float = 0.59, electrons: Column | None = None) -> DataFrame:
    """(adiabatic, constant_mu, ne): sums of three forms of the thermal weight over gas particles, without pixels."""
    gas = with_motion(df).where(P.has_bit(F.col("mask")))
    m, u, d2 = F.col("mass"), F.col("uu"), F.col("_d2")
    ne = F.lit(1.0) if electrons is None else electrons
    form = lambda c: F.sum(F.try_divide(c, d2))
    return gas.agg(form(m * F.col("mu") * u).alias("adiabatic"), form(m * F.lit(mu) * u).alias("constant_mu"), form(ne * m * F.col("mu") * u).alias("ne"))


def sz_map(df: DataFrame, nside: int, factors: dict[str, float] | None = None) -> DataFrame:
    """(idx, tsz, ksz): gas particles of all steps on the pixels that hold them."""
    unit = {"tsz": 1.0, "ksz": 1.0} | (factors or {})
    gas = G.with_ring_pixel(with_motion(off_centre(df.where(P.has_bit(F.col("mask"))))), "x", "y", "z", nside, "idx")
    tsz, ksz = P.sz_weights(*[F.col(c) for c in ("mass", "mu", "uu", "a", "_d2", "_v")])
    return gas.groupBy("idx").agg((F.sum(tsz) * unit["tsz"]).alias("tsz"), (F.sum(ksz) * unit["ksz"]).alias("ksz"))


def sz_grid(df: DataFrame, box: float = 150.0, n: int = 256, factors: dict[str, float] | None = None) -> DataFrame:
    """(idx, tsz, ksz) on a flat periodic grid seen along z: weights without distance, velocity along z."""
    unit = {"tsz": 1.0, "ksz": 1.0} | (factors or {})
    gas = df.where(P.has_bit(F.col("mask"))).withColumn("idx", G.grid_pixel(F.col("x"), F.col("y"), box, n))
    tsz = F.sum(F.col("mass") * F.col("mu") * F.col("uu"))
    ksz = F.sum(F.try_divide(F.col("mass") * F.col("vz"), F.col("a")))
    return gas.groupBy("idx").agg((tsz * unit["tsz"]).alias("tsz"), (ksz * unit["ksz"]).alias("ksz"))


def step_ranges(df: DataFrame, columns: tuple[str, ...] = ("a", "mu", "mass", "uu")) -> DataFrame:
    """(step, least and most of each column and of the distance squared), over all rows of the step."""
    df = df.withColumn("d2", P.dist2(F.col("x"), F.col("y"), F.col("z")))
    return df.groupBy("step").agg(*[f(c).alias(f"{n}_{c}") for c in (*columns, "d2") for n, f in (("min", F.min), ("max", F.max))])


#: Pixels of a block in which gaps are filled.
BLOCK = 1 << 16


def densify(df: DataFrame, nside: int, step: str | None = "step", idx: str = "idx", in_order: bool = False, block: int = BLOCK) -> DataFrame:
    """Every pixel of every step, zeros where the map is empty. Steps are few.

    Rows meet the next row of their block of pixels and make what is missing between them where they stand; one more row for
    each block covers its beginning. So only the sparse rows and these are shuffled, never what is made of them. With
    in_order, blocks are dealt out by range, so that each partition's pixels follow those of the one before it.
    """
    spark, values, npix = df.sparkSession, [c for c in df.columns if c not in (step, idx)], 12 * nside * nside
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = [] if step is None else [step]
    rows = df.where(F.col(idx).between(0, npix - 1)) if step is None else df.where(F.col(idx).between(0, npix - 1) & F.col(step).isNotNull())
    rows = rows.select(*keys, F.col(idx).cast("long").alias("_pix"), F.lit(True).alias("_own"), *values)
    begins = spark.range(0, npix, block).withColumnRenamed("id", "_pix")
    if step is not None:
        listed = df.agg(F.sort_array(F.collect_set(step)).alias("_steps"))  # a row for each step and block, a few for each gap
        begins = begins.crossJoin(F.broadcast(listed)).select(F.explode("_steps").alias(step), "_pix")
    begins = begins.select(*keys, "_pix", F.lit(False).alias("_own"), *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    both = rows.unionByName(begins).withColumn("_block", F.expr(f"_pix div {block}"))
    both = both.repartitionByRange(*keys, "_block") if in_order else both
    after = F.lead("_pix").over(W.partitionBy(*keys, "_block").orderBy("_pix", "_own"))
    both = both.withColumn("_next", F.coalesce(after, F.least((F.col("_block") + 1) * block, F.lit(npix))))
    made = F.when(F.col("_next") > F.col("_pix"), F.sequence("_pix", F.col("_next") - 1)).when(F.col("_own"), F.array("_pix")).otherwise(F.array().cast("array<bigint>"))
    out = both.select(*keys, "_pix", "_own", *values, F.explode(made).alias("_idx"))
    own = F.col("_own") & (F.col("_idx") == F.col("_pix"))
    return out.select(*keys, F.col("_idx").alias(idx), *[F.when(own, F.col(v)).alias(v) for v in values]).fillna(0, values)


def _unpivot(df: DataFrame, values: tuple[str, ...], *keys: str) -> DataFrame:
    stacked = ", ".join(f"'{c}', cast({c} as double)" for c in values)
    return df.selectExpr(*keys, f"stack({len(values)}, {stacked}) AS (map, v)")


def map_summary(df: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(map, total, least, most, n_nonzero) over all pixels."""
    return _unpivot(df, values).groupBy("map").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") != 0).alias("n_nonzero"))


def particle_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(F.count("*").alias("n"), F.count_if(P.has_bit(F.col("mask"))).alias("n_gas"))


def map_qa(df: DataFrame, values: tuple[str, ...], nside: int, step: str = "step") -> DataFrame:
    """(step, map, least, most, mean, std, n_zero, n_bad, pixels_ok) for each step and map; bad values are NaN and infinities.

    std is the population's. Bad values are counted and left out of the other figures.
    """
    rows = _unpivot(df, values, step)
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    good = F.when(~bad, F.col("v"))
    return rows.groupBy(step, "map").agg(
        F.min(good).alias("least"), F.max(good).alias("most"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), F.count_if(F.col("v") == 0).alias("n_zero"),
        F.count_if(bad).alias("n_bad"), (F.count("*") == 12 * nside * nside).alias("pixels_ok"),
    )


def pixel_mismatch(df: DataFrame, step: str = "step", idx: str = "idx") -> DataFrame:
    """(step, n_mismatch): pixels that a step and the first step do not share."""
    first = df.agg(F.min(step).alias("_s"))
    base = df.join(F.broadcast(first), F.col(step) == F.col("_s")).select(F.col(idx).alias("_b")).distinct()
    own = df.join(base, F.col(idx) == F.col("_b"), "left").groupBy(step).agg(F.count("*").alias("n"), F.count("_b").alias("common"))
    size = base.agg(F.count("*").alias("_size"))
    return own.crossJoin(F.broadcast(size)).select(step, (F.col("n") - F.col("common") + F.col("_size") - F.col("common")).alias("n_mismatch"))


def stack_maps(df: DataFrame, values: tuple[str, ...], slices: list[int] | None = None, step: str = "step", idx: str = "idx") -> DataFrame:
    """Sums over steps for each pixel; with slices (upper ends of step ranges) for each slice and pixel."""
    if slices is None:
        return df.groupBy(idx).agg(*[F.sum(v).alias(v) for v in values])
    number = sum((F.col(step) > s).cast("int") for s in slices)
    return df.withColumn("slice", number).groupBy("slice", idx).agg(*[F.sum(v).alias(v) for v in values])


def map_median(df: DataFrame, values: tuple[str, ...], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """(map, median) of the values that are not null; for an even number of them the mean of the middle two.

    exact takes two values from a sketch that lie just around the middle, by twice its largest error, counts what is below
    them, and ranks only what is between them. Else the sketch alone answers.
    """
    rows = _unpivot(df, values).where("v IS NOT NULL").withColumn("v", F.col("v") + F.lit(0.0))
    if not exact:
        return rows.groupBy("map").agg(F.percentile_approx("v", 0.5, accuracy).alias("median"))
    around = F.percentile_approx("v", F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy)), accuracy)
    cuts = rows.groupBy("map").agg(around.alias("cut"), F.count("*").alias("total"))
    cuts = cuts.select(F.col("map").alias("c_map"), F.col("cut")[0].alias("lo"), F.col("cut")[1].alias("hi"), "total")
    # maps are few: a row for each
    both = rows.join(F.broadcast(cuts), F.col("map") == F.col("c_map"))
    below = both.groupBy(F.col("map").alias("b_map")).agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
    near = both.where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("map", "v", "total").agg(F.count("*").alias("n"))
    near = near.join(F.broadcast(below), F.col("map") == F.col("b_map"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy("map").orderBy("v"))
    near = near.select("map", "v", "n", upto.alias("upto"), F.floor((F.col("total") + 1) / 2).alias("low"), (F.floor(F.col("total") / 2) + 1).alias("high"))
    holds = lambda k: F.max(F.when((F.col("upto") - F.col("n") < F.col(k)) & (F.col(k) <= F.col("upto")), F.col("v")))
    return near.groupBy("map").agg(((holds("low") + holds("high")) / 2).alias("median"))


def with_luminosities(
    df: DataFrame, table: DataFrame, axes: dict[str, tuple[float, float, int]], bands: tuple[str, ...], k: P.Constants = P.Constants(), is_gas: Column | None = None, packed_bytes: int = PACKED_BYTES
) -> DataFrame:
    """df with the luminosities of its rows in the bands, from a table of log10(L / nH^2) on a grid; null for what is no gas of a positive temperature.

    The table's index columns are among a (scale factor), yp (metal-free helium fraction), r (metals to the sun's), nh and t
    (logarithms of hydrogen density and temperature); axes gives the range and the number of points of each. With a as
    the first axis, a row meets only the two time slices around its own.
    """
    state = P.gas_state(*[F.col(c) for c in ("mass", "rho", "zmet", "yhe", "a")], k)
    t = P.gas_temperature(F.col("uu"), F.col("mu"), F.col("a"), k)
    hot = (P.has_bit(F.col("mask")) if is_gas is None else is_gas) & (t > 0)
    at = {"a": F.col("a"), "yp": state["helium_ratio"], "r": P.metal_ratio(F.col("zmet"), state["hydrogen"]), "nh": F.log10(state["n_h"]), "t": F.log10(t)}
    found = grid_interpolate(df, table, {n: (F.when(hot, at[n]), *axes[n]) for n in axes}, bands, tuple(df.columns), packed_bytes)
    return G.sealed(found, **{b: P.luminosity(state["volume"], state["n_h"], F.col(b)) for b in bands})


def map_rms(df: DataFrame, values: tuple[str, ...], npix: int) -> DataFrame:
    """(map, rms): root of the sum of squares, over the number of pixels."""
    return _unpivot(df, values).groupBy("map").agg((F.sqrt(F.sum(F.col("v") * F.col("v"))) / npix).alias("rms"))


def block_sums(df: DataFrame, values: tuple[str, ...], npix: int, blocks: int = 16, idx: str = "idx") -> DataFrame:
    """(block, sums) over equal blocks of pixel numbers."""
    return df.withColumn("block", F.expr(f"cast({idx} div {npix // blocks} as int)")).groupBy("block").agg(*[F.sum(v).alias(v) for v in values])


def rescale_map(df: DataFrame, kind: str, nside: int, particle_mass: float = 1.0, pi: float = math.pi, xray_scaling: float = 1.0) -> DataFrame:
    """Map values in physical terms: potential and velocity for each particle, mass density or flux-weighted temperature."""
    area = 4 * pi / (12 * nside * nside)
    ratio = lambda c: F.when(F.col("rho") > 0, F.col(c) / F.col("rho") / F.lit(area)).otherwise(F.col(c))
    out = df.withColumn("phi", ratio("phi")).withColumn("vel", ratio("vel"))
    if kind == "go":
        return out.withColumn("rho", F.when(F.col("rho") > 0, F.col("rho") * F.lit(particle_mass)).otherwise(F.col("rho")))
    if kind == "hydro":
        return out.withColumn("temp", F.coalesce(F.try_divide(F.col("temp"), F.col("xray4") / F.lit(xray_scaling)), F.col("temp")))
    raise ValueError("kind is 'go' or 'hydro'")


def grid_interpolate(
    df: DataFrame, table: DataFrame, axes: dict[str, tuple[Column, float, float, int]], values: tuple[str, ...], key: tuple[str, ...], packed_bytes: int = PACKED_BYTES
) -> DataFrame:
    """(key, values): multi-linear interpolation of a gridded table at each row of df.

    axes gives, for each index column of the table, (value, lo, hi, n). Values outside of the grid are taken at its edge; a
    null or NaN coordinate gives nulls, and so does a cell with a corner of some weight that the table lacks. Of repeated
    grid points the largest values count.

    The table is packed along its first axis: a row for each pair of neighbouring slices, with an array for each slice and
    value. A row of df meets its pair by one broadcast join and picks its corners by index arithmetic, so rows are neither
    multiplied nor shuffled. The size follows from axes and values alone; a table of more than packed_bytes is joined corner
    by corner.
    """
    n_first, *rest = [n for _, _, _, n in axes.values()]
    cells = math.prod(rest)
    place = {n: (f"_{n}_i", f"_{n}_f") for n in axes}
    # Each sealed step is a method of its own; together they would be too large for the JVM to compile.
    df = G.sealed(df, **{f"_{n}": c.cast("double") for n, (c, *_) in axes.items()})
    for n, (_, lo, hi, size) in axes.items():
        at = F.least(F.greatest((F.col(f"_{n}") - F.lit(float(lo))) / F.lit((hi - lo) / (size - 1)), F.lit(0.0)), F.lit(float(size - 1)))
        df = df.withColumn(f"_{n}", F.when(F.col(f"_{n}").isNotNull() & ~F.isnan(f"_{n}"), at)).withColumn(place[n][0], F.least(F.floor(f"_{n}").cast("int"), F.lit(size - 2)))
    df = G.sealed(df, **{c: e for n, (i, f) in place.items() for c, e in ((i, i), (f, f"_{n} - {i}"))}).drop(*[f"_{n}" for n in axes])
    if n_first < 2 or min(rest, default=2) < 2 or 2 * n_first * cells * len(values) * 8 > packed_bytes:
        return _interpolate_by_corners(df, table, axes, values, key)
    first, *others = axes
    slices = packed_slices(table, {n: axes[n][3] for n in axes}, values)
    strides = [math.prod(rest[k + 1 :]) for k in range(len(rest))]
    base = " + ".join(f"_{n}_i * {m}" for n, m in zip(others, strides, strict=True)) or "0"
    out = df.withColumn("_base", F.expr(f"cast({base} as int)")).join(F.broadcast(slices), F.col(f"_{first}_i") == F.col("_slice"), "left")
    for v in values:

        def corner(k: int, at: int, v: str = v) -> str:
            return f"get(`_p_{v}`, _base + {at})" if k == len(others) else weighed(corner(k + 1, at), corner(k + 1, at + strides[k]), f"_{others[k]}_f")

        out = G.sealed(out, _before=corner(0, 0))
        out = G.sealed(out, _after=corner(0, cells)).drop(f"_p_{v}")
        out = out.withColumn(f"_v_{v}", F.expr(weighed("_before", "_after", f"_{first}_f"))).drop("_before", "_after")
    return out.select(*key, *[F.col(f"_v_{v}").alias(v) for v in values])


def weighed(low: str, high: str, f: str) -> str:
    """Between two values; one of no weight may be missing."""
    return f"(if({f} = 1D, 0D, {low} * (1D - {f})) + if({f} = 0D, 0D, {high} * {f}))"


def packed_slices(table: DataFrame, sizes: dict[str, int], values: tuple[str, ...]) -> DataFrame:
    """(_slice, _p_<value>): for each index of the first axis but the last, an array of its slice and the next one, each in order of the other indices."""
    first, *others = sizes
    cells = math.prod([sizes[n] for n in others])
    flat = " + ".join([f"`{first}` * {cells}L", *[f"`{n}` * {math.prod([sizes[m] for m in others[k + 1 :]])}L" for k, n in enumerate(others)]])
    inside = reduce(lambda a, b: a & b, [F.col(n).between(0, k - 1) for n, k in sizes.items()])
    points = table.where(inside).select(F.expr(flat).alias("id"), *[F.col(v).cast("double").alias(v) for v in values])
    # a row without values for every grid point, so that each has a place
    every = table.sparkSession.range(sizes[first] * cells).select("id", *[F.lit(None).cast("double").alias(v) for v in values])
    points = points.unionByName(every).groupBy("id").agg(*[F.max(v).alias(v) for v in values])
    both = points.select(F.explode(F.expr(f"array(cast(id div {cells} as int), cast(id div {cells} - 1 as int))")).alias("_slice"), "id", *values)
    rows = both.where(F.col("_slice").between(0, sizes[first] - 2)).groupBy("_slice").agg(F.array_sort(F.collect_list(F.struct("id", *values))).alias("_l"))
    return rows.select("_slice", *[F.col("_l").getField(v).alias(f"_p_{v}") for v in values])


def _interpolate_by_corners(df: DataFrame, table: DataFrame, axes: dict[str, tuple[Column, float, float, int]], values: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """The same for a table of any size: the corners of a row as rows with weights, one join on the indices, one sum."""
    names = list(axes)
    corners = []
    for bits in range(1 << len(names)):
        up = [bits >> k & 1 for k in range(len(names))]
        w = reduce(lambda a, b: a * b, [F.col(f"_{n}_f") if u else 1 - F.col(f"_{n}_f") for n, u in zip(names, up, strict=True)])
        corners.append(F.struct(w.alias("w"), *[(F.col(f"_{n}_i") + u).alias(f"_{n}_c") for n, u in zip(names, up, strict=True)]))
    known = reduce(lambda a, b: a & b, [F.col(f"_{n}_f").isNotNull() for n in names])  # least() passes over nulls, so an index is always there
    rows = df.where(known).withColumn("_row", F.monotonically_increasing_id()).select("_row", *key, F.inline(F.array(*corners))).where("w <> 0")
    table = table.groupBy(*[F.col(n).alias(f"_{n}_t") for n in names]).agg(*[F.max(F.col(v).cast("double")).alias(f"_v_{v}") for v in values])
    both = rows.join(table, reduce(lambda a, b: a & b, [F.col(f"_{n}_c") == F.col(f"_{n}_t") for n in names]), "left")
    # A sum would pass over nulls; a missing corner must not.
    whole = lambda v: F.when(F.count(v) == F.count("*"), F.sum(F.col("w") * F.col(v)))
    found = both.groupBy("_row", *key).agg(*[whole(f"_v_{v}").alias(v) for v in values])
    return found.select(*key, *values).unionByName(df.where(~known).select(*key, *[F.lit(None).cast("double").alias(v) for v in values]))


def overdensity(counts: DataFrame, mask: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, delta): (n - mean) / mean on the pixels of mask (pix, inside), 0 outside; the mean is over all mask pixels."""
    both = mask.join(counts.select(F.col(idx).alias("_i"), F.col("n").alias("_n")), F.col("pix") == F.col("_i"), "left")
    both = both.select("pix", "inside", F.coalesce("_n", F.lit(0)).alias("n"))
    mean = both.where("inside").agg(F.avg("n").alias("_mean"))
    delta = F.when(F.col("inside"), F.try_divide(F.col("n") - F.col("_mean"), F.col("_mean"))).otherwise(0.0)
    return both.crossJoin(F.broadcast(mean)).select(F.col("pix").alias(idx), delta.alias("delta"))


def compare_spectra(a: DataFrame, b: DataFrame) -> DataFrame:
    """(l, c_a, c_b, change): |difference| over the first."""
    both = a.select("l", F.col("c_l").alias("c_a")).join(b.select("l", F.col("c_l").alias("c_b")), "l")
    return both.withColumn("change", F.try_divide(F.abs(F.col("c_b") - F.col("c_a")), F.col("c_a")))
