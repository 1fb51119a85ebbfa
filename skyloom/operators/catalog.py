"""Filters, joins, selections and samples on catalogues and particle tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import physics as P

XYZ = ("x", "y", "z")


def sphere_cut(df: DataFrame, cx: float, cy: float, cz: float, r: float, columns: tuple[str, str, str] = XYZ) -> DataFrame:
    """Rows within r of a centre, the edge included. The enclosing cube comes first: the scan can prune by it."""
    d = [F.col(c) - F.lit(v) for c, v in zip(columns, (cx, cy, cz), strict=True)]
    cube = reduce(lambda a, b: a & b, [F.col(c).between(v - r, v + r) for c, v in zip(columns, (cx, cy, cz), strict=True)])
    return df.where(cube).where(P.dist2(*d) <= r * r)


def distance_limit(df: DataFrame, most2: float = 25_000_000.0) -> DataFrame:
    return df.where(P.dist2(F.col("x"), F.col("y"), F.col("z")) < most2)


def mirrored(df: DataFrame) -> DataFrame:
    """The octant below the plane as if above it."""
    return df.withColumn("z", -F.col("z"))


def octant_mask(spark: SparkSession, nside: int, octant: int = 0) -> DataFrame:
    """(pix, inside) for every RING pixel: the upper (0) or lower (1) octant of positive x and y."""
    df = G.with_direction_of_ring(spark.range(12 * nside * nside).withColumnRenamed("id", "pix"), "pix", nside)
    above = F.col("vz") >= 0 if octant == 0 else F.col("vz") <= 0
    # Centres on a coordinate plane belong to the octant; cos(pi/2) is not exactly 0 in floating point.
    return df.select("pix", ((F.col("vx") >= -1e-12) & (F.col("vy") >= -1e-12) & above).alias("inside"))


def octant_blocks(spark: SparkSession, nside: int, octant: int = 0, edge: float = 1e-12) -> DataFrame:
    """(lo, hi): ranges of NESTED pixels whose centres lie in an octant or within `edge` of it, hi excluded.

    Each of the 12 base pixels is split on its own: a pixel far enough inside is a range, one far enough outside is none, and
    only those that a border crosses are split again. So the work grows as nside and not as the number of pixels.
    """
    levels = nside.bit_length() - 1
    # x and y, and z up or down; a centre on the plane z = 0 is in both octants, as octant_mask has it
    least = ((0, 1, -edge), (1, 1, -edge), (2, 1 if octant == 0 else -1, -edge if edge > 1e-9 else 0.0))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for face in batch.column("id").to_pylist():
                pix, ix, iy, found = np.array([face], np.int64), np.array([0], np.int64), np.array([0], np.int64), []
                for level in range(levels + 1):
                    n, left = 1 << level, levels - level
                    c = G.centres_of_nest(face, ix, iy, n)
                    reach = 0.0 if left == 0 else 1.05 / n  # no centre within a pixel is farther from its own
                    at = [np.arcsin(np.clip(s * c[k], -1, 1)) for k, s, _ in least]
                    # at the last level the coordinate itself decides
                    low = [s * c[k] if left == 0 else np.sin(np.maximum(a - reach, -math.pi / 2)) for a, (k, s, _) in zip(at, least, strict=True)]
                    high = [np.sin(np.minimum(a + reach, math.pi / 2)) for a in at]
                    inside = np.all([v >= t for v, (*_, t) in zip(low, least, strict=True)], axis=0)
                    found += [(p << 2 * left, (p + 1) << 2 * left) for p in pix[inside].tolist()]
                    if left == 0:
                        break
                    split = ~inside & np.all([v >= t for v, (*_, t) in zip(high, least, strict=True)], axis=0)
                    bits = np.arange(4)
                    pix, ix, iy = (v[split] for v in (pix, ix, iy))
                    pix, ix, iy = ((m * v[:, None] + b).ravel() for m, v, b in ((4, pix, bits), (2, ix, bits & 1), (2, iy, bits >> 1)))
                found.sort()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["lo", "hi"])

    return spark.range(12).repartition(12).mapInArrow(descend, "lo long, hi long")


def keep_blocks(df: DataFrame, blocks: DataFrame, key: str, nside: int, nside_low: int = 8) -> DataFrame:
    """Rows whose NESTED pixel is in one of the blocks (lo, hi), which do not overlap; they meet by their parents at nside_low."""
    cell = (nside // nside_low) ** 2
    parents = F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))
    parts = blocks.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(parents).alias("_parent"))
    here = (F.floor(F.col(key) / cell) == F.col("_parent")) & (F.col(key) >= F.col("_lo")) & (F.col(key) < F.col("_hi"))
    return df.join(parts, here, "left_semi")


def octant_pixels(spark: SparkSession, nside: int, nside_hi: int, edge: float = 0.1) -> DataFrame:
    """(pix, inside) for every low-resolution RING pixel: whether a fine pixel within `edge` of the octant lies in it."""
    cell = (nside_hi // nside) ** 2
    touching = octant_blocks(spark, nside_hi, 0, edge).select(F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("n")).distinct()
    touching = G.with_ring_of_nest(touching, "n", nside, "t").select("t")
    every = spark.range(12 * nside * nside).withColumnRenamed("id", "pix")
    return every.join(touching, F.col("pix") == F.col("t"), "left").select("pix", F.col("t").isNotNull().alias("inside"))


def keep_pixels(df: DataFrame, pixels: DataFrame, key: str = "pix") -> DataFrame:
    """Rows whose pixel is in the list (pix)."""
    wanted = pixels.select(F.col("pix").alias("_keep"))
    return df.join(wanted, df[key] == F.col("_keep"), "left_semi")


def octant_first(pixels: DataFrame) -> DataFrame:
    """(pix, rank): pixels of the octant, then the others, each in order; the place where a pixel is written."""
    inside, outside = pixels.where("inside").select("pix", F.lit(0).alias("part")), pixels.where("NOT inside").select("pix", F.lit(1).alias("part"))
    return inside.unionByName(outside)


def substitute_steps(df: DataFrame, rules: DataFrame, step: str = "step", a: str = "a") -> DataFrame:
    """Fills missing steps from others: rules (target, source, lo, hi) give source rows with lo < a <= hi to target.

    Rows of a source that a rule moves leave the source step; all other rows stay as they are.
    """
    r = rules.select(F.col("target").alias("_to"), F.col("source").alias("_from"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    on = (F.col(step) == F.col("_from")) & (F.col(a) > F.coalesce("_lo", F.lit(float("-inf")))) & (F.col(a) <= F.coalesce("_hi", F.lit(float("inf"))))
    moved = df.join(r, on, "left").withColumn(step, F.coalesce("_to", step))
    return moved.drop("_to", "_from", "_lo", "_hi")


def skip_steps(df: DataFrame, bad: list[int], step: str = "step") -> DataFrame:
    return df.where(~F.col(step).isin(bad)) if bad else df


def missing_steps(df: DataFrame, first: int, last: int, step: str = "step") -> DataFrame:
    """The steps of first..last that have no row."""
    want = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("step"))
    have = df.select(F.col(step).cast("int").alias("have")).distinct()
    return want.join(have, F.col("step") == F.col("have"), "left_anti")


def match_properties(lightcone: DataFrame, halos: DataFrame, tag: str = "fof_halo_tag") -> DataFrame:
    """Every lightcone row with the properties of its halo, and `matched`; tags are decoded on both sides.

    Of several halos with one tag that with the largest row (by its properties, in order) counts, so the result does not
    depend on the order of reading; one aggregation with partial maxima, no window.
    """
    names = [c for c in halos.columns if c != tag]
    best = halos.groupBy(P.decode_tag(F.col(tag)).alias("_tag")).agg(F.max(F.struct(*names)).alias("_best"))
    out = lightcone.withColumn("_key", P.decode_tag(F.col(tag))).join(best, F.col("_key") == F.col("_tag"), "left")
    kept = [c for c in lightcone.columns if c not in names]
    return out.select(*kept, *[F.col(f"_best.{c}").alias(c) for c in names], F.col("_tag").isNotNull().alias("matched"))


def drop_repeated_next_step(df: DataFrame, keys: tuple[str, ...] = ("id", "replication"), tie: tuple[str, ...] = (), step: str = "step") -> DataFrame:
    """Rows that do not stand in the next step again, as a bag: n copies there take away n copies here, the first ones by `tie`.

    All of it is one exchange by the keys and one sort: rows are numbered along the steps of a key, and counts over the
    steps before and over the next one turn that into the number of a copy and the number of copies to take away. Tables
    that are bucketed by the keys (``io.write_keyed``) need no exchange. A row with a null in keys or step never repeats.
    """
    along = W.partitionBy(*keys).orderBy(step, *(tie or keys))
    of_steps = W.partitionBy(*keys).orderBy(step)
    out = df.withColumn("_nth", F.row_number().over(along))
    out = out.withColumn("_before", F.count("*").over(of_steps.rangeBetween(W.unboundedPreceding, -1))).withColumn("_again", F.count("*").over(of_steps.rangeBetween(1, 1)))
    known = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in (step, *keys)])
    return out.where(~known | (F.col("_nth") - F.col("_before") > F.col("_again"))).select(*df.columns)


def repeat_report(df: DataFrame, keys: tuple[str, ...] = ("id", "replication"), step: str = "step") -> DataFrame:
    """(step, total, repeated, fraction): rows of each step and how many of them stand in the next step again."""
    counts = df.groupBy(step, *keys).agg(F.count("*").alias("n"))
    after = counts.select((F.col(step) - 1).alias("_step"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("m"))
    on = reduce(lambda p, q: p & q, [F.col(k) == F.col(f"_{k}") for k in (step, *keys)])
    both = counts.join(after, on, "left").withColumn("r", F.least("n", F.coalesce("m", F.lit(0))))
    return both.groupBy(step).agg(F.sum("n").alias("total"), F.sum("r").alias("repeated"), (F.sum("r") / F.sum("n")).alias("fraction"))


def halo_cut(particles: DataFrame, halos: DataFrame, mass_cut: float, radius_cut: float, tag: str = "fof_halo_tag") -> DataFrame:
    """Particles of halos above mass_cut and at radius_cut halo radii or more: the outskirts.

    A particle without a halo has mass 0, which no cut of 0 or more lets pass. halos has tag, centre, sod_halo_mass and
    sod_halo_radius; of equal tags the heaviest counts.
    """
    names = ("fof_halo_center_x", "fof_halo_center_y", "fof_halo_center_z", "sod_halo_radius")
    heavy = halos.where(F.col("sod_halo_mass") > mass_cut)
    best = heavy.groupBy(F.col(tag).alias("_tag")).agg(F.max(F.struct("sod_halo_mass", *names)).alias("_h"))
    both = particles.join(best, F.col(tag) == F.col("_tag"))
    d2 = P.dist2(*[F.col(c) - F.col(f"_h.fof_halo_center_{c}") for c in XYZ])
    return both.where(F.sqrt(d2) >= radius_cut * F.col("_h.sod_halo_radius")).select(*particles.columns)


def select_ids(df: DataFrame, id_list: DataFrame, keys: tuple[str, ...] = ("step", "fof_halo_tag")) -> DataFrame:
    return df.join(id_list.select(*keys).distinct(), list(keys), "left_semi").select(*df.columns)


def locate_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(file, n): the files that hold rows with these ids, and how many. df has to be read from files."""
    named = df.select(F.col(key), F.input_file_name().alias("file"))
    return named.join(ids.select(key).distinct(), key, "left_semi").groupBy("file").agg(F.count("*").alias("n"))


def hash_sample(df: DataFrame, keys: tuple[str, ...], k: int, seed: int = 607, draw: Column | None = None) -> DataFrame:
    """About one row in k, the same ones however the table is partitioned. draw is a number in [0, 1), by default a hash of the keys."""
    if draw is not None:
        return df.where(draw * k < 1)
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(k)) == 0)


def exact_sample(df: DataFrame, rate: float, keys: tuple[str, ...], seed: int = 607, step: str = "step", draw: Column | None = None) -> DataFrame:
    """round(rate * n) rows of each step, those with the smallest draw; ties go by the keys.

    No window holds a step: the draw is cut into 4096 equal parts, running counts over these find the part with the last
    row to take, and only that part is ranked. draw is a number in [0, 1), by default a hash of the keys.
    """
    # 2**-53: the shifted hash has 53 bits
    u = draw if draw is not None else F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) * F.lit(2.0**-53)
    drawn = df.withColumn("_u", u).withColumn("_part", F.floor(F.col("_u") * 4096).cast("int"))
    parts = drawn.groupBy(F.col(step).alias("_step"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("_step").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy("_step"))
    parts = parts.select("_step", "_p", "_n", ahead.alias("_ahead"), F.round(total * F.lit(rate)).cast("long").alias("_want"))
    out = drawn.join(parts, F.col(step).eqNullSafe(F.col("_step")) & (F.col("_part") == F.col("_p"))).where("_ahead < _want")
    whole = out.where("_ahead + _n <= _want")
    last = out.where("_ahead + _n > _want")
    nth = F.row_number().over(W.partitionBy(step, "_part").orderBy("_u", *keys))
    last = last.withColumn("_nth", nth).where("_ahead + _nth <= _want")
    return whole.select(*df.columns).unionByName(last.select(*df.columns))


def pixel_offsets(df: DataFrame, pix: str = "pix", step: str = "step", block_pixels: int = 1 << 16) -> DataFrame:
    """(step, pixel_id, start_idx, count_idx): rows of each pixel and where they start when written in pixel order."""
    counts = df.groupBy(step, F.col(pix).alias("pixel_id")).agg(F.count("*").alias("count_idx"))
    # Running sums over blocks of pixels, then within a block: no window holds the pixels of a step.
    block = F.floor(F.col("pixel_id") / block_pixels)
    blocks = counts.groupBy(F.col(step).alias("_step"), block.alias("_block")).agg(F.sum("count_idx").alias("_n"))
    ahead = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_step", "_block", ahead("_n", W.partitionBy("_step").orderBy("_block")).alias("_ahead"))
    both = counts.withColumn("_in", block).join(blocks, F.col(step).eqNullSafe(F.col("_step")) & (F.col("_in") == F.col("_block")))
    within = ahead("count_idx", W.partitionBy(step, "_in").orderBy("pixel_id"))
    return both.select(step, "pixel_id", (F.col("_ahead") + within).alias("start_idx"), "count_idx")


def next_steps(df: DataFrame, step: str = "step") -> DataFrame:
    """(step, next_step) over the steps that are there."""
    steps = df.select(step).distinct()
    return steps.select(step, F.lead(step).over(W.orderBy(step)).alias("next_step"))
