"""Comparison of two catalogues: by key, by position, by distribution."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import physics as P
from ..sources.folders import checkpointed
from . import graph


def drop_duplicated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose key stands once; of a repeated key all rows go."""
    names = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in names]).where("_n = 1")
    return one.select(*df.columns)


def duplicated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(n_duplicate_rows): rows whose key stands more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"))


def aligned(a: DataFrame, b: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Full outer join on keys: keys, in_a, in_b, a_<column>, b_<column>."""
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    return left.join(right, list(keys), "full_outer").fillna(False, ["in_a", "in_b"])


def match_counts(pairs: DataFrame) -> DataFrame:
    """(n_pairs, only_a, only_b) of an aligned table."""
    return pairs.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_pairs"),
        F.count_if(~F.col("in_b")).alias("only_a"),
        F.count_if(~F.col("in_a")).alias("only_b"),
    )


def pair_statistics(pairs: DataFrame, columns: tuple[str, ...], guard: float = 0.0) -> DataFrame:
    """(var, mean_diff, std_diff, max_frac, mean_q, std_q, n) for each column of aligned pairs, in one pass.

    Differences are a - b; std is the sample deviation; max_frac is the largest |a - b| / |a| over values with |a| above
    the guard (0 leaves out exact zeros).
    """
    both = pairs.where("in_a AND in_b") if "in_a" in pairs.columns else pairs
    stacked = ", ".join(f"'{c}', a_{c}, b_{c}" for c in columns)
    rows = both.selectExpr(f"stack({len(columns)}, {stacked}) AS (var, a, b)").withColumn("d", F.col("a") - F.col("b"))
    frac = F.when(F.abs("a") > guard, F.abs(F.col("d")) / F.nullif(F.abs("a"), F.lit(0.0)))
    return rows.groupBy("var").agg(
        F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("std_diff"), F.max(frac).alias("max_frac"), F.avg("a").alias("mean_q"),
        F.stddev_samp("a").alias("std_q"), F.count("*").alias("n"),
    )


def verdicts(stats: DataFrame, limit: float, nan_fails: bool = True) -> DataFrame:
    """Adds passed: max_frac below the limit, or mean and deviation of the difference both small against the quantity's."""
    small = (F.abs(F.try_divide("std_diff", "std_q")) < limit) & (F.abs(F.try_divide("mean_diff", "mean_q")) < limit)
    ok = (F.col("max_frac") < limit) | small
    bad = F.isnan("mean_diff") if nan_fails else F.lit(False)
    return stats.withColumn("passed", ~bad & F.coalesce(ok, F.lit(False)))


def failing(verdict: DataFrame) -> DataFrame:
    return verdict.agg(F.count_if(~F.col("passed")).alias("n_failing"), F.count("*").alias("n_columns"))


def compare_by_key(a: DataFrame, b: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], limit: float, guard: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(statistics with verdicts, counts)."""
    pairs = aligned(a, b, keys, columns)
    return verdicts(pair_statistics(pairs, columns, guard), limit, nan_fails=False), match_counts(pairs)


def compare_halos(a: DataFrame, b: DataFrame, columns: tuple[str, ...], limit: float, lo: float, hi: float, tag: str = "fof_halo_tag", mass: str = "fof_halo_mass", guard: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """As compare_by_key, inside a mass window and without tags that stand more than once."""
    clean = [drop_duplicated_keys(x.where(P.mass_window(F.col(mass), lo, hi)).select(tag, *columns), (tag,)) for x in (a, b)]
    pairs = aligned(*clean, (tag,), columns)
    return verdicts(pair_statistics(pairs, columns, guard), limit), match_counts(pairs)


def compare_bins(a: DataFrame, b: DataFrame, tags: DataFrame, columns: tuple[str, ...], limit: float, keys: tuple[str, str] = ("fof_halo_bin_tag", "sod_halo_bin")) -> tuple[DataFrame, DataFrame]:
    """Profile bins of the halos with these tags, aligned on tag and bin.

    The statistics are of bins that both tables hold, so it does to cut the first one by the tags; the second one then stays
    where its own keys have placed it.
    """
    wanted = tags.select(F.col(tags.columns[0]).alias(keys[0])).distinct()
    one, two = (x.join(wanted, keys[0], "left_semi") for x in (a, b))
    return compare_by_key(one, b, keys, columns, limit)[0], compare_by_key(one, two, keys, columns, limit)[1]


def bag_diff_count(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(only_a, only_b): rows of each side without a partner, with repeats counted. One shuffle of counts."""
    both = a.select(*keys, F.lit(1).alias("_side")).unionByName(b.select(*keys, F.lit(-1).alias("_side")))
    net = both.groupBy(*keys).agg(F.sum("_side").alias("_net"))
    return net.agg(F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).alias("only_b"))


def bucket_digests(df: DataFrame, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """(bucket, n, d1, d2): of each bucket of keys how many rows it has and sums of two hashes of them, whatever their order."""
    nulls = [F.col(k).isNull() for k in keys]  # which the hash passes over
    h = F.xxhash64(*keys, *nulls)
    sums = df.select(F.pmod(h, F.lit(buckets)).alias("bucket"), h.alias("h1"), F.xxhash64(*keys, *nulls, F.lit(1)).alias("h2")).groupBy("bucket")
    wide = "decimal(38,0)"  # sums of 64-bit numbers
    return sums.agg(F.count("*").alias("n"), F.sum(F.col("h1").cast(wide)).alias("d1"), F.sum(F.col("h2").cast(wide)).alias("d2"))


def bag_diff_by_digests(a: DataFrame, b: DataFrame, keys: tuple[str, ...], buckets: int = 4096) -> DataFrame:
    """As bag_diff_count, for tables that are mostly the same: first digests of buckets are compared, which are all that is shuffled of equal ones, then only the rows of buckets that differ."""
    one, two = (bucket_digests(x, keys, buckets) for x in (a, b))
    two = two.select(*[F.col(c).alias(f"_{c}") for c in two.columns])
    same = (F.col("bucket") == F.col("_bucket")) & (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    other = one.join(two, same, "left_anti").select("bucket").unionByName(two.join(one, same, "left_anti").select(F.col("_bucket").alias("bucket"))).distinct()
    other = checkpointed(other.select(F.col("bucket").alias("_differs")))  # at most `buckets` numbers
    bucket = F.pmod(F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]), F.lit(buckets))
    return bag_diff_count(*[x.join(F.broadcast(other), bucket == F.col("_differs"), "left_semi").select(*keys) for x in (a, b)], keys)


def in_cubes(df: DataFrame, prefix: str, width: float, tol: float = 0.0) -> DataFrame:
    """The rows with cx, cy, cz, the cube of that width that they are in; with tol, once for each cube that is within tol of them along each axis."""
    cube = lambda c: F.floor(c / width).cast("long")
    reach = tol * 1.001  # rounding puts no row short of a border
    for c in "xyz":
        at = F.col(f"{prefix}{c}")
        df = df.withColumn(f"c{c}", F.explode(F.sequence(cube(at - reach), cube(at + reach))) if tol else cube(at))
    return df


def near_pairs(a: DataFrame, b: DataFrame, tol: float, mass_tol: float, two_sided: bool, key: str, mass: str, within: float = math.inf, edge: float = 4.0) -> DataFrame:
    """(a_key, b_key, d2, cx, cy, cz: a cube of theirs) of all pairs whose coordinates each differ by less than tol and whose masses agree.

    Both sides are cut into cubes of `edge` times tol; b is also put into the other cubes within tol of it (3.4 rows for each at
    an edge of 4), so equal cubes hold every pair that can match. Rows of one key count as one, at their smallest distance.
    With `within`, only pairs nearer than that.
    """
    xyz = ("x", "y", "z")
    left = in_cubes(a.select(F.col(key).alias("a_key"), F.col(mass).alias("a_m"), *[F.col(c).alias(f"a_{c}") for c in xyz]), "a_", edge * tol)
    right = in_cubes(b.select(F.col(key).alias("b_key"), F.col(mass).alias("b_m"), *[F.col(c).alias(f"b_{c}") for c in xyz]), "b_", edge * tol, tol)
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in xyz]
    near = reduce(lambda p, q: p & q, [F.abs(v) < tol for v in d])
    change = F.try_divide(F.col("a_m") - F.col("b_m"), F.col("a_m"))
    near = near & ((F.abs(change) if two_sided else change) < mass_tol)
    if within < math.inf:
        near = near & (P.dist2(*d) < within * within)
    # never broadcast: Spark's estimate does not know how many cubes a row goes to
    return left.join(right.hint("merge"), [f"c{c}" for c in xyz]).where(near).groupBy("a_key", "b_key").agg(F.min(P.dist2(*d)).alias("d2"), *[F.min(f"c{c}").alias(f"c{c}") for c in xyz])


def mutual(pairs: DataFrame) -> DataFrame:
    """The pairs that are the nearest of both their rows; equal distances go by key."""
    first = lambda x, y: F.row_number().over(W.partitionBy(x).orderBy("d2", y))
    ranked = pairs.withColumn("ra", first("a_key", "b_key")).withColumn("rb", first("b_key", "a_key"))
    return ranked.where("ra = 1 AND rb = 1").select("a_key", "b_key", "d2")


def match_by_position(a: DataFrame, b: DataFrame, tol: float = 0.05, mass_tol: float = 0.05, two_sided: bool = False, key: str = "tag", mass: str = "mass") -> DataFrame:
    """(a_key, b_key, d2): one-to-one pairs by place and mass, each the nearest of both its rows."""
    return mutual(near_pairs(a, b, tol, mass_tol, two_sided, key, mass))


def without(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """The pairs of which neither row is in a pair that is taken."""
    return pairs.join(taken.select("a_key"), "a_key", "left_anti").join(taken.select("b_key"), "b_key", "left_anti").select(*pairs.columns)


def match_remainder(
    a: DataFrame, b: DataFrame, tol: float = 0.05, mass_tol: float = 0.05, two_sided: bool = False, key: str = "tag", mass: str = "mass", one_task: int = 1_000_000, near: float = 16.0
) -> DataFrame:
    """(a_key, b_key, d2): as match_by_position, then the same among the rows that are left, until no pair is left.

    That is the matching that takes pairs nearest first (equal distances by key), wherever both rows are free. Of pairs
    nearer than a fraction of tol the mutual nearest ones are so among all pairs, so they are taken first, and all pairs
    within tol are only made of the rows that these leave: what is shuffled does not grow with the square of the density
    of rows that have their partner near. After one
    round of mutual nearest pairs, components of what is left are matched each in a stream of its own, so the number of
    jobs does not grow with chains of pairs that wait for each other. Components of more than one_task pairs are not put
    into one task: from these, rounds of mutual nearest pairs are taken off until they fall apart.
    """
    a, b = (x.select(key, mass, "x", "y", "z") for x in (a, b))
    found = checkpointed(mutual(near_pairs(a, b, tol / near, mass_tol, two_sided, key, mass, within=tol / near)))
    a, b = (x.join(found.select(F.col(f"{s}_key").alias("_taken")), F.col(key) == F.col("_taken"), "left_anti") for s, x in (("a", a), ("b", b)))
    left = checkpointed(near_pairs(a, b, tol, mass_tol, two_sided, key, mass))
    while True:
        new = checkpointed(mutual(left))
        found = found.unionByName(new)
        left = checkpointed(without(left, new))
        if left.isEmpty():
            return found
        parts = checkpointed(graph.components(left, ("cx", "cy", "cz")))
        large = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > one_task)
        small = parts.join(large, "component", "left_anti")
        found = found.unionByName(checkpointed(graph.greedy(small)))
        left = parts.join(large, "component", "left_semi").select(*left.columns)
        if left.isEmpty():
            return found


def match_report(a: DataFrame, b: DataFrame, columns: tuple[str, ...], limit: float, key: str = "tag", **options) -> tuple[DataFrame, DataFrame]:
    """(statistics with verdicts over the pairs, and (n_pairs, only_a, only_b) in keys); of a repeated key the smallest row counts."""
    pairs = match_remainder(a, b, key=key, **options)
    one = lambda df, s: df.groupBy(F.col(key).alias(f"{s}_key")).agg(F.min(F.struct(*columns)).alias(s))
    both = pairs.select("a_key", "b_key").join(one(a, "a"), "a_key", "full_outer").join(one(b, "b"), "b_key", "full_outer")
    wide = both.select(*[F.col(f"{s}.{c}").cast("double").alias(f"{s}_{c}") for s in "ab" for c in columns], F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"))
    return verdicts(pair_statistics(wide, columns), limit), match_counts(wide)


def compare_distributions(a: DataFrame, b: DataFrame, columns: tuple[str, ...], limit: float) -> DataFrame:
    """(var, mean_a, std_a, max_a, mean_b, std_b, max_b, row_difference, passed) without pairing rows; a NaN mean passes."""
    stacked = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    rows = reduce(DataFrame.unionByName, [x.selectExpr(f"'{s}' AS src", f"stack({len(columns)}, {stacked}) AS (var, v)") for s, x in (("a", a), ("b", b))])
    side = lambda f, s: f(F.when(F.col("src") == s, F.col("v")))
    out = rows.groupBy("var").agg(
        *[side(f, s).alias(f"{n}_{s}") for s in "ab" for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", lambda c: F.max(F.abs(c))))],
        (F.count_if(F.col("src") == "a") - F.count_if(F.col("src") == "b")).alias("row_difference"),
    )
    close = lambda n: F.abs(F.try_divide(F.col(f"{n}_b") - F.col(f"{n}_a"), F.col(f"{n}_a"))) < limit
    return out.withColumn("passed", F.isnan("mean_a") | F.isnan("mean_b") | F.coalesce(close("mean") & close("std"), F.lit(False)))


def missing_rows(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a and of b whose key the other side lacks, with `side`."""
    only = lambda x, y, s: x.join(y.select(*keys), list(keys), "left_anti").withColumn("side", F.lit(s)).select(*a.columns, "side")
    return only(a, b, "a").unionByName(only(b, a, "b"))


def missing_distances(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return missing_rows(a, b, keys).select("side", *keys, P.distance(F.col("x"), F.col("y"), F.col("z")).alias("distance"))


def missing_distance_stats(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    d = missing_distances(a, b, keys).groupBy("side")
    return d.agg(F.avg("distance").alias("mean"), F.max("distance").alias("most"), F.min("distance").alias("least"), F.count("*").alias("n"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(same): whether both sides hold the same bag of keys."""
    return bag_diff_by_digests(a.select(key), b.select(key), (key,)).select(((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("same"))


def at_positions(df: DataFrame, key: str) -> DataFrame:
    """(at, key): where each row of a table that is read from files stands, counted over the files in order of their names."""
    rows = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), key)
    # one row a file
    sizes = rows.groupBy(F.col("_file").alias("_f")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_f", F.coalesce(F.sum("_n").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(starts, F.col("_file") == F.col("_f")).select((F.col("_start") + F.col("_row")).alias("at"), key)


def same_order(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n, n_different): rows of the longer table, and how many of them have another key than the row at that place in the other one."""
    both = at_positions(a, key).join(at_positions(b, key).select("at", F.col(key).alias("_b")), "at", "full_outer")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col(key).eqNullSafe(F.col("_b"))).alias("n_different"))


def exact_compare(a: DataFrame, b: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """(var, identical, n_different, max_diff, min_diff, max_rel, min_rel) over keys that both sides hold."""
    pairs = aligned(a, b, keys, columns).where("in_a AND in_b")
    stacked = ", ".join(f"'{c}', a_{c}, b_{c}" for c in columns)
    rows = pairs.selectExpr(f"stack({len(columns)}, {stacked}) AS (var, a, b)").withColumn("d", F.col("b") - F.col("a"))
    rel = F.try_divide(F.col("d"), F.col("a"))
    n = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return rows.groupBy("var").agg(
        (n == 0).alias("identical"), n.alias("n_different"), F.max("d").alias("max_diff"), F.min("d").alias("min_diff"), F.max(rel).alias("max_rel"), F.min(rel).alias("min_rel")
    )


def ratio_stats(a: DataFrame, b: DataFrame, mass_cut: float, tol: float = 0.01, tag: str = "fof_halo_tag", mass: str = "sod_halo_mass", concentration: str = "sod_halo_cdelta", radius: str = "sod_halo_radius", centre: str = "fof_halo_center_") -> DataFrame:
    """(var, pct_within, pct_within_abs, pct_zero, mean, std, n_above, n_below, n) of the relative changes from a to b.

    Halos above the mass cut in a; changes of mass and concentration, and the centre's shift over the radius.
    pct_within is of changes below tol with their sign, pct_within_abs without. Of a repeated tag the first rows of both
    sides are a pair, then the second ones, in order of the columns.
    """
    columns = (mass, concentration, radius, *[f"{centre}{c}" for c in "xyz"])
    a, b = (x.withColumn("_nth", F.row_number().over(W.partitionBy(tag).orderBy(*columns))) for x in (a, b))
    pairs = aligned(a.where(P.mass_window(F.col(mass), mass_cut)), b, (tag, "_nth"), columns).where("in_a AND in_b")
    shift = P.distance(*[F.col(f"b_{centre}{c}") - F.col(f"a_{centre}{c}") for c in "xyz"])
    rows = pairs.select(
        P.rel_change(F.col(f"b_{mass}"), F.col(f"a_{mass}")).alias("m"), P.rel_change(F.col(f"b_{concentration}"), F.col(f"a_{concentration}")).alias("c"), F.try_divide(shift, F.col(f"a_{radius}")).alias("s")
    ).selectExpr("stack(3, 'mass', m, 'concentration', c, 'shift', s) AS (var, r)")
    pct = lambda c: F.lit(100.0) * F.avg(c.cast("double"))
    r = F.col("r")
    return rows.groupBy("var").agg(
        pct(r < tol).alias("pct_within"), pct(F.abs(r) < tol).alias("pct_within_abs"), pct(r == 0).alias("pct_zero"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"),
        F.count_if(r > 0).alias("n_above"), F.count_if(r < 0).alias("n_below"), F.count("*").alias("n"),
    )


def catalog_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, rows): how many rows break each rule, all in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()], F.count("*").alias("rows"))
    stacked = ", ".join(f"'{n}', `{n}`" for n in rules)
    return counts.selectExpr(f"stack({len(rules)}, {stacked}) AS (rule, violations)", "rows")
