"""Histograms of catalogues; every one is a grouped count, made dense by a join with the list of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as P


def _dense(df: DataFrame, n: int, name: str = "bin") -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def histogram(df: DataFrame, value: Column, n: int, lo: float, hi: float, scale: str = "linear", where: Column | None = None) -> DataFrame:
    """(bin, n, fraction, mean) for bins 0 to n-1.

    The fraction is of all rows, those outside of the range or of `where` included; so is the mean of the value.
    """
    index = P.linear_bin(value, lo, hi, n) if scale == "linear" else P.log_bin(value, lo, hi, n)
    index = index if where is None else F.when(where, index)
    counts = df.select(index.alias("b"), value.cast("double").alias("v")).groupBy("b").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.count("v").alias("k"))
    # One row for each bin and one for what is in none: totals over these are totals over all rows.
    total = counts.agg(F.sum("n").alias("rows"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean"))
    out = _dense(df, n).join(counts.select("b", "n"), F.col("bin") == F.col("b"), "left").crossJoin(F.broadcast(total))
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), F.col("rows")).alias("fraction"), "mean")


def histogram2d_log(
    df: DataFrame, x: Column, y: Column, n: int, x_range: tuple[float, float], y_range: tuple[float, float], skip_first_y: bool = True
) -> DataFrame:
    """(i, j, n, fraction): counts in log10 bins of x and y, also over the number of all rows, those in no bin included.

    With skip_first_y the first bin of y is left out.
    """
    cells = df.select(P.log_bin(x, *x_range, n).alias("i"), P.log_bin(y, *y_range, n).alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("rows"))
    kept = cells.where((F.col("i") >= 0) & (F.col("j") >= (1 if skip_first_y else 0)))
    return kept.crossJoin(F.broadcast(total)).select("i", "j", "n", (F.col("n") / F.col("rows")).alias("fraction"))


def halo_histograms(df: DataFrame, spec: dict[str, tuple[Column, float, float, int, str]]) -> DataFrame:
    """(var, bin, n, fraction) for each name: (value, lo, hi, n, scale), in one pass over the catalogue."""
    bins = {k: P.linear_bin(c, lo, hi, n) if scale == "linear" else P.log_bin(c, lo, hi, n) for k, (c, lo, hi, n, scale) in spec.items()}
    wide = df.select(*[b.alias(k) for k, b in bins.items()])
    stacked = ", ".join(f"'{k}', `{k}`" for k in spec)
    counts = wide.selectExpr(f"stack({len(spec)}, {stacked}) AS (var, bin)").groupBy("var", "bin").agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col("var").alias("t")).agg(F.sum("n").alias("rows"))
    return counts.join(total, F.col("var") == F.col("t")).where("bin IS NOT NULL").select("var", "bin", "n", (F.col("n") / F.col("rows")).alias("fraction"))


def edge_bin(c: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of n equal ones from lo to hi; the last holds its upper edge, what lies outside has none."""
    k = F.floor((c - F.lit(lo)) / F.lit((hi - lo) / n)).cast("int")
    return F.when((c >= lo) & (c <= hi), F.least(k, F.lit(n - 1)))


def projected_counts(df: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """(plane, i, j, n): counts on the planes xy, yz and xz."""
    b = {c: edge_bin(F.col(c), lo, hi, n) for c in "xyz"}
    rows = df.select(*[b[c].alias(f"b{c}") for c in "xyz"]).selectExpr("stack(3, 'xy', bx, by, 'yz', by, bz, 'xz', bx, bz) AS (plane, i, j)")
    return rows.where("i IS NOT NULL AND j IS NOT NULL").groupBy("plane", "i", "j").agg(F.count("*").alias("n"))


def diff_counts(a: DataFrame, b: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """(plane, i, j, difference): projected counts of a less those of b, where either has some."""
    x, y = projected_counts(a, lo, hi, n), projected_counts(b, lo, hi, n)
    out = x.withColumnRenamed("n", "na").join(y.withColumnRenamed("n", "nb"), ["plane", "i", "j"], "full_outer")
    return out.select("plane", "i", "j", (F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("difference"))


def speed_histogram(a: DataFrame, b: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """(src, bin, n) of the speeds in two tables."""
    rows = a.select(F.lit("a").alias("src"), "vx", "vy", "vz").unionByName(b.select(F.lit("b").alias("src"), "vx", "vy", "vz"))
    cell = edge_bin(P.speed(F.col("vx"), F.col("vy"), F.col("vz")), lo, hi, n)
    return rows.select("src", cell.alias("bin")).where("bin IS NOT NULL").groupBy("src", "bin").agg(F.count("*").alias("n"))
