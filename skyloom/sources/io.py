"""Scans and sinks. Reading prunes columns, steps and row groups; writing lays files out for that."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..operators import catalog, maps


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Named columns of a Parquet table. Old column names are taken to new ones by aliases; a missing column is an error."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    df = df.withColumnsRenamed({k: v for k, v in (aliases or {}).items() if k in df.columns})
    if columns and (lost := [c for c in columns if c not in df.columns]):
        raise ValueError(f"{path} has no columns {lost}")
    return df.select(*columns) if columns else df


def scan_steps(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, steps: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table partitioned by step, of a range or a list of steps; only their folders are read."""
    df = scan(spark, path)
    if first is not None and last is not None:
        df = df.where(F.col("step").between(first, last))
    if steps is not None:
        df = df.where(F.col("step").isin([int(s) for s in steps]))
    return df.select(*columns) if columns else df


def step_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, step) from a text file of step numbers."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("position", "s"))
    return lines.where("s <> ''").select("position", F.col("s").cast("int").alias("step"))


def membership(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(fof_halo_tag, id, source) of several membership tables."""
    parts = [scan(spark, p, ["fof_halo_tag", "id"]).withColumn("source", F.lit(s)) for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inspect(df: DataFrame) -> DataFrame:
    """(name, type, n): columns and row count."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string").crossJoin(df.agg(F.count("*").alias("n")))


def write_steps(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each step."""
    df.write.mode(mode).partitionBy("step").parquet(path)


def write_map(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(step, idx, values), each step in pixel order: ranges of idx prune row groups when read."""
    df.repartitionByRange("step", "idx").sortWithinPartitions("step", "idx").write.mode(mode).partitionBy("step").parquet(path)


def write_dense(df: DataFrame, path: str, nside: int, values: tuple[str, ...], mode: str = "errorifexists") -> None:
    """One folder for each map, every pixel in order: a row's place is its pixel."""
    full = maps.densify(df, nside, in_order=True).sortWithinPartitions("step", "idx")
    for v in values:
        full.select("step", "idx", v).write.mode(mode).partitionBy("step").parquet(f"{path}/{v}")


def write_keyed(df: DataFrame, table: str, path: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """The table, written in buckets of its keys and read back. Tables with the same keys and buckets are joined, and one of them grouped, by these keys without an exchange."""
    df.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def write_ranged(df: DataFrame, path: str, key: str, files: int) -> None:
    """Rows in `files` ranges of a key, with Bloom filters of it, and beside them the least and the most key of each file."""
    ranged = df.repartitionByRange(files, key).sortWithinPartitions(key)
    ranged.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), key)
    rows.groupBy("file").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).write.parquet(f"{path}/ranges")


def files_of_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, cells: int = 4096) -> DataFrame:
    """(file): files whose range may hold one of the ids, by cells of the key's whole range."""
    ranges = scan(spark, f"{path}/ranges").where("lo IS NOT NULL")
    whole = ranges.agg(F.min("lo").alias("_from"), F.greatest(F.ceil((F.max("hi") - F.min("lo") + 1) / cells), F.lit(1)).alias("_width"))
    cell = lambda c: F.floor((F.col(c) - F.col("_from")) / F.col("_width"))
    by_cell = ranges.crossJoin(F.broadcast(whole)).select("file", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("_cell"))
    wanted = ids.select(F.col(key).alias("_id")).distinct().crossJoin(F.broadcast(whole)).select("_id", cell("_id").alias("_in"))
    return by_cell.join(wanted, (F.col("_cell") == F.col("_in")) & F.col("_id").between(F.col("lo"), F.col("hi")), "left_semi").select("file").distinct()


def read_ids(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """The rows with these ids, from the files that may hold some of them."""
    every = scan(spark, f"{path}/rows")
    names = sorted(r.file for r in files_of_ids(spark, path, ids, key).collect())  # one name a file
    rows = spark.read.schema(every.schema).parquet(*names) if names else every.where("false")
    return rows.join(ids.select(key).distinct(), key, "left_semi").select(*every.columns)


def write_sample(df: DataFrame, path: str, rate: float, keys: tuple[str, ...], seed: int = 607, mode: str = "errorifexists", draw: Column | None = None) -> None:
    """An exact share of each step's particles; draw as for exact_sample."""
    write_steps(catalog.exact_sample(df, rate, keys, seed, draw=draw), path, mode)


def write_by_pixel(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Folders zrange / pix / step. Rows are brought together by all three; Spark deals a large pixel over several tasks, each with a file of its own."""
    df.hint("rebalance", "zrange", "pix", "step").write.mode(mode).partitionBy("zrange", "pix", "step").parquet(path)


def write_slabs(df: DataFrame, path: str, slabs: int, mode: str = "errorifexists", task_rows: int = 1_000_000) -> None:
    """Rows of a step in pixel order in `slabs` ranges of pixels, and a table of offsets beside them.

    A table of more than task_rows rows is cut into more ranges, as many for each slab, so that no task sorts much more than
    that; then the rows of one pixel may go on in the next file. Within a step, files follow each other in pixel order in both cases.
    """
    catalog.pixel_offsets(df).write.mode(mode).partitionBy("step").parquet(f"{path}/offsets")
    rows = scan(df.sparkSession, f"{path}/offsets").agg(F.sum("count_idx")).first()[0] or 0
    if rows <= task_rows:
        ranged = df.repartitionByRange(slabs, "pix").sortWithinPartitions("step", "pix")
    else:
        tasks = slabs * math.ceil(rows / (slabs * task_rows))
        cut = df.withColumn("_row", F.xxhash64(*df.columns))  # where a pixel of many rows is cut
        ranged = cut.repartitionByRange(tasks, "pix", "step", "_row").drop("_row").sortWithinPartitions("step", "pix")
    ranged.write.mode(mode).partitionBy("step").parquet(f"{path}/rows")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(step, file, n, start): the files of a table partitioned by step, and the place of each one's first row within its step.

    Files of a step follow each other by name, which is the order that they were written in. Counting them reads no column.
    """
    rows = scan(spark, path).select("step", F.col("_metadata.file_path").alias("file"))
    sizes = rows.groupBy("step", "file").agg(F.count("*").alias("n"))
    before = W.partitionBy("step").orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_places(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(step, place, columns): every row with its place within its step. Of a map written by ``write_dense`` that is its pixel, whose number is not read."""
    starts = file_starts(spark, path).select("file", "start")
    rows = scan(spark, path).select("step", *columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(starts, F.col("_file") == F.col("file")).select("step", (F.col("start") + F.col("_row")).alias("place"), *columns)


def pixel_ranges(spark: SparkSession, path: str, pixels: DataFrame) -> DataFrame:
    """(file, lo, hi): where in the files of slabs the rows of the pixels (pix) stand."""
    offsets = scan(spark, f"{path}/offsets").join(pixels.select(F.col("pix").alias("pixel_id")).distinct(), "pixel_id", "left_semi")
    wanted = offsets.select(F.col("step").alias("w_step"), F.col("start_idx").alias("lo"), (F.col("start_idx") + F.col("count_idx")).alias("hi"))
    files = file_starts(spark, f"{path}/rows")
    meets = (F.col("step") == F.col("w_step")) & (F.col("lo") < F.col("start") + F.col("n")) & (F.col("hi") > F.col("start"))
    return files.join(wanted, meets).select("file", (F.col("lo") - F.col("start")).alias("lo"), (F.col("hi") - F.col("start")).alias("hi"))


def read_pixels(spark: SparkSession, path: str, pixels: DataFrame) -> DataFrame:
    """The rows of the pixels (pix) from slabs, found by their offsets: only files with some of these rows are opened, and of these only the rows at the places."""
    ranges, every = pixel_ranges(spark, path, pixels), scan(spark, f"{path}/rows")
    names = sorted(r.file for r in ranges.select("file").distinct().collect())  # one name a file
    rows = spark.read.option("basePath", f"{path}/rows").schema(every.schema).parquet(*names) if names else every.where("false")
    found = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    inside = (F.col("_file") == F.col("file")) & (F.col("_row") >= F.col("lo")) & (F.col("_row") < F.col("hi"))
    return found.join(ranges, inside).select(*rows.columns)


#: What the columns of a rescaled map hold.
DESCRIPTIONS = {
    "rho": "mass density", "phi": "potential", "vel": "line-of-sight velocity", "temp": "flux-weighted temperature", "tsz": "Compton y", "ksz": "kinetic decrement",
    "xray1": "flux, band 1", "xray2": "flux, band 2", "xray3": "flux, band 3", "xray4": "bolometric flux",
}


def write_rescaled(df: DataFrame, path: str, kind: str, nside: int, particle_mass: float = 1.0, pi: float = math.pi, mode: str = "errorifexists") -> None:
    """A rescaled map in single precision, in pixel order, with a description in each column's metadata."""
    out = maps.rescale_map(df, kind, nside, particle_mass, pi)
    values = [c for c in out.columns if c not in ("step", "idx")]
    described = [F.col(c).cast("float").alias(c, metadata={"comment": DESCRIPTIONS.get(c, c)}) for c in values]
    write_map(out.select("step", "idx", *described), path, mode)


def write_text(df: DataFrame, path: str, order: tuple[str, ...] = (), mode: str = "errorifexists", bounded: bool = False) -> None:
    """A table as CSV: lists of distances, flat maps. Files are ranges in the order asked for; a table of bounded size, such as bins or steps, is one file."""
    df = df.orderBy(*order) if order else df
    (df.coalesce(1) if bounded else df).write.mode(mode).csv(path, header=True)


def write_histogram(hist: DataFrame, path: str, value: str = "fraction", mode: str = "errorifexists") -> None:
    """(bin, value) as text, a line for each bin."""
    write_text(hist.select("bin", value), path, ("bin",), mode, bounded=True)


def write_histogram2d(df: DataFrame, path: str, n: int, mode: str = "errorifexists", value: str = "fraction") -> None:
    """(i, j, value) as a matrix of text: a line for each i with its number and n values, 0 for empty cells."""
    wide = df.groupBy("i").pivot("j", list(range(n))).agg(F.sum(value))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("_i"))
    out = every.join(wide, F.col("_i") == F.col("i"), "left").drop("i").fillna(0)
    write_text(out.withColumnRenamed("_i", "i"), path, ("i",), mode, bounded=True)


def read_histogram2d(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(i, j, value) of a matrix of text, empty cells included."""
    wide = spark.read.csv(path, header=True, schema="i int, " + ", ".join(f"`{j}` double" for j in range(n)))
    return wide.selectExpr("i", f"stack({n}, {', '.join(f'{j}, `{j}`' for j in range(n))}) AS (j, value)")


def write_logs(qa: DataFrame, path: str, statistic: str, names: list[str], mode: str = "errorifexists") -> None:
    """One line for each step, one value for each map, of one statistic of map_qa."""
    write_text(qa.groupBy("step").pivot("map", names).agg(F.first(statistic)), path, ("step",), mode, bounded=True)
