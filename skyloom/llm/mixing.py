"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target of words. A document of a source is expected ``target / source_size`` times. Running sums of
these expectations within the source, plus one random offset for each source, say how often a document is emitted: once
for each integer that its step of the running sum crosses. Documents are walked in order of size, so the words taken
stay within about one document of the target.

The running sum of equal expectations is the expectation times the row's rank, so only ranks are needed. They come from
counts of (source, size, salt), summed over sizes and then over salts, and a row number inside one such small group; no
window ever holds a source, and rows that are equal in source and size are spread over the salts.

Defined cases: a null text has size 0; a null source is a source of its own and takes the last weight; sources of size 0
have target 0 and take nothing; rows that repeat are separate documents; an empty table gives an empty result; further
columns are ignored by ``mix_plan`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import saved


#: Names of inner columns.
INNER = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_salt", "mix_source", "mix_nth")


def salt(doc_id: Column, seed: int) -> Column:
    """One of 256 groups over which rows with equal source and size are spread: two hexadecimal digits."""
    return F.coalesce(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f"/{seed}"))), 1, 2), F.lit("00"))


def word_count(text: Column) -> Column:
    """Runs of anything but space, tab, LF, VT, FF and CR; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    The total to take is `share` of all sizes. A source takes min(most * size, weight * level), where the level makes the
    targets add up to the total: sources that reach their cap do so in the order of cap / weight, so one sorted pass finds
    the first source that does not.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = (
        t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    # With all before it at their caps, the level if this source and those after it stay below theirs.
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("capped").alias("k"), F.col("level").alias("v")))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level["v"] * F.col("w"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, columns: list[str], share: float, most: float, weights: tuple[float, ...], seed: int) -> DataFrame:
    """columns of docs, and size, source_size, target and copies under the names in ``INNER``, which docs must not have."""
    size, source_size, target, copies, key, n, nth = INNER
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    sized = docs.select(*[F.col(f"`{c}`") for c in columns], word_count(text).alias(size), salt(F.col("doc_id"), seed).alias(key), source.alias(n), F.xxhash64(text).alias(nth))
    slim = docs.select(source.alias("source"), word_count(text).alias("size"), salt(F.col("doc_id"), seed).alias("salt"))
    if "text" not in columns:  # the rows are slim themselves
        sized = saved(sized, "sizes")
        slim = sized.select(F.col(n).alias("source"), F.col(size).alias("size"), F.col(key).alias("salt"))
    cells = saved(slim.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "cells")
    steps = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights)
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select("source", "size", ahead(W.partitionBy("source").orderBy("size")).alias("of_smaller"))
    cells = cells.select("source", "size", "salt", ahead(W.partitionBy("source", "size").orderBy("salt")).alias("of_salts"))
    sources = sources.withColumnRenamed("source", "t_source")
    steps = steps.join(sources, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("s_source"), F.col("size").alias("s_size"), "of_smaller", "source_size", "target"
    )
    cells = cells.join(steps, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size"))).select(
        *[F.col(c).alias(f"{size}_{c}") for c in ("source", "size", "salt")],
        (F.col("of_smaller") + F.col("of_salts")).alias(f"{size}_before"), F.col("source_size").alias(source_size), F.col("target").alias(target),
    )
    # Rows that are equal here too are equal but for columns that do not count.
    rows = sized.withColumn(nth, F.row_number().over(W.partitionBy(n, size, key).orderBy("doc_id", nth)))
    rows = rows.join(cells, F.col(n).eqNullSafe(F.col(f"{size}_source")) & (F.col(size) == F.col(f"{size}_size")) & (F.col(key) == F.col(f"{size}_salt")))
    expected = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    drawn = F.substring(F.md5(F.concat(F.coalesce(F.col(n), F.lit("")), F.lit(f"/{seed}"))), 1, 7)
    offset = F.conv(drawn, 16, 10).cast("double") / F.lit(float(1 << 28))
    last = F.col(f"{size}_before") + F.col(nth)
    taken = F.floor(last * expected + offset) - F.floor((last - 1) * expected + offset)
    return rows.select(*[F.col(f"`{c}`") for c in columns], size, source_size, target, taken.cast("long").alias(copies))


def mix_plan(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 17
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each row of (doc_id, source, text) is emitted."""
    plan = with_copies(docs.select("doc_id", "source", "text"), ["doc_id", "source"], share, most, weights, seed)
    return plan.select("doc_id", "source", *[F.col(c).alias(c.removeprefix("mix_")) for c in INNER[:4]])


def mixed_documents(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 17
) -> DataFrame:
    """The rows of docs, each as often as ``mix_plan`` emits it, with the same columns. Rows are numbered where they are emitted, so none is looked up by its doc_id."""
    own = [F.col(f"`{c}`").alias(f"doc_{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")]
    plain = docs.select("doc_id", "source", "text", *own)
    plan = with_copies(plain, plain.columns, share, most, weights, seed).where(F.col(INNER[3]) > 0)
    repeated = plan.withColumn(INNER[3], F.explode(F.sequence(F.lit(1), F.col(INNER[3]).cast("int"))))
    return repeated.select(*[F.col(c if c in ("doc_id", "source", "text") else f"doc_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The targets by the same level, and the ranks by one running count.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(substr(md5(doc_id::VARCHAR || '/17'), 1, 2), '00') AS salt FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (
  SELECT source, source_size, ([3e0, 1e0, 2e0])[1 + r % 3] AS w, 2e0 * source_size AS cap FROM s),
o AS (
  SELECT *, 1.5e0 * sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER b, 0e0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER b, 0e0) AS open
  FROM w WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - capped) / open, capped) AS level FROM o WHERE (total - capped) / open * w <= cap),
t AS (
  SELECT d.*, o.source_size, least(o.cap, coalesce(l.level * o.w, o.cap)) AS target,
    ('0x' || substr(md5(coalesce(d.source, '') || '/17'), 1, 7))::BIGINT::DOUBLE / 268435456e0 AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.salt, d.doc_id) AS n
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS e FROM t)
SELECT doc_id, size, source_size, target, ((floor(n * e + u) - floor((n - 1) * e + u))::BIGINT * size)::BIGINT AS taken FROM e
"""
