"""Connected components of graphs whose edges have a place, and greedy matching inside of them.

The number of jobs follows from the size of the graph, not from the length of its paths: edges in order of place are united
in each range, and only what links the parts of different ranges goes on, as a smaller graph of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


def united(pairs: Iterator[tuple]) -> dict:
    """For each node of the pairs the node that stands for its component."""
    up: dict = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def in_ranges(edges: DataFrame, order: tuple[str, ...], bipartite: bool, ranges: int) -> DataFrame:
    """The edges with `part`: a number for the component that they belong to in their range of `order`."""
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        ends = [[(bipartite * side, k) for b in held for k in b.column(c).to_pylist()] for side, c in enumerate(("a_key", "b_key"))]
        stands, number, first = united(zip(*ends, strict=True)), {}, TaskContext.get().partitionId() << 36
        parts, at = [number.setdefault(stands[x], first + len(number)) for x in ends[0]], 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts[at : at + b.num_rows], pa.int64())], [*names, "part"])
            at += b.num_rows

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields]
    return checkpointed(edges.repartitionByRange(ranges, *order).mapInArrow(run, ", ".join([*fields, "part long"])))


def components(edges: DataFrame, order: tuple[str, ...], bipartite: bool = True, one_task: int = 2_000_000, ranges: int = 0) -> DataFrame:
    """Edges (a_key, b_key, ...) with `component`, a number. order: columns by which near edges stand together.

    A graph of what links the ranges that has at most `one_task` edges is united in one task; a larger one is cut into
    a quarter as many ranges again, so that it shrinks whatever its form. With bipartite, an a_key and a b_key of one value are two nodes.
    """
    ranges = ranges or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = in_ranges(edges, order, bipartite, ranges)
    side = lambda c, n: parts.select(F.lit(n * bipartite).alias("side"), F.col(c).alias("key"), "part")
    # A node has at most one part in each range.
    nodes = side("a_key", 0).unionByName(side("b_key", 1)).groupBy("side", "key").agg(F.min("part").alias("a_key"), F.collect_set("part").alias("all"))
    links = nodes.where(F.size("all") > 1).select("a_key", F.explode("all").alias("b_key")).where("a_key <> b_key").distinct()
    links = checkpointed(links)
    if links.count() <= one_task:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = united(p for b in batches for p in zip(*[c.to_pylist() for c in b.columns], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in (found.keys(), found.values())], ["p", "root"])

        roots = links.coalesce(1).mapInArrow(run, "p long, root long")
    else:
        again = components(links, ("a_key",), False, one_task, max(1, ranges // 4))
        roots = again.select(F.explode(F.array("a_key", "b_key")).alias("p"), F.col("component").alias("root")).distinct()
    out = parts.join(roots, F.col("part") == F.col("p"), "left")
    return out.select(*edges.columns, F.coalesce("root", "part").alias("component"))


def greedy(edges: DataFrame) -> DataFrame:
    """(a_key, b_key, d2) of the edges (component, a_key, b_key, d2) that are taken nearest first, where neither end is taken yet."""
    ordered = edges.select("component", "a_key", "b_key", "d2").repartition("component").sortWithinPartitions("component", "d2", "a_key", "b_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, b = None, set(), set()
        for batch in batches:
            taken = []
            for k, (c, x, y) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("component", "a_key", "b_key")], strict=True)):
                if c != now:
                    now, a, b = c, set(), set()
                if x not in a and y not in b:
                    a.add(x)
                    b.add(y)
                    taken.append(k)
            yield batch.take(pa.array(taken, pa.int64())).select(["a_key", "b_key", "d2"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return ordered.mapInArrow(run, f"a_key {kinds['a_key']}, b_key {kinds['b_key']}, d2 double")
