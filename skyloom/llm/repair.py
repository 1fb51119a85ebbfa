"""Repair of conversation structure: the cheapest edits that make role initials ``(s?(ua)+)?``, by a checkpointed program.

Rows of a conversation in order of turn are kept (0), given another role (3), deleted (4, as blank and duplicate rows must
be), or preceded by an inserted empty message (3); what is left of a truncated row costs 3 more. The grammar has four
states, so a backward vector of four costs says what the rest costs from each of them. Within a run of rows these vectors
are stored at every square root of its length only; the walk forward computes a block's vectors again and takes, of the
edits that are tight, the one whose initial comes first in ASCII. Role to insert or give follow from the state, so the
initials determine the repair.

Rows are placed by range of (conversation, turn, role, text), so a conversation with very many rows spreads over tasks. The
part of a conversation in one range is a segment. Each segment is summed up in a min-plus matrix (costs from state to
state); these, one row a segment, are chained backward into the vector at each segment's end; a second look at the segments
says which state each leads to, chained forward; the last one writes the edits. No task holds more than a range, without
texts. Equal rows of one turn are counted before anything else.

Defined cases: nulls in conv_id and turn count as one space in the checksum of ``damaged``, null roles and texts are one
space; null turns come first; rows of one turn are in the order of role and text, equal rows in a row; a null conv_id is a
conversation of its own; a conversation without rows has zeros, an empty audit and the digest of nothing; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import saved

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. The one that a given or inserted role leads to, that role, and where kept rows lead.
NEXT, GIVEN = (2, 2, 3, 2), ("user", "user", "assistant", "user")
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NONE = (None, None, None, None)
FAR = 1 << 60
Vector = tuple[int, int, int, int]


def closed(b: list[int]) -> Vector:
    """The vector with insertions allowed before what follows."""
    u, a = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return min(b[0], INSERT + u), min(b[1], INSERT + u), u, a


#: At the end of a conversation nothing is left to do in the states that may end it.
END = closed([0, FAR, FAR, 0])


def before(v: Vector, initial: str, live: bool, cut: bool, dropped: int) -> Vector:
    """The vector before a row (if it is live) and `dropped` rows after it that have to go."""
    v = tuple(DELETE * dropped + c for c in v)
    if not live:
        return v
    tail, step, out = CUT if cut else 0, STEP.get(initial, NONE), []
    for s in range(4):
        best = min(DELETE + v[s], REROLE + tail + v[NEXT[s]])
        out.append(best if step[s] is None else min(best, KEEP + tail + v[step[s]]))
    return closed(out)


Rows = list[tuple[str, bool, bool, int]]


def matrix(rows: Rows) -> list[Vector]:
    """For each state at the end, the least costs to get there from each state at the start."""
    out = []
    for t in range(4):
        v = tuple(0 if s == t else FAR for s in range(4))
        for r in reversed(rows):
            v = before(v, *r)
        out.append(v)
    return out


def walk(rows: Rows, state: int, end: Vector, last: bool) -> Iterator[tuple[int, str, int, str | None, int]]:
    """(row, edit, times, role given, cost) of the tight edits that come first in ASCII; the state at the end is the last item, as a row of its own."""
    size = max(1, math.isqrt(len(rows)))
    marks, v = [end], end  # vectors at the ends of blocks, the last block's first
    for k in range(len(rows) - 1, -1, -1):
        v = before(v, *rows[k])
        if k % size == 0:
            marks.append(v)
    for start in range(0, len(rows), size):
        now = marks.pop()
        block = rows[start : start + size]
        after, v = [], marks[-1]
        for r in reversed(block):
            after.append(v)
            v = before(v, *r)
        for k, (r, rest) in enumerate(zip(block, reversed(after), strict=True), start):
            initial, live, cut, dropped = r
            tail, step = CUT if cut else 0, STEP.get(initial, NONE)
            beyond = tuple(DELETE * dropped + c for c in rest)
            while live:
                if now[state] == DELETE + beyond[state]:
                    yield k, "D", 1, None, DELETE
                    break
                if now[state] == INSERT + now[NEXT[state]]:
                    yield k, "I", 1, GIVEN[state], INSERT
                    state = NEXT[state]
                    continue
                if step[state] is not None and now[state] == tail + beyond[step[state]]:
                    yield k, "K", 1, None, tail
                    state = step[state]
                else:
                    yield k, "R", 1, GIVEN[state], REROLE + tail
                    state = NEXT[state]
                break
            if dropped:
                yield k, "D", dropped, None, DELETE * dropped
            now = rest
    while last and end[state]:
        yield len(rows) - 1, "I", 1, GIVEN[state], INSERT
        state = NEXT[state]
    yield -1, "", state, None, 0


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one row in five damaged: dropped, emptied, without its stops, doubled, or the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), draw.alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 3, F.array_repeat(F.lit(1), 2)).otherwise(F.array(F.lit(1)))
    return out.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def placed(rows: DataFrame) -> DataFrame:
    """Distinct rows in order, saved: (pid, at, conv_id, turn, role, text, copies, blank, first, cut).

    pid numbers the ranges, at the rows. blank rows hold white space only; first says that no earlier row says the same;
    cut that the text ends without a stop.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    cells = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    says = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    cells = cells.withColumn("says", says)
    when = F.struct(F.col("turn").isNotNull().alias("n"), F.col("turn").alias("t"))
    firsts = cells.groupBy(F.col("conv_id").alias("f_conv"), F.col("says").alias("f_says")).agg(F.min(when).alias("at_first"))
    both = cells.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("says") == F.col("f_says")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = F.col("turn").eqNullSafe(F.col("at_first.t"))
    both = both.select("conv_id", "turn", "role", "text", "copies", blank.alias("blank"), first.alias("first"), cut.alias("cut"))
    order = ("conv_id", "turn", "role", "text")
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ranged.select(F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at"), *both.columns), "placed")


def by_segment(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], make, schema: str) -> DataFrame:
    """make(columns of one group as lists) -> rows, for each group of keys; a task holds one group at a time."""
    names, kinds = df.columns, [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [[] for _ in names], None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            now = list(zip(*[columns[names.index(k)] for k in keys], strict=True))
            cuts = [0, *(k for k in range(1, len(now)) if now[k] != now[k - 1]), len(now)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held[0] and now[a] != key:
                    out += make(dict(zip(names, held, strict=True)))
                    held = [[] for _ in names]
                key = now[a]
                for h, c in zip(held, columns, strict=True):
                    h += c[a:b]
                if len(out) >= 5000:
                    yield batch_of(out)
                    out = []
        if held[0]:
            out += make(dict(zip(names, held, strict=True)))
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(list(v), arrow[n]) for n, v in zip(kinds, zip(*rows, strict=True), strict=True)})

    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    arrow = {f.split()[0]: plain[f.split()[1]] for f in schema.split(", ")}
    conv = df.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    if conv not in plain:
        raise ValueError(f"conv_id is {conv}; it has to be a long, an int or a string")
    arrow["conv_id"], schema = plain[conv], schema.replace("conv_id long", f"conv_id {conv}")
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _rows(g: dict[str, list], start: int = 0) -> Rows:
    """Of each distinct row: initial, whether one of its copies may stay, whether that one is cut, how many have to go."""
    out = []
    for role, n, blank, first, cut in zip(*[g[c][start:] for c in ("initial", "copies", "blank", "first", "cut")], strict=True):
        live = first and not blank
        out.append((role, live, cut, n - live))
    return out


def summed(g: dict[str, list]) -> list[tuple]:
    """A segment's matrix, its first and last initial, and the illegal neighbours in it."""
    rows, role = _rows(g), g["initial"]
    pairs = sum(n - 1 for n in g["copies"]) + sum(illegal(x, y) for x, y in zip(role, role[1:]))
    return [(g["conv_id"][0], g["pid"][0], [c for v in matrix(rows) for c in v], role[0], role[-1], pairs)]


def illegal(x: str, y: str) -> bool:
    return x + y not in ("su", "ua", "au")


def chained(g: dict[str, list]) -> list[tuple]:
    """For each segment of a conversation the vector at its end, whether it is the last, and illegal neighbours with those at its border."""
    out, v, n = [], END, len(g["pid"])
    for k in range(n - 1, -1, -1):
        border = k > 0 and illegal(g["final"][k - 1], g["initial"][k])
        out.append((g["conv_id"][k], g["pid"][k], list(v), k == n - 1, g["pairs"][k] + border))
        m = g["matrix"][k]
        v = tuple(min(FAR, *(m[4 * t + s] + v[t] for t in range(4))) for s in range(4))
    return out


def leads_to(g: dict[str, list]) -> list[tuple]:
    """The state after a segment for each state before it; nothing for groups whose first row is not a head."""
    if g["at"][0] is not None:
        return []
    rows, v, last = _rows(g, 1), tuple(g["vector"][0]), g["last"][0]
    ends = [0] * 4 if last else [[*walk(rows, s, v, False)][-1][2] for s in range(4)]
    return [(g["conv_id"][0], g["pid"][0], ends)]


def entered(g: dict[str, list]) -> list[tuple]:
    out, state = [], 0
    for c, p, ends in zip(g["conv_id"], g["pid"], g["ends"], strict=True):
        out.append((c, p, state))
        state = ends[state]
    return out


def edits_of(g: dict[str, list]) -> list[tuple]:
    rows = _rows(g, 1)
    done = list(walk(rows, g["state"][0], tuple(g["vector"][0]), g["last"][0]))[:-1]
    return [(g["conv_id"][0], g["at"][k + 1], nth, e, n, role, cost) for nth, (k, e, n, role, cost) in enumerate(done)]


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edits, placed rows, segments) of conversations (conv_id, turn, role, text).

    edits: (conv_id, at, nth, edit, times, cost, role, text) in the order of (at, nth); role and text are those of the
    message that stands there after the edit, null for deletions.
    """
    table = placed(rows)
    slim = table.select("conv_id", "pid", "at", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "first", "cut")
    segment, conversation = ("conv_id", "pid"), ("conv_id",)
    parts = by_segment(slim, segment, ("at",), summed, "conv_id long, pid int, matrix array<long>, initial string, final string, pairs long")
    heads = saved(by_segment(saved(parts, "parts"), conversation, ("pid",), chained, "conv_id long, pid int, vector array<long>, last boolean, pairs long"), "heads")
    headed = lambda h: slim.unionByName(h, allowMissingColumns=True)  # noqa: E731  a head has no `at`, so it comes first
    # which state a segment leads to matters where another one follows
    more = heads.select("conv_id").groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("m_conv"))
    several = heads.join(more, F.col("conv_id").eqNullSafe(F.col("m_conv")), "left_semi")
    ends = by_segment(headed(several.select(*segment, "vector", "last")), segment, ("at",), leads_to, "conv_id long, pid int, ends array<long>")
    states = by_segment(ends, conversation, ("pid",), entered, "conv_id long, pid int, state long")
    states = states.select(F.col("conv_id").alias("s_conv"), F.col("pid").alias("s_pid"), "state")
    entry = heads.join(states, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("pid") == F.col("s_pid")), "left")
    entry = entry.select(*segment, "vector", "last", F.coalesce("state", F.lit(0)).alias("state"))
    done = by_segment(headed(entry), segment, ("at",), edits_of, "conv_id long, at long, nth long, edit string, times long, given string, cost long")
    said = table.select(F.col("at").alias("t_at"), F.col("role").alias("t_role"), F.col("text").alias("t_text"))
    both = done.join(said, F.col("at") == F.col("t_at"))
    role = F.when(F.col("edit") != "D", F.coalesce("given", "t_role"))
    text = F.when(F.col("edit") == "I", "").when(F.col("edit") != "D", F.col("t_text"))
    return both.select("conv_id", "at", "nth", "edit", "times", "cost", role.alias("role"), text.alias("text")), table, heads


def repair_report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of `every`."""
    edits, table, heads = repaired(rows)
    n, live = F.col("copies"), F.col("first") & ~F.col("blank")
    when = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    # 1 + most - least turns, less the distinct ones; sums beyond a long stop at the largest one
    span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count_distinct("turn"))
    gaps = F.when(F.count("turn") == 0, 0).otherwise(F.coalesce(span, F.lit((1 << 63) - 1)))
    counts = table.groupBy("conv_id").agg(
        gaps.alias("gaps"), when(F.col("blank"), n).alias("blank"), when(~F.col("blank"), n - live.cast("int")).alias("duplicate"), when(live & F.col("cut"), 1).alias("truncated")
    )
    pairs = heads.groupBy(F.col("conv_id").alias("p_conv")).agg(F.sum("pairs").alias("illegal"))
    listed = lambda keep, c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "nth", c.alias("t"))))), lambda x: x["t"]), by)
    kept = F.col("edit") != "D"
    audits = edits.groupBy(F.col("conv_id").alias("a_conv")).agg(
        F.sum("cost").alias("cost"), listed(F.lit(True), F.repeat("edit", F.col("times").cast("int")), "").alias("audit"), listed(kept, F.concat("role", F.lit(":"), "text"), "\n").alias("lines")
    )
    out = every.select(F.col("conv_id").alias("e_conv")).distinct()
    for side, key in ((counts, "conv_id"), (pairs, "p_conv"), (audits, "a_conv")):
        out = out.join(side, F.col("e_conv").eqNullSafe(F.col(key)), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    blank_text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        F.col("e_conv").alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], blank_text("audit").alias("audit"),
        F.sha2(blank_text("lines").cast("binary"), 256).alias("repaired_sha256"),
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), rows)
