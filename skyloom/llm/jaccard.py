"""N-gram Jaccard join by chosen paths, and the groups of near copies that its links make.

Documents are sets of hashes of their runs of five words; two are linked at a Jaccard similarity of 0.8 or more.
Documents with equal sets form one class, and only one of each class goes further.

Chosen paths: in a run, a token is chosen by a set of size n if its hash under that run and level is below 1 / (0.8 n).
Sets that choose the same token meet in a bucket; a bucket above ``limit`` sets splits again by the tokens of the next
level, up to ``levels``. Similar sets share most tokens and the thresholds, so they meet in a run with a probability that
is known; runs are repeated until the target recall is reached at the similarity of 0.8 (``runs_for``). Buckets that hold
the same sets as another are dropped. What is left is compared by brute force: the token sets of a bucket are intersected
by matrix products over blocks of at most ``block`` sets, so a bucket that no level splits (a large group of near copies)
is spread over many tasks. A pair is counted only in the first of the buckets where it meets, so each link counts once.
No pair leaves its task: a task returns, for each set, its number of links and one link to a set of smaller number for
each local component, which is all that the groups need.

Groups are the connected components of the links, found by rounds of joins with pointer jumping.

Defined cases: a text of one to four words is one shingle of all its words; texts without words are in no link and each
is a class of its own; repeated rows are copies, and rows of one doc_id with different texts are documents of their own;
rows with a null doc_id are documents like others in ``near_groups``, where a class without any doc_id has a null class_id,
and are all kept by ``one_of_each_group``, where they link nothing; an empty table gives an empty result; further columns are ignored by ``near_groups`` and kept, whatever they are called, by ``one_of_each_group``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text as T
from .storage import saved, unused


def runs_for(recall: float, similarity: float, levels: int) -> int:
    """Runs until two sets of at least that similarity have met with probability `recall`, if all levels are gone through.

    Both sets choose a shared token if its hash is below the larger set's threshold, 1 / (s n). The larger set shares at
    least s n of its n tokens, so the number of tokens that both choose in a level is about Poisson with a mean of at least
    1; it is that for a set inside of another, and 2 / (1 + s) for sets of equal size.
    """
    meet = (1 - math.exp(-1)) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def chosen(tokens: np.ndarray, runs: int, levels: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(slot, token) of each token chosen; slot is run * levels + level."""
    if not len(tokens):
        return np.empty(0, np.int16), np.empty(0, np.uint64)
    edge = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(tokens)))))
    # An odd multiplier for each slot, drawn by the same mixing, deals the mixed tokens anew.
    odd = T.mixed(np.arange(1, runs * levels + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        hit = [tokens[tokens * m <= edge] for m in odd]
    slots = np.repeat(np.arange(len(odd), dtype=np.int16), [len(x) for x in hit])
    return slots, np.concatenate(hit)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def set_table(docs: DataFrame, n: int, runs: int, levels: int, similarity: float) -> DataFrame:
    """(doc_id, h, key, slots, picks) for each row of (doc_id, h, text) with words; equal sets have equal keys."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, hashes, keys, slots, picks = [], [], [], [], []
        for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h")), T.texts(batch.column("text")), strict=True):
            s = T.shingles(t, n)
            if len(s):
                a, b = chosen(s, runs, levels, similarity)
                ids.append(i)
                hashes.append(h)
                keys.append(set_key(s))
                slots.append(a)
                picks.append(T.signed(b))
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "h": pa.array(hashes, pa.int64()),
            "key": pa.array(keys, pa.binary()),
            "slots": T.lists(slots, pa.int16()),
            "picks": T.lists(picks, pa.int64()),
        }

    return T.per_batch(docs, run, "doc_id long, h long, key binary, slots array<smallint>, picks array<long>", rows=500)


def buckets(sets: DataFrame, runs: int, levels: int, limit: int) -> DataFrame:
    """(bucket, id) of the buckets to compare: those of 2 to limit sets, and at the last level also larger ones."""
    every = sets.select("id", F.inline(F.arrays_zip("slots", "picks"))).select("id", F.col("slots").alias("slot"), F.col("picks").alias("pick"))
    level = F.pmod(F.col("slot").cast("int"), F.lit(levels))
    every = every.withColumn("run", F.expr(f"cast(slot div {levels} as int)")).withColumn("level", level)
    open_ = every.where("level = 0").select(F.xxhash64("run", "pick").alias("bucket"), "id", "run")
    done = None
    for k in range(levels):
        # written first, so that Spark can split a hot bucket in the join
        sizes = saved(open_.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{k}")
        open_ = open_.join(sizes, "bucket")
        if k < levels - 1:
            open_ = saved(open_, f"level{k}")
            small = open_.where(F.col("n") <= limit).select("bucket", "id")
            deeper = every.where(F.col("level") == k + 1).select(F.col("id").alias("d_id"), F.col("run").alias("d_run"), "pick")
            large = open_.where(F.col("n") > limit)
            open_ = large.join(deeper, (F.col("id") == F.col("d_id")) & (F.col("run") == F.col("d_run"))).select(
                F.xxhash64("bucket", "pick").alias("bucket"), "id", "run"
            )
        else:
            small = open_.select("bucket", "id")
        done = small if done is None else done.unionByName(small)
    done = saved(done.distinct(), "buckets")
    # Of buckets that hold the same sets, one stays.
    marks = done.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("id"), 20)).alias("s"), F.expr("bit_xor(xxhash64(id, 1))").alias("x")
    )
    kept = marks.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return saved(done.join(kept, "bucket"), "kept")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    ia, ib = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    common = np.intersect1d(a, b)
    ka, kb = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a, in_b = np.isin(a, common), np.isin(b, common)
    ka, ia, kb, ib = ka[in_a], ia[in_a], kb[in_b], ib[in_b]
    width = max(1, min(len(common), (8 << 20) // max(1, 4 * (len(left) + len(right)))))
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, ia, kb, ib = ka[oa], ia[oa], kb[ob], ib[ob]
    for at in range(0, len(common), width):
        ma, mb = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        sa, sb = slice(*np.searchsorted(ka, (at, at + width))), slice(*np.searchsorted(kb, (at, at + width)))
        ma[ia[sa], ka[sa] - at] = 1
        mb[ib[sb], kb[sb] - at] = 1
        out += ma @ mb.T
    return out


def linked(left: list[dict], right: list[dict], bucket: int, similarity: float) -> np.ndarray:
    """Which pairs are similar and meet in no bucket of a smaller number."""
    la, lb = [r["tokens"] for r in left], [r["tokens"] for r in right]
    na, nb = np.array(list(map(len, la)))[:, None], np.array(list(map(len, lb)))[None, :]
    if len(left) == len(right) == 1:
        common = np.array([[len(np.intersect1d(la[0], lb[0], assume_unique=True))]])
    else:
        common = overlaps(la, lb)
    similar = common >= similarity * (na + nb - common) - 1e-9
    if similar.any():
        before = [[x for x in r["buckets"] if x < bucket] for r in left], [[x for x in r["buckets"] if x < bucket] for r in right]
        if any(before[0]) and any(before[1]):
            similar &= overlaps(*[[np.array(sorted(x), np.int64) for x in side] for side in before]) == 0
    return similar


def forest(pairs: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """For each set in a link that is not the smallest of its component, a link to the smallest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in zip(*np.nonzero(pairs), strict=True):
        x, y = top(a[i]), top(b[j])
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in up if top(x) != x]


def compared(entries: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """(id, links, to): per task and set its number of links, weighted by copies, and a link to join it by, if any.

    Entries carry texts, which are about half as large as their token sets; the sets are made where they are compared.
    """
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")
    rows = entries.withColumn("parts", parts).withColumn("own", own)
    # Each block meets each block of its bucket once: a row goes to the tasks of its block's row and column.
    others = F.expr("transform(sequence(0, parts - 1), p -> struct(least(own, p) as i, greatest(own, p) as j))")
    rows = rows.withColumn("task", F.explode(others)).select("bucket", "id", "key", "text", "buckets", "copies", "own", F.col("task.i").alias("i"), F.col("task.j").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, key = [], set(), None

        def result() -> pa.RecordBatch:
            bucket, i, j = key
            left = [r for r in held if r["own"] == i]
            right = left if i == j else [r for r in held if r["own"] == j]
            links: dict[int, int] = defaultdict(int)
            to: dict[int, int] = {}
            if left and right and len(held) > 1:
                pairs = linked(left, right, bucket, similarity)
                if i == j:
                    np.fill_diagonal(pairs, False)
                wl, wr = np.array([r["copies"] for r in left]), np.array([r["copies"] for r in right])
                for r, c in zip(left, pairs @ wr, strict=True):
                    links[r["id"]] += int(c)
                if i != j:
                    for r, c in zip(right, wl @ pairs, strict=True):
                        links[r["id"]] += int(c)
                to = dict(forest(pairs, [r["id"] for r in left], [r["id"] for r in right]))
            ids = [x for x in links if links[x]]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([links[x] for x in ids], pa.int64()), pa.array([to.get(x) for x in ids], pa.int64())], ["id", "links", "to"]
            )

        for batch in batches:
            texts = T.texts(batch.column("text"))
            rest = {c: batch.column(c).to_pylist() for c in ("bucket", "i", "j", "id", "key", "own", "copies", "buckets")}
            for k, t in enumerate(texts):
                new = (rest["bucket"][k], rest["i"][k], rest["j"][k])
                if new != key:
                    if held:
                        yield result()
                    held, seen, key = [], set(), new
                if rest["id"][k] not in seen:  # a row that repeats
                    tokens = T.shingles(t, words)
                    if set_key(tokens) == rest["key"][k]:  # else another text of this doc_id
                        seen.add(rest["id"][k])
                        held.append({c: rest[c][k] for c in ("id", "own", "copies", "buckets")} | {"tokens": tokens})
        if held:
            yield result()

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "id long, links long, to long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ends of the edges (a, b): root is the smallest id of its connected component.

    Each round takes the smallest root among a node's neighbours, then jumps to that one's own root; a long chain halves
    in each round. Rounds go on until no root changes; nothing but that count reaches the driver.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = saved(both.distinct(), "edges")
    roots = saved(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")), "roots")
    changed, k = 1, 0
    while changed:
        near = both.join(roots.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        # The neighbours' smallest root becomes the root of the own root as well.
        told = roots.join(near, "x").select("x", "root", F.least("root", "r").alias("low"))
        upward = told.groupBy("root").agg(F.min("low").alias("up"))
        now = told.join(upward, "root").select("x", F.least("low", "up").alias("root"), F.col("root").alias("old"))
        jump = now.select(F.col("x").alias("j"), F.col("root").alias("jr"))
        now = now.join(jump, F.col("root") == F.col("j"), "left").select("x", F.least("root", F.coalesce("jr", "root")).alias("root"), "old")
        now = saved(now, f"round{k}")
        changed = now.where("root <> old").limit(1).count()
        roots, k = now.select("x", "root"), k + 1
    return roots.withColumnRenamed("x", "id")


def grouped(
    docs: DataFrame, n: int, similarity: float, recall: float, levels: int, limit: int, block: int
) -> DataFrame:
    """(doc_id, h, group, root, n_links) of each row of (doc_id, h, text) with words; the root is the set that is first in the group.

    Sets have numbers of their own, so that a doc_id may stand in several rows with different texts.
    """
    runs = runs_for(recall, similarity, levels)
    table = saved(set_table(docs, n, runs, levels, similarity), "sets")
    classes = table.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("first"), F.count("*").alias("copies"))
    classes = saved(classes.select("key", "first", "copies", F.monotonically_increasing_id().alias("id")), "classes")
    names = classes.select(F.col("key").alias("c_key"), "first", "copies", "id")
    members = saved(table.select("doc_id", "h", "key").join(names, F.col("key") == F.col("c_key")).select("doc_id", "h", "id", "copies", "first"), "members")
    one = names.select("c_key", "id", F.col("first.doc_id").alias("f_id"), F.col("first.h").alias("f_h"))
    is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    sets = table.join(one, (F.col("key") == F.col("c_key")) & is_first).select("id", "slots", "picks")
    kept = buckets(saved(sets, "first_sets"), runs, levels, limit)
    of_set = kept.groupBy("id").agg(F.collect_set("bucket").alias("buckets")).join(classes.select(F.col("id").alias("c_id"), "key", "copies", "first"), F.col("id") == F.col("c_id"))
    of_set = saved(of_set.select("id", "buckets", "copies", "key", F.col("first.doc_id").alias("f_id"), F.col("first.h").alias("f_h")), "of_set")
    # The entries grow with the corpus: a plan that broadcasts them while they are few would not last.
    entries = kept.join(of_set, "id").hint("shuffle_hash")
    entries = docs.join(entries, is_first).drop("doc_id", "h")
    found = saved(compared(entries, n, similarity, block), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = links.join(roots.withColumnRenamed("id", "r_id"), F.col("id") == F.col("r_id"), "left")
    links = saved(links.select(F.col("id").alias("l_id"), "links", F.coalesce("root", "id").alias("root")), "rooted")
    # The first row of each group: sets in links have it from their root, the others are groups by themselves.
    firsts = links.join(classes.select("id", "first"), F.col("l_id") == F.col("id")).groupBy("root").agg(F.min("first").alias("top"))
    links = saved(links.join(firsts, "root").select("l_id", "links", "top"), "tops")
    return members.join(links, F.col("id") == F.col("l_id"), "left").select(
        "doc_id", "h", F.coalesce("top", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text); h tells rows of one doc_id, or of none, apart by their texts."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", F.xxhash64("text").alias("h"), "text")


def near_groups(
    docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, levels: int = 2, limit: int = 128, block: int = 512
) -> DataFrame:
    """(doc_id, class_id, n_links): the smallest doc_id of the group and the number of other rows linked to this one."""
    docs = keyed(docs)
    out = grouped(docs, n, similarity, recall, levels, limit, block).select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links")
    bare = docs.where(~has_words("text")).select("doc_id")
    return out.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def has_words(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def one_of_each_group(
    docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, levels: int = 2, limit: int = 128, block: int = 512
) -> DataFrame:
    """One row of docs of each group, with the same columns: that with the smallest doc_id, and of these the smallest text hash.

    Rows without words and rows without a doc_id all stay; of rows that repeat doc_id and text one stays.
    """
    gone_id, gone_h, row, nth = unused(docs, "gone_id", "gone_h", "row_h", "nth")
    gone = grouped(keyed(docs).where("doc_id IS NOT NULL"), n, similarity, recall, levels, limit, block).where("doc_id <> first.doc_id OR h <> first.h")
    gone = saved(gone.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).distinct(), "gone").hint("shuffle_hash")
    # Only rows with a doc_id and words can repeat; the others are not brought together.
    may = F.col("doc_id").isNotNull() & has_words("text")
    own = F.col("doc_id").cast("long")
    left = docs.where(may).withColumn(row, F.xxhash64(F.col("text").cast("string")))
    left = left.join(gone, (own == F.col(gone_id)) & (F.col(row) == F.col(gone_h)), "left_anti")
    once = left.withColumn(nth, F.row_number().over(W.partitionBy(own, row).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return once.drop(row, nth).unionByName(docs.where(~may))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, and the components of their links by what each document reaches.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT id AS doc_id, min(other) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.id) AS n_links FROM r GROUP BY id
"""
