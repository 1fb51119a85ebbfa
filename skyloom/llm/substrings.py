"""Removal of repeated passages by relative Lempel-Ziv parsing.

The reference holds each window of ``window`` words once, at its first place: the smallest doc_id that has it, and the
first word where it starts there. A document is parsed greedily against it. A factor starts at a window whose place is in
an earlier document, and goes on as long as the next window's place is the next word of the same document; windows across
the end of a factor are looked up one by one, and the first one found starts the next factor. A factor (doc_id, start,
length, ref_doc, ref_start) is thus a copy of at least ``window`` words, every window that stands in an earlier document
is in a factor, and all words of factors are removed.

* Reference blocks. In each window the smallest of its k-word hashes is its anchor. Equal windows have equal anchors, so
  the reference is cut into blocks by anchor, and a window is looked up in the block of its anchor alone. Neighbouring
  windows mostly share their anchor; they form a segment. Anchors of one document index nothing that could match.
* Segments parsed once. However many documents have a segment, it is parsed against its block once, for the first of them.
  Where the block holds no other segment, it is its own place as a whole. Else its windows are hashed and looked up.
* Factors. The parsed segments of a document, less the parts whose place is not earlier, are joined at their ends.

So every window of every document is looked up against all documents. Only hashes and positions are shuffled, apart from
the texts that are brought together with what was found for them. A passage that many documents share is combined before
the shuffle; no list of the documents of an anchor is ever built, and lists to join with are written first, so that Spark
can split a hot anchor among tasks.

Defined cases: a null or empty text has no words and nothing is removed, its kept text is empty; texts shorter than the
window are kept; repetition inside one document is kept; rows of one doc_id are each parsed by their own text, and none
removes words of another; rows with a null doc_id are kept whole and are no reference; an empty table gives an empty
result; further columns are ignored by ``factors`` and kept, whatever they are called, by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import saved, unused

SEGMENTS = "doc_id long, h long, lo array<int>, n array<int>, anchor array<long>, segment array<long>"
ROW = ["doc_id", "h"]


def segments(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and segment hash of each segment of a text with word hashes h."""
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    g, w = T.rolling(h, k), T.rolling(h, window)
    anchor = T.sliding_argmin(g, window - k + 1)
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(lo, len(anchor)))
    at = anchor[lo]
    with np.errstate(over="ignore"):
        shape = (at - lo).astype(np.uint64) * np.uint64(257) + n.astype(np.uint64)
        whole = T.mixed(w[lo] * T.BASE + T.mixed(w[lo + n - 1] + shape * T.MIX_B))
    return lo, n, g[at], whole


def segment_table(docs: DataFrame, window: int, k: int) -> DataFrame:
    """A row (doc_id, h, lo, n, anchor, segment) for each segment."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [segments(T.word_hashes(T.words(t)), window, k) for t in T.texts(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "h": batch.column("h"),
            "lo": T.lists([f[0].astype(np.int32) for f in found], pa.int32()),
            "n": T.lists([f[1].astype(np.int32) for f in found], pa.int32()),
            "anchor": T.lists([T.signed(f[2]) for f in found], pa.int64()),
            "segment": T.lists([T.signed(f[3]) for f in found], pa.int64()),
        }

    table = saved(T.per_batch(docs.where("doc_id IS NOT NULL"), run, SEGMENTS, rows=500), "segments")
    return table.select(*ROW, F.inline(F.arrays_zip("lo", "n", "anchor", "segment")))


def window_table(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, k, hash, doc_id, at) for each window of the wanted segments (doc_id, h, lo, n, anchor, segment)."""
    lists = wanted.groupBy(*ROW).agg(F.collect_set(F.struct("lo", "n", "anchor", "segment")).alias("s"))
    lists = lists.select(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"), *[F.col(f"s.{c}").alias(c) for c in ("lo", "n", "anchor", "segment")])
    rows = docs.join(lists, (F.col("doc_id") == F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("doc_id", "text", "lo", "n", "anchor", "segment")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = {c: [] for c in ("anchor", "segment", "k", "hash", "doc_id", "at")}
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "lo", "n", "anchor", "segment")]
        for t, i, *parts in zip(T.texts(batch.column("text")), *cols, strict=True):
            w = T.signed(T.rolling(T.word_hashes(T.words(t)), window))
            for lo, n, anchor, segment in zip(*parts, strict=True):
                part = w[lo : lo + n]
                out["hash"].append(part)
                out["k"].append(np.arange(len(part), dtype=np.int32))
                out["at"].append(np.arange(lo, lo + len(part), dtype=np.int32))
                for c, v in (("doc_id", i), ("anchor", anchor), ("segment", segment)):
                    out[c].append(np.full(len(part), v, np.int64))
        flat = {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}
        return {c: pa.array(v, pa.int32() if c in ("k", "at") else pa.int64()) for c, v in flat.items()}

    return T.per_batch(rows, run, "anchor long, segment long, k int, hash long, doc_id long, at int", rows=200)


def joined(places: list[dict]) -> list[tuple[int, int, int, int]]:
    """Runs (p, n, e, q) of n windows from word p whose places start at word q of document e, joined where one goes on in the next."""
    out: list[list[int]] = []
    for p, n, e, q in sorted((r["p"], r["n"], r["e"], r["q"]) for r in places):
        if out and (last := out[-1])[0] + last[1] == p and last[2] == e and last[3] + last[1] == q:
            last[1] += n
        else:
            out.append([p, n, e, q])
    return [tuple(r) for r in out]


PLACES = "array<struct<p: int, n: int, e: bigint, q: int>>"


def parsed_segments(hits: DataFrame, first: DataFrame) -> DataFrame:
    """(anchor, segment, places) of each distinct segment; windows not among hits (anchor, segment, k, e, q) have their place in the segment itself."""
    found = hits.groupBy("anchor", "segment").agg(F.collect_list(F.struct("k", "e", "q")).alias("hits"))
    found = saved(found.withColumnsRenamed({"anchor": "h_anchor", "segment": "h_segment"}), "hits")
    same = (F.col("anchor") == F.col("h_anchor")) & (F.col("segment") == F.col("h_segment"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        places = []
        for hits_, e, lo, n in zip(*(batch.column(c).to_pylist() for c in ("hits", "first", "lo", "n")), strict=True):
            own = {k: (e, lo + k) for k in range(n)} | {h["k"]: (h["e"], h["q"]) for h in hits_}
            own = [{"p": k, "n": 1, "e": e, "q": q} for k, (e, q) in own.items()]
            places.append([dict(zip("pneq", r, strict=True)) for r in joined(own)])
        kind = pa.list_(pa.struct([("p", pa.int32()), ("n", pa.int32()), ("e", pa.int64()), ("q", pa.int32())]))
        return {"anchor": batch.column("anchor"), "segment": batch.column("segment"), "places": pa.array(places, kind)}

    odd = T.per_batch(first.join(found, same).select("anchor", "segment", "hits", "first", "lo", "n"), run, f"anchor long, segment long, places {PLACES}")
    own = F.array(F.struct(F.lit(0).alias("p"), F.col("n"), F.col("first").alias("e"), F.col("lo").alias("q"))).cast(PLACES)
    even = first.join(found, same, "left_anti").select("anchor", "segment", own.alias("places"))
    return even.unionByName(odd)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells rows of one doc_id apart by their texts."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", F.xxhash64("text").alias("h"), "text")


def places_of(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, h, places): runs of windows of each text with their earlier places, for (doc_id, h, text)."""
    every = segment_table(docs, window, k)
    # Anchors of two documents at least; the others index nothing that could match.
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    every = saved(every.join(saved(shared, "anchors"), "anchor", "left_semi").select(*ROW, "lo", "n", "anchor", "segment"), "shared")
    first = every.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "lo", "n", "h")).alias("f"))
    first = saved(first.select("anchor", "segment", F.col("f.doc_id").alias("first"), F.col("f.lo").alias("lo"), F.col("f.n").alias("n"), F.col("f.h").alias("h")), "first")
    # Segments of blocks that hold others too: their windows are looked up one by one.
    several = first.groupBy("anchor").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a <> b").select("anchor")
    wanted = first.join(saved(several, "several"), "anchor", "left_semi").select(F.col("first").alias("doc_id"), "h", "lo", "n", "anchor", "segment")
    windows = saved(window_table(docs, wanted, window), "windows")
    place = windows.groupBy("anchor", "hash").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    place = saved(place.select("anchor", "hash", F.col("f.doc_id").alias("e"), F.col("f.at").alias("q")), "places")
    hits = windows.join(place, ["anchor", "hash"]).where("e <> doc_id OR q <> at").select("anchor", "segment", "k", "e", "q")
    parsed = saved(parsed_segments(hits, first), "parsed").withColumnsRenamed({"anchor": "p_anchor", "segment": "p_segment"})
    runs = every.join(parsed, (F.col("anchor") == F.col("p_anchor")) & (F.col("segment") == F.col("p_segment"))).select(*ROW, "lo", F.inline("places"))
    runs = runs.where("e < doc_id").select(*ROW, F.struct((F.col("lo") + F.col("p")).alias("p"), "n", "e", "q").alias("r"))
    return runs.groupBy(*ROW).agg(F.collect_set("r").alias("places"))


def factors(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """(doc_id, h, start, length, ref_doc, ref_start): words start to start + length of the text with xxhash64 h stand in ref_doc from ref_start."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [(i, h, p, n + window - 1, e, q) for i, h, places in zip(*(batch.column(c).to_pylist() for c in (*ROW, "places")), strict=True) for p, n, e, q in joined(places)]
        names = (*ROW, "start", "length", "ref_doc", "ref_start")
        return {c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(names)}

    return T.per_batch(places_of(keyed(docs), window, k), run, "doc_id long, h long, start long, length long, ref_doc long, ref_start long")


def kept_words(tokens: list[bytes], places: list[dict] | None, window: int) -> list[bytes]:
    """The words outside of all factors."""
    if not places:
        return tokens
    keep = np.ones(len(tokens), bool)
    for p, n, _, _ in joined(places):
        keep[p : p + n + window - 1] = False
    return [t for t, k in zip(tokens, keep.tolist(), strict=True) if k]


def with_places(docs: DataFrame, window: int, k: int) -> tuple[DataFrame, str]:
    """docs with a column of the places of their repeated windows, and its name."""
    places, row, of_id, of_h = unused(docs, "places", "row_h", "of_id", "of_h")
    found = saved(places_of(keyed(docs), window, k), "found").withColumnsRenamed({"doc_id": of_id, "h": of_h, "places": places})
    docs = docs.withColumn(row, F.xxhash64(F.col("text").cast("string")))
    match = (F.col("doc_id").cast("long") == F.col(of_id)) & (F.col(row) == F.col(of_h))
    return docs.join(found, match, "left").drop(row, of_id, of_h), places


def without_repeats(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """The rows of docs with repeated passages taken out of text, its other words joined by one space where any were."""

    @F.pandas_udf("string")
    def cut(text, places):
        return text.combine(places, lambda t, s: t if t is None or s is None else b" ".join(kept_words(T.words(t.encode()), list(s), window)).decode())

    out, places = with_places(docs, window, k)
    return out.withColumn("text", cut(F.col("text").cast("string"), places)).drop(places)


def removal_digest(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every document."""
    slim, places = with_places(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window, k)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        split = [T.words(t) for t in T.texts(batch.column("text"))]
        kept = [kept_words(w, s, window) for w, s in zip(split, batch.column(places).to_pylist(), strict=True)]
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array([len(w) for w in split], pa.int64()),
            "n_removed": pa.array([len(w) - len(x) for w, x in zip(split, kept, strict=True)], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in kept], pa.string()),
        }

    return T.per_batch(slim, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS f FROM p GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM p JOIN f USING (h) WHERE f.f < p.doc_id),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
