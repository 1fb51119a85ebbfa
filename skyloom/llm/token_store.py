"""Token-ID output: documents as individually compressed id arrays under one shared Zstandard dictionary.

File format. A store is a folder with two Parquet tables, both written by Spark:

* ``dictionary``: one row (hash, dictionary bytes, dtype, tokenizer file name, end id).
* ``blocks``: a row for each run of up to ``block_docs`` documents or ``block_bytes`` compressed bytes, in document order:
  shard and block number, first and last id, and, for each document, its id, token count and offset into ``data``.
  ``data`` is the concatenation of one Zstandard frame a document. ``dict_hash`` names the dictionary.

One document is read by finding its block through the min/max statistics of ``first_id``/``last_id``, slicing one frame
out of ``data`` by the offset index, and inflating that frame alone.

Defined cases: a null or empty text is the end id alone; repeated rows are stored as often as they occur, ties in doc_id
ordered by a hash of the text; a null doc_id sorts first; an empty table gives an empty store; further
columns of the input are ignored.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text as T
from .storage import shared_dir, trained_dictionary

BLOCKS = (
    "shard int, block int, first_id long, last_id long, ids array<long>, n_tokens array<int>, offsets array<int>, "
    "dict_hash string, data binary"
)
#: Marks that may follow a word; the apostrophe is left out, for a tokenizer may have rules for what comes after it.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What the vocabulary puts at the end of a word's last token.
WORD_END = "</w>"
#: Entries of the word memo before it starts anew.
MEMO = 700_000


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of each word.

    A word here is a run without ASCII white space. Tokens never cross white space with a tokenizer that drops it before
    it splits, so a text's ids are those of its words, one after the other. The tokenizer lowers case and splits letters
    from the marks after them; so words are remembered in lower case, and one that ends in a letter and a mark as the two.
    Both are checked on the tokenizer at hand before they are used.

    New words of letters only are encoded many in one text, which costs less than a text each, and told apart by the
    vocabulary's word-end suffix. Each of them has one token with it at least, so as many such tokens as words means one
    in each word, its last; a text where the numbers differ is encoded word by word.
    """

    def __init__(self, path: str, end_id: int, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.end, self.memo = np.array([end_id], self.dtype).tobytes(), {}
        probe, apart = ("Ab c, x.", "It's A1b, b.###", "c\u00e9."), ("ab c , x .", "it's a1b , b .###", "c\u00e9 .")
        self.lowers = self.encode(["Ab cD É."]) == self.encode(["ab cd É."]) and self.encode(probe) == self.encode(apart)

        vocabulary, added = self.tokenizer.get_vocab(), [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t.lower().encode() for t in added]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if not any(t.replace(" ", "").isalpha() for t in added):  # such a token could stand inside of words
            self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def together(self, words: list[bytes], size: int = 256) -> list[bytes]:
        """For each word of letters its ids, the words of a text encoded together."""
        out, width = [], self.dtype.itemsize
        for at in range(0, len(words), size):
            part = words[at : at + size]
            raw = self.encode([b" ".join(part).decode()])[0]
            cuts = [0, *(width * (np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1)).tolist()]
            if len(cuts) == len(part) + 1 and cuts[-1] == len(raw):
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self.encode([w.decode() for w in part])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def learn(self, new: list[bytes]) -> None:
        """Remembers the ids of each of the words."""
        memo, parts = self.memo, {}
        if self.lowers:
            cores = ((w, w.rstrip(MARKS)) for w in new)
            parts = {w: (c, w[len(c) :]) for w, c in cores if len(c) < len(w) and (c[-1:].isalpha() or unicodedata.normalize("NFC", c.decode()).lower().isalpha())}
            new = list({*(w for w in new if w not in parts), *(c for p in parts.values() for c in p)}.difference(memo))
        if self.ends.any():
            letters = [w for w in new if w.decode().isalpha()]
            memo.update(zip(letters, self.together(letters), strict=True))
            new = [w for w in new if w not in memo]
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            memo.update(zip(part, self.encode([w.decode() for w in part]), strict=True))
        memo.update((w, memo[a] + memo[b]) for w, (a, b) in parts.items())

    def many(self, docs: list[bytes]) -> list[bytes]:
        """For each text its ids as bytes, the end id last."""
        low = [d.lower() for d in docs]
        # A special token spelled out, such as an end mark, must not be split: such a text is encoded whole.
        whole = {k for k, d in enumerate(low) if any(t in d for t in self.added)}
        split = [[] if k in whole else T.words(low[k] if self.lowers else d) for k, d in enumerate(docs)]
        seen = set().union(*split)
        new = list(seen.difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            # Short words come again more often.
            self.memo = {w: v for w, v in self.memo.items() if len(w) < 9}
            if len(self.memo) > MEMO // 2:
                self.memo = {}
            new = list(seen.difference(self.memo))
        self.learn(new)
        get = self.memo.__getitem__
        return [(self.encode([d.decode()])[0] if k in whole else b"".join(map(get, w))) + self.end for k, (d, w) in enumerate(zip(docs, split, strict=True))]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int, dtype: str) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    key = (path, end_id, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def train_dictionary(docs: DataFrame, path: str, end_id: int, dtype: str, sample_docs: int, sample_chars: int, size: int) -> bytes:
    """A dictionary from the serialized ids of `sample_docs` documents, those with the smallest hash of the ones of up to `sample_chars` characters.

    Only where there are fewer of them, longer ones are cut to that length. The bounds are parameters; the dictionary only
    affects size, never content.
    """
    # keys first, so that no text is sorted
    keys = docs.where(F.length("text") > 0).select("doc_id", (F.length("text") > sample_chars).alias("long"), F.xxhash64("doc_id", "text").alias("h"))
    chosen = keys.orderBy("long", "h", "doc_id").limit(sample_docs).select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h")).distinct()
    sample = docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64("doc_id", "text") == F.col("s_h")))
    rows = [r.t.encode() for r in sample.select(F.substring("text", 1, sample_chars).alias("t")).limit(sample_docs).collect()]
    return trained_dictionary(encoder(path, end_id, dtype).many(rows), size)


def write_store(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    vocabulary: int = 49_408,
    sample_docs: int = 1_000,
    sample_chars: int = 20_000,
    dictionary_bytes: int = 32_768,
    block_docs: int = 256,
    block_bytes: int = 4 << 20,
    level: int = 3,
) -> None:
    """Encodes every whole text of (doc_id, text) and writes the store, ordered by doc_id over the whole table."""
    spark = docs.sparkSession
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = train_dictionary(docs, tokenizer, end_id, dtype, sample_docs, sample_chars, dictionary_bytes)
    name = xxhash.xxh3_128_hexdigest(trained)
    spark.createDataFrame(
        [(name, bytearray(trained), dtype, tokenizer.rpartition("/")[2], end_id)],
        "hash string, dictionary binary, dtype string, tokenizer string, end_id long",
    ).coalesce(1).write.parquet(f"{folder}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer, end_id, dtype), TaskContext.get().partitionId()
        dictionary = zstandard.ZstdCompressionDict(trained) if trained else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
        block, ids, counts, frames, held = 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames])
            known = [i for i in ids if i is not None]
            values = [
                [shard], [block], [min(known, default=None)], [max(known, default=None)], [list(ids)], [list(counts)],
                [[0, *ends.tolist()]], [name], [b"".join(frames)],
            ]
            kinds = [
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                pa.list_(pa.int32()), pa.string(), pa.binary(),
            ]
            names = ["shard", "block", "first_id", "last_id", "ids", "n_tokens", "offsets", "dict_hash", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, raw in zip(part.column("doc_id").to_pylist(), enc.many(T.texts(part.column("text"))), strict=True):
                    frame = zip_.compress(raw)
                    ids.append(i)
                    counts.append(len(raw) // enc.dtype.itemsize)
                    frames.append(frame)
                    held += len(frame)
                    if len(ids) >= block_docs or held >= block_bytes:
                        yield row()
                        block, ids, counts, frames, held = block + 1, [], [], [], 0
        if ids:
            yield row()

    # rows that are equal in both are the same row again
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h").drop("h")
    ordered.mapInArrow(pack, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_store(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(shard, block, position, doc_id, before, n_tokens, raw, width): each document's ids as bytes of `width`-byte integers.

    `before` counts the ids ahead of it in its block. With doc_ids, only blocks that can hold them are read and only
    their frames inflated.
    """
    head = spark.read.parquet(f"{folder}/dictionary").first()
    trained, name, width = bytes(head.dictionary), head.hash, np.dtype(head.dtype).itemsize
    wanted = None if doc_ids is None else set(doc_ids)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    if wanted is not None:
        hit = F.lit(False)
        for i in wanted:
            hit = hit | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.where(hit)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = zstandard.ZstdCompressionDict(trained) if trained else None
        unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
        for batch in batches:
            for b in batch.to_pylist():
                if b["dict_hash"] != name:
                    raise ValueError(f"block {b['shard']}/{b['block']} needs dictionary {b['dict_hash']}, the store has {name}")
                keep = [k for k, i in enumerate(b["ids"]) if wanted is None or i in wanted]
                before = np.concatenate([[0], np.cumsum(b["n_tokens"])])
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([b["shard"]] * len(keep), pa.int32()),
                        "block": pa.array([b["block"]] * len(keep), pa.int32()),
                        "position": pa.array(keep, pa.int32()),
                        "doc_id": pa.array([b["ids"][k] for k in keep], pa.int64()),
                        "before": pa.array([int(before[k]) for k in keep], pa.int64()),
                        "n_tokens": pa.array([b["n_tokens"][k] for k in keep], pa.int64()),
                        "raw": pa.array([unzip.decompress(b["data"][b["offsets"][k] : b["offsets"][k + 1]]) for k in keep], pa.binary()),
                    }
                )

    out = blocks.select("shard", "block", "ids", "n_tokens", "offsets", "dict_hash", "data").mapInArrow(
        unpack, "shard int, block int, position int, doc_id long, before long, n_tokens long, raw binary"
    )
    return out.withColumn("width", F.lit(width))


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, block, block_start): ids ahead of each block, by sums of shards first and of blocks within a shard."""
    sizes = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select(
        "shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.select("shard", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("b"))
    return blocks.join(shards, "shard").select("shard", "block", (F.col("s") + F.col("b")).alias("block_start"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the store."""
    docs = read_store(spark, folder)

    def crc(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        width = batch.column("width")[0].as_py()
        raws = batch.column("raw").to_pylist()
        sums = [zlib.crc32(np.frombuffer(r, f"<u{width}").astype("<u4").tobytes()) for r in raws]
        return {c: batch.column(c) for c in ("shard", "block", "doc_id", "before", "n_tokens")} | {"ids_crc32": pa.array(sums, pa.int64())}

    slim = T.per_batch(docs, crc, "shard int, block int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return slim.join(block_starts(spark, folder), ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return digest(spark, folder)
