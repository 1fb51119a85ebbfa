"""Cross-tokenizer alignment: where the tokens of two tokenizers end together in each document.

The tokens of A and B of one text are two lists of byte ends. A dictionary from end to index is made of each list; the
intersection of their keys, sorted, cuts both id lists into groups, and the last tokens of a group are linked.

Words are remembered with what they align to. A word here is a run of white space and the run of other characters after
it. A's pattern never matches from other characters into white space, and neither does a token of B, except for the
characters in ``Aligner.glue`` (found in B's vocabulary); a text with one of these is aligned whole. So both tokenizers end
a token at each word's end, and a text's groups are those of its words. New words are encoded many in one text and cut;
the white space that ends a text, a word without other characters, is encoded by itself.

Of two tokens that end together, the shorter one's bytes end the longer one's. So the vocabularies alone bound the number
of id pairs that can ever be linked (``PairTable``, 324,297 for the two files of the query, whatever the corpus holds).
A group has one link, for no token is without bytes.
Links are stored as pair numbers, counted in a dense vector for each task, and only that table of counts is broadcast.

Defined cases: a text that is null or empty, or whose joined tokens of either side differ from a space and the text, has
no tokens: zeros and an empty digest. Strings of special tokens in a text are plain text. Each row is a document of its
own, also where a doc_id is null or repeats; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import saved

#: Fixed value: the characters of Unicode's property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HIGH = re.compile("[^\0-\u024f]")
#: B's sign for a space.
LOW_LINE = "▁"
#: Characters of a word from which the tokenizers library encodes it: the other one's pattern fails on a million characters of white space.
STACK = 100_000
#: Words remembered before the memo starts anew, and the longest that is.
MEMO, LONGEST = 400_000, 48

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else those from 256 on in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class PairTable:
    """Numbers for all pairs of tokens that can end together, from their bytes; None for an id without bytes."""

    def __init__(self, a: list[bytes | None], b: list[bytes | None]):
        of_a, of_b = defaultdict(list), defaultdict(list)
        for ids, tokens in ((of_a, a), (of_b, b)):
            for k, t in enumerate(tokens):
                if t is not None:
                    ids[t].append(k)
        self.width = len(b)
        keys = [x * self.width + y for x, t in enumerate(a) if t is not None for k in range(len(t)) for y in of_b.get(t[k:], ())]
        keys += [x * self.width + y for y, t in enumerate(b) if t is not None for k in range(1, len(t)) for x in of_a.get(t[k:], ())]
        self.keys = np.sort(np.array(keys, np.int64))
        self.a, self.b = (v.astype(np.int32) for v in np.divmod(self.keys, self.width))

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a * self.width + b).astype("<i4")

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether each pair's count is the highest of its B id."""
        top = np.zeros(self.width, np.int64)
        np.maximum.at(top, self.b, counts)
        return counts == top[self.b]


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both lists hold, in order, and how many tokens of A and of B there are up to each."""
    at_a, at_b = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    both = sorted(at_a.keys() & at_b.keys())
    return both, [at_a[e] for e in both], [at_b[e] for e in both]


class Aligner:
    """Encodes texts by a byte-level tokenizer file (A) and a sentencepiece model (B), and aligns them.

    Where a text has only characters below U+0250, tiktoken encodes it for A, from the ranks in the same file (five times as
    fast; the two libraries agree on all of these characters). The tokenizers library encodes the others.
    """

    def __init__(self, tokenizer: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tok, self.sp = Tokenizer.from_file(tokenizer), SentencePieceProcessor(model_file=model)
        self.tok.encode_special_tokens = True
        read = json.loads(self.tok.to_str())
        pattern, ranks = read["pre_tokenizer"], read["model"]["vocab"]
        if not (pattern["type"] == "ByteLevel" and pattern["use_regex"] and not pattern["add_prefix_space"]):
            raise ValueError("the first tokenizer is not a byte-level one with its usual pattern")
        byte, special = byte_alphabet(), self.tok.get_added_tokens_decoder()
        a: list[bytes | None] = [None] * (max(self.tok.get_vocab().values()) + 1)
        for t, k in ranks.items():
            a[k] = None if k in special else bytes(byte[c] for c in t)
        pieces = [self.sp.id_to_piece(k) for k in range(self.sp.vocab_size())]
        plain = lambda k: not (self.sp.is_control(k) or self.sp.is_unknown(k))
        b = [(bytes([int(p[3:5], 16)]) if self.sp.is_byte(k) else p.replace(LOW_LINE, " ").encode()) if plain(k) else None for k, p in enumerate(pieces)]
        if b"" in a or b"" in b:
            raise ValueError("a token of no bytes")
        in_order = all(ranks["".join(m)] == 256 + k for k, m in enumerate(read["model"]["merges"]))
        self.fast = Encoding("a", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(a) if t is not None}, special_tokens={}) if in_order else None
        self.a_bytes, self.b_bytes, self.pairs = a, b, PairTable(a, b)
        self.a_size, self.b_size = (np.array([len(t or b"") for t in v]) for v in (a, b))
        self.a_text, self.b_text = [str(k) for k in range(len(a))], [str(k) for k in range(len(b))]
        self.prefix = self.sp.piece_to_id(LOW_LINE)
        inside = re.compile(f"[^{SPACE}](?=([{SPACE}]))")
        self.glue = frozenset(c for k, t in enumerate(b) if t is not None and not self.sp.is_byte(k) for c in inside.findall(t.decode()))
        self.memo: dict[str, tuple | None] = {}

    def entries(self, words: list[str]) -> list[tuple[str, bytes, int, int, int]] | None:
        """For each word (groups as text, pair numbers of the links, numbers of tokens of A and of B, number of groups).

        The words are encoded as one text, which has to start with white space. None if either's bytes are not the text's.
        """
        text = "".join(words)
        if self.fast and max(map(len, words)) < STACK and not HIGH.search(text):
            a = self.fast.encode_ordinary(text)
        else:
            a = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.sp.encode(text[1:] if text[0] == " " else text, num_threads=1)
        if text[0] != " ":  # the model has put a space before it
            if b[:1] != [self.prefix]:
                return None
            b = b[1:]
        raw = text.encode()
        try:
            if b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
                return None
        except TypeError:  # an id without bytes
            return None
        a_ids, b_ids = np.array(a), np.array(b)
        ends, p, q = common_ends(np.cumsum(self.a_size[a_ids]).tolist(), np.cumsum(self.b_size[b_ids]).tolist())
        links = self.pairs.numbers(a_ids[np.array(p) - 1], b_ids[np.array(q) - 1]).tobytes()
        ta, tb = [self.a_text[k] for k in a], [self.b_text[k] for k in b]
        p0, q0 = [0, *p], [0, *q]
        groups = [
            f"{ta[i]}|{tb[j]}" if m == i + 1 and n == j + 1 else f"{','.join(ta[i:m])}|{','.join(tb[j:n])}" for i, m, j, n in zip(p0, p, q0, q)
        ]
        cuts = [0, *(np.searchsorted(ends, np.cumsum([len(w.encode()) for w in words])) + 1).tolist()]
        return [(";".join(groups[g:h]), links[4 * g : 4 * h], p0[h] - p0[g], q0[h] - q0[g], h - g) for g, h in zip(cuts, cuts[1:])]

    def whole(self, text: str) -> tuple | None:
        """The entry of a text by itself."""
        found = self.entries([text])
        return found and found[0]

    def learn(self, new: list[str], size: int = 500) -> None:
        """Remembers the entry of each word. One of white space alone ends a text; beside another word its run would go on, so it is encoded by itself."""
        ends, new = [w for w in new if not w.strip(SPACE)], [w for w in new if w.strip(SPACE)]
        self.memo.update(zip(ends, map(self.whole, ends), strict=True))
        for at in range(0, len(new), size):
            part = new[at : at + size]
            self.memo.update(zip(part, self.entries(part) or map(self.whole, part), strict=True))

    def many(self, texts: list[str | None]) -> list[tuple | None]:
        """The entry of a space and each text; None for texts without tokens."""
        split = [[] if not t or not self.glue.isdisjoint(t) else WORD.findall(f" {t}") for t in texts]
        seen = set().union(*split)
        new = seen.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            # short words come again more often
            self.memo = {w: v for w, v in self.memo.items() if len(w) < 9}
            if len(self.memo) > MEMO // 2:
                self.memo = {}
            new = seen.difference(self.memo)
        # those of high characters together, for another library encodes these
        self.learn(sorted(new, key=str.isascii))
        out, get = [], self.memo.__getitem__
        for t, words in zip(texts, split, strict=True):
            found = list(map(get, words))
            if not t:
                out.append(None)
            elif not words or None in found:
                out.append(self.whole(f" {t}"))
            else:
                listed, links, a, b, g = zip(*found)
                out.append((";".join(listed), b"".join(links), sum(a), sum(b), sum(g)))
        for w in new:
            if len(w) > LONGEST:
                self.memo.pop(w, None)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer: str, model: str) -> Aligner:
    """One for each Python worker, kept between its tasks."""
    key = (tokenizer, model)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def alignments(docs: DataFrame, tokenizer: str, model: str, groups: bool = False, rows: int = 128) -> DataFrame:
    """For each row of (doc_id, text) the columns of ``SCHEMA``; with `groups`, the groups themselves as text too.

    links holds pair numbers as little-endian 32-bit integers: entries of ``Aligner.pairs``.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = aligner(tokenizer, model).many(batch.column("text").to_pylist())
        count = lambda k: pa.array([f[k] if f else 0 for f in found], pa.int64())
        out = {"doc_id": batch.column("doc_id"), "n_a": count(2), "n_b": count(3), "n_groups": count(4)}
        out["n_links"] = pa.array([len(f[1]) // 4 if f else 0 for f in found], pa.int64())
        out["groups_sha256"] = pa.array([hashlib.sha256(f[0].encode()).hexdigest() if f else "" for f in found], pa.string())
        out["links"] = pa.array([f[1] if f else b"" for f in found], pa.binary())
        return out | ({"groups": pa.array([f[0] if f else "" for f in found], pa.string())} if groups else {})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return T.per_batch(slim, run, SCHEMA + (", groups string" if groups else ""), rows)


def pair_counts(aligned: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """(pair, a_id, b_id, n): how many links of all documents hold each pair of ids, for pairs with some.

    A task adds up a vector over all pairs; there are at most four tasks a core, so what is shuffled does not grow with the
    table.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = aligner(tokenizer, model).pairs
        total = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, "<i4"), minlength=len(pairs)) if len(raw) > len(pairs) // 4 else 0
            small = b"".join(raw for raw in batch.column(0).to_pylist() if len(raw) <= len(pairs) // 4)
            total += np.bincount(np.frombuffer(small, "<i4"), minlength=len(pairs))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (hit.astype(np.int32), pairs.a[hit], pairs.b[hit], total[hit])], ["pair", "a_id", "b_id", "n"])

    tasks = 4 * aligned.sparkSession.sparkContext.defaultParallelism
    parts = aligned.select("links").coalesce(tasks).mapInArrow(add_up, "pair int, a_id int, b_id int, n long")
    return parts.groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """The rows of a saved ``alignments`` with n_best and count_sum in place of the links.

    The counts that all tasks look up are one number for each entry of the pair table, which the vocabularies bound.
    """
    spark, pairs = aligned.sparkSession, aligner(tokenizer, model).pairs
    table = pair_counts(aligned, tokenizer, model).select("pair", "n").toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((counts, pairs.best(counts)))
    names = [c for c in aligned.columns if c != "links"]

    def look_up(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, best = shared.value
        links = [np.frombuffer(raw, "<i4") for raw in batch.column("links").to_pylist()]
        found = {"n_best": [int(best[v].sum()) for v in links], "count_sum": [int(n[v].sum()) for v in links]}
        return {c: batch.column(c) for c in names} | {c: pa.array(v, pa.int64()) for c, v in found.items()}

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    return T.per_batch(aligned, look_up, ", ".join([*(f"{c} {kinds[c]}" for c in names), "n_best long, count_sum long"]))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = saved(alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"), *files), "alignments", compression="zstd")
    return scored(aligned, *files)
