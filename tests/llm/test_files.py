"""Packing against a scan of all bins, and files: dictionaries of few rows, tied ids, members that fail once."""

import io
from collections import Counter, defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from skyloom.llm import media, packing, storage, token_store, warc
from skyloom.llm import text as T

SF = "/root/testdata/sf0.001"


def scan_all_bins(pieces, capacity, per_source):
    """Bins of (length, source, cluster) taken in the order given, each put in the fullest one that it fits and does not conflict with."""
    bins, out = [], []
    for n, s, c in pieces:
        free = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and b[1][s] < per_source and (c is None or c not in b[2])]
        k = min(free)[1] if free else len(bins)
        if not free:
            bins.append([capacity, Counter(), set()])
        b = bins[k]
        out.append((k, capacity - b[0]))
        b[0] -= n
        b[1][s] += 1
        b[2].add(c)
    return out


def test_best_fit_is_a_scan_of_all_bins():
    rng = np.random.RandomState(4)
    for _ in range(30):
        capacity, per_source = 100, int(rng.randint(1, 3))
        pieces = sorted(((int(rng.randint(1, 100)), int(rng.randint(6)), int(rng.randint(12))) for _ in range(150)), reverse=True)
        pieces = [(n, s, None if c > 8 else c) for n, s, c in pieces]
        got = packing.best_fit([p[0] for p in pieces], [p[1] for p in pieces], [-1 if p[2] is None else p[2] for p in pieces], capacity, per_source)
        assert list(zip(*got, strict=True)) == scan_all_bins(pieces, capacity, per_source)


def test_packed_table_is_a_scan_of_all_bins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    texts = Counter(r.text for r in rows.values())
    pieces = []
    for i, r in rows.items():
        n = len(T.words((r.text or "").encode()))
        pieces += [(n % 512, i, n // 512)] if n % 512 else []
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    want = scan_all_bins([(n, rows[i].source, rows[i].text if texts[rows[i].text] > 1 else None) for n, i, _ in pieces], 512, 2)
    got = packing.packed_documents(docs, capacity=512, shard_rows=None).where("length BETWEEN 1 AND 511").collect()
    at = {(r.doc_id, r.piece): (r.bin, r.start) for r in got}
    assert [at[i, k] for _, i, k in pieces] == want


def test_few_rows_still_have_a_dictionary(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "the only text"), (1, "another text"), (2, "a third one"), (None, "no id")], "doc_id long, text string")
    stores = []
    for parts in (1, 3):
        folder = storage.shared_dir(spark)
        token_store.write_store(docs.repartition(parts), folder, public_tokenizers.path("word_bpe_49k.json"))
        assert len(spark.read.parquet(f"{folder}/dictionary").first().dictionary) > 0
        stores.append([(r.doc_id, bytes(r.raw)) for r in token_store.read_store(spark, folder).orderBy("shard", "block", "position").collect()])
    assert len(stores[0]) == 4 and stores[0] == stores[1] and stores[0][0][0] is None
    pages = spark.createDataFrame([(1, "u", "<p>x</p>" * 9000), (2, "u", "<p>y</p>")], "page_id long, url string, html string")
    assert len(warc.trained(pages, 16, 100, 1000)) > 100
    manifest = warc.write_archives(pages, storage.shared_dir(spark), sample_pages=16, sample_chars=100)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(manifest).collect()) == [(1, 72_000), (2, 8)]
    assert zstandard.ZstdCompressionDict(storage.trained_dictionary([b"one", b"two"], 100)).as_bytes() == b"onetwo"


def test_pages_that_repeat_an_id(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>y</p>"), (2, "u", "<p>y</p>"), (3, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (1, "u", "<p>x</p>")]
    found = warc.with_first(spark.createDataFrame(rows, "page_id long, url string, html string"), 0).collect()
    assert Counter((r.page_id, r.html[3], r["first"]) for r in found) == Counter([(1, "x", None)] * 2 + [(1, "y", None), (2, "y", 1), (3, "x", 1), (None, "x", 1)])


class FailsOnce:
    """A file system whose reads of each file fail, then succeed."""

    def __init__(self, system, failures):
        self.system, self.failures, self.opened = system, failures, 0

    def open_input_file(self, path):
        self.opened += 1
        if self.opened <= self.failures:
            raise OSError("lost")
        return self.system.open_input_file(path)


def test_a_member_that_comes_back(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(20)], "doc_id long, text string")
    media.write_media(docs.coalesce(1), f"file://{tmp_path}/m")
    reader = media.MemberReader({"path": f"file://{tmp_path}/m"})
    (part,) = reader.partitions()
    system, path = storage.filesystem(part.archive)
    member = reader.directory(system, path)[3]
    once = FailsOnce(system, 2)
    assert reader.alone(once, path, member)[:8] == media.PNG and once.opened == 3
    # the run of members is lost at its first reading: each is read by itself
    broken = FailsOnce(system, 0)
    monkeypatch.setattr(media, "filesystem", lambda uri: (broken, path))
    batches = reader.read(part)
    broken.opened, broken.failures = 0, 1
    reader.directory = lambda *_: media.MemberReader.directory(reader, system, path)
    assert sum(b.num_rows for b in batches) == 20 and broken.opened == 21


def test_ranges_grow_with_the_archives(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} " * 500) for k in range(40)], "doc_id long, text string")
    media.write_media(docs, f"file://{tmp_path}/m")
    few = {"path": f"file://{tmp_path}/m", "rangeBytes": "1", "mostRanges": "10"}
    assert 1 < len(media.MemberReader(few).partitions()) <= 10 + 40
    ids = defaultdict(int)
    for r in media.read_media(spark, f"file://{tmp_path}/m", rangeBytes="1", mostRanges="10").select("id").collect():
        ids[r.id] += 1
    assert ids == {k: 1 for k in range(40)}


def test_tables_on_the_way_are_deleted(spark):
    made = []

    def stage():
        inner = storage.saved(spark.range(5), "inner")
        made.append(inner.inputFiles()[0])
        return inner.where("id > 1")

    out = storage.settled(spark, stage, "outer")
    path = made[0].removeprefix("file://")
    try:
        io.open(path).close()
        gone = False
    except FileNotFoundError:
        gone = True
    assert gone and out.agg(F.sum("id")).first()[0] == 9


def test_packing_does_not_depend_on_partitions(spark):
    rows = [(k % 40, f"{'w ' * (k * 37 % 600)}{k % 90}", f"s{k % 3}" if k % 5 else None) for k in range(700)] + [(7, "same text", "s1")] * 30 + [(None, "no id " * 300, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [Counter(map(tuple, packing.packed_documents(docs.repartition(n), capacity=256, shard_rows=64).collect())) for n in (1, 4, 7)]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) > 900
    assert len({r[3] >> 32 for r in found[0] if r[3] is not None}) > 10
