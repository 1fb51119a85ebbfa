"""Repeated passages: factors against a plain greedy parse, and rows that repeat."""

import numpy as np

from skyloom.llm import substrings
from skyloom.llm import text as T

SF = "/root/testdata/sf0.001"


def naive_parse(rows, n=50):
    """(doc_id, start, length, ref_doc, ref_start) by a dictionary of the first places of all windows."""
    words = [(i, T.words((t or "").encode())) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - n + 1):
            place = first.setdefault(tuple(w[k : k + n]), (i, k))
            if place[0] == i:
                first[tuple(w[k : k + n])] = min(place, (i, k))
    out = set()
    for i, w in words:
        p = 0
        while p + n <= len(w):
            e, q = first[tuple(w[p : p + n])]
            m = 1
            while e < i and p + m + n <= len(w) and first[tuple(w[p + m : p + m + n])] == (e, q + m):
                m += 1
            if e < i:
                out.add((i, p, m + n - 1, e, q))
            p += m
    return out


def passages(seed, docs=60):
    rng = np.random.RandomState(seed)
    pool = [f"p{rng.randint(400)}" for _ in range(3000)]
    rows = []
    for i in range(docs):
        parts = [f"u{i}_{k}" for k in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(len(pool) - 230)
            parts += pool[a : a + rng.randint(45, 230)] + [f"v{i}_{k}" for k in range(rng.randint(0, 3))]
        rows.append((int(i), " ".join(parts)))
    return rows


def parse(df):
    return {tuple(r) for r in substrings.factors(df).drop("h").collect()}


def test_factors_are_those_of_a_greedy_parse(spark):
    rows = [*passages(11), (100, "a b " * 80), (101, "a b " * 90), (102, None), (103, " "), (104, "short")]
    want = naive_parse(rows)
    assert len(want) > 50 and parse(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_factors_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert parse(docs) == naive_parse([tuple(r) for r in docs.collect()])


def test_rows_of_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(70)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, f"x {a}"), (2, f"{b} {c}"), (3, f"{c} {a} y"), (None, f"{a} n")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS places", "2 AS row_h", "3 AS _of_id")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, f"{a} n"), (1, a), (1, a), (1, b), (2, "x"), (2, c), (3, "y")])
    assert set(got[0].asDict()) == {"doc_id", "text", "places", "row_h", "_of_id"} and {(r["places"], r.row_h, r._of_id) for r in got} == {(1, 2, 3)}
