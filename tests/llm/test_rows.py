"""Stages on rows that repeat a doc_id, on null ids and on columns named like inner ones; the robust estimates against NumPy."""

import re
from collections import Counter, defaultdict

import numpy as np

from skyloom.llm import jaccard, mixing, quality

SF = "/root/testdata/sf0.001"
W1, W2 = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
CLASH = "doc_id long, text string, lang string, source string, kept_id int, row_h int, gone_id int, nth int, mix_size int, _mix_id int, places int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, 5, 6, 7) for i, t, s in rows], CLASH)


def kept(df):
    rows = df.collect()
    assert df.columns == [c.split()[0] for c in CLASH.split(", ")] and all(tuple(r)[4:] == (1, 2, 3, 4, 5, 6, 7) for r in rows)
    return Counter((r.doc_id, r.text, r.source) for r in rows)


def test_one_of_each_group_keeps_each_document_once(spark):
    rows = [(1, W1, "s"), (1, W1, "s"), (5, W1, "s"), (5, W2, "s"), (6, f"{W2} end", None), (7, None, "s"), (7, None, "s"), (8, " ", "s"), (None, W1, "s"), (None, W1, "s")]
    got = kept(jaccard.one_of_each_group(clashing(spark, rows)))
    assert got == Counter({(1, W1, "s"): 1, (5, W2, "s"): 1, (7, None, "s"): 2, (8, " ", "s"): 1, (None, W1, "s"): 2})
    # a group whose smallest doc_id has two texts keeps one of them
    got = kept(jaccard.one_of_each_group(clashing(spark, [(1, W1, "s"), (1, f"{W1} end", "s"), (2, f"{W1} end", "s")])))
    assert sum(got.values()) == 1 and next(iter(got))[0] == 1


def test_groups_of_one_doc_id_with_two_texts(spark):
    rows = [(1, W1, "s"), (5, W1, "s"), (5, W2, "s"), (6, f"{W2} end", "s")]
    got = sorted(tuple(r) for r in jaccard.near_groups(clashing(spark, rows)).collect())
    assert got == [(1, 1, 1), (5, 1, 1), (5, 5, 1), (6, 5, 1)]


def test_rows_without_a_doc_id_have_links(spark):
    rows = [(1, W1, "s"), (None, W1, "s"), (None, f"{W1} end", "s"), (None, W2, "s"), (None, W2, "s"), (None, None, "s"), (3, "other words", "s")]
    got = Counter(tuple(r) for r in jaccard.near_groups(clashing(spark, rows)).collect())
    assert got == Counter({(1, 1, 2): 1, (None, 1, 2): 2, (None, None, 1): 2, (None, None, 0): 1, (3, 3, 0): 1})


def test_mix_emits_its_plan(spark):
    rows = [(1, W1, "a")] * 40 + [(1, W2, "a"), (2, W2, None), (None, W1, None), (None, None, "b"), (3, "", "b")]
    df = clashing(spark, rows)
    want = defaultdict(int)
    for r in mixing.mix_plan(df).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = defaultdict(int)
    for (i, _, s), n in kept(mixing.mixed_documents(df)).items():
        got[(i, s)] += n
    assert {k: v for k, v in want.items() if v} == got and 55 <= got[(1, "a")] <= 62


def test_good_documents_by_row(spark):
    good = [" ".join(f"word{(i * 7 + k) % 90}" for k in range(60)) for i in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(good)] + [(3, "x " * 50, "s"), (4, "short", "s"), (None, good[0], "s"), (9, good[9], "s")]
    got = kept(quality.good_documents(clashing(spark, rows)))
    assert got == Counter((i, t, s) for i, t, s in rows if t in good)


def plain_vector(text):
    """The six statistics of a text, and its number of words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, seen, pairs = len(w), Counter(w), list(zip(w, w[1:], strict=False))
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    same = sum(a == b for a, b in pairs)
    x = [np.log(sum(map(len, w)) / n), np.log((marks + 1) / (n + 1)), np.sqrt(same / n), np.log(len(seen)) / np.log(n), np.sqrt(1 - len(set(pairs)) / len(pairs)), np.log(max(seen.values()) / n)]
    return [n, *x]


def plain_quality(rows, share=0.75, prior=200.0, weight=40.0):
    """Distances of rows (doc_id, lang, source, n_words, x0...) by NumPy, groups and starts one after the other."""
    dims, half = quality.DIMS, quality.DIMS // 2
    chi = quality.chi2_quantile
    floor = 5e-4**2 * np.eye(dims)

    def at(v, p):
        return np.sort(v)[int(np.ceil(p * len(v))) - 1]

    def d2(x, mean, cov):
        return np.einsum("ki,ij,kj->k", x - mean, np.linalg.inv(cov), x - mean)

    def fit(x, scale):
        return x.mean(axis=0), scale * (x.T @ x / len(x) - np.outer(x.mean(axis=0), x.mean(axis=0))) + floor

    def estimate(x):
        m = np.array([at(x[:, i], 0.5) for i in range(dims)])
        d = np.sqrt(np.array([1.4826 * at(np.abs(x[:, i] - m[i]), 0.5) for i in range(dims)]) ** 2 + np.diag(floor))
        z = (x - m) / d
        t, norm = np.tanh(z), np.square(z).sum(axis=1)
        u = z[norm > 0] / np.sqrt(norm[norm > 0])[:, None]
        best = []
        for r in (np.eye(dims), t.T @ t / len(x) - np.outer(t.mean(axis=0), t.mean(axis=0)), u.T @ u / len(x)):
            r = r + 1e-6 * np.eye(dims)
            s = np.sqrt(np.diag(r))
            now, low = (m, r / np.outer(s, s) * np.outer(d, d)), np.inf
            while True:
                dist = d2(x, *now)
                new = fit(x[dist <= at(dist, share)], share / quality.chi2_cdf(chi(share, half), half + 1))
                det = np.linalg.slogdet(new[1])[1]
                if det >= low - 1e-6:
                    break
                now, low = new, det
            best.append((low, now))
        raw = min(best, key=lambda b: b[0])[1]
        inside = x[d2(x, *raw) <= chi(0.975, half)]
        return fit(inside, 0.975 / quality.chi2_cdf(chi(0.975, half), half + 1)) if len(inside) else raw

    x, out = np.array([r[4:] for r in rows]), {}
    size = np.array([r[3] for r in rows], float)[:, None]
    for lang in {r[1] for r in rows}:
        here = np.array([r[1] == lang for r in rows])
        of = np.unique(np.hstack([size, x])[here], axis=0)[:, 1:]
        median = np.array([at(of[:, i], 0.5) for i in range(dims)])
        x[here] = (size[here] * x[here] + weight * median) / (size[here] + weight)
    # groups as ordered pairs, so that one vector in two groups counts in both
    names = sorted({(str(r[1]), str(r[2])) for r in rows})
    numbered = np.hstack([np.array([names.index((str(r[1]), str(r[2]))) for r in rows])[:, None], x])
    once = lambda here: np.unique(numbered[here], axis=0)[:, 1:]
    whole = estimate(once(size[:, 0] > 0))
    for lang in {r[1] for r in rows}:
        in_lang = np.array([r[1] == lang for r in rows])
        draw = lambda own, up, n: tuple(n / (n + prior) * a + prior / (n + prior) * b for a, b in zip(own, up, strict=True))
        of_lang = draw(estimate(once(in_lang)), whole, len(once(in_lang)))
        for source in {r[2] for r in rows if r[1] == lang}:
            here = in_lang & np.array([r[2] == source for r in rows])
            mean, cov = draw(estimate(once(here)), of_lang, len(once(here)))
            cov = cov + whole[1] / 4 + np.diag([0, 0, 1, 0, 1, 0]) / (16 * weight)
            out |= dict(zip([r[0] for r, h in zip(rows, here, strict=True) if h], d2(x[here], mean, cov), strict=True))
    return out


def test_robust_estimates_are_those_of_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passed = quality.stats(docs).where("NOT base_failed").select("doc_id", "lang", "source")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_quality([(*r, *plain_vector(texts[r.doc_id])) for r in passed.collect()])
    got = {r.doc_id: (r.d2, r.kept) for r in quality.quality_verdicts(docs).where("NOT base_failed").collect()}
    cut = quality.chi2_quantile(1 - 1e-8, quality.DIMS // 2)
    assert got.keys() == want.keys() and sum(not k for _, k in got.values()) > 3
    assert max(abs(got[i][0] - want[i]) / (1 + want[i]) for i in got) <= 1e-6 and all(got[i][1] == (want[i] <= cut) for i in got)


def test_spread_of_a_language_decides(spark):
    """The same text is ordinary where word lengths differ from text to text, and an outlier where they hardly do."""
    rng, rows = np.random.RandomState(5), []

    share = 1 / np.arange(1, 301) / (1 / np.arange(1, 301)).sum()
    pools = {n: ["".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.randint(0, 26, n + k % 3 - 1)) for k in range(300)] for n in range(3, 10)}

    def text(length):
        return ", ".join(" ".join(pools[length][k] for k in rng.choice(300, rng.randint(3, 9), p=share)) for _ in range(rng.randint(10, 60)))

    for i in range(1500):
        rows.append((i, text(6), "narrow", "s"))
        if i < 300:
            rows.append((10_000 + i, text(3 + i % 7), "wide", "s"))
    odd = text(9)
    rows += [(9_000, odd, "narrow", "s"), (19_000, odd, "wide", "s")]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in got.where("NOT kept").collect()} == {9_000}


def test_labelled_documents_keep_to_their_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = Counter(tuple(r) for r in quality.quality_verdicts(docs).where("NOT base_failed").join(labels, "doc_id").select("quality", "kept").collect())
    assert got[1, False] <= 0.01 * got[1, True] and got[0, True] <= 0.01 * got[0, False]
