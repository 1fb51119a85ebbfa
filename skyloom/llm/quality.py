"""Quality rules: base rules on words and repetition, then robust multivariate outliers.

Each document that passes the base rules becomes a vector of six transformed statistics, all of which vary among ordinary
texts: word length, marks for a word, words equal to the one before, distinct words, word pairs seen before, and the share
of the commonest word. A short text says less of itself, so its vector is drawn to the median of its language with the
weight of ``weight`` words. For each language and source,
for each language and for all documents a minimum-covariance-determinant estimate of centre and scatter is made. It has
three starts, all with the median as centre and median absolute deviations as scales: uncorrelated, with the correlation
of the hyperbolic tangents of the standardised statistics, and with that of their spatial signs. From each, concentration
steps take the three quarters of the rows nearest to the present estimate and estimate anew, which never raises the
determinant of the scatter; steps go on until no start gains by them. The start with the lowest determinant is kept and
reweighted once. Equal vectors of a group count once in all of this, so that copies do not narrow it.

The estimate of a language is then drawn to that of all documents, and that of a language and source to its language's,
with the weight of ``prior`` rows against its own: smoothly, and alike at every size. A quarter of the scatter of all
documents is added to it (``COMMON``), so that a group of near copies does not reject what is unlike them, and to the two
statistics that are roots of rates the variance that such a root has by chance: 1 / 4n in n words, and at most 1 / 16
``weight`` when it is drawn to a median, so one repeated pair rejects no text where most have none. A document is rejected where its squared Mahalanobis distance to the estimate of its language and source is above the cutoff. No
deviation is set by hand; ``FLOOR`` only keeps matrices from being singular.

Estimates use every document. Only one row for each group and start reaches Python; distances and moments are Spark
expressions. Tables of one row a group are written before they are joined. They are broadcast where there are at most
``few`` groups, by a count; else Spark joins them by its own choice and can split a hot group among tasks.

Defined cases: a null or empty text has no words and fails the base rules; a null language or source is a value of its
own; repeated rows each have a verdict, and rows of one doc_id are told apart by text, language and source; an empty
table gives an empty result; a statistic that varies in no document has the scatter ``FLOOR``, and a group of one row has
that row as its centre before it is drawn to its language; further columns are ignored by ``quality_verdicts`` and
kept, whatever they are called, by ``good_documents``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import saved, unused

STATS = "doc_id long, h long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_same_words long, n_distinct_words long, n_distinct_pairs long, n_commonest long"
SYMBOLS = b"#*$%&|<>"
#: Bytes of ASCII signs that are no letters, digits or white space.
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: A standard deviation that keeps matrices regular, under a tenth of that of any statistic among ordinary texts.
FLOOR = 5e-4
#: Share of the deviation of all documents that is added to that of each group.
COMMON = 0.5
DIMS = 6
#: The statistics that are square roots of rates.
ROOTS = (0, 0, 1, 0, 1, 0)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def repeated_words(tokens: list[bytes], n: int = 8) -> int:
    """Words inside runs of n words that occur twice or more in the text."""
    runs = T.rolling(T.word_hashes(tokens), n) if len(tokens) > n else np.empty(0, np.uint64)
    if not len(runs):
        return 0
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(runs, twice))
    edge = np.zeros(len(tokens) + 1, np.int64)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge) > 0).sum())


def variety(tokens: list[bytes]) -> tuple[int, int, int, int]:
    """Words equal to the one before, distinct words, distinct pairs of neighbours, and occurrences of the commonest word."""
    seen = Counter(tokens)
    return sum(map(eq, tokens, tokens[1:])), len(seen), len(set(zip(tokens, tokens[1:], strict=False))), max(seen.values(), default=0)


def base_stats(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    rows = []
    for t in T.texts(batch.column("text")):
        tokens = T.words(t)
        of = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        chars = len(t) - of[128:192].sum() - of[9:14].sum() - of[32]
        rows.append((len(tokens), chars, sum(of[s] for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(tokens), of[MARKS].sum(), *variety(tokens)))
    cols = zip(*rows, strict=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_same_words", "n_distinct_words", "n_distinct_pairs", "n_commonest")
    return {c: batch.column(c) for c in ("doc_id", "h", "lang", "source")} | {c: pa.array(map(int, v), pa.int64()) for c, v in zip(names, cols, strict=True)}


def row_hash() -> Column:
    """Tells rows of one doc_id apart by all that their verdict depends on."""
    return F.xxhash64(*[F.col(c).cast("string") for c in ("text", "lang", "source")], *[F.col(c).isNull() for c in ("lang", "source")])


def stats(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), row_hash().alias("h"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return T.per_batch(slim, base_stats, STATS).withColumn("base_failed", failed)


def vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(2))
    return [
        F.log(F.greatest("word_chars", F.lit(1)) / n),
        F.log((F.col("n_marks") + 1) / (n + 1)),
        F.sqrt(F.col("n_same_words") / n),
        # the share of distinct words falls with length, the ratio of the logarithms hardly does
        F.log(F.greatest("n_distinct_words", F.lit(1))) / F.log(n),
        F.sqrt(F.greatest(1 - F.col("n_distinct_pairs") / (n - 1), F.lit(0.0))),
        F.log(F.greatest("n_commonest", F.lit(1)) / n),
    ]


def chi2_cdf(x: float, half: int) -> float:
    """Of a chi-square variable with 2 * half degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(half):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - np.exp(-x / 2) * total


def chi2_quantile(p: float, half: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, half) < p else (lo, mid)
    return (lo + hi) / 2


def with_groups(rows: DataFrame) -> DataFrame:
    """Adds g0, g1 and g2, the numbers of the groups of all rows, of a language, and of a language and source."""
    named = lambda level, *c: F.xxhash64(F.lit(level), *[F.coalesce(x, F.lit("")) for x in c], *[F.col(x).isNull() for x in c])
    return rows.withColumns({"g0": named(0), "g1": named(1, "lang"), "g2": named(2, "lang", "source")})


#: Marks a table of one row a group for broadcast where there are few groups.
Side = Callable[[DataFrame], DataFrame]
XS = [f"x{i}" for i in range(DIMS)]
MS = [f"m{i}" for i in range(DIMS)]
LEVELS, STARTS = ("g0", "g1", "g2"), (0, 1, 2)
#: Centre, scatter, inverse scatter and the logarithm of its determinant.
PARAMS = ", ".join(f"{c} double" for c in [*MS, *[f"c{i}{j}" for i, j in PAIRS], *[f"p{i}{j}" for i, j in PAIRS], "logdet"])


def square(f: pd.DataFrame, name: str) -> np.ndarray:
    """A symmetric matrix for each row from the columns name + ij."""
    out = np.empty((len(f), DIMS, DIMS))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = f[f"{name}{i}{j}"].to_numpy(float)
    return out


def params_of(keys: dict, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    inv = np.linalg.inv(cov)
    out = keys | {m: mean[:, i] for i, m in enumerate(MS)}
    for name, v in (("c", cov), ("p", inv)):
        out |= {f"{name}{i}{j}": v[:, i, j] for i, j in PAIRS}
    return pd.DataFrame(out | {"logdet": np.linalg.slogdet(cov)[1]})


def estimates(moments: DataFrame, scale: float) -> DataFrame:
    """PARAMS for each group and start from its count, sums and sums of products; a Pandas step on one row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["n"].to_numpy(float)[:, None]
            mean = f[XS].to_numpy(float) / n
            cov = scale * (square(f, "s") / n[:, :, None] - mean[:, :, None] * mean[:, None, :]) + FLOOR**2 * np.eye(DIMS)
            yield params_of({"g": f["g"], "s": f["s"]}, mean, cov)

    return moments.mapInPandas(run, f"g long, s int, {PARAMS}")


def moments(rows: DataFrame) -> DataFrame:
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    return rows.groupBy("g", "s").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in XS], *products)


def in_groups(rows: DataFrame, starts: tuple[int, ...] = (0,)) -> DataFrame:
    """(g, s, x0...): each row once for each of its groups and each start."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(g).alias("g"), F.lit(s).alias("s")) for g in LEVELS for s in starts])).alias("of"), *XS).select("of.g", "of.s", *XS)


def distance() -> Column:
    diff = [F.col(x) - F.col(m) for x, m in zip(XS, MS, strict=True)]
    return sum((1 if i == j else 2) * F.col(f"p{i}{j}") * diff[i] * diff[j] for i, j in PAIRS)


def starts(rows: DataFrame, side: Side) -> DataFrame:
    """PARAMS for each group and start."""
    rows = in_groups(rows)
    centre = saved(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(m) for x, m in zip(XS, MS, strict=True)]), "centre")
    spread = [F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 10_000).alias(f"d{i}") for i, (x, m) in enumerate(zip(XS, MS, strict=True))]
    spread = saved(rows.join(side(centre), "g").groupBy("g", *MS).agg(*spread), "spread")
    scale = [F.sqrt(F.pow(F.lit(1.4826) * F.col(f"d{i}"), 2) + F.lit(FLOOR**2)) for i in range(DIMS)]
    z = rows.join(side(spread), "g").select("g", *[((F.col(x) - F.col(m)) / d).alias(f"z{i}") for i, (x, m, d) in enumerate(zip(XS, MS, scale, strict=True))])
    z = z.withColumns({f"t{i}": F.tanh(f"z{i}") for i in range(DIMS)}).withColumn("norm", sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)))
    tanh = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"t{i}{j}") for i, j in PAIRS] + [F.sum(f"t{i}").alias(f"t{i}") for i in range(DIMS)]
    sign = [F.sum(F.when(F.col("norm") > 0, F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).otherwise(0.0)).alias(f"u{i}{j}") for i, j in PAIRS]
    sums = z.groupBy("g").agg(F.count("*").alias("n"), *tanh, *sign)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, eye = f["n"].to_numpy(float)[:, None], np.eye(DIMS)
            mean = f[[f"t{i}" for i in range(DIMS)]].to_numpy(float) / n
            like = [np.broadcast_to(eye, (len(f), DIMS, DIMS)), square(f, "t") / n[:, :, None] - mean[:, :, None] * mean[:, None, :], square(f, "u") / n[:, :, None]]
            wide = np.sqrt(np.square(1.4826 * f[[f"d{i}" for i in range(DIMS)]].to_numpy(float)) + FLOOR**2)
            for s in STARTS:
                # a little of the unit matrix keeps what does not vary from being singular
                r = like[s] + 1e-6 * eye
                d = np.sqrt(np.einsum("kii->ki", r))
                r = r / d[:, :, None] / d[:, None, :]
                cov = r * wide[:, :, None] * wide[:, None, :]
                yield params_of({"g": f["g"], "s": np.full(len(f), s, np.int32)}, f[MS].to_numpy(float), cov).assign(logdet=np.inf)

    return saved(sums.join(spread, "g").mapInPandas(run, f"g long, s int, {PARAMS}"), "starts")


def mcd(rows: DataFrame, share: float, side: Side) -> DataFrame:
    """PARAMS for each group of rows (g0, g1, g2, x0...), before reweighting."""
    every, scale = in_groups(rows, STARTS), share / chi2_cdf(chi2_quantile(share, DIMS // 2), DIMS // 2 + 1)
    names = [f.split()[0] for f in PARAMS.split(", ")]
    now = starts(rows, side).withColumn("moves", F.lit(True))
    k, moving = 0, True
    while moving:
        at = every.join(side(now.where("moves")), ["g", "s"]).select("g", "s", *XS, distance().alias("d2"))
        nearest = saved(at.groupBy("g", "s").agg(F.percentile_approx("d2", share, 10_000).alias("most")), f"nearest{k}")
        new = saved(estimates(moments(at.join(side(nearest), ["g", "s"]).where("d2 <= most")), scale), f"step{k}")
        new = new.select(F.col("g").alias("n_g"), F.col("s").alias("n_s"), *[F.col(c).alias(f"n_{c}") for c in names])
        both = now.join(new, (F.col("g") == F.col("n_g")) & (F.col("s") == F.col("n_s")), "left")
        better = F.coalesce(F.col("n_logdet") < F.col("logdet") - 1e-6, F.lit(False))
        now = saved(both.select("g", "s", *[F.when(better, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in names], better.alias("moves")), f"best{k}")
        moving, k = bool(now.where("moves").limit(1).count()), k + 1
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "s", *names[:-1])).alias("b"))
    return saved(best.select("g", F.lit(0).alias("s"), *[F.col(f"b.{c}").alias(c) for c in names]), "mcd")


def drawn(rows: DataFrame, raw: DataFrame, prior: float, weight: float, side: Side) -> DataFrame:
    """PARAMS and g for each group g2, reweighted, drawn to those of its language and of all rows, and widened by the latter."""
    edge = 0.975
    inside = in_groups(rows).join(side(raw), ["g", "s"]).where(distance() <= chi2_quantile(edge, DIMS // 2)).select("g", "s", *XS)
    better = estimates(moments(inside), edge / chi2_cdf(chi2_quantile(edge, DIMS // 2), DIMS // 2 + 1))
    better = saved(better, "reweighted")
    every = better.unionByName(raw.join(better.select("g"), "g", "left_anti"))
    columns = [*MS, *[f"c{i}{j}" for i, j in PAIRS]]
    cells = rows.groupBy(*LEVELS).agg(F.count("*").alias("n2"))
    langs = cells.groupBy(F.col("g1").alias("l_g1")).agg(F.sum("n2").alias("n1"))
    cells = cells.join(langs, F.col("g1") == F.col("l_g1")).drop("l_g1")
    for k, g in enumerate(LEVELS):
        of = every.select(F.col("g").alias(f"of{k}"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
        cells = cells.join(of, F.col(g) == F.col(f"of{k}")).drop(f"of{k}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            of = [f[[f"{c}_{k}" for c in columns]].set_axis(columns, axis=1) for k in range(3)]
            mean, cov = of[0][MS].to_numpy(float), square(of[0], "c")
            for k in (1, 2):
                n = f[f"n{k}"].to_numpy(float)
                w = (n / (n + prior))[:, None]
                mean = w * of[k][MS].to_numpy(float) + (1 - w) * mean
                cov = w[:, :, None] * square(of[k], "c") + (1 - w)[:, :, None] * cov
            yield params_of({"g": f["g2"]}, mean, cov + COMMON**2 * square(of[0], "c") + np.diag(ROOTS) / (16 * weight))

    return saved(cells.mapInPandas(run, f"g long, {PARAMS}"), "drawn")


def drawn_by_length(rows: DataFrame, weight: float, side: Side) -> DataFrame:
    """rows with x0... drawn to the medians of their language, as much as `weight` words count against their own."""
    once = rows.select("g1", "n_words", *XS).distinct()
    median = saved(once.groupBy(F.col("g1").alias("m_g")).agg(*[F.percentile_approx(x, 0.5, 10_000).alias(m) for x, m in zip(XS, MS, strict=True)]), "medians")
    n = F.col("n_words")
    near = {x: (n * F.col(x) + weight * F.col(m)) / (n + weight) for x, m in zip(XS, MS, strict=True)}
    return rows.join(side(median), F.col("g1") == F.col("m_g")).withColumns(near).select(*rows.columns)


def quality_verdicts(
    docs: DataFrame, share: float = 0.75, prior: float = 200.0, weight: float = 40.0, level: float = 1 - 1e-8, few: int = 10_000
) -> DataFrame:
    """(doc_id, h, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept) for every document."""
    found = saved(stats(docs), "stats")
    columns = ["doc_id", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = with_groups(found.where(~F.col("base_failed"))).select(*columns, *LEVELS, *[x.alias(n) for n, x in zip(XS, vector(), strict=True)])
    passed = saved(passed, "raw")
    side: Side = F.broadcast if passed.select("g2").distinct().count() <= few else lambda df: df
    passed = saved(drawn_by_length(passed, weight, side), "vectors")
    once = saved(passed.select(*LEVELS, *XS).distinct(), "once")
    judged = passed.join(side(drawn(once, mcd(once, share, side), prior, weight, side)), F.col("g2") == F.col("g")).select(*columns, distance().alias("d2"))
    judged = judged.withColumn("kept", F.col("d2") <= chi2_quantile(level, DIMS // 2))
    failed = found.where("base_failed").select(*columns, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with the same columns."""
    kept_id, kept_h, row = unused(docs, "kept_id", "kept_h", "row_h")
    kept = quality_verdicts(docs, **options).where("kept").select(F.col("doc_id").alias(kept_id), F.col("h").alias(kept_h))
    # The list grows with the corpus: a plan that broadcasts it while it is short would not last.
    kept = saved(kept, "kept").hint("shuffle_hash")
    docs = docs.withColumn(row, row_hash())
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(row) == F.col(kept_h)), "left_semi").drop(row)


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h", "d2")
