"""Quality rules: hard limits, then robust multivariate outliers per language and source.

Word and line statistics of each text are turned into a short vector. For every (language,
source) group, every language and the whole table, a minimum-covariance-determinant (MCD)
estimate of centre and scatter is found by concentration steps: keep the three quarters of the
rows that lie nearest, estimate again from them. A step is one grouped sum over the stored
vectors; ranks within a group come from counts in narrow bins of the distance, so that no group,
however large, is sorted or gathered in one task. A document is rejected if its Mahalanobis
distance from the estimate of its group lies beyond a far chi-square quantile. Groups too small
for an estimate use their language's, then the whole table's; if that is too small as well,
only the hard limits apply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_stored, stored
from .text_stats import text_stats

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Rows that a group needs for an estimate of its own.
MIN_GROUP = 100
KEPT_SHARE = 0.75
STEPS = 4
#: Far out: the sample scatter of a group of a few hundred rows is itself uncertain.
QUANTILE = 1 - 1e-9

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

# Vector: name, SQL of the statistics, least standard deviation. The floor keeps the scatter
# regular where nearly all texts agree, as in having no symbols at all.
VECTOR: tuple[tuple[str, str, float], ...] = (
    ("log_words", "ln(double(n_words))", 0.5),
    # Ten words of six letters are added, which steadies the mean of short texts.
    ("log_word_length", "ln((word_chars + 60) / (n_words + 10))", 0.03),
    ("symbols", "sqrt(n_symbols / word_chars)", 0.05),
    ("dup_lines", "sqrt(n_dup_lines / n_words)", 0.05),
    ("repeats", "sqrt(n_repeat_words / n_words)", 0.12),
)
NAMES = [name for name, _, _ in VECTOR]
P = len(VECTOR)
PAIRS = list(combinations_with_replacement(range(P), 2))


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function at (k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def with_stats(docs: DataFrame, into: str = "__stats") -> DataFrame:
    """``docs`` with a struct of statistics; all columns stay, whatever their names.

    It comes out of a generator, below which Spark pushes no filter on it; the texts would be
    measured twice, by twice as many Python workers.
    """

    @F.pandas_udf(STATS)
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [text_stats(t) for t in texts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")], dtype="int64")

    return docs.withColumn(into, F.explode(F.array(measure(F.col("text").cast("string")))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )


def group_keys() -> list[Column]:
    """A row's groups, narrow to wide; null values are groups of their own."""
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    return [
        F.concat(F.lit("3"), F.to_json(F.struct(lang.alias("l"), source.alias("s")))),
        F.concat(F.lit("2"), F.to_json(F.struct(lang.alias("l")))),
        F.lit("1"),
    ]


def _distance() -> Column:
    d = [F.col(n) - F.col(f"m_{n}") for n in NAMES]
    terms = [d[i] * d[j] * F.col(f"w{i}{j}") * (1 if i == j else 2) for i, j in PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


ESTIMATE = (
    "grp string, n long, " + ", ".join(f"m_{n} double" for n in NAMES) + ", "
    + ", ".join(f"w{i}{j} double" for i, j in PAIRS)
)


def _inverse(scatter: np.ndarray) -> list[float]:
    floors = np.array([f for _, _, f in VECTOR]) ** 2
    scatter = scatter + np.diag(np.maximum(0.0, floors - np.diag(scatter)))
    inverse = np.linalg.inv(scatter)
    return [float(inverse[i, j]) for i, j in PAIRS]


def _from_moments(moments: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse scatter of each group from its sums; a few numbers a group."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                scatter = np.empty((P, P))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = r[f"q{i}{j}"] / r["n"] - mean[i] * mean[j]
                rows.append((r["grp"], r["n"], *map(float, mean), *_inverse(scatter * factor)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    return moments.mapInPandas(solve, ESTIMATE)


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}{j}") for i, j in PAIRS],
    )


def _share_point(bins: DataFrame, by: list[str], share: float) -> DataFrame:
    """For each group the first bin at which at least ``share`` of its rows are reached.

    ``bins`` has a count for each group and bin; bins have a bounded range, so the window
    sees a bounded number of rows however large a group is.
    """
    w = Window.partitionBy(*by)
    reached = F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return (
        bins.withColumn("reached", reached).withColumn("all", F.sum("c").over(w))
        .where(F.col("reached") >= F.ceil(F.col("all") * share))
        .groupBy(*by).agg(F.min("bin").alias("bin"))
    )


def _start(cells: DataFrame) -> DataFrame:
    """First estimate: medians and median deviations of each coordinate, on a fine grid."""
    grid = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.round(F.col(n) / (f / 16)).cast("long").alias("bin"))
        for i, (n, _, f) in enumerate(VECTOR)
    ]))
    bins = (
        cells.select("grp", grid.alias("g")).select("grp", "g.*")
        .groupBy("grp", "i", "bin").agg(F.count(F.lit(1)).alias("c"))
    )
    medians = _share_point(bins, ["grp", "i"], 0.5).withColumnRenamed("bin", "mid")
    off = bins.join(medians, ["grp", "i"]).select(
        "grp", "i", F.abs(F.col("bin") - F.col("mid")).alias("bin"), "c"
    ).groupBy("grp", "i", "bin").agg(F.sum("c").alias("c"))
    spread = _share_point(off, ["grp", "i"], 0.5).withColumnRenamed("bin", "mad")
    n = bins.where("i = 0").groupBy("grp").agg(F.sum("c").alias("n"))
    wide = (
        medians.join(spread, ["grp", "i"]).groupBy("grp").agg(
            *[F.max(F.when(F.col("i") == i, F.col("mid") * (f / 16))).alias(f"m_{name}")
              for i, (name, _, f) in enumerate(VECTOR)],
            *[F.max(F.when(F.col("i") == i, F.col("mad") * (1.4826 * f / 16))).alias(f"d{i}")
              for i, (_, _, f) in enumerate(VECTOR)],
        ).join(n, "grp")
    )
    inverse = [
        (1 / F.pow(F.greatest(F.col(f"d{i}"), F.lit(VECTOR[i][2])), F.lit(2)) if i == j else F.lit(0.0))
        .alias(f"w{i}{j}") for i, j in PAIRS
    ]
    return wide.select("grp", "n", *[f"m_{x}" for x in NAMES], *inverse)


def estimate(stats: DataFrame) -> DataFrame:
    """MCD centre and inverse scatter of every group that has rows enough.

    ``stats`` has lang, source and the statistics of the rows that pass the hard limits.
    """
    vectors = stats.select(
        F.explode(F.array(*group_keys())).alias("grp"), *[F.expr(e).alias(n) for n, e, _ in VECTOR]
    )
    sizes = vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= MIN_GROUP)
    cells = stored(vectors.join(sizes.select("grp"), "grp", "left_semi"), "mcd-vectors")
    # Consistency of the scatter of the nearest share, for a normal centre.
    share_factor = KEPT_SHARE / chi2_cdf(chi2_quantile(KEPT_SHARE, P), P + 2)
    now = stored(_start(cells), "mcd-estimate")
    for step in range(STEPS + 1):
        near = cells.join(now.drop("n"), "grp").withColumn("d2", _distance())
        if step < STEPS:
            near = near.withColumn("bin", F.floor(F.log1p("d2") * 200))
            bins = near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
            cut = _share_point(bins, ["grp"], KEPT_SHARE).withColumnRenamed("bin", "cut")
            # With the cut beside the estimate, the vectors meet one small table again and
            # are summed where they lie.
            cut = stored(now.drop("n").join(cut, "grp"), "mcd-cut")
            near = cells.join(cut, "grp").withColumn("d2", _distance())
            near, factor = near.where(F.floor(F.log1p("d2") * 200) <= F.col("cut")), share_factor
        else:  # the usual reweighting: all rows that fit the estimate
            near, factor = near.where(F.col("d2") <= chi2_quantile(0.975, P)), 1.0
        before, now = now, stored(_from_moments(_moments(near), factor), "mcd-estimate")
        drop_stored(before)
    drop_stored(cells)
    return now


def judged(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` (lang, source, statistics) with base_failed, distance2 and kept."""
    names = ["__g3", "__g2", "__g1"]
    out = rows.withColumns(dict(zip(names, group_keys())))
    fits = []
    for name in names:
        fit = F.struct(*[c for c in estimates.columns if c not in ("grp", "n")])
        side = estimates.select(F.col("grp").alias(name), fit.alias(f"{name}_fit"))
        out = out.join(side, name, "left")
        fits.append(F.col(f"{name}_fit"))
    out = out.withColumn("__fit", F.coalesce(*fits))
    vector = {n: F.expr(e) for n, e, _ in VECTOR}
    d = [vector[n] - F.col(f"__fit.m_{n}") for n in NAMES]
    terms = [d[i] * d[j] * F.col(f"__fit.w{i}{j}") * (1 if i == j else 2) for i, j in PAIRS]
    far = F.when(~base_failed(), F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)))
    out = out.withColumn("base_failed", base_failed()).withColumn("distance2", far)
    limit = chi2_quantile(QUANTILE, P)
    return out.withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= limit)
    ).drop("__fit", *names, *[f"{n}_fit" for n in names])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: statistics, base_failed, distance2 and kept.

    Null and empty texts have no words and fail the hard limits; null languages and sources
    are groups of their own; repeated rows count and are judged alike; other columns are
    ignored; an empty table gives an empty result. distance2 is null where the hard limits
    fail or no group is large enough.
    """
    measured = with_stats(docs.select("doc_id", "text", "lang", "source"))
    rows = stored(measured.select("doc_id", "lang", "source", "__stats.*"), "quality-stats")
    fits = estimate(rows.where(~base_failed()))
    return judged(rows, fits).select(
        "doc_id", *[c.split()[0] for c in STATS.split(", ")], "base_failed", "kept", "distance2"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    The verdict depends on a row's text, language and source only, so rows are matched by
    nothing but their own values.
    """
    names = docs.columns
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("__doc"), "text", "lang", "source")
    measured = with_stats(held)
    rows = stored(measured.select("lang", "source", "__stats.*"), "quality-stats")
    fits = estimate(rows.where(~base_failed()))
    wide = measured.select("__doc", "lang", "source", "__stats.*")
    return judged(wide, fits).where("kept").select("__doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))
