"""Quality rules: robust multivariate outliers per language and source.

Plain rules come first: a text of under 20 words fails, and so does one with over
30 % of its words in repeated 8-word runs. Statistic vectors of the rest (log
word count, word length, shares of symbols, repeated lines and repeated words)
are judged by their Mahalanobis distance from the bulk of their own language and
source. The bulk's mean and covariance are minimum-covariance-determinant
estimates: concentration steps that keep the ``COVERAGE`` of rows nearest to the
last estimate, from three starts: all rows; medians with deviations from them; the
rows that are near the median in every statistic. After ``TRIAL_STEPS`` the start
with the smallest determinant of its rows' covariance goes on, until no group's
determinant gets smaller any more. A step is one aggregation of moments and one of a
distance histogram, so a language or source may hold any share of the rows.

Groups of fewer than ``LEAST_ROWS`` rows take the estimate of their language, or
of all rows. Every variance has a floor, since most texts have no symbols or
repeats at all and an estimate without spread would reject any that has.

Defined results: null text has no words and fails; null language or source are
groups of their own; repeated rows count as often as they stand there; an empty
table stays empty; extra columns are ignored or, in ``kept_documents``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .columns import documents, held, released
from .tokens import Words, covered, portions

MIN_WORDS = 20
RUN_WORDS = 8
MAX_REPEAT_PERCENT = 30
#: Share of a group's rows that the estimate rests on.
COVERAGE = 0.75
#: Steps of every start, steps of the best one at most, and a decrease of the determinant's logarithm that counts as none.
TRIAL_STEPS, MOST_STEPS, STILL = 2, 12, 1e-3
#: Rows of the third start: within so many deviations of the median, in every statistic.
INNER = 1.5
ACCURACY = 1000
LEAST_ROWS = 100
#: Squared distance of one in a million rows of a five-dimensional normal distribution.
CUTOFF = 36.0
#: Median of the squared distance in five dimensions.
MEDIAN_SQUARE = 4.351
#: Least standard deviations of the transformed statistics below.
FLOORS = (0.5, 0.35, 0.03, 0.15, 0.1)
N = len(FLOORS)
BINS_PER_OCTAVE = 32
BATCH_CHARS = 1 << 19

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[end] - sums[begin]


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def text_counts(texts: list[bytes]) -> pd.DataFrame:
    """The counts of ``COUNTS`` for each text."""
    tokens = Words(texts)
    first, runs = tokens.run_hashes(RUN_WORDS)
    order = np.lexsort((runs, tokens.doc[first])) if len(first) else first
    doc, run = tokens.doc[first][order], runs[order]
    same = (doc[1:] == doc[:-1]) & (run[1:] == run[:-1])
    repeated = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(first) else np.zeros(0, bool)
    in_repeat = covered(len(tokens.start), first[order][repeated], RUN_WORDS)
    continues = (tokens.buffer & 0xC0) == 0x80
    lines = [_duplicate_lines(text) for text in texts]
    return pd.DataFrame({
        "n_words": tokens.n_words,
        "word_chars": _per_text(tokens.inside & ~continues, tokens.text_start, tokens.text_end),
        "n_symbols": _per_text(_SYMBOL[tokens.buffer], tokens.text_start, tokens.text_end),
        "n_dup_lines": [a for a, _ in lines],
        "n_repeat_words": np.bincount(tokens.doc[in_repeat], minlength=len(texts)),
        "n_lines": [b for _, b in lines],
    }).astype("int64")


def _count_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [text if isinstance(text, str) else "" for text in batch]
        parts = [
            text_counts([text.encode("utf-8", "replace") for text in texts[a:b]])
            for a, b in portions([len(text) for text in texts], BATCH_CHARS)
        ]
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in COUNTS}, dtype="int64")


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``_counts``."""
    # Marked so that the optimizer neither copies it below a filter nor runs it twice.
    count = F.pandas_udf(_count_batches, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()
    return docs.withColumn("_counts", count(F.col("text")))


def base_failed(counts: str) -> Column:
    n, repeats = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (repeats * 100 > n * MAX_REPEAT_PERCENT)


def statistics(counts: str) -> Column:
    """The transformed statistic vector as an array."""
    c = {name: F.col(f"{counts}.{name}").cast("double") for name in COUNTS}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    return F.array(
        F.log(words), c["word_chars"] / words, F.sqrt(c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1.0))),
        c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
    )


def group_levels(lang: str = "lang", source: str = "source") -> Column:
    """The keys of a row's groups: language and source, language, all."""
    shown = [F.coalesce(F.concat(F.lit("v"), F.col(name)), F.lit("n")) for name in (lang, source)]
    return F.array(F.concat_ws("\x00", F.lit("3"), *shown), F.concat_ws("\x00", F.lit("2"), shown[0]), F.lit("1"))


def _covariance(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = moments[1 : N + 1] / moments[0]
    square = np.zeros((N, N))
    square[np.triu_indices(N)] = moments[N + 1 :] / moments[0]
    square = square + np.triu(square, 1).T
    return mean, square - np.outer(mean, mean)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Means, inverse covariances and the logarithm of the rows' determinant from one row of moments per group and start."""
    for pdf in batches:
        rows = []
        for moments, scale in zip(pdf.moments, pdf.scale):
            mean, cov = _covariance(np.asarray(moments, float))
            floor = np.diag(np.square(FLOORS))
            inverse = np.linalg.inv(cov * max(scale, 1.0) + floor)
            rows.append((np.round(mean, 9).tolist(), np.round(inverse, 9).ravel().tolist(), float(np.linalg.slogdet(cov + floor)[1])))
        yield pd.DataFrame({
            "grp": pdf.grp, "start": pdf.start, "mean": [r[0] for r in rows], "inverse": [r[1] for r in rows], "det": [r[2] for r in rows],
        })


def _moments(vector: str) -> Column:
    v = [F.col(vector)[i] for i in range(N)]
    products = [F.sum(v[i] * v[j]) for i in range(N) for j in range(i, N)]
    return F.array(F.count("*").cast("double"), *[F.sum(x) for x in v], *products)


def squared_distance(vector: str) -> Column:
    """From ``mean`` by ``inverse``."""
    d = [F.col(vector)[i] - F.col("mean")[i] for i in range(N)]
    total: Column = F.lit(0.0)
    for i in range(N):
        total = total + d[i] * sum((F.col("inverse")[i * N + j] * d[j] for j in range(1, N)), F.col("inverse")[i * N] * d[0])
    return F.greatest(total, F.lit(0.0))


def _solved(moments: DataFrame) -> DataFrame:
    return stage(moments.mapInPandas(_solve, "grp string, start int, mean array<double>, inverse array<double>, det double"), "mcd")


def _starts(rows: DataFrame) -> DataFrame:
    """The first estimates of every group."""

    def middles(of: list[Column], name: str) -> Column:
        return F.array(*[F.percentile_approx(x, 0.5, ACCURACY) for x in of]).alias(name)

    each = [F.col("v")[i] for i in range(N)]
    medians = stage(rows.groupBy("grp").agg(middles(each, "median")), "medians")
    apart = rows.join(medians, "grp")
    # 1.4826 median deviations are a standard deviation of a normal distribution.
    spread = [F.abs(F.col("v")[i] - F.col("median")[i]) * 1.4826 for i in range(N)]
    spreads = stage(apart.groupBy("grp").agg(F.first("median").alias("median"), middles(spread, "spread")), "spreads")
    near = rows.join(spreads, "grp")
    inner = F.lit(True)
    for i in range(N):
        inner = inner & (F.abs(F.col("v")[i] - F.col("median")[i]) <= INNER * F.greatest(F.col("spread")[i], F.lit(FLOORS[i])))
    every = rows.select("grp", "v", F.lit(0).alias("start")).unionByName(near.where(inner).select("grp", "v", F.lit(2).alias("start")))
    sums = every.groupBy("grp", "start").agg(_moments("v").alias("moments"))
    # Moments of a single row that stands for median and deviations.
    m, s = F.col("median"), F.col("spread")
    products = [m[i] * m[j] + (s[i] * s[i] if i == j else F.lit(0.0)) for i in range(N) for j in range(i, N)]
    marginal = spreads.select("grp", F.lit(1).alias("start"), F.array(F.lit(1.0), *[m[i] for i in range(N)], *products).alias("moments"))
    return _solved(sums.unionByName(marginal).withColumn("scale", F.lit(1.0)))


def _concentrated(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """The estimates from the ``COVERAGE`` of each group's rows that are nearest by ``fit``."""
    apart = rows.join(fit.drop("det"), "grp").withColumn("_d", squared_distance("v"))
    apart = apart.withColumn("_bin", F.floor(F.log2(F.col("_d") + 1e-6) * BINS_PER_OCTAVE).cast("int"))
    bins = apart.groupBy("grp", "start", "_bin").agg(F.count("*").alias("rows"))
    # A group has some hundreds of bins however many rows it has.
    counted = bins.groupBy("grp", "start").agg(F.sort_array(F.collect_list(F.struct("_bin", "rows"))).alias("bins"))

    def reached(share: float) -> Column:
        return F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("at")),
            lambda a, b: F.struct(
                (a.sum + b.rows).alias("sum"),
                F.coalesce(a["at"], F.when(a.sum + b.rows >= F.col("_n") * F.lit(share), b["_bin"])).alias("at"),
            ),
            lambda a: a["at"],
        )

    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b.rows)
    limits = counted.withColumn("_n", total).select(
        "grp", "start", reached(COVERAGE).alias("_last"),
        # Scaled so that the middle distance is that of a normal distribution.
        (F.pow(F.lit(2.0), reached(0.5) / BINS_PER_OCTAVE) / MEDIAN_SQUARE).alias("scale"),
    )
    # One row per group, staged so that its size is known: rows of a group stay where they are.
    near = apart.join(stage(limits.coalesce(1), "mcd-limits"), ["grp", "start"]).where(F.col("_bin") <= F.col("_last"))
    return _solved(near.groupBy("grp", "start").agg(_moments("v").alias("moments"), F.max("scale").alias("scale")))


def estimates(rows: DataFrame) -> DataFrame:
    """One row per group with ``mean`` and ``inverse``; ``rows``: ``grp`` and the vector ``v``."""
    fit = _starts(rows)
    for _ in range(TRIAL_STEPS):
        fit = _concentrated(rows, fit)
    best = F.min_by(F.struct(*fit.columns), F.struct("det", "start")).alias("best")
    fit = stage(fit.groupBy("grp").agg(best).select("best.*"), "mcd-best")
    for _ in range(MOST_STEPS):
        further = _concentrated(rows, fit)
        both = fit.select("grp", F.col("det").alias("_before")).join(further, "grp")
        fit = further
        if both.where(F.col("_before") - F.col("det") > STILL).isEmpty():
            break
    return fit.drop("det", "start")


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as the struct ``_doc``, with ``_counts``, ``_base_failed``, ``_distance`` and ``_kept``."""
    counted = with_counts(docs.select("lang", "source", "text"))
    vectors = stage(
        counted.select(group_levels().alias("levels"), statistics("_counts").alias("v"), base_failed("_counts").alias("out")),
        "quality",
    ).where("not out")
    rows = vectors.select(F.explode("levels").alias("grp"), "v")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    fits = estimates(rows).join(sizes, "grp").where((F.col("n") >= LEAST_ROWS) | (F.col("grp") == "1"))
    chosen = vectors.select("levels").distinct().withColumn("grp", F.explode("levels")).join(fits, "grp")
    best = chosen.groupBy(F.col("levels")[0].alias("_group")).agg(
        F.max_by(F.struct("mean", "inverse"), F.col("grp").substr(1, 1)).alias("fit")
    )
    best = stage(best.select("_group", "fit.mean", "fit.inverse").coalesce(1), "quality-fits")
    full = with_counts(docs.select(held(keep), "lang", "source", "text")).withColumns({"_group": group_levels()[0], "_v": statistics("_counts")})
    full = full.join(best, "_group", "left").withColumn("_base_failed", base_failed("_counts"))
    full = full.withColumn("_distance", squared_distance("_v"))
    return full.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_distance") <= CUTOFF, F.lit(False)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without those that a rule or the estimates reject."""
    return judged(docs, docs.columns).where("_kept").select(*released(docs.columns))


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = judged(documents(spark, sf_dir), ["doc_id"])
    counts = [F.col(f"_counts.{name}").alias(name) for name in COUNTS[:5]]
    return kept.select(
        "_doc.doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
        F.round("_distance", 6).alias("distance"),
    )
