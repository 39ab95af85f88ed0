"""Quality rules and robust multivariate outliers: a minimum covariance determinant per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import small_batches, with_python, written
from quillon.llm.text_stats import text_stats

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

DIM = 4
#: Repeated words that one repetition makes: a three-word window, twice.
WORDS_A_REPEAT = 6
#: Spread of the dither of a log count of zero, as a share of its standard error. Most texts have no symbol and repeat
#: nothing; without dither the core of such a statistic has no spread, and one symbol is infinitely far.
DITHER = 0.4
#: Least standard deviation of any combination of statistics (logarithms: a tenth of a percent). It only stops division by zero.
FLOOR = 1e-3
#: Median of the chi-squared distribution with four degrees of freedom.
CHI2_MEDIAN = 3.3567
#: A document is rejected beyond the chi-squared quantile that a normal document exceeds once in a million.
TAIL = 1e-6
#: Rows below which a group takes the estimate of its language, a language that of the table, and a table has none.
MIN_ROWS = 40
#: Share of a group's rows in the subset whose covariance determinant is minimised: up to 40 percent may be outliers.
CORE = 0.6
MAX_STEPS = 10
STEPS_PER_OCTAVE = 16


def chi2_4_tail(x: float) -> float:
    """Share of a chi-squared variable with four degrees of freedom above ``x``."""
    return math.exp(-x / 2) * (1 + x / 2)


def chi2_4_quantile(tail: float) -> float:
    """The value above which the share ``tail`` of such a variable lies."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_4_tail(middle) > tail else (low, middle)
    return high


CUTOFF = chi2_4_quantile(TAIL)


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the counts of ``text`` (``COUNTS``, 0 for null); counts replace columns
    of their names."""
    return with_python(docs, ["text"], {c: ("long", pa.int64()) for c in COUNTS},
                       lambda texts: map(text_stats, texts), keep)


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``measure``, written: a text is counted once, in batches of bounded size."""
    with small_batches(docs.sparkSession):
        return written(measure(docs, keep), "text-counts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def dither(number: int) -> Column:
    """Nearly normal noise of variance 1 between -3.5 and 3.5, fixed by the counts of a row."""
    bits = F.xxhash64(*[F.col(c) for c in COUNTS], F.lit(number))
    four = [F.shiftrightunsigned(bits, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    return (sum(four[1:], four[0]) + 2) / 65536 * math.sqrt(3) - 2 * math.sqrt(3)


def vector() -> list[Column]:
    """The transformed statistics: logarithms of the word length and of the rates of symbols, repeated lines and
    repetitions. A count has one added, and dither in proportion to the standard error of its logarithm."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    out = [F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0)))]
    for i, (c, size) in enumerate((("n_symbols", 1), ("n_dup_lines", 1), ("n_repeat_words", WORDS_A_REPEAT))):
        events = F.col(c) / size + 1
        out.append(F.log(events / n) + DITHER * dither(i) / F.sqrt(events))
    return out


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance by ``centre`` and the lower triangle ``white`` of the whitening matrix."""
    rows, at = [], 0
    for i in range(DIM):
        parts = [F.col("white")[at + j] * (x[j] - F.col("centre")[j]) for j in range(i + 1)]
        rows.append(sum(parts[1:], parts[0]))
        at += i + 1
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def _moments(x: list[Column]) -> list[Column]:
    pairs = [x[i] * x[j] for i in range(DIM) for j in range(i + 1)]
    return [F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("sums"),
            F.array(*[F.sum(p) for p in pairs]).alias("squares")]


def _estimate(n: float, sums, squares) -> tuple[list[float], list[float], float]:
    """Centre, whitening triangle and log determinant of moments."""
    centre = np.asarray(sums, dtype=float) / n
    cov = np.zeros((DIM, DIM))
    cov[np.tril_indices(DIM)] = np.asarray(squares, dtype=float) / n
    cov = cov + np.tril(cov, -1).T - np.outer(centre, centre)
    values, vectors = np.linalg.eigh(cov)
    cov = (vectors * np.maximum(values, FLOOR ** 2)) @ vectors.T
    lower = np.linalg.cholesky(cov)
    white = np.linalg.inv(lower)
    return centre.tolist(), white[np.tril_indices(DIM)].tolist(), float(2 * np.log(np.diag(lower)).sum())


def _models(moments: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group: its estimate from ``n, sums, squares``. Rows are few numbers each; groups stay distributed."""
    schema = moments.select(*keys, F.col("n").alias("rows"), F.col("sums").alias("centre"),
                            F.col("sums").alias("white"), F.lit(0.0).alias("log_det")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_estimate(n, s, q) for n, s, q in zip(batch["n"], batch["sums"], batch["squares"])]
            out = batch[keys].copy()
            out["rows"] = batch["n"]
            for i, c in enumerate(("centre", "white", "log_det")):
                out[c] = [r[i] for r in rows]
            yield out

    return moments.select(*keys, "n", "sums", "squares").mapInPandas(run, schema)


def _with_model(rows: DataFrame, models: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null. A model is a few numbers per group: the optimizer broadcasts models while their
    measured size allows it and shuffles both sides, splitting hot groups, beyond."""
    left, right = rows.alias("l"), models.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same, how).select("l.*", *[f"r.{c}" for c in models.columns if c not in keys])


def fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rows, centre, white, log_det`` of the minimum covariance determinant of every group.

    ``points`` has ``keys`` and ``x0..x3``. Three deterministic starts per group (median and absolute deviations, the
    covariance of tanh scores, that of spatial signs) go through concentration steps until no determinant falls. A
    step takes the ``CORE`` share of rows with the smallest distances; the limit comes from a histogram of distances,
    so that a step is two aggregations that combine before the shuffle, and a hot group is never in one task. The
    subset can be larger than the share by the rows of the histogram's last bin. All rows count at each step.
    """
    x = [F.col(f"x{i}") for i in range(DIM)]
    middle = points.groupBy(*keys).agg(F.array(*[F.percentile_approx(c, 0.5, 1000) for c in x]).alias("mid"))
    off = _with_model(points, middle, keys).select(*keys, *x, "mid")
    spread = off.groupBy(*keys).agg(F.array(
        *[F.greatest(F.percentile_approx(F.abs(x[i] - F.col("mid")[i]), 0.5, 1000) * 1.4826, F.lit(FLOOR)) for i in range(DIM)]
    ).alias("dev"), F.first("mid").alias("mid"))
    z = [(x[i] - F.col("mid")[i]) / F.col("dev")[i] for i in range(DIM)]
    scored = _with_model(points, written(spread, "mcd-scale"), keys).select(
        *keys, "mid", "dev", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(DIM)]
    norm = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]) + 1e-12)
    starts = []
    for number, score in ((1, [F.tanh(c) for c in z]), (2, [c / norm for c in z])):
        starts.append(scored.groupBy(*keys, F.lit(number).alias("start")).agg(
            *_moments([s * F.col("dev")[i] + F.col("mid")[i] for i, s in enumerate(score)])))
    plain = scored.groupBy(*keys, F.lit(0).alias("start")).agg(
        F.count("*").alias("n"), F.array(*[F.first("mid")[i] * F.count("*") for i in range(DIM)]).alias("sums"),
        F.array(*[F.count("*") * (F.first("mid")[i] * F.first("mid")[j]
                                  + (F.pow(F.first("dev")[i], 2) if i == j else F.lit(0.0)))
                  for i in range(DIM) for j in range(i + 1)]).alias("squares"))
    state = written(_models(plain.unionByName(starts[0]).unionByName(starts[1]), [*keys, "start"]), "mcd-start")

    group = [*keys, "start"]
    bucket = F.floor(F.log2(distance(x) + 1e-6) * STEPS_PER_OCTAVE).cast("int")
    many = points.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    before = None
    for _ in range(MAX_STEPS):
        placed = _with_model(many, state.select(*group, "centre", "white"), group).withColumn("bucket", bucket)
        counts = placed.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
        # a distance has at most some thousand buckets, so a group's counts are few rows
        limit = counts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("bins")).select(
            *group, F.expr(f"""aggregate(bins, struct(0L as seen, cast(null as int) as edge), (s, b) -> struct(
                s.seen + b.n as seen,
                if(s.edge is null and s.seen + b.n >= {CORE} * aggregate(bins, 0L, (t, c) -> t + c.n), b.bucket, s.edge)
                as edge)).edge""").alias("edge"))
        core = _with_model(placed, limit, group).where("bucket <= edge")
        state = written(_models(core.groupBy(*group).agg(*_moments(x)), group), "mcd-step")
        after = state.agg(F.sum("log_det").alias("s"), F.count("*").alias("n")).first()
        if before is not None and (not after["n"] or before - after["s"] < 1e-4 * after["n"]):
            break
        before = after["s"] or 0.0
    best = state.groupBy(*keys).agg(F.min_by(F.struct("centre", "white", "log_det"), F.struct("log_det", "start"))
                                    .alias("m")).select(*keys, "m.*")
    # the core is tighter than the whole group: scale so that the median distance is that of a normal group
    half = _with_model(points, best, keys).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.percentile_approx(distance(x), 0.5, 1000).alias("half"))
    scaled = _with_model(best, half, keys).withColumn("by", F.sqrt(F.greatest(F.col("half"), F.lit(1e-6)) / CHI2_MEDIAN))
    return written(scaled.select(*keys, "rows", "centre", F.transform("white", lambda w: w / F.col("by")).alias("white"),
                                 "log_det"), "mcd")


def fit_all(measured: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Estimates by (lang, source), by lang and of the table, over the rows that pass the base rules. Rows of one group with equal
    counts, copies among them, are one point: a text with very many copies is no more normal than another."""
    passed = measured.where(~base_failed()).select("lang", "source", *COUNTS).distinct()
    points = written(passed.select("lang", "source", *[c.alias(f"x{i}") for i, c in enumerate(vector())]), "mcd-points")
    levels = points.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(3)]))) \
        .withColumns({"lang": F.when(F.col("level") < 2, F.col("lang")), "source": F.when(F.col("level") < 1, F.col("source"))})
    models = fit(levels, ["level", "lang", "source"])
    return tuple(models.where(F.col("level") == i).drop("level", *unused) for i, unused in enumerate(((), ("source",), ("lang", "source"))))


def judge(measured: DataFrame, models: tuple[DataFrame, DataFrame, DataFrame], cutoff: float = CUTOFF,
          min_rows: int = MIN_ROWS) -> DataFrame:
    """``measured`` with ``base_failed, distance, kept``.

    The estimate is that of the row's language and source, of its language where the pair has fewer than ``min_rows`` points
    (different counts that pass the base rules), or of the table where the language has fewer. A table with fewer has no
    estimate: its rows have no distance (null) and are kept. Null language and source are groups of their own. A row that
    fails the base rules has no distance and is not kept.
    """
    by_source, by_lang, whole = (m.where(F.col("rows") >= min_rows) for m in models)
    columns = [c for c in measured.columns if c not in ("base_failed", "distance", "kept")]
    rows = measured.select(*columns)
    fine = by_source.select("lang", "source", F.struct("centre", "white").alias("_fine"))
    rough = by_lang.select("lang", F.struct("centre", "white").alias("_rough"))
    both = _with_model(_with_model(rows, fine, ["lang", "source"], "left"), rough, ["lang"], "left")
    # one row at most, as a scalar subquery
    every = whole.select(F.struct("centre", "white").alias("_all")).scalar()
    model = F.coalesce("_fine", "_rough", every)
    scored = both.withColumns({"base_failed": base_failed(), "centre": model["centre"], "white": model["white"]})
    scored = scored.withColumn("distance", F.when(~F.col("base_failed"), distance(vector())))
    return scored.select(*columns, "base_failed", "distance",
                         (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept, distance`` of every row of ``docs``; a row per row, repeated ids too."""
    counts = counted(docs, ["doc_id", "lang", "source"])
    judged = judge(counts, fit_all(counts), cutoff)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", F.round("distance", 6).alias("distance"))


def filter_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are not shuffled: their rows are written with their counts."""
    if not {*docs.columns} <= {"doc_id", "text", "lang", "source", "n_chars"}:
        # further columns may have the names of ours and travel as one struct
        packed = docs.select("lang", "source", "text", F.struct(*docs.columns).alias("_row"))
        return _filtered(packed, ["lang", "source", "_row"], cutoff).select("_row.*")
    return _filtered(docs, docs.columns, cutoff)


def _filtered(docs: DataFrame, keep: list[str], cutoff: float) -> DataFrame:
    rows = counted(docs, keep)
    return judge(rows, fit_all(rows), cutoff).where("kept").select(*keep)
