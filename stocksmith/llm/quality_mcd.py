"""Quality rules by robust multivariate outliers (operator 1), in DataFrame operations only.

Each document gives counts (words, symbols, repeated lines and word windows) and
from them a vector of four transformed statistics.  Per language and source a
minimum-covariance-determinant estimate says where the bulk of the vectors
lies: from two starts (medians with median deviations; plain mean and
covariance), C-steps refit mean and covariance to the 75 % of rows that are
nearest until the determinant falls no more; the start that ends with the
smaller determinant stands, is reweighted once, and vectors at a large
Mahalanobis distance are rejected.

Vectors are kept as integers (1/1024), so that all sums are exact and no result
hangs on the order of rows.  A C-step sorts no rows: distances are counted in
buckets, with sums beside the counts, and the nearest buckets are taken until
they hold three quarters of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
DIMS = 4
SCALE = 1024
#: Buckets a unit of distance, and the distance from which the last one takes all.
BUCKETS, FAR = 64, 4096
#: Part of a group's rows that the estimate is fitted to.
CORE = 0.75
#: Groups with fewer rows are pooled by language, then all together; a last pool below it is judged by all rows.
MIN_ROWS = 50
#: Least spread of each statistic: log mean word length, log symbols, log repeated lines, log repeated words (per cent).
#: Each alone can reject: in a group where all others have none, over 52 % repeated lines do, and over 41 % repeated words; one line of two does not.
LEAST_SPREAD = (0.08, 0.5, 0.74, 0.7)
#: A clean vector is farther out with this probability.
TAIL = 1e-5
#: Up to this many groups the estimates are broadcast (about 200 bytes each); beyond it they are joined.
BROADCAST_GROUPS = 100_000


def chi2_cdf(x: float, dims: int) -> float:
    """Chi-square distribution function for an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi2_quantile(p: float, dims: int = DIMS) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


def consistency(p: float) -> float:
    """What the covariance of the nearest part ``p`` of normal rows must be multiplied with."""
    return p / chi2_cdf(chi2_quantile(p), DIMS + 2)


def with_counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts of each row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    a = docs.select(
        *keep,
        F.filter(F.split(text, BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("lines"),
        F.length(plain).cast("bigint").alias("word_chars"),
        (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    names = [k for k in a.columns if k not in ("words", "lines")]
    n = F.greatest(F.size("words") - 2, F.lit(0))
    triples = F.arrays_zip(*(F.slice("words", k, n).alias(f"w{k}") for k in (1, 2, 3)))
    # sorted by hash, words and place, equal windows are neighbours
    window = lambda t, i: F.struct(F.xxhash64(t.w1, t.w2, t.w3).alias("h"), t.w1, t.w2, t.w3, i.alias("at"))
    b = a.select(*names, F.size("words").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                 F.sort_array(F.transform(triples, window)).alias("s"))
    names = [k for k in b.columns if k != "s"]
    same = lambda x, y: (x.h == y.h) & (x.w1 == y.w1) & (x.w2 == y.w2) & (x.w3 == y.w3)
    rest = F.greatest(F.size("s") - 1, F.lit(0))
    c = b.select(*names, F.transform("s", lambda x: x.at).alias("at"), F.zip_with(F.slice("s", 1, rest), F.slice("s", 2, rest), same).alias("eq"))
    none = F.array(F.lit(False))
    hit = F.zip_with(F.concat(none, "eq"), F.concat("eq", none), lambda x, y: x | y)
    d = c.select(*names, F.sort_array(F.filter(F.zip_with("at", hit, lambda i, y: F.when(y, i)), lambda i: i.isNotNull())).alias("p"))
    rest = F.greatest(F.size("p") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("p", 1, rest), F.slice("p", 2, rest), lambda x, y: F.least(y - x, F.lit(3)))
    covered = F.when(F.size("p") == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))
    return d.select(*names, covered.cast("bigint").alias("n_repeat_words"))


def with_vectors(rows: DataFrame) -> DataFrame:
    """base_failed and the integer vector x0..x3 added to the counts."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    part = lambda a, b: F.log(1 + 100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)).cast("double") / F.greatest(F.col("n_words"), F.lit(1))),
         part("n_symbols", "n_words"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words")]
    return rows.select("*", failed.alias("base_failed"), *(F.floor(v * SCALE + 0.5).cast("bigint").alias(f"x{i}") for i, v in enumerate(x)))


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _factor(sums: DataFrame, keys: list[str], times: float) -> DataFrame:
    """Mean and lower Cholesky factor of the covariance (times a factor, plus the least spreads) from the sums."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n / SCALE for i in range(DIMS)]
    df = sums.select(*keys, *(m.alias(f"m{i}") for i, m in enumerate(mean)), *(
        (times * (F.col(f"s{i}{j}") / n / SCALE / SCALE - mean[i] * mean[j]) + (LEAST_SPREAD[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS))
    for i, j in PAIRS:  # row by row
        v = F.col(f"c{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    return df.select(*keys, *(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i, j in PAIRS))


def _distance(rows: DataFrame) -> DataFrame:
    """``d2``, the squared Mahalanobis distance, added to rows with x, m and l."""
    for i in range(DIMS):
        y = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = F.col("y0") * F.col("y0")
    for i in range(1, DIMS):
        d2 = d2 + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn("d2", d2)


_SUM_NAMES = ["n", *(f"s{i}" for i in range(DIMS)), *(f"s{i}{j}" for i, j in PAIRS)]


def _sums() -> list[Column]:
    """Rows, sums and sums of products of the vectors: whole numbers, the same in any order."""
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS)]


@dataclass
class Model:
    """``groups``: lang, source, grp; ``estimates``: grp, m, l of the reweighted estimates; ``steps``: C-steps taken."""

    groups: DataFrame
    estimates: DataFrame
    few: bool
    steps: int = 0

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df


def _named(value: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), value), F.lit("null"))


def _step(rows: DataFrame, model: Model, now: DataFrame) -> DataFrame:
    """One C-step from the estimates ``now``: those of the rows nearest to each, with ``det``."""
    keys = ["grp", "start"]
    by = Window.partitionBy(*keys).orderBy("bucket")
    near = _distance(rows.join(model.small(now), "grp")).withColumn("bucket", F.floor(F.least(F.sqrt("d2"), F.lit(float(FAR))) * BUCKETS))
    hist = near.groupBy(*keys, "bucket").agg(*_sums())
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    core = hist.withColumn("before", before).withColumn("total", total).where(F.col("before") < F.ceil(CORE * F.col("total"))).groupBy(*keys).agg(*(F.sum(k).alias(k) for k in _SUM_NAMES))
    return _factor(core, keys, consistency(CORE)).withColumn("det", F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33"))


def fit(rows: DataFrame) -> Model:
    """The estimates of all groups of ``rows`` (lang, source, base_failed, x0..x3; rows that failed take no part).

    Each C-step is one pass over the vectors and a written table of a row per
    group and start; a group whose determinant does not fall keeps what it had and
    takes no further part, so the steps end."""
    spark = rows.sparkSession
    rows = rows.where(~F.col("base_failed"))
    sizes = rows.groupBy(_named("lang").alias("lang_"), _named("source").alias("source_")).agg(F.count("*").alias("n"))
    few_rows = F.col("n") < MIN_ROWS
    pool = F.sum(F.when(few_rows, F.col("n"))).over(Window.partitionBy("lang_"))
    grp = F.when(~few_rows, F.concat_ws("\x01", "lang_", "source_")).when(pool >= MIN_ROWS, F.col("lang_")).otherwise(F.lit("*"))
    groups = checkpointed(spark, sizes.select("lang_", "source_", "n", grp.alias("grp")))
    model = Model(groups.select("lang_", "source_", "grp"), None, groups.count() <= BROADCAST_GROUPS)
    x = [f"x{i}" for i in range(DIMS)]
    rows = _with_group(rows.select("lang", "source", *x), model).select("grp", *x)
    if not groups.where(F.col("grp") == "*").agg(F.sum("n").alias("n")).where(F.col("n") < MIN_ROWS).isEmpty():
        rows = rows.where(F.col("grp") != "*").unionByName(rows.withColumn("grp", F.lit("*")))

    # first start: medians and median absolute deviations, no correlation; second: all rows
    median = rows.groupBy("grp").agg(*(F.percentile(v, 0.5).alias(f"m{i}") for i, v in enumerate(x)))
    off = rows.join(model.small(median), "grp").groupBy("grp").agg(*(F.percentile(F.abs(F.col(v) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, v in enumerate(x)))
    spread = lambda i: F.sqrt((1.4826 * F.col(f"d{i}") / SCALE) * (1.4826 * F.col(f"d{i}") / SCALE) + LEAST_SPREAD[i] ** 2)
    robust = median.join(off, "grp").select("grp", F.lit(0).alias("start"), *((F.col(f"m{i}") / SCALE).alias(f"m{i}") for i in range(DIMS)),
                                            *((spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS))
    plain = _factor(rows.groupBy("grp").agg(*_sums()).withColumn("start", F.lit(1)), ["grp", "start"], 1.0)
    every = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i, j in PAIRS]
    now = checkpointed(spark, robust.unionByName(plain).select("grp", "start", *every, F.lit(math.inf).alias("det"), F.lit(True).alias("falls")))
    while not now.where("falls").isEmpty():
        step = _step(rows, model, now.where("falls"))
        fell = F.coalesce(F.col("step.det") < F.col("now.det"), F.lit(False))
        now = checkpointed(spark, now.alias("now").join(model.small(step).alias("step"), ["grp", "start"], "left").select(
            "grp", "start", *(F.when(fell, F.col(f"step.{k}")).otherwise(F.col(f"now.{k}")).alias(k) for k in [*every, "det"]), fell.alias("falls")))
        model.steps += 1
    best = now.groupBy("grp").agg(F.min(F.struct("det", "start", *every)).alias("b")).select("grp", *(f"b.{k}" for k in every))
    near = _distance(rows.join(model.small(best), "grp")).where(F.col("d2") <= chi2_quantile(0.975))
    weighted = _factor(near.groupBy("grp").agg(*_sums()), ["grp"], consistency(0.975))
    model.estimates = checkpointed(spark, weighted)
    return model


def _with_group(rows: DataFrame, model: Model) -> DataFrame:
    rows = rows.withColumn("lang_", _named("lang")).withColumn("source_", _named("source"))
    return rows.join(model.small(model.groups), ["lang_", "source_"], "left").drop("lang_", "source_")


def judge(rows: DataFrame, model: Model) -> DataFrame:
    """``distance`` (null where all rows of the group failed) and ``kept`` added to rows with counts and vectors."""
    rows = _distance(_with_group(rows, model).join(model.small(model.estimates), "grp", "left"))
    # one comparison over both tables' columns: as a conjunction, a filter on it would be pushed
    # below the join and there repeat the counting of every word
    outlying = F.greatest(F.when(F.col("base_failed"), 1e300).otherwise(0.0), F.coalesce("d2", F.lit(0.0)))
    return rows.select("*", F.sqrt("d2").alias("distance"), (outlying <= chi2_quantile(1 - TAIL)).alias("kept"))


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, counts, base_failed, distance and kept of each row of ``docs``.

    base_failed: under 50 words, or more than half of the words lie in 3-word
    windows that occur twice or more.  kept: not base_failed, and the vector is
    not an outlier of its group.  Null or empty text: no words, so it fails.  Null
    languages and sources are groups of their own; groups of under 50 rows that
    did not fail are pooled, and a last pool of under 50 is held against the estimate
    of all rows.  Null ids and repeated rows pass through, one row
    out for each in; an empty table gives an empty result; further columns are
    ignored."""
    spark = docs.sparkSession
    keep = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")]
    rows = checkpointed(spark, with_vectors(with_counts(docs, F.col(text), keep)))
    return judge(rows, fit(rows)).select("doc_id", *RESULT, "distance", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns.

    Texts are neither shuffled nor counted twice: each row is written once beside its
    vector, the estimates are fitted from the vectors alone, and the rows are read again."""
    keep = [F.struct("*").alias("doc"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")]
    rows = with_vectors(with_counts(docs, F.col(text), keep))
    rows = written(docs.sparkSession, rows.select("doc", "lang", "source", "base_failed", *(f"x{i}" for i in range(DIMS))), "quality")
    return judge(rows, fit(rows.drop("doc"))).where("kept").select("doc.*")
