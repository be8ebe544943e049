"""Quality rules with robust multivariate outliers, by DataFrame functions only.

Each text gives counts; base rules fail on few words or much repetition. Of what passes, each language and source has
its own minimum-covariance-determinant estimate of the transformed counts. There are two starts, the classical mean and
covariance, and the medians with scales from the quartiles; from each, every C-step keeps the share `KEEP` of the rows with
the smallest Mahalanobis distances and estimates again, and of the two ends the one with the smaller determinant is taken.
The share is cut on a fixed grid of distances (`GRID` steps a natural log), whose moments are summed per cell, so a step
is one aggregation and no group is sorted. Rows beyond `CUT` under the last, consistency-scaled estimate are rejected.
A fixed ridge per statistic keeps constant statistics from being rejected for tiny deviations.

Five by five moments need rows: a language and source of fewer than `LEAST` rows is judged by the estimate of its whole
language, a language of fewer by that of all rows, which is made of what there is. So every row that passes the base rules
has a distance.

Defined cases: a null or empty text has zero counts and fails the base; null language and null source are groups of
their own; repeated rows count as often as they occur; an empty table gives no rows; other columns play no part. Windows
of words are compared by their 64-bit hashes, within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.llm.common import SPACE_CHARS, SPACES, cut, read, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
KEEP, GRID, STEPS, LEAST, SALT = 0.75, 64, 3, 60, 16
#: KEEP over the chance that chi-squared with 7 degrees is below its 5-degree quantile at KEEP.
CONSISTENCY = 1.41
#: The 0.999 quantile of chi-squared with 5 degrees.
CUT = 20.515
STATS = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeat")
#: x_lines ends at 1 and x_repeat, after the base rules, at sqrt(0.3): their ridges are under these over sqrt(CUT), so that each can pass CUT by itself.
RIDGE = (0.3, 0.06, 0.25, 0.15, 0.1)


def let(value: Column, body) -> Column:
    """body(value), the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def covered(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows whose hash occurs again in the array."""

    def count(s: Column) -> Column:
        again = F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1).h == x.h)) | (F.get(s, k + 1).h == x.h), x.i))
        return let(F.sort_array(F.filter(again, lambda i: i.isNotNull())), lambda p: F.aggregate(F.transform(p, lambda i, k: F.coalesce(F.least(F.get(p, k + 1) - i, F.lit(window)), F.lit(window))), F.lit(0), lambda a, n: a + n))

    sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(sorted_, count))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words in windows of `window` words that occur twice or more, from the array of words."""
    starts = lambda h: F.when(F.size(h) >= window, F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(starts(h), lambda s: covered(s, window)))


def _without(text: str, chars: str) -> Column:
    """How many code points a text has besides those."""
    out = F.col(text)
    for c in chars:
        out = F.replace(out, F.lit(c), F.lit(""))
    return F.length(out)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, grp (language and source), lang_grp (language) and the counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))).alias("grp"), F.to_json(F.struct(F.col(lang_col).alias("l"))).alias("lang_grp"), text.alias("t"))
    both = let(words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    d = d.select(
        "doc_id",
        "grp",
        "lang_grp",
        both.alias("w"),
        _without("t", SPACE_CHARS).cast("long").alias("word_chars"),
        (F.length("t") - _without("t", SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("n"))).alias("lines"),
    )
    n, r = F.col("w.n"), F.col("w.r")
    return d.select("doc_id", "grp", "lang_grp", n.alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("lines.n").cast("long").alias("n_lines"), r.alias("n_repeat_words"), ((n < 20) | (100 * r > 30 * n)).alias("base_failed"))


def transformed(d: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return d.withColumns({"x_words": F.log1p("n_words"), "x_length": F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.5))), "x_symbols": F.log1p(100 * share("n_symbols", "word_chars")), "x_lines": F.sqrt(share("n_dup_lines", "n_lines")), "x_repeat": F.sqrt(share("n_repeat_words", "n_words"))})


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _moments(prefix: bool) -> list[Column]:
    if prefix:
        return [F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(STATS))), *(F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in _PAIRS)]
    x = [F.col(s) for s in STATS]
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(len(x))), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _PAIRS)]


def _factor(m: DataFrame, scale: float = 1.0) -> DataFrame:
    """grp, size, means m0.. and the Cholesky factor l0_0.. of the covariance, from summed moments. size is kept if there."""
    m = m.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(STATS))})
    m = m.withColumns({f"c{i}_{j}": F.lit(scale) * (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (F.lit(RIDGE[i] ** 2) if i == j else F.lit(0.0)) for i, j in _PAIRS})
    for i, j in _PAIRS:
        rest = F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        m = m.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    return m.select("grp", "size", *(f"m{i}" for i in range(len(STATS))), *(f"l{i}_{j}" for i, j in _PAIRS))


def _looked_up(rows: DataFrame, table: DataFrame, key: str = "grp") -> DataFrame:
    """rows with the columns of table, which has one row a key; a hot key is dealt over SALT parts."""
    spread = table.withColumnRenamed(key, "at_key").withColumn("at_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.join(spread, (F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALT)) == F.col("at_salt")) & (F.col(key) == F.col("at_key")), "left").drop("at_key", "at_salt")


def _distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """rows with size and d2, the squared distance under their group's estimate."""
    out = _looked_up(rows, fit)
    for i, s in enumerate(STATS):
        out = out.withColumn(f"y{i}", (F.col(s) - F.col(f"m{i}") - sum((F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}_{i}"))
    return out.select(*rows.columns, "size", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(STATS))), F.lit(0.0)).alias("d2"))


def _quartile_start(rows: DataFrame) -> DataFrame:
    """Medians as means, and scales from the quartiles without covariances."""
    q = rows.groupBy("grp").agg(F.count("*").alias("size"), *(F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, s in enumerate(STATS)))
    scale = lambda i: F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + RIDGE[i] ** 2)
    return q.select("grp", "size", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(STATS))), *((scale(i) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in _PAIRS))


def estimate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group, the better of two starts."""
    named = lambda df, start: df.withColumn("grp", F.concat(F.lit(start), "grp"))
    fit = cut(named(_factor(rows.groupBy("grp").agg(*_moments(False)).withColumn("size", F.col("n"))), "m").unionByName(named(_quartile_start(rows), "q")))
    both = rows.withColumn("grp", F.explode(F.array(F.concat(F.lit("m"), "grp"), F.concat(F.lit("q"), "grp"))))
    for _ in range(steps):
        cells = _distance(both, fit).withColumn("cell", F.floor(F.log1p("d2") * GRID)).groupBy("grp", "cell").agg(F.first("size").alias("size"), *_moments(False))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = cells.withColumn("before", before).where(F.col("before") < KEEP * F.col("size"))
        fit = cut(_factor(inner.groupBy("grp").agg(F.first("size").alias("size"), *_moments(True)), CONSISTENCY))
    volume = sum((F.log(f"l{i}_{i}") for i in range(len(STATS))), F.lit(0.0))
    rest = [c for c in fit.columns if c != "grp"]
    return fit.groupBy(F.substring("grp", 2, 1 << 30).alias("grp")).agg(F.min(F.struct(volume.alias("v"), *rest)).alias("x")).select("grp", *(f"x.{c}" for c in rest))


def pools(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """grp, used (the group whose estimate judges it: itself, its language or all, named "") and members (the groups whose estimates its rows are part of)."""
    per = rows.groupBy("grp", "lang_grp").agg(F.count("*").alias("n"))
    lang = per.groupBy("lang_grp").agg(F.sum("n").alias("in_lang"), F.min("n").alias("least_n")).withColumnRenamed("lang_grp", "lg")
    known = cut(per.join(lang, F.col("lang_grp") == F.col("lg")))
    wide = known.where(F.col("in_lang") < least).limit(1).count() > 0
    own = F.col("n") >= least
    return known.select(
        "grp",
        F.when(own, F.col("grp")).when(F.col("in_lang") >= least, F.col("lang_grp")).otherwise("").alias("used"),
        F.array_compact(F.array(F.when(own, F.col("grp")), F.when((F.col("least_n") < least) & (F.col("in_lang") >= least), F.col("lang_grp")), F.lit("" if wide else None))).alias("members"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = CUT, least: int = LEAST) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null where the base rules failed) and kept."""
    rows = cut(transformed(counts(docs, id_col, text_col, lang_col, source_col)))
    passed = rows.where(~F.col("base_failed"))
    pool = cut(pools(passed, least))
    fit = estimate(_looked_up(passed, pool).withColumn("grp", F.explode("members")))
    d = _distance(_looked_up(rows, pool.drop("members")).withColumn("grp", F.col("used")), fit)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.sqrt(d2).alias("distance"), (~F.col("base_failed") & F.coalesce(d2 <= limit, F.lit(True))).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdicts of all documents. Nulls, empty tables and repeated rows as the module says."""
    return judge(read(spark, sf_dir, "documents"))
