"""Descriptive bibliometrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_author, normalize_title


def histogram(df: DataFrame, key: Column, name: str = "k") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("counter"))


def word_counts(df: DataFrame, text: Column | str) -> DataFrame:
    """Frequency of the words of normalised titles."""
    return histogram(df.select(F.explode(F.split(normalize_title(text), " ")).alias("w")).where("w != ''"), F.col("w"), "word")


def name_token_counts(df: DataFrame, name: Column | str) -> DataFrame:
    """Frequency of name words that are neither initials nor numbers."""
    words = df.select(F.explode(F.split(normalize_author(name), " ")).alias("w"))
    return histogram(words.where((F.length("w") != 1) & (F.col("w") != "") & F.col("w").try_cast("bigint").isNull()), F.col("w"), "token")


def histogram_of(df: DataFrame, key: str, name: str = "k") -> DataFrame:
    """How many keys occur k times; two aggregates, nothing collected."""
    return histogram(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), F.col("_n"), name)


def career(df: DataFrame, author: str, year: str) -> DataFrame:
    """(author, year, counter): publications of each author and year."""
    return df.groupBy(F.col(author).alias("author"), F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("counter"))


def career_length(careers: DataFrame) -> DataFrame:
    """(k, authors): authors by years from first to last publication."""
    return careers.groupBy("author").agg((F.max("year") - F.min("year")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("authors"))


def career_by_year(careers: DataFrame) -> DataFrame:
    """(k, publications, authors, mean) by year of work, counted from 0."""
    first = careers.groupBy("author").agg(F.min("year").alias("first"))
    by = careers.join(first, "author").groupBy((F.col("year") - F.col("first")).alias("k")).agg(F.sum("counter").alias("publications"), F.count(F.lit(1)).alias("authors"))
    return by.withColumn("mean", F.round(F.col("publications") / F.col("authors"), 6))


def career_continuation(lengths: DataFrame) -> DataFrame:
    """(k, authors): at k = 0 all authors, at k > 0 those with a longer career.
    lengths has a row per length, so that its single ordered window is small."""
    rest = F.sum("authors").over(W.orderBy("k").rowsBetween(1, W.unboundedFollowing))
    total = F.sum("authors").over(W.partitionBy())
    return lengths.select("k", F.when(F.col("k") == 0, total).otherwise(F.coalesce(rest, F.lit(0))).alias("authors"))


def normalized_by_first(df: DataFrame, k: str, v: str) -> DataFrame:
    """v as a share of the value at the smallest k; df has a row per k."""
    first = F.first(v).over(W.orderBy(k).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.select(k, F.round(F.col(v) / first, 6).alias("share"))


def weighted_mean(df: DataFrame, k: str, c: str) -> DataFrame:
    return df.agg(F.round(F.sum(F.col(k) * F.col(c)) / F.sum(c), 6).alias("mean"))


def arg_max(df: DataFrame, k: str, c: str) -> DataFrame:
    """The key with the largest count; of equal ones the smallest key."""
    return df.agg(F.max_by(k, F.struct(F.col(c), -F.col(k))).alias("k"), F.max(c).alias("counter"))


def popular(df: DataFrame, key: str, more_than: int = 10) -> DataFrame:
    """(key, counter) of keys with more than so many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("counter")).where(F.col("counter") > more_than)


def rows_of_popular(df: DataFrame, key: str, more_than: int = 10) -> DataFrame:
    return df.join(popular(df, key, more_than).select(key), key, "left_semi")


def link_outcomes(truth: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Every link of either side once, with its outcome: correct, false (found
    but not true) or missing."""
    t = truth.select(*on).distinct().withColumn("_t", F.lit(True))
    p = found.select(*on).distinct().withColumn("_p", F.lit(True))
    outcome = F.when(F.col("_t").isNull(), "false").when(F.col("_p").isNull(), "missing").otherwise("correct")
    return t.join(p, on, "full_outer").select(*on, outcome.alias("outcome"))


def link_report(outcomes: DataFrame, source: str, reference: str, titles: DataFrame) -> DataFrame:
    """(outcome, line): readable lines of link outcomes; titles(id, title). A
    link whose end has no title has no line."""
    s, r = (titles.groupBy(F.col("id").alias(c)).agg(F.trim(F.min("title")).alias(f"_{n}")) for c, n in ((source, "s"), (reference, "r")))
    end = lambda i, t: F.concat(F.lit("("), F.col(i).cast("string"), F.lit(","), F.col(t), F.lit(")"))
    return outcomes.join(s, source).join(r, reference).select("outcome", F.concat(end(source, "_s"), F.lit("-->"), end(reference, "_r")).alias("line"))


def link_quality(truth: DataFrame, found: DataFrame, on: list[str], missed: int = 63) -> DataFrame:
    """tp, fp, missing and precision, recall, f1. Recall divides by tp + missed,
    a constant of the published evaluation; None uses the missing links."""
    t = truth.select(*on).distinct().withColumn("_t", F.lit(1))
    p = found.select(*on).distinct().withColumn("_p", F.lit(1))
    n = t.join(p, on, "full_outer").agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("missing"))
    return quality_measures(n, missed)


def quality_measures(counts: DataFrame, missed: int | None = 63) -> DataFrame:
    """counts (tp, fp, ...) with precision, recall and f1."""
    base = F.col("missing") if missed is None else F.lit(missed)
    n = counts.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + base))
    n = n.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return n.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def quality_sweep(truth: DataFrame, scored: DataFrame, on: list[str], score: str, thresholds: list[int], missed: int | None = 63) -> DataFrame:
    """(threshold, tp, fp, missing, precision, recall, f1): how good the links are
    whose best score reaches each threshold. One pass over the links."""
    t = truth.select(*on).distinct().withColumn("_t", F.lit(True))
    p = scored.groupBy(*on).agg(F.max(score).alias("_s")).join(t, on, "full_outer")
    reached = lambda x: F.coalesce(F.col("_s") >= x, F.lit(False))
    known = F.col("_t").isNotNull()
    counts = [F.struct(F.lit(x).cast("long").alias("threshold"), F.count_if(reached(x) & known).alias("tp"), F.count_if(reached(x) & ~known).alias("fp"), F.count_if(~reached(x) & known).alias("missing")) for x in thresholds]
    return quality_measures(p.agg(F.array(*counts).alias("c")).select(F.inline("c")), missed)


def kinds_by_year(rows: DataFrame, year: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """(year, a column for each of kinds): how many rows of each kind a year has."""
    return rows.groupBy(year).agg(*[F.count_if(F.col(kind) == value).alias(name) for name, value in kinds.items()])


def ingest_outcomes(decided: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(outcome, n) of decided(key, status): limbo, duplicate for keys in known, else added."""
    rows = decided.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    outcome = F.when(F.col("status") == "LIMBO", "limbo").when(F.col("_known"), "duplicate").otherwise("added")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
