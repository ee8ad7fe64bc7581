"""Quality gates between a baseline and a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .validate import LANGUAGES

# The gate's thresholds.
THRESHOLDS = {"min_hours": 1.0, "min_macro_gain": 0.02, "min_languages": 4, "max_regression": 0.03}


def language_table(spark: SparkSession, languages=LANGUAGES) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(languages)], "language string, place long")


def hours_by_language(df: DataFrame, languages=LANGUAGES) -> DataFrame:
    """Hours of each wanted language, zero where it has no row."""
    sums = df.groupBy("language").agg((F.sum(F.when(~F.isnan("duration"), F.col("duration"))) / 3600).alias("h"))
    table = F.broadcast(language_table(df.sparkSession, languages))  # the wanted languages are a parameter, a handful
    return table.join(sums, "language", "left").select("language", F.coalesce("h", F.lit(0.0)).alias("hours"))


def missing_languages(df: DataFrame, languages=LANGUAGES) -> DataFrame:
    """Wanted languages without a row."""
    return language_table(df.sparkSession, languages).join(df.select("language").distinct(), "language", "left_anti").select("language")


def leaking_sources(aligned: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Number of (language, source_id) of the aligned rows that also stand in evaluation rows."""
    key = ["language", "source_id"]
    both = aligned.select(*key).join(evaluation.select(*key).distinct(), key, "left_semi")
    return both.agg(F.countDistinct(*key).alias("leaking_sources"))


def evaluate_gate(rates: DataFrame, hours: DataFrame, macro_clean: float | None = None, macro_aligned: float | None = None, limits=THRESHOLDS, need_hours=LANGUAGES) -> DataFrame:
    """One row: whether to proceed and all reasons against it.

    ``rates``: language, clean, aligned; ``hours``: language, hours. Macro rates
    default to the unweighted means.
    """
    table = F.broadcast(language_table(rates.sparkSession))
    own = table.join(rates, "language", "left").join(hours, "language", "left")
    own = own.withColumn("gain", F.col("clean") - F.col("aligned")).withColumn("hours", F.coalesce("hours", F.lit(0.0)))

    def listed(cond):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "language")))), lambda s: s["language"]), ",")

    one = own.agg(
        (F.avg("clean") if macro_clean is None else F.lit(macro_clean)).alias("clean_macro"),
        (F.avg("aligned") if macro_aligned is None else F.lit(macro_aligned)).alias("aligned_macro"),
        F.count_if(F.col("gain") > 0).alias("languages_improved"),
        listed(F.col("language").isin(*need_hours) & (F.col("hours") < limits["min_hours"])).alias("_few"),
        listed(F.col("gain") < -limits["max_regression"]).alias("_worse"),
    )
    gain = F.col("clean_macro") - F.col("aligned_macro")
    reasons = F.filter(
        F.array(
            F.when(F.col("_few") != "", F.concat(F.lit("insufficient_aligned_hours:"), "_few")),
            F.when(gain < limits["min_macro_gain"], F.lit("macro_wer_improvement_below_threshold")),
            F.when(F.col("languages_improved") < limits["min_languages"], F.lit("too_few_languages_improved")),
            F.when(F.col("_worse") != "", F.concat(F.lit("excessive_language_regression:"), "_worse")),
        ),
        lambda r: r.isNotNull(),
    )
    one = one.withColumn("macro_gain", gain).withColumn("reasons", reasons)
    return one.select((F.size("reasons") == 0).alias("proceed"), "reasons", "clean_macro", "aligned_macro", "macro_gain", "languages_improved")


def lower_macro(candidates: DataFrame) -> DataFrame:
    """The candidate with the least macro rate; the first one on ties (columns name, place, macro_wer)."""
    return candidates.agg(F.min_by(F.struct("name", "macro_wer"), F.struct("macro_wer", "place")).alias("c")).select("c.*")


def alignment_counts(df: DataFrame) -> DataFrame:
    """Sources, accepted segments and hours and rejected segments per language (``accepted`` tells them apart)."""
    ok = F.col("accepted")
    return df.groupBy("language").agg(
        F.countDistinct("source_id").alias("sources"), F.count_if(ok).alias("accepted_segments"),
        (F.coalesce(F.sum(F.when(ok & ~F.isnan("duration"), F.col("duration"))), F.lit(0.0)) / 3600).alias("accepted_hours"),
        F.count_if(~ok).alias("rejected_segments"),
    )
