"""Canonical manifests: alias resolution, ordered checks with one reason each, first-wins duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ManifestError
from ..functions import text as tx
from ..functions.labels import stripped
from ..plans.staging import stage

# The languages accepted and the field names looked at, in order.
LANGUAGES = ("swa", "som", "kik", "luo", "mas", "kln")
ALIASES = {
    "id": ("id", "utterance_id", "record_id"),
    "source_id": ("source_id", "recording_id", "original_id", "id"),
    "audio_path": ("audio_path", "path", "file", "filename"),
    "language": ("language", "lang", "lang3"),
    "dialect": ("dialect", "accent", "variety"),
    "subtype": ("subtype", "type", "scripted_type"),
    "speaker_id": ("speaker_id", "speaker", "client_id"),
    "duration": ("duration", "duration_seconds", "seconds"),
    "transcription": ("normalized_transcription", "transcription", "actualSentence", "transcript", "text", "sentence"),
}
PROVENANCE = ("dataset", "source_shard", "source_repo")


def resolve_aliases(df: DataFrame, keep: list[str]) -> DataFrame:
    """One column per canonical field, the first present alias; columns the input lacks read as null."""
    def pick(names) -> Column:
        have = [F.col(n).cast("string") for n in names if n in df.columns]
        return tx.first_present(*have) if have else F.lit(None).cast("string")

    return df.select(*keep, *[pick(v).alias(k) for k, v in ALIASES.items()], *[pick((p,)).alias(p) for p in PROVENANCE])


def resolve_json(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """The same from a column of raw JSON objects; what is no object has all fields null."""
    record = F.from_json(F.col(raw), "map<string,string>")
    parsed = df.select(*keep, record.alias("_record"))

    def pick(names) -> Column:
        return tx.first_present(*[F.col("_record")[n] for n in names])

    return parsed.select(*keep, *[pick(v).alias(k) for k, v in ALIASES.items()], *[pick((p,)).alias(p) for p in PROVENANCE])


def check_records(fields: DataFrame, languages=LANGUAGES) -> DataFrame:
    """Canonical values beside ``reason``, the first check that failed, null if none.

    Checks in order: language, transcription, source, audio path, duration not
    a number, duration not positive. NaN and infinite durations pass.
    """
    def bare(c: str) -> Column:
        return stripped(F.col(c), tx.SPACES)

    rows = fields.withColumn("transcription", tx.normalize_text(F.col("transcription")))
    rows = rows.withColumn("language", F.lower(F.coalesce(bare("language"), F.lit(""))))
    rows = rows.withColumn("_raw_duration", F.col("duration")).withColumn("duration", F.expr("try_cast(duration AS DOUBLE)"))
    for c in ("source_id", "audio_path", "id", "speaker_id"):
        rows = rows.withColumn(c, F.nullif(bare(c), F.lit("")))
    for c in ("dialect", "subtype"):
        rows = rows.withColumn(c, F.lower(F.coalesce(bare(c), F.lit("unknown"))))
    for c in PROVENANCE:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit("unknown")))
    # The texts of the reasons.
    reason = F.coalesce(
        F.when(~F.col("language").isin(*languages), F.lit("unsupported language")),
        F.when(F.col("transcription") == "", F.lit("empty transcription")),
        F.when(F.col("source_id").isNull(), F.lit("source_id is required")),
        F.when(F.col("audio_path").isNull(), F.lit("audio_path is required")),
        F.when(F.col("_raw_duration").isNotNull() & F.col("duration").isNull(), F.lit("invalid duration")),
        F.when(F.col("duration") <= 0, F.lit("duration must be positive")),
    )
    made = tx.content_id(F.col("language"), F.col("source_id"), F.col("audio_path"), F.col("transcription"))
    return rows.withColumn("id", F.coalesce("id", made)).withColumn("reason", reason).drop("_raw_duration")


def reject_duplicates(checked: DataFrame, order: str) -> DataFrame:
    """Later valid rows of an id already taken get a reason; null-safe and free of per-group gathering.

    The first valid row of each id is a minimum combined on the map side, so a
    heavily repeated id costs one row per partition. ``checked`` is read twice:
    hand in a stage.
    """
    first = checked.where("reason IS NULL").groupBy(F.col("id").alias("_id")).agg(F.min(order).alias("_first"))
    joined = checked.join(first, checked["id"] == first["_id"], "left")
    again = F.when(F.col("reason").isNull() & (F.col(order) > F.col("_first")), F.lit("duplicate id"))
    return joined.withColumn("reason", F.coalesce("reason", again)).drop("_id", "_first")


def within_limits(df: DataFrame, minimum: float, maximum: float) -> DataFrame:
    """``reason`` for durations unknown or outside the inclusive limits."""
    d = F.col("duration")
    return df.withColumn("reason", F.coalesce(
        F.when(d.isNull() | F.isnan(d), F.lit("unreadable audio")),
        F.when(d < minimum, F.lit("too short")),
        F.when(d > maximum, F.lit("too long")),
    ))


def failing_reasons(checks: dict[str, Column]) -> Column:
    """All reasons whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]), lambda r: r.isNotNull())


def drop_report(df: DataFrame, reason: Column) -> DataFrame:
    """How many rows each reason drops."""
    return df.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("dropped"))


def drop_samples(df: DataFrame, reason: Column, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows that each reason drops, with their number; limited in each partition before the shuffle."""
    rows = df.select(reason.alias("reason"), F.col(order)).where("reason IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("reason").orderBy(order))).where(F.col("nth") <= n)


def not_train(df: DataFrame) -> DataFrame:
    """Rows of an additional manifest that are in another split than train, or in none."""
    return df.where("split IS NULL OR split <> 'train'")


def require_train(df: DataFrame) -> None:
    if not not_train(df).isEmpty():
        raise ManifestError("an additional manifest may hold train rows only")


def require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ManifestError(f"missing columns: {', '.join(missing)}")


def submission_problems(frame: DataFrame, expected: DataFrame, languages=LANGUAGES) -> DataFrame:
    """One row (``check_no``, ``problem``, ``n_rows``) per failed check of a submission, in the order they are made.

    Raises if the columns are not exactly id, language, transcription. Both tables are read once, into stages of their keys.
    """
    if frame.columns != ["id", "language", "transcription"]:
        raise ValueError("submission columns must be exactly id, language, transcription")
    key = ["id", "language"]
    want = stage(expected.select(*[F.col(c).cast("string").alias(c) for c in key]), "expected")
    have = frame.select(*[F.col(c).cast("string").alias(c) for c in key], tx.present(F.col("transcription")).isNull().alias("blank"))
    have = stage(have, "submitted")

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n_rows"))

    def left_over(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select(*key).distinct().join(b.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_rows"))

    parts = [
        ("duplicate submission id", repeated(have)),
        ("duplicate expected id", repeated(want)),
        ("missing id and language", left_over(want, have)),
        ("unexpected id and language", left_over(have, want)),
        ("unsupported language", have.where(~F.col("language").isin(*languages)).agg(F.count(F.lit(1)).alias("n_rows"))),
        ("empty transcription", have.where("blank").agg(F.count(F.lit(1)).alias("n_rows"))),
    ]
    out = None
    for i, (problem, part) in enumerate(parts, 1):
        one = part.select(F.lit(i).cast("long").alias("check_no"), F.lit(problem).alias("problem"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.where("n_rows > 0")


def first_of_each(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key; the planner limits each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
