"""The corpus flows as plans: sources to clips, long recordings to aligned segments, test rows to a submission."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ManifestError
from ..functions import text as tx
from ..operators import align, decode, lookup, segment, select, validate
from ..sources import archive, audio, records
from ..streaming.resume import not_done
from .staging import broadcast_if_small, stage


def store_clips(rows: DataFrame, root: str, rate: int, kind: str = "flac") -> tuple[DataFrame, DataFrame]:
    """Clips of ``rows`` (id, language, shard, content, text, and columns that pass through) decoded and written below ``root``.

    Returns the records (with ``audio_path`` and ``duration``) and a report per shard: rows, rejected, and the status
    ``prepared``, or ``empty`` if none could be used. Rows without letters or with unreadable audio are rejected. Files
    that stand already are left alone, so a run after a loss goes on where it stopped.
    """
    rows = stage(rows.withColumn("_usable", tx.normalize_text(F.col("text")) != ""), "sources")
    heard = audio.decode_column(rows.where("_usable"), "id", "content", rate)
    path = F.concat_ws("/", F.lit(root), F.col("language"), tx.short_digest(F.col("shard")), F.concat("id", F.lit(f".{kind}")))
    whole = rows.drop("content").join(heard, "id", "left").withColumn("audio_path", path)
    whole = stage(whole.withColumn("_kept", F.col("samples").isNotNull()), "heard")
    audio.write_clips(whole.where("_kept"), "audio_path", "samples", rate)
    kept = whole.where("_kept").withColumn("duration", F.size("samples") / F.lit(float(rate))).drop("samples", "reason", "_usable", "_kept")
    report = whole.groupBy("shard").agg(F.count_if("_kept").alias("n_rows"), F.count_if(~F.col("_kept")).alias("rejected"))
    return kept, report.withColumn("status", F.when(F.col("n_rows") > 0, "prepared").otherwise("empty"))


def archive_clips(archives: DataFrame, texts: DataFrame, language: str, root: str, rate: int, kind: str = "flac") -> tuple[DataFrame, DataFrame]:
    """Clips of audio members of tar archives (path, content) that have a text (key, place, text) by their stem or full name."""
    found = stage(archive.members(archives).where("member IS NOT NULL").select("archive", "member", "content"), "members")
    named = lookup.two_tier(found.select("member").distinct(), texts, "member", "key", "place", "text")
    rows = found.join(named, "member").select(
        tx.stable_id(F.lit(language), F.col("archive"), F.col("member")).alias("id"), F.lit(language).alias("language"),
        F.col("archive").alias("shard"), "content", "text",
    )
    return store_clips(rows, root, rate, kind)


def listed_clips(rows: DataFrame, finished: DataFrame, most: int, languages, split: str, subtypes) -> DataFrame:
    """Rows of the shards to be prepared: evenly spread over each language and subtype, and not finished yet (``shard``)."""
    listed = select.listed_shards(rows.select(F.col("shard").alias("path")).where("path IS NOT NULL").distinct(), languages, split, subtypes)
    chosen = select.spread_sample(stage(listed, "listed"), ["language", "subtype"], "path", most).select(F.col("path").alias("shard"))
    return rows.join(broadcast_if_small(not_done(chosen, finished, "shard")), "shard", "left_semi")


def target_ids(transcription: Column, vocabulary: dict[str, int]) -> Column:
    """Vocabulary ids of a text's characters, the blank as ``|``; null if one is unknown."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    ids = F.transform(F.filter(F.split(transcription, ""), lambda c: c != ""), lambda c: F.try_element_at(table, F.when(c == " ", "|").otherwise(c)))
    return F.when(F.forall(ids, lambda i: i.isNotNull()), ids)


def aligned_pilot(
    recordings: DataFrame, vocabulary: dict[str, int], frame_seconds: float, shortest: float = 2.0, longest: float = 20.0, padding: float = 0.15,
    least_posterior: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """(segments, failures) of long recordings: id, language, duration, transcription, emissions (frames x vocabulary).

    Texts become vocabulary ids, tokens are aligned, tokens make words, words make segments; ``reasons`` lists why a segment
    is not accepted. Recordings with unknown characters or without an alignment are failures with their reason.
    """
    rows = recordings.withColumn("targets", target_ids(F.col("transcription"), vocabulary)).withColumn("words", tx.words(F.col("transcription")))
    rows = stage(rows, "recordings")
    unknown = rows.where("targets IS NULL").select("id", F.lit("unknown character or no text").alias("reason"))
    tokens = stage(align.align_utterances(rows.where("targets IS NOT NULL"), "id"), "tokens")
    spans = segment.aligned_words(tokens.where("reason IS NULL"), "id", "place", F.col("token_id") == vocabulary["|"])
    texts = rows.select("id", F.posexplode("words").alias("word_no", "text"))
    words = spans.join(texts, ["id", "word_no"]).join(rows.select("id", "duration"), "id").select(
        "id", "word_no", (F.col("start_frame") * frame_seconds).alias("start"), ((F.col("last_frame") + 1) * frame_seconds).alias("end"), "text", "posterior", "duration"
    )
    made = segment.padded_segments(words, "id", "word_no", F.col("duration"), shortest, longest, padding)
    made = made.withColumn("reasons", validate.failing_reasons({"low_token_posterior": F.col("posterior") < least_posterior}))
    failed = tokens.where("reason IS NOT NULL").select("id", "reason").unionByName(unknown)
    return made.join(rows.select("id", "language"), "id"), failed


def infer_test(
    chunks: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], done: DataFrame | None, path: str, languages=validate.LANGUAGES
) -> dict:
    """A submission of the test rows (id, language, place, and what ``fn`` needs), one CSV file sorted by id as text.

    Ids with a result in ``done`` (id, language, transcription) are not worked out again. Chunks of an id are joined in order; any failure
    or problem of the submission is an error that names it, and nothing is written.
    """
    validate.require_columns(chunks, ("id", "language", "place"))
    expected = stage(chunks.select(F.col("id").cast("string").alias("id"), "language").distinct(), "expected")
    pending = (chunks if done is None else not_done(chunks, done, "id")).withColumn("_key", F.concat_ws("\x00", F.col("id").cast("string"), F.col("place").cast("string")))
    heard = stage(decode.infer(pending, fn, "_key"), "heard")
    bad = heard.where("reason IS NOT NULL").count()
    if bad:
        raise ManifestError(f"{bad} rows failed")
    parts = heard.join(pending.select("_key", F.col("id").cast("string").alias("id"), "place"), "_key")
    texts = decode.joined_chunks(parts, "id", "place", "text").join(expected, "id").select("id", "language", F.col("text").alias("transcription"))
    if done is not None:
        texts = texts.unionByName(done.select(F.col("id").cast("string").alias("id"), "language", "transcription"))
    texts = stage(texts, "submission")
    problems = [f"{r['problem']} ({r['n_rows']})" for r in validate.submission_problems(texts, expected, languages).orderBy("check_no").collect()]  # six at most
    if problems:
        raise ManifestError("; ".join(problems))
    records.write_single_csv(texts.repartition(1).sortWithinPartitions("id"), path)
    return {"rows": texts.count(), "submission": path}
