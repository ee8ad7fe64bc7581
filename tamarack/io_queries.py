"""Queries of the sources and sinks: tables written by a sink and read again by a source, beside the SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.labels import label
from .operators import decode, lookup, validate
from .plans import flows
from .plans.ordered import rank_in_group
from .plans.staging import scratch, stage, table
from .sources import archive, audio, records
from .streaming.resume import not_done, not_standing, run_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_B = r"[\s\x{A0}\x{2007}\x{202F}\x{3000}\x{FEFF}\x{200B}]+"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _label(c: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace({c}, '^{_B}|{_B}$', '', 'g')), ''), 'unknown')"


_CLIP = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("id", "language", "transcription")]])
_FIELDS = ("row_id", "id", "language", "transcription")


@query("SELECT row_id, id, language, transcription FROM manifest")
def jsonl_strict(spark, d):
    """The manifest written as JSONL and read again, where any bad line would abort the load."""
    path = scratch(spark, "clips") + ".jsonl"
    records.write_jsonl(table(spark, d, "manifest").select(*_FIELDS), path)
    return records.read_manifest(spark, path, _CLIP).select(*_FIELDS)


@query("SELECT row_id, id, language, transcription FROM manifest")
def jsonl_appended(spark, d):
    """One half written, the other appended to it."""
    path, m = scratch(spark, "clips") + ".jsonl", table(spark, d, "manifest").select(*_FIELDS)
    records.write_jsonl(m.where("row_id % 2 = 0"), path)
    records.append_jsonl(m.where("row_id % 2 <> 0"), path)
    return records.read_jsonl(spark, path, _CLIP).select(*_FIELDS)


@query(
    """WITH s AS (SELECT unnest(regexp_split_to_array(raw, '\r\n|\r|\n')) AS raw FROM raw_lines),
  l AS (SELECT CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM s WHERE trim(raw) <> '')
  SELECT count(*) FILTER (kind = 'OBJECT') AS good, count(*) FILTER (kind IS DISTINCT FROM 'OBJECT') AS bad FROM l"""
)
def jsonl_tolerant(spark, d):
    """Raw lines as a text table, read with malformed lines kept apart."""
    path = scratch(spark, "lines")
    table(spark, d, "raw_lines").where("raw IS NOT NULL").select("raw").write.text(path)
    good, bad = records.read_jsonl_tolerant(spark, path, T.StructType([T.StructField("id", T.StringType())]))
    counts = good.agg(F.count(F.lit(1)).alias("good")).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("bad"))))  # one row each
    return counts.select("good", "bad")


@query("SELECT row_id, nullif(language, '') AS language, nullif(replace(replace(transcription, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS text FROM manifest")
def csv_single_file(spark, d):
    """The manifest as one CSV file and read again; an empty text reads as null, each line end as one line feed."""
    text = F.regexp_replace("transcription", "\\r\\n?", "\n")
    path = scratch(spark, "clips") + ".csv"
    records.write_single_csv(table(spark, d, "manifest").select("row_id", F.nullif("language", F.lit("")).alias("language"), F.nullif(text, F.lit("")).alias("text")), path)
    return records.read_manifest(spark, path).select(F.col("row_id").cast("long"), "language", "text")


@query("SELECT transcription FROM manifest")
def one_column(spark, d):
    return records.read_column(spark, f"{d}/manifest.parquet", "transcription")


@query(f"SELECT {_label('language')} AS language, count(*) AS n_rows FROM manifest GROUP BY 1")
def json_report(spark, d):
    """A small report as one JSON file, replaced at once, and read again."""
    counts = table(spark, d, "manifest").groupBy(label("language").alias("language")).agg(F.count(F.lit(1)).alias("n_rows"))
    path = scratch(spark, "report").removeprefix("file://") + ".json"
    records.write_json_file(path, [r.asDict() for r in counts.orderBy(F.desc("n_rows"), "language").limit(10_000).collect()])  # a report of languages
    return spark.read.schema("language string, n_rows long").option("multiLine", True).json(f"file://{path}" if path.startswith("/") else path)


@query("SELECT doc_id || '.txt' AS member, octet_length(encode(text)) AS size, text FROM documents WHERE text IS NOT NULL")
def tar_members(spark, d):
    """Documents packed into archives and read out of them again."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("body"))
    out = archive.members(archive.packed(docs, "name", "body"), (".txt",))
    return out.select("member", "size", F.decode("content", "UTF-8").alias("text"))


def _sounds(spark, d, suffix: str) -> DataFrame:
    """The vectors as clips of 16 kHz in files of one kind, read back as bytes."""
    folder = scratch(spark, "sounds")
    rows = table(spark, d, "embeddings").select(F.format_string(f"{folder}/%d.{suffix}", "vec_id").alias("path"), F.transform("embedding", lambda x: x.cast("float")).alias("samples"))
    audio.write_clips(rows, "path", "samples", 16000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("vec_id"), "content")


_PCM = "list_transform(embedding, lambda x: round(trunc(greatest(least(x::FLOAT, 1), -1) * 32767::FLOAT)::INT::DOUBLE / 32768, 7))"


@query("SELECT vec_id, len(embedding)::BIGINT AS frames, 16000::BIGINT AS sample_rate, 1::BIGINT AS channels, len(embedding) / 16000.0::DOUBLE AS duration FROM embeddings")
def wav_probe(spark, d):
    return audio.probe_column(_sounds(spark, d, "wav"), "vec_id", "content")


@query(f"SELECT vec_id, {_PCM} AS samples FROM embeddings")
def wav_decode(spark, d):
    out = audio.decode_column(_sounds(spark, d, "wav"), "vec_id", "content", 16000)
    return out.select("vec_id", F.transform("samples", lambda x: F.round(x.cast("double"), 7)).alias("samples"))


@query(f"SELECT vec_id, {_PCM} AS samples FROM embeddings")
def flac_decode(spark, d):
    out = audio.decode_column(_sounds(spark, d, "flac"), "vec_id", "content", 16000)
    return out.select("vec_id", F.transform("samples", lambda x: F.round(x.cast("double"), 7)).alias("samples"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
def missing_clips(spark, d):
    """Rows whose file was not written; only names are listed."""
    folder = scratch(spark, "sounds")
    rows = table(spark, d, "embeddings").select("vec_id", F.format_string(f"{folder}/%d.wav", "vec_id").alias("path"), F.transform("embedding", lambda x: x.cast("float")).alias("samples"))
    audio.write_clips(rows.where("vec_id % 3 <> 0"), "path", "samples", 16000)
    return audio.missing_files(rows.select("vec_id", "path"), "path", folder).select("vec_id")


@query("SELECT row_id, id, language FROM manifest WHERE id IS NULL UNION ALL SELECT min(row_id), id, NULL FROM manifest WHERE id IS NOT NULL GROUP BY id")
def stream_resume(spark, d):
    """New files processed once, ids done before skipped: two runs over a growing folder."""
    source, results, mark = (scratch(spark, x) for x in ("incoming", "results", "mark"))
    m = table(spark, d, "manifest").select("row_id", "id", "language")
    schema = m.schema

    def work(rows: DataFrame) -> DataFrame:
        return rows.select("row_id", "id", F.when(F.col("id").isNull(), F.col("language")).alias("language"))

    first = m.where("id IS NOT NULL").groupBy("id").agg(F.min("row_id").alias("row_id"))
    once = m.where("id IS NULL").unionByName(first.select("row_id", "id", F.lit(None).cast("string").alias("language")))
    once.where("row_id % 2 = 0").write.parquet(source)
    run_available(spark, source, schema, work, results, mark, "id")
    # the second delivery holds the rest and repeats the ids of the first
    once.where("row_id % 2 <> 0 OR id IS NOT NULL").write.mode("append").parquet(source)
    run_available(spark, source, schema, work, results, mark, "id")
    return spark.read.parquet(results)


_DONE = "SELECT source_shard FROM shard_status WHERE source_shard IS NOT NULL AND status IN ('prepared', 'existing')"


@query(
    f"""SELECT DISTINCT source_shard FROM manifest WHERE source_shard IS NOT NULL AND NOT (source_shard IN ({_DONE}) AND source_shard IN (SELECT shard FROM duration_audit WHERE shard IS NOT NULL))"""
)
def resume_with_files(spark, d):
    """Shards to be done (again): those without a finished result, and those whose file is gone."""
    shards = table(spark, d, "manifest").where("source_shard IS NOT NULL").select("source_shard").distinct()
    done = table(spark, d, "shard_status").where("status IN ('prepared', 'existing')")
    files = table(spark, d, "duration_audit").select(F.col("shard").alias("source_shard"))
    return not_standing(shards, done, files, "source_shard")


@query("SELECT row_id, id FROM manifest")
def combined_manifests(spark, d):
    """Manifests of different columns as one; an id that came twice would be an error."""
    m = table(spark, d, "manifest")
    train = m.where("split = 'train'").select("row_id", "id", "split")
    rest = m.where("split IS NULL OR split <> 'train'").select("row_id", "id")
    return lookup.combined([train, rest], "row_id").select("row_id", "id")


@query(f"SELECT row_id, {_label('split')} AS split FROM manifest WHERE {_label('split')} <> 'train'")
def not_train(spark, d):
    return validate.not_train(table(spark, d, "manifest").select("row_id", label("split").alias("split")))


@query(
    """WITH r AS (SELECT row_id, CASE WHEN duration IS NULL OR isnan(duration) THEN 'unreadable audio' WHEN duration < 1 THEN 'too short' WHEN duration > 60 THEN 'too long' END AS reason FROM manifest),
  k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY row_id) AS nth FROM r WHERE reason IS NOT NULL) SELECT reason, row_id, nth FROM k WHERE nth <= 10"""
)
def drop_samples(spark, d):
    """The first ten rows dropped for each reason, a sample for a report."""
    rows = validate.within_limits(table(spark, d, "manifest").select("row_id", "duration"), 1.0, 60.0)
    return validate.drop_samples(rows, F.col("reason"), "row_id").select("reason", "row_id", F.col("nth").cast("long").alias("nth"))


@query(
    f"""SELECT language, subtype, n_rows, row_number() OVER (ORDER BY n_rows DESC, language, subtype) AS place
  FROM (SELECT {_label('language')} AS language, {_label('subtype')} AS subtype, count(*) AS n_rows FROM manifest GROUP BY ALL)"""
)
def ordered_report(spark, d):
    """Counts in descending order, ties by their labels; one row per language and subtype."""
    counts = table(spark, d, "manifest").groupBy(label("language").alias("language"), label("subtype").alias("subtype")).agg(F.count(F.lit(1)).alias("n_rows"))
    return decode.ordered(counts, [F.desc("n_rows"), F.asc("language"), F.asc("subtype")], "place")


@query("SELECT row_id, id, row_number() OVER (ORDER BY encode(id::VARCHAR), row_id) AS place FROM manifest WHERE id IS NOT NULL")
def string_order(spark, d):
    """Results in the order of their ids as strings, ranked in ranges."""
    rows = table(spark, d, "manifest").where("id IS NOT NULL").select("row_id", "id", F.lit(0).alias("_all"))
    return rank_in_group(rows, ["_all"], ["id", "row_id"], "place").select("row_id", "id", "place")


@query("SELECT DISTINCT row_id, id, split FROM manifest WHERE split IS NULL OR id IS NULL")
def cached_stage(spark, d):
    """A stage written once and read by two consumers."""
    rows = stage(table(spark, d, "manifest").select("row_id", "id", "split"), "rows")
    return rows.where("split IS NULL").unionByName(rows.where("id IS NULL")).distinct()


@query(f"SELECT row_id::VARCHAR AS id, {_label('language')} AS language, 'heard ' || row_id AS transcription FROM manifest WHERE {_label('split')} = 'test' AND {_label('language')} IN ('swa','som','kik','luo','mas','kln')")
def infer_flow(spark, d):
    """Test rows through a batch function, checks and the single submission file; half of them had results before."""
    m = table(spark, d, "manifest").select("row_id", label("language").alias("language"), label("split").alias("split"))
    rows = m.where((F.col("split") == "test") & F.col("language").isin(*validate.LANGUAGES)).select(F.col("row_id").alias("id"), "language", F.lit(0).alias("place"))
    done = rows.where("id % 2 = 0").select("id", "language", F.concat(F.lit("heard "), F.col("id").cast("string")).alias("transcription"))
    path = scratch(spark, "submission") + ".csv"
    flows.infer_test(rows, lambda part: "heard " + part["id"].astype(str), done, path)
    return records.read_manifest(spark, path)


@query("SELECT vec_id, ((len(embedding) - 16) // 10 + 1) * 8 + 16 AS n_samples FROM embeddings")
def stretched_clips(spark, d):
    """Lengths of clips played a quarter faster, in windows of 16 samples."""
    out = audio.stretch_column(table(spark, d, "embeddings"), "vec_id", "embedding", 1.25, frame=16)
    return out.select("vec_id", F.size("samples").cast("long").alias("n_samples"))
