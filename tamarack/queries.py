"""The engine's queries over the driver's tables, each beside its SQL twin.

Queries run over whole tables. Label fields are normalised first (trimmed,
lower-cased, null or blank as ``unknown``); durations that are null, not finite
or not positive are unknown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as tx
from .functions.labels import label, usable_seconds
from .operators import audit, decode, gate, lookup, metrics, segment, select, splits, validate, vocab
from .operators.align import align_utterances
from .plans.staging import stage, table
from .streaming.resume import not_done

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- pieces of SQL

_B = r"[\s\x{A0}\x{2007}\x{202F}\x{3000}\x{FEFF}\x{200B}]+"
_S = r"\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}"
_KEEP = r"\p{L}\p{N}_" + _S + r"\x{C0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}"
_LANGS = "('swa','som','kik','luo','mas','kln')"


def _label(c: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace({c}, '^{_B}|{_B}$', '', 'g')), ''), 'unknown')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_S}]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _squeeze(f"regexp_replace(lower(nfc_normalize(coalesce({x}, ''))), '[^{_KEEP}''\\x{{2019}}\\x{{14B}}\\x{{14A}}]', ' ', 'g')")


def _plain(x: str) -> str:
    return _squeeze(f"regexp_replace(lower({_squeeze(x)}), '[^{_KEEP}]', '', 'g')")


def _bare(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}_{_S}]', ' ', 'g')"


def _dot(x: str) -> str:
    return f"coalesce(nullif({x}, ''), '.')"


def _collapse(x: str) -> str:
    return _dot(_squeeze(x))


def _nopunct(x: str) -> str:
    return _collapse(f"regexp_replace({x}, '[^{_KEEP}''\\x{{2019}}\\x{{14B}}\\x{{14A}}]', ' ', 'g')")


_CLIPS = f"""clips AS (SELECT row_id, id, source_id, audio_path, speaker_id, source_shard, transcription, ingested_at,
  {_label('language')} AS language, {_label('subtype')} AS subtype, {_label('split')} AS split, {_label('dataset')} AS dataset,
  CASE WHEN duration > 0 AND isfinite(duration) THEN duration END AS duration FROM manifest)"""
_WORDS = f"list_filter(regexp_split_to_array({_norm('transcription')}, ' '), lambda w: w <> '')"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with label fields in one spelling and unusable durations as null."""
    m = table(spark, sf_dir, "manifest")
    out = m.select(
        "row_id", "id", "source_id", "audio_path", "speaker_id", "source_shard", "transcription", "ingested_at",
        *[label(c).alias(c) for c in ("language", "subtype", "split", "dataset")], usable_seconds("duration").alias("duration"),
    )
    return out


# ---------------------------------------------------------------- text and identifiers


@query(f"SELECT row_id, {_norm('transcription')} AS text FROM manifest")
def normalize_text(spark, d):
    return table(spark, d, "manifest").select("row_id", tx.normalize_text(F.col("transcription")).alias("text"))


@query(f"SELECT row_id, {_plain('transcription')} AS text FROM manifest WHERE transcription IS NOT NULL")
def normalize_plain(spark, d):
    m = table(spark, d, "manifest").where("transcription IS NOT NULL")
    return m.select("row_id", tx.normalize_plain(F.col("transcription")).alias("text"))


@query(f"SELECT row_id, {_squeeze(_bare('transcription'))} AS text FROM manifest WHERE transcription IS NOT NULL")
def normalize_eval(spark, d):
    m = table(spark, d, "manifest").where("transcription IS NOT NULL")
    return m.select("row_id", tx.normalize_eval(F.col("transcription")).alias("text"))


_FINAL = r"[" + _S + r".,!?:;\x{964}\x{61F}]+$"


@query(
    f"""SELECT row_id, variant, text FROM (SELECT row_id, transcription AS t FROM manifest WHERE transcription IS NOT NULL),
  LATERAL (SELECT unnest(['collapsed','no_final_punct','no_punct','lower_no_punct','normalized']) AS variant,
  unnest([{_collapse('t')}, {_dot(_squeeze(f"regexp_replace({_collapse('t')}, '{_FINAL}', '')"))}, {_nopunct('t')}, {_nopunct('lower(t)')}, {_dot(_norm('t'))}]) AS text)"""
)
def text_variants(spark, d):
    t = F.col("transcription")
    made = {
        "collapsed": tx.collapse_ws(t), "no_final_punct": tx.strip_final_punct(t), "no_punct": tx.strip_all_punct(t),
        "lower_no_punct": tx.lower_strip_punct(t), "normalized": tx.submission_text(t),
    }
    rows = table(spark, d, "manifest").where("transcription IS NOT NULL")
    wide = rows.select("row_id", *[c.alias(n) for n, c in made.items()])
    return wide.unpivot(["row_id"], list(made), "variant", "text")


@query(
    """WITH j AS (SELECT line_id, CASE WHEN json_valid(raw) THEN raw END AS r FROM raw_lines)
  SELECT line_id, coalesce(r->>'id', r->>'utterance_id', r->>'record_id') AS id, coalesce(r->>'source_id', r->>'recording_id', r->>'original_id', r->>'id') AS source_id,
  coalesce(r->>'language', r->>'lang', r->>'lang3') AS language FROM j WHERE r IS NOT NULL AND json_type(r) = 'OBJECT'"""
)
def alias_fields(spark, d):
    rows = table(spark, d, "raw_lines").where("raw IS NOT NULL")
    rows = rows.where(F.from_json("raw", "struct<_c string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_c"})["_c"].isNull())
    out = validate.resolve_json(rows.where("trim(raw) <> ''"), "raw", ["line_id"])
    return out.select("line_id", "id", "source_id", "language")


@query("SELECT row_id, CASE WHEN NOT isnan(duration) THEN duration END AS duration, CASE WHEN trim(regexp_replace(speaker_id, '\\s', '', 'g')) <> '' THEN speaker_id END AS speaker_id FROM manifest")
def clean_optional(spark, d):
    m = table(spark, d, "manifest")
    return m.select("row_id", tx.clean_number(F.col("duration")).alias("duration"), tx.present(F.col("speaker_id")).alias("speaker_id"))


@query(
    """SELECT row_id, coalesce(language,'None') || '-' || substr(sha1(coalesce(source_id,'None') || chr(0) || coalesce(audio_path,'None') || chr(0) || coalesce(transcription,'None')), 1, 16) AS content_id,
  'clip-' || substr(sha1(coalesce(source_shard,'None') || chr(0) || row_id), 1, 20) AS stable_id, substr(sha1(source_shard), 1, 12) AS shard_digest FROM manifest"""
)
def stable_ids(spark, d):
    c = F.col
    return table(spark, d, "manifest").select(
        "row_id", tx.content_id(F.coalesce(c("language"), F.lit("None")), c("source_id"), c("audio_path"), c("transcription")).alias("content_id"),
        tx.stable_id(F.lit("clip"), c("source_shard"), c("row_id")).alias("stable_id"), tx.short_digest(c("source_shard")).alias("shard_digest"),
    )


@query(
    """SELECT row_id, 'clip_' || substr(regexp_replace(source_shard, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 180) || '_orig' AS clip_id,
  regexp_extract(source_shard, '[^/]*$') AS file, regexp_replace(regexp_extract(source_shard, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem,
  lower(regexp_extract(regexp_extract(source_shard, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS extension FROM manifest WHERE source_shard IS NOT NULL"""
)
def clip_ids(spark, d):
    s = F.col("source_shard")
    return table(spark, d, "manifest").where("source_shard IS NOT NULL").select(
        "row_id", tx.clip_id(F.lit("clip"), s).alias("clip_id"), tx.base_name(s).alias("file"), tx.stem(s).alias("stem"), tx.extension(s).alias("extension")
    )


@query(f"SELECT row_id, len({_WORDS})::BIGINT AS n_words FROM manifest")
def word_counts(spark, d):
    return table(spark, d, "manifest").select("row_id", F.size(tx.words(tx.normalize_text(F.col("transcription")))).cast("long").alias("n_words"))


@query(
    """SELECT step, round(CASE WHEN step < 100 THEN step / 100.0 ELSE greatest(0, (1000 - step) / 900.0) END, 9) AS factor
  FROM (SELECT DISTINCT event_id % 1101 AS step FROM events)"""
)
def lr_schedule(spark, d):
    steps = table(spark, d, "events").select((F.col("event_id") % 1101).alias("step")).distinct()
    return steps.select("step", F.round(audit.warmup_decay(F.col("step"), 100, 1000), 9).alias("factor"))


@query(
    f"""SELECT row_id, list_concat([50258::BIGINT, 50359, 50363], list_concat(list_transform(regexp_split_to_array(t, ''), lambda c: ord(c)::BIGINT), [50257::BIGINT])) AS ids
  FROM (SELECT row_id, {_norm('transcription')} AS t FROM manifest) WHERE length(t) BETWEEN 1 AND 444"""
)
def label_build(spark, d):
    rows = table(spark, d, "manifest").select("row_id", tx.normalize_text(F.col("transcription")).alias("t"))
    return rows.select("row_id", vocab.label_ids(F.col("t"), [50258, 50359, 50363], [50257], 448).alias("ids")).where("ids IS NOT NULL")


# ---------------------------------------------------------------- validation

_REASON = f"""CASE WHEN lower(trim(coalesce(regexp_replace(language, '^[{_S}]+|[{_S}]+$', '', 'g'), ''))) NOT IN {_LANGS} THEN 'unsupported language'
  WHEN {_norm('transcription')} = '' THEN 'empty transcription'
  WHEN coalesce(trim(source_id), '') = '' THEN 'source_id is required' WHEN coalesce(trim(audio_path), '') = '' THEN 'audio_path is required'
  WHEN duration <= 0 THEN 'duration must be positive' END"""
_CHECKED = f"""checked AS (SELECT row_id, coalesce(nullif(trim(id), ''), lower(trim(regexp_replace(language, '^[{_S}]+|[{_S}]+$', '', 'g'))) || '-' || substr(sha1(trim(source_id) || chr(0) || trim(audio_path) || chr(0) || {_norm('transcription')}), 1, 16)) AS id,
  source_id, speaker_id, lower(trim(regexp_replace(language, '^[{_S}]+|[{_S}]+$', '', 'g'))) AS language, {_label('subtype')} AS subtype, duration, {_norm('transcription')} AS transcription, {_REASON} AS reason FROM manifest),
  accepted AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS rn FROM checked WHERE reason IS NULL)"""


def _checked(spark, d) -> DataFrame:
    fields = validate.resolve_aliases(table(spark, d, "manifest"), ["row_id"])
    return validate.reject_duplicates(stage(validate.check_records(fields), "records"), "row_id")


@query(
    f"""WITH {_CHECKED} SELECT row_id, reason FROM checked WHERE reason IS NOT NULL
  UNION ALL SELECT row_id, 'duplicate id' FROM accepted WHERE rn > 1"""
)
def canonicalize_rejects(spark, d):
    return _checked(spark, d).where("reason IS NOT NULL").select("row_id", "reason")


@query(f"WITH {_CHECKED} SELECT row_id, id, language, transcription, duration FROM accepted WHERE rn = 1")
def canonical_manifest(spark, d):
    return _checked(spark, d).where("reason IS NULL").select("row_id", "id", "language", "transcription", "duration")


@query(
    f"""WITH {_CHECKED}, r AS (SELECT reason FROM checked WHERE reason IS NOT NULL UNION ALL SELECT 'duplicate id' FROM accepted WHERE rn > 1)
  SELECT reason, count(*) AS dropped FROM r GROUP BY reason"""
)
def drop_report(spark, d):
    return validate.drop_report(_checked(spark, d), F.col("reason"))


@query(
    f"""WITH {_CLIPS} SELECT row_id, CASE WHEN duration IS NULL THEN 'unreadable audio' WHEN duration < 1 THEN 'too short' WHEN duration > 60 THEN 'too long' END AS reason
  FROM clips WHERE duration IS NULL OR duration < 1 OR duration > 60"""
)
def audio_limits(spark, d):
    return validate.within_limits(clips(spark, d), 1.0, 60.0).where("reason IS NOT NULL").select("row_id", "reason")


@query(f"WITH {_CLIPS} SELECT row_id, language, duration FROM clips WHERE split = 'train' AND duration <= 30")
def seed_filter(spark, d):
    return select.seed_rows(clips(spark, d), "train", 30.0).select("row_id", "language", "duration")


@query(f"WITH {_CLIPS} SELECT row_id, language, duration FROM clips WHERE split = 'train' AND subtype = 'unscripted' AND duration > 30 AND duration <= 120")
def pilot_filter(spark, d):
    return select.pilot_rows(clips(spark, d), 30.0, 120.0).select("row_id", "language", "duration")


@query(
    f"""WITH {_CLIPS} SELECT row_id, list_filter([CASE WHEN duration < 5 THEN 'short' END, CASE WHEN duration > 60 THEN 'long' END, CASE WHEN speaker_id IS NULL THEN 'no_speaker' END,
  CASE WHEN split = 'unknown' THEN 'no_split' END], lambda x: x IS NOT NULL) AS reasons FROM clips"""
)
def reject_reasons(spark, d):
    c = F.col
    checks = {"short": c("duration") < 5, "long": c("duration") > 60, "no_speaker": c("speaker_id").isNull(), "no_split": c("split") == "unknown"}
    return clips(spark, d).select("row_id", validate.failing_reasons(checks).alias("reasons"))


@query(
    f"""SELECT row_id, len({_WORDS})::BIGINT AS n_labels FROM manifest WHERE len({_WORDS}) > 24"""
)
def overlong_labels(spark, d):
    rows = table(spark, d, "manifest").select("row_id", F.size(tx.words(tx.normalize_text(F.col("transcription")))).cast("long").alias("n_labels"))
    return rows.where("n_labels > 24")


@query(
    f"""WITH {_CLIPS}, want AS (SELECT id::VARCHAR AS id, language FROM clips WHERE id IS NOT NULL),
  have AS (SELECT id, language, transcription FROM clips WHERE id IS NOT NULL AND split <> 'unknown')
  SELECT * FROM (
  SELECT 1::BIGINT AS check_no, 'duplicate submission id' AS problem, (SELECT count(*) FROM (SELECT id FROM have GROUP BY id HAVING count(*) > 1)) AS n_rows
  UNION ALL SELECT 2, 'duplicate expected id', (SELECT count(*) FROM (SELECT id FROM want GROUP BY id HAVING count(*) > 1))
  UNION ALL SELECT 3, 'missing id and language', (SELECT count(*) FROM (SELECT id, language FROM want EXCEPT SELECT id, language FROM have))
  UNION ALL SELECT 4, 'unexpected id and language', (SELECT count(*) FROM (SELECT id, language FROM have EXCEPT SELECT id, language FROM want))
  UNION ALL SELECT 5, 'unsupported language', (SELECT count(*) FROM have WHERE language NOT IN {_LANGS})
  UNION ALL SELECT 6, 'empty transcription', (SELECT count(*) FROM have WHERE coalesce({_squeeze('transcription')}, '') = '')) WHERE n_rows > 0"""
)
def submission_checks(spark, d):
    rows = clips(spark, d).where("id IS NOT NULL")
    return validate.submission_problems(rows.where("split <> 'unknown'").select("id", "language", "transcription"), rows.select("id", "language"))


@query(
    f"""WITH {_CLIPS} SELECT language, round(avg(CASE WHEN coalesce({_squeeze('transcription')}, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS blank_share,
  avg(CASE WHEN coalesce({_squeeze('transcription')}, '') = '' THEN 1.0 ELSE 0.0 END) > 0.5 AS discard FROM clips GROUP BY language"""
)
def blank_share(spark, d):
    blank = F.avg(F.when(tx.present(F.col("transcription")).isNull(), 1.0).otherwise(0.0))
    return clips(spark, d).groupBy("language").agg(F.round(blank, 6).alias("blank_share"), (blank > 0.5).alias("discard"))


# ---------------------------------------------------------------- lookups and set operations


@query(
    """WITH texts AS (SELECT row_id, transcription, regexp_replace(regexp_extract(audio_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, audio_path FROM manifest WHERE audio_path IS NOT NULL),
  keyed AS (SELECT stem AS k, row_id, transcription FROM texts UNION ALL SELECT audio_path, row_id, transcription FROM texts),
  known AS (SELECT k, arg_max({'t': transcription}, row_id).t AS t FROM keyed GROUP BY k),
  members AS (SELECT DISTINCT audio_path AS member FROM manifest WHERE audio_path IS NOT NULL)
  SELECT m.member, coalesce(a.t, b.t) AS transcription FROM members m
  LEFT JOIN known a ON a.k = regexp_replace(regexp_extract(m.member, '[^/]*$'), '(.)\\.[^.]*$', '\\1') LEFT JOIN known b ON b.k = m.member WHERE coalesce(a.t, b.t) IS NOT NULL"""
)
def two_tier_lookup(spark, d):
    m = table(spark, d, "manifest")
    members = m.where("audio_path IS NOT NULL").select(F.col("audio_path").alias("member")).distinct()
    return lookup.two_tier(members, m.select("audio_path", "row_id", "transcription"), "member", "audio_path", "row_id", "transcription")


_SHARD = r"regexp_replace(trim(regexp_replace(lower(source_shard), '\\', '/', 'g')), '(^|/)(\./|/)+', '\1', 'g')"


@query(
    f"""SELECT row_id, id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM manifest x WHERE x.id = m.id AND lower(trim(x.split)) = 'test')"""
)
def resume_anti(spark, d):
    m = table(spark, d, "manifest")
    return not_done(m.select("row_id", "id"), m.where("lower(trim(split)) = 'test'").select("id"), "id")


@query(
    f"""WITH {_CLIPS} SELECT count(*) AS leaking_sources FROM (SELECT language, source_id FROM clips WHERE split = 'train' AND source_id IS NOT NULL
  INTERSECT SELECT language, source_id FROM clips WHERE split IN ('validation', 'test'))"""
)
def leakage_semi(spark, d):
    c = clips(spark, d)
    return gate.leaking_sources(c.where("split = 'train' AND source_id IS NOT NULL"), c.where("split IN ('validation', 'test')"))


@query(
    f"""WITH {_CLIPS}, a AS (SELECT DISTINCT id, language FROM clips WHERE split = 'train' AND id IS NOT NULL), b AS (SELECT DISTINCT id, language FROM clips WHERE split <> 'train' AND id IS NOT NULL)
  SELECT id, language, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, language, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def id_set_diff(spark, d):
    c = clips(spark, d).where("id IS NOT NULL")
    return lookup.difference(c.where("split = 'train'"), c.where("split <> 'train'"), ["id", "language"])


@query(
    f"""WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array({_norm('transcription')}, '')) AS s FROM manifest WHERE {_label('split')} = 'train'),
  c AS (SELECT row_id, unnest(list_distinct(regexp_split_to_array({_norm('transcription')}, ''))) AS symbol FROM manifest WHERE {_label('split')} <> 'train')
  SELECT symbol, count(*) AS n_rows FROM c WHERE symbol NOT IN ('', ' ') AND symbol NOT IN (SELECT s FROM v) GROUP BY symbol"""
)
def unknown_characters(spark, d):
    rows = clips(spark, d).select("split", tx.normalize_text(F.col("transcription")).alias("t"))
    known = vocab.characters(rows.where("split = 'train'"), "t")
    return vocab.unknown_characters(rows.where("split <> 'train'"), "t", known)


@query(
    f"""WITH {_CLIPS}, a AS (SELECT source_shard, row_id, row_number() OVER (PARTITION BY source_shard ORDER BY row_id) - 1 AS place FROM clips WHERE split = 'train' AND source_shard IS NOT NULL),
  b AS (SELECT source_shard, row_id, row_number() OVER (PARTITION BY source_shard ORDER BY row_id) - 1 AS place FROM clips WHERE split = 'test' AND source_shard IS NOT NULL)
  SELECT a.source_shard, a.place, a.row_id AS train_row, b.row_id AS test_row FROM a JOIN b USING (source_shard, place)"""
)
def rank_zip(spark, d):
    c = clips(spark, d).where("source_shard IS NOT NULL")
    a = c.where("split = 'train'").select("source_shard", "row_id", F.col("row_id").alias("train_row"))
    b = c.where("split = 'test'").select("source_shard", "row_id", F.col("row_id").alias("test_row"))
    return lookup.rank_zip(a, b, "source_shard", "row_id", "train_row", "test_row")


@query(f"WITH {_CLIPS} SELECT language FROM (VALUES ('swa'),('som'),('kik'),('luo'),('mas'),('kln'),('xyz')) t(language) EXCEPT SELECT language FROM clips WHERE split = 'train'")
def missing_languages(spark, d):
    return gate.missing_languages(clips(spark, d).where("split = 'train'"), (*validate.LANGUAGES, "xyz"))


@query(
    f"""WITH {_CLIPS} SELECT row_id AS key, language, 'manifest' AS origin, split FROM clips
  UNION ALL SELECT doc_id, {_label('lang')}, 'documents', NULL FROM documents"""
)
def combined_rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), label("lang").alias("language"), F.lit("documents").alias("origin"))
    own = clips(spark, d).select(F.col("row_id").alias("key"), "language", F.lit("manifest").alias("origin"), "split")
    return own.unionByName(docs, allowMissingColumns=True)


@query("SELECT DISTINCT source_shard, source_repo FROM manifest")
def distinct_sources(spark, d):
    return table(spark, d, "manifest").select("source_shard", "source_repo").distinct()


@query(
    f"""WITH {_CLIPS} SELECT dataset AS repo, list_sort(list_filter(['scripted','studio','unscripted'], lambda x: NOT list_contains(list(DISTINCT subtype), x))) AS missing,
  list_has_any(list(DISTINCT subtype), ['scripted','other']) AS has_any FROM clips GROUP BY dataset"""
)
def repository_gaps(spark, d):
    files = clips(spark, d).select(F.col("dataset").alias("repo"), F.col("subtype").alias("name"))
    return lookup.repository_gaps(files, ["scripted", "unscripted", "studio"], ["scripted", "other"])


# ---------------------------------------------------------------- aggregation


@query(f"WITH {_CLIPS} SELECT split, language, subtype, count(*) AS n_rows FROM clips GROUP BY ALL")
def split_counts(spark, d):
    return splits.split_counts(clips(spark, d))


@query(
    f"""WITH {_CLIPS} SELECT split, language, round(sum(duration) / 3600, 3) AS hours, count(*) FILTER (duration IS NULL) AS unknown_rows FROM clips GROUP BY ALL HAVING count(duration) > 0"""
)
def split_hours(spark, d):
    return splits.split_hours(clips(spark, d))


@query(
    f"""WITH {_CLIPS} SELECT language, round(coalesce(h, 0), 6) AS hours FROM (VALUES ('swa'),('som'),('kik'),('luo'),('mas'),('kln')) t(language)
  LEFT JOIN (SELECT language, sum(duration) / 3600 AS h FROM clips WHERE split = 'test' GROUP BY language) USING (language)"""
)
def language_hours(spark, d):
    return gate.hours_by_language(clips(spark, d).where("split = 'test'")).select("language", F.round("hours", 6).alias("hours"))


_GROUP = "language || chr(0) || coalesce('speaker:' || nullif(speaker_id, ''), 'source:' || coalesce(source_id, 'None'))"


@query(f"WITH {_CLIPS} SELECT {_GROUP} AS \"group\", count(DISTINCT split) AS splits FROM clips GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_leakage(spark, d):
    rows = clips(spark, d).withColumn("group", splits.group_key(F.col("language"), F.col("speaker_id"), F.col("source_id")))
    return splits.leaking_groups(rows, split="split")


@query(f"WITH {_CLIPS} SELECT dataset, count(*) AS n_rows, count(DISTINCT language) AS languages FROM clips GROUP BY dataset")
def dataset_counts(spark, d):
    return clips(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("language").alias("languages"))


@query(
    f"""WITH c AS (SELECT DISTINCT unnest(regexp_split_to_array({_norm('transcription')}, '')) AS symbol FROM manifest WHERE {_label('split')} = 'train')
  SELECT symbol, row_number() OVER (ORDER BY encode(symbol)) + 2 AS id FROM c WHERE symbol NOT IN ('', ' ', '|', '<pad>', '<unk>')
  UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('|', 2))"""
)
def vocabulary(spark, d):
    rows = clips(spark, d).where("split = 'train'").select(tx.normalize_text(F.col("transcription")).alias("t"))
    return vocab.shared_vocabulary(rows, "t")


@query(
    f"""WITH c AS (SELECT DISTINCT replace(unnest(regexp_split_to_array({_plain('transcription')}, '')), ' ', '|') AS symbol FROM manifest), k AS (SELECT symbol FROM c WHERE symbol <> '')
  SELECT symbol, row_number() OVER (ORDER BY encode(symbol)) - 1 AS id FROM k UNION ALL SELECT '[UNK]', (SELECT count(*) FROM k) UNION ALL SELECT '[PAD]', (SELECT count(*) + 1 FROM k)"""
)
def vocabulary_plain(spark, d):
    rows = table(spark, d, "manifest").select(tx.normalize_plain(F.col("transcription")).alias("t"))
    return vocab.plain_vocabulary(rows, "t")


_PROFILE = f"""{_CLIPS}, profile AS (SELECT language, subtype, source_shard, count(*) AS n_rows, count(duration) AS known, count(*) - count(duration) AS unknown, avg(duration) AS mean_sec,
  quantile_cont(duration, 0.5) AS p50_sec, quantile_cont(duration, 0.75) AS p75_sec, quantile_cont(duration, 0.9) AS p90_sec, quantile_cont(duration, 0.95) AS p95_sec,
  avg((duration > 30)::INT) * 100 AS over_30s_pct, avg((duration > 45)::INT) * 100 AS over_45s_pct, avg((duration > 60)::INT) * 100 AS over_60s_pct
  FROM clips WHERE source_shard IS NOT NULL GROUP BY ALL HAVING count(duration) > 0)"""
_FIGURES = ("mean_sec", "p50_sec", "p75_sec", "p90_sec", "p95_sec", "over_30s_pct", "over_45s_pct", "over_60s_pct")


@query(f"WITH {_PROFILE} SELECT language, subtype, source_shard, n_rows, known, unknown, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)} FROM profile")
def duration_audit(spark, d):
    rows = clips(spark, d).where("source_shard IS NOT NULL")
    out = audit.shard_profile(rows, ["language", "subtype", "source_shard"], "duration")
    return out.select("language", "subtype", "source_shard", "n_rows", "known", "unknown", *[F.round(c, 6).alias(c) for c in _FIGURES])


_MEANS = ("mean_sec", "p90_sec", "over_30s_pct", "over_45s_pct", "over_60s_pct")


@query(
    f"""WITH {_PROFILE} SELECT language, subtype, count(*) AS shards, sum(n_rows)::BIGINT AS n_rows, sum(known)::BIGINT AS known, sum(unknown)::BIGINT AS unknown,
  {', '.join(f'round(avg({c}), 6) AS {c}' for c in _MEANS)} FROM profile GROUP BY language, subtype"""
)
def duration_audit_rollup(spark, d):
    rows = clips(spark, d).where("source_shard IS NOT NULL")
    out = audit.bucket_profile(audit.shard_profile(rows, ["language", "subtype", "source_shard"], "duration"), ["language", "subtype"])
    return out.select("language", "subtype", "shards", "n_rows", "known", "unknown", *[F.round(c, 6).alias(c) for c in _MEANS])


@query(
    f"""SELECT lang AS language, subtype, count(*) AS shards, sum(row_count)::BIGINT AS n_rows, round(avg(mean_sec), 6) AS mean_sec, round(avg(p90_sec), 6) AS p90_sec FROM duration_audit GROUP BY ALL"""
)
def audit_table_rollup(spark, d):
    a = table(spark, d, "duration_audit")
    return a.groupBy(F.col("lang").alias("language"), "subtype").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("row_count").alias("n_rows"), F.round(F.avg("mean_sec"), 6).alias("mean_sec"), F.round(F.avg("p90_sec"), 6).alias("p90_sec")
    )


@query(
    """SELECT 'dialect' AS "column", dialect AS value, count(*) AS n_rows FROM manifest GROUP BY dialect ORDER BY n_rows DESC, value ASC NULLS FIRST LIMIT 8"""
)
def top_dialects(spark, d):
    return audit.top_values(table(spark, d, "manifest"), "dialect", 8)


@query(
    """WITH v AS (SELECT CASE WHEN isfinite(duration) THEN duration END AS v FROM manifest)
  SELECT 'duration' AS "column", count(v) AS known, round(avg(v) * count(*) / 3600, 6) AS hours, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM v"""
)
def column_hours(spark, d):
    out = audit.column_hours(table(spark, d, "manifest"))
    return out.select("column", "known", F.round("hours", 6).alias("hours"), F.round("mean", 6).alias("mean"), "least", "most")


@query(
    f"""WITH {_CLIPS} SELECT language, count(duration) AS known, round(avg(duration), 6) AS mean_sec, round(quantile_cont(duration, 0.5), 6) AS median_sec, round(sum(duration), 4) AS total_sec,
  round(avg(CASE WHEN duration < 10 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_under_10s, round(avg(CASE WHEN duration > 20 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_over_20s FROM clips GROUP BY language"""
)
def duration_probe(spark, d):
    out = audit.duration_probe(clips(spark, d), "language", "duration")
    return out.select("language", "known", F.round("mean_sec", 6).alias("mean_sec"), F.round("median_sec", 6).alias("median_sec"), F.round("total_sec", 4).alias("total_sec"),
                      F.round("pct_under_10s", 6).alias("pct_under_10s"), F.round("pct_over_20s", 6).alias("pct_over_20s"))


@query(f"WITH {_CLIPS} SELECT language, count(*) AS n_rows FROM clips GROUP BY language")
def language_counts(spark, d):
    return clips(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "language")


# ---------------------------------------------------------------- error rates

_HYP = "array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i % 7 <> 0), lambda i: CASE WHEN i % 5 = 0 THEN 'x' || w[i] ELSE w[i] END), ' ')"


def _pairs(spark, d) -> DataFrame:
    """References and hypotheses: every seventh word is missing and every fifth is wrong."""
    w = tx.words(tx.normalize_text(F.col("transcription")))
    kept = F.filter(F.transform(F.col("w"), lambda x, i: F.when((i + 1) % 7 != 0, F.when((i + 1) % 5 == 0, F.concat(F.lit("x"), x)).otherwise(x))), lambda x: x.isNotNull())
    rows = clips(spark, d).select("row_id", "language", w.alias("w"))
    pairs = rows.select("row_id", "language", F.array_join("w", " ").alias("r"), F.array_join(kept, " ").alias("h"))
    return metrics.edit_counts(pairs, F.col("r"), F.col("h"), ["row_id", "language"])


_DISTANCE = f"""{_CLIPS}, p AS (SELECT row_id, language, {_WORDS} AS w FROM clips), q AS (SELECT row_id, language, w, list_filter(regexp_split_to_array({_HYP}, ' '), lambda x: x <> '') AS h FROM p),
  e AS (SELECT row_id, language, len(w)::BIGINT AS ref_words,
    CASE WHEN len(w) = 0 THEN len(h) ELSE list_last(list_reduce(w, lambda r, x: list_reduce(range(1, len(h) + 1), lambda a, j: list_append(a, least(a[j] + 1, r[j + 1] + 1, r[j] + (h[j] <> x)::BIGINT)), [r[1] + 1]), range(0, len(h) + 1))) END::BIGINT AS word_edits FROM q)"""


@query(f"WITH {_DISTANCE} SELECT row_id, word_edits, ref_words FROM e")
def word_edit_distance(spark, d):
    return _pairs(spark, d).select("row_id", "word_edits", "ref_words")


@query(f"WITH {_DISTANCE} SELECT coalesce(language, 'all') AS language, round(sum(word_edits) / nullif(sum(ref_words), 0), 4) AS wer FROM e GROUP BY ROLLUP (language)")
def wer_pooled(spark, d):
    return metrics.rates_with_total(_pairs(spark, d), "language")


@query(
    f"""WITH {_DISTANCE} SELECT round(avg(wer), 6) AS macro_wer, count(*) AS languages, 6::BIGINT AS wanted
  FROM (SELECT language, sum(word_edits) / sum(ref_words) AS wer FROM e WHERE language IN {_LANGS} GROUP BY language)"""
)
def wer_macro(spark, d):
    return metrics.macro_rate(_pairs(spark, d), "language", validate.LANGUAGES)


# The SQL function counts bytes, so each row's further letters stand as single bytes that its text does not hold.
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^`{|}~"
_EDITS = f"""{_DISTANCE}, x AS (SELECT row_id, array_to_string(w, ' ') AS r, {_HYP} AS h FROM p),
  y AS (SELECT *, array_to_string(list_distinct(list_filter(regexp_split_to_array(r, ''), lambda c: c <> '' AND ord(c) > 127)), '') AS far FROM x),
  z AS (SELECT row_id, length(r) AS ref_chars, levenshtein(translate(r, far, substr('{_BYTES}', 1, length(far))), translate(h, far, substr('{_BYTES}', 1, length(far)))) AS char_edits FROM y)"""


@query(
    f"""WITH {_EDITS} SELECT language, sum(ref_words)::BIGINT AS ref_words, round(sum(word_edits) / nullif(sum(ref_words), 0), 4) AS wer, round(sum(char_edits) / nullif(sum(ref_chars), 0), 4) AS cer
  FROM e JOIN z USING (row_id) GROUP BY language"""
)
def cer_by_language(spark, d):
    return metrics.error_rates(_pairs(spark, d), ["language"])


# ---------------------------------------------------------------- gate


def _gate_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    c = clips(spark, d)
    rates = c.groupBy("language").agg(F.avg(F.when(F.col("duration") > 30, 1.0).otherwise(0.0)).alias("clean"), F.avg(F.when(F.col("duration") > 40, 1.0).otherwise(0.0)).alias("aligned"))
    return rates, gate.hours_by_language(c.where("split = 'test'"))


@query(
    f"""WITH {_CLIPS}, t AS (SELECT * FROM (VALUES ('swa',0),('som',1),('kik',2),('luo',3),('mas',4),('kln',5)) t(language, place)),
  r AS (SELECT language, avg(CASE WHEN duration > 30 THEN 1.0 ELSE 0.0 END) AS clean, avg(CASE WHEN duration > 40 THEN 1.0 ELSE 0.0 END) AS aligned FROM clips GROUP BY language),
  h AS (SELECT language, sum(duration) / 3600 AS hours FROM clips WHERE split = 'test' GROUP BY language),
  o AS (SELECT place, language, clean, aligned, clean - aligned AS gain, coalesce(hours, 0) AS hours FROM t LEFT JOIN r USING (language) LEFT JOIN h USING (language)),
  a AS (SELECT avg(clean) AS clean_macro, avg(aligned) AS aligned_macro, count(*) FILTER (gain > 0) AS languages_improved,
    string_agg(language, ',' ORDER BY place) FILTER (hours < 1) AS few, string_agg(language, ',' ORDER BY place) FILTER (gain < -0.03) AS worse FROM o)
  SELECT len(reasons) = 0 AS proceed, reasons, round(clean_macro, 9) AS clean_macro, round(aligned_macro, 9) AS aligned_macro, round(clean_macro - aligned_macro, 9) AS macro_gain, languages_improved
  FROM (SELECT *, list_filter(['insufficient_aligned_hours:' || few, CASE WHEN clean_macro - aligned_macro < 0.02 THEN 'macro_wer_improvement_below_threshold' END,
    CASE WHEN languages_improved < 4 THEN 'too_few_languages_improved' END, 'excessive_language_regression:' || worse], lambda x: x IS NOT NULL) AS reasons FROM a)"""
)
def gate_report(spark, d):
    out = gate.evaluate_gate(*_gate_inputs(spark, d))
    return out.select("proceed", "reasons", *[F.round(c, 9).alias(c) for c in ("clean_macro", "aligned_macro", "macro_gain")], "languages_improved")


@query(
    """SELECT event_type AS name, round(v, 9) AS macro_wer FROM (SELECT event_type, avg(value) AS v FROM events GROUP BY event_type) ORDER BY v, event_type LIMIT 1"""
)
def lower_macro(spark, d):
    own = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("macro_wer"))
    return gate.lower_macro(own.select(F.col("event_type").alias("name"), F.col("event_type").alias("place"), "macro_wer")).select("name", F.round("macro_wer", 9).alias("macro_wer"))


@query(
    f"""WITH {_CLIPS} SELECT language, count(DISTINCT source_id) AS sources, count(*) FILTER (ok) AS accepted_segments, round(coalesce(sum(duration) FILTER (ok), 0) / 3600, 6) AS accepted_hours,
  count(*) FILTER (NOT ok) AS rejected_segments FROM (SELECT *, coalesce(duration BETWEEN 2 AND 60, false) AS ok FROM clips) GROUP BY language"""
)
def alignment_counts(spark, d):
    rows = clips(spark, d).withColumn("accepted", F.coalesce(F.col("duration").between(2, 60), F.lit(False)))
    return gate.alignment_counts(rows).withColumn("accepted_hours", F.round("accepted_hours", 6))


_RUNS = "runs AS (SELECT event_type AS run, date_trunc('day', ts) AS step, avg(value) AS loss FROM events GROUP BY ALL)"


def _runs(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").alias("step")).agg(F.avg("value").alias("loss"))


@query(
    f"""WITH {_RUNS}, b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM runs),
  i AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY step) AS island FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS since_best FROM i)
  SELECT run, step, improved, since_best, since_best >= 4 AS stop FROM n"""
)
def early_stop(spark, d):
    return audit.best_so_far(_runs(spark, d), "run", "step", "loss", 4).select("run", "step", "improved", "since_best", "stop")


@query(f"WITH {_RUNS} SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM runs")
def moving_avg_loss(spark, d):
    return audit.moving_mean(_runs(spark, d), "run", "step", "loss", 25).select("run", "step", F.round("moving_mean", 6).alias("moving_mean"))


# ---------------------------------------------------------------- splits, ranks, samples

_SPLIT = f"""{_CLIPS}, g AS (SELECT DISTINCT language, {_GROUP} AS "group" FROM clips), k AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY sha256('42' || chr(0) || "group"), "group") AS place,
  count(*) OVER (PARTITION BY language) AS size FROM g), s AS (SELECT language, "group", CASE WHEN place <= least(greatest(1, round_even(size * 0.1, 0)), size - 1) THEN 'validation' ELSE 'train' END AS new_split FROM k)"""


@query(f"WITH {_SPLIT} SELECT row_id, new_split FROM clips c JOIN s ON s.language = c.language AND s.\"group\" = {_GROUP.replace('language', 'c.language', 1)}")
def grouped_split(spark, d):
    return splits.grouped_split(clips(spark, d)).select("row_id", "new_split")


@query(f"WITH {_SPLIT} SELECT new_split AS split, c.language, subtype, count(*) AS n_rows FROM clips c JOIN s ON s.language = c.language AND s.\"group\" = {_GROUP.replace('language', 'c.language', 1)} GROUP BY ALL")
def split_report(spark, d):
    rows = splits.grouped_split(clips(spark, d)).withColumn("split", F.col("new_split"))
    return splits.split_counts(rows)


_HASH = "sha256('{seed}' || chr(0) || row_id)"


@query(
    f"""WITH {_CLIPS}, k AS (SELECT row_id, language, subtype, row_number() OVER (PARTITION BY language, subtype ORDER BY {_HASH.format(seed='strata')}, row_id) AS place, count(*) OVER (PARTITION BY language, subtype) AS size FROM clips)
  SELECT row_id, language, subtype, CASE WHEN place <= greatest(1, round_even(size * 0.05, 0)) THEN 'eval' ELSE 'train' END AS new_split FROM k"""
)
def stratified_split(spark, d):
    return splits.stratified_split(clips(spark, d).withColumn("row_id", F.col("row_id").cast("string")), "row_id", ["language", "subtype"], 0.05).withColumn("row_id", F.col("row_id").cast("long"))


@query(
    f"""WITH {_CLIPS}, k AS (SELECT row_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH.format(seed='floor')}, row_id) AS place, count(*) OVER (PARTITION BY dataset) AS size FROM clips)
  SELECT row_id, dataset, CASE WHEN place <= floor(size * 0.95) THEN 'train' ELSE 'eval' END AS new_split FROM k"""
)
def floor_split(spark, d):
    return splits.floor_split(clips(spark, d).withColumn("row_id", F.col("row_id").cast("string")), "row_id", ["dataset"]).withColumn("row_id", F.col("row_id").cast("long"))


@query(f"WITH {_CLIPS} SELECT row_id, language FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY id NULLS FIRST, row_id) AS rn FROM clips WHERE split = 'train' AND duration <= 30) WHERE rn <= 20")
def topk_per_language(spark, d):
    return select.seed_rows(clips(spark, d), "train", 30.0, 20).select("row_id", "language")


@query(
    f"""WITH {_CLIPS}, b AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY language ORDER BY source_shard, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM clips WHERE split = 'train' AND duration IS NOT NULL AND source_shard IS NOT NULL) SELECT row_id, language FROM b WHERE before < 7200.0005"""
)
def budget_prefix(spark, d):
    rows = clips(spark, d).where("split = 'train' AND duration IS NOT NULL AND source_shard IS NOT NULL").select("row_id", "language", "source_shard", "duration")
    return select.budget_prefix(rows, ["language"], ["source_shard", "row_id"], "duration", 7200.0005).select("row_id", "language")


@query(
    f"""WITH {_CLIPS}, s AS (SELECT DISTINCT language, subtype, source_shard FROM clips WHERE source_shard IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY language, subtype ORDER BY source_shard) - 1 AS i, count(*) OVER (PARTITION BY language, subtype) AS n FROM s)
  SELECT language, subtype, source_shard FROM k WHERE list_contains(list_transform(range(0, least(6, n)), lambda j: round_even(j * ((n - 1) / greatest(least(6, n) - 1, 1)), 0)::BIGINT), i)"""
)
def spread_sample(spark, d):
    shards = clips(spark, d).where("source_shard IS NOT NULL").select("language", "subtype", "source_shard").distinct()
    return select.spread_sample(shards, ["language", "subtype"], "source_shard", 6)


@query(
    f"""WITH s AS (SELECT DISTINCT source_shard AS path FROM manifest), p AS (SELECT path, string_split(path, '/') AS x FROM s),
  k AS (SELECT x[1] AS language, x[3] AS subtype, path FROM p WHERE path LIKE '%.parquet' AND len(x) >= 4 AND x[1] IN {_LANGS} AND x[2] = 'train' AND x[3] IN ('scripted', 'unscripted'))
  SELECT language, subtype, path FROM (SELECT *, row_number() OVER (PARTITION BY language, subtype ORDER BY path) AS rn FROM k) WHERE rn <= 10"""
)
def first_shards(spark, d):
    paths = table(spark, d, "manifest").select(F.col("source_shard").alias("path")).distinct()
    return validate.first_of_each(select.listed_shards(paths, validate.LANGUAGES, "train", ["scripted", "unscripted"]), ["language", "subtype"], ["path"], 10)


@query(f"WITH {_CLIPS} SELECT language, count(*) AS n_rows, round(sum(duration) / 3600, 6) AS hours, round(sqrt(sum(duration) / 3600) / count(*), 9) AS weight FROM clips WHERE split = 'train' AND duration IS NOT NULL GROUP BY language")
def balance_weights(spark, d):
    rows = clips(spark, d).where("split = 'train' AND duration IS NOT NULL")
    return select.balance_weights(rows).select("language", "n_rows", F.round("hours", 6).alias("hours"), F.round("weight", 9).alias("weight"))


@query(
    f"""WITH {_CLIPS}, r AS (SELECT row_id, language, duration FROM clips WHERE split = 'train' AND duration IS NOT NULL AND language IN {_LANGS}),
  w AS (SELECT language, count(*) AS n_rows, sqrt(sum(duration) / 3600) AS mass FROM r GROUP BY language),
  h AS (SELECT *, sum(mass) OVER (ORDER BY language) / sum(mass) OVER () AS hi FROM w), s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY language), 0) AS lo FROM h),
  d AS (SELECT i AS draw, ('0x' || substr(sha256('3-0' || chr(0) || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u, ('0x' || substr(sha256('3-1' || chr(0) || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS v
    FROM range(0, (SELECT count(*) FROM r)) t(i)),
  p AS (SELECT draw, language, floor(v * n_rows)::BIGINT + 1 AS place FROM d JOIN s ON u >= lo AND u < hi), k AS (SELECT row_id, language, row_number() OVER (PARTITION BY language ORDER BY row_id) AS place FROM r)
  SELECT language, row_id, count(*) AS draws FROM p JOIN k USING (language, place) GROUP BY ALL"""
)
def balanced_draws(spark, d):
    rows = clips(spark, d).where(F.col("split").eqNullSafe("train") & F.col("duration").isNotNull() & F.col("language").isin(*validate.LANGUAGES))
    weights = stage(select.balance_weights(rows), "weights")
    return select.weighted_draws(rows, weights, "row_id", rows.count()).groupBy("language", "row_id").agg(F.count(F.lit(1)).alias("draws"))


@query(
    f"""WITH {_CLIPS}, r AS (SELECT row_id, language, subtype, duration > 30 AS bonus, row_number() OVER (PARTITION BY language, subtype ORDER BY source_shard, row_id) AS p,
    row_number() OVER (PARTITION BY language, subtype, duration > 30 ORDER BY source_shard, row_id) AS x FROM clips WHERE duration IS NOT NULL AND source_shard IS NOT NULL)
  SELECT row_id, (p <= 40)::BIGINT + 2 * (p <= 20)::BIGINT + (bonus AND x <= 15)::BIGINT AS uses FROM r WHERE (p <= 40)::BIGINT + 2 * (p <= 20)::BIGINT + (bonus AND x <= 15)::BIGINT > 0"""
)
def quota_harvest(spark, d):
    rows = clips(spark, d).where("duration IS NOT NULL AND source_shard IS NOT NULL").select("row_id", "language", "subtype", "source_shard", "duration")
    return select.quota_harvest(rows, ["language", "subtype"], ["source_shard", "row_id"], 40, 2, F.col("duration") > 30, 15).select("row_id", "uses")


# ---------------------------------------------------------------- segments


@query(
    f"""WITH w AS (SELECT row_id, {_WORDS} AS w FROM manifest)
  SELECT row_id, CASE WHEN len(w) >= 12 THEN list_transform(range(0, 4), lambda i: CASE WHEN round_even((i + 1) * len(w) / 4, 0) - round_even(i * len(w) / 4, 0) >= 3
    THEN array_to_string(list_slice(w, round_even(i * len(w) / 4, 0)::BIGINT + 1, round_even((i + 1) * len(w) / 4, 0)::BIGINT), ' ') ELSE '' END) ELSE [] END AS slices FROM w"""
)
def proportional_words(spark, d):
    rows = table(spark, d, "manifest").select("row_id", tx.words(tx.normalize_text(F.col("transcription"))).alias("w"))
    return rows.select("row_id", segment.word_slices(F.col("w"), F.lit(4)).alias("slices"))


_LONG = f"""{_CLIPS}, s AS (SELECT row_id, least(ceil(duration / 25), 8)::BIGINT AS n, floor(duration * 16000)::BIGINT AS samples, {_WORDS} AS w FROM clips WHERE duration > 30 AND duration <= 180)"""


@query(
    f"""WITH {_LONG} SELECT row_id, i AS segment, round_even(i * (samples / 16000.0::DOUBLE) / n * 16000, 0)::BIGINT AS first_sample,
  least(samples, round_even((i + 1) * (samples / 16000.0::DOUBLE) / n * 16000, 0)::BIGINT) AS last_sample FROM s, LATERAL (SELECT unnest(range(0, n)) AS i) WHERE samples / 16000.0::DOUBLE / n >= 4"""
)
def time_windows(spark, d):
    rows = clips(spark, d).where("duration > 30 AND duration <= 180")
    rows = rows.select("row_id", F.least(F.ceil(F.col("duration") / 25), F.lit(8)).cast("int").alias("n"), F.floor(F.col("duration") * 16000).alias("samples"))
    out = rows.select("row_id", F.posexplode(segment.time_windows(F.col("samples"), F.col("n"))))
    return out.select("row_id", F.col("pos").cast("long").alias("segment"), F.col("col.first").alias("first_sample"), F.col("col.last").alias("last_sample"))


@query(
    f"""WITH {_LONG}, x AS (SELECT row_id, n, samples, w, i FROM s, LATERAL (SELECT unnest(range(0, n)) AS i) WHERE samples / 16000.0::DOUBLE / n >= 4 AND len(w) >= n * 3),
  y AS (SELECT *, round_even(i * len(w) / n, 0)::BIGINT AS a, round_even((i + 1) * len(w) / n, 0)::BIGINT AS b FROM x)
  SELECT row_id, i AS segment, round_even(i * (samples / 16000.0::DOUBLE) / n * 16000, 0)::BIGINT AS first_sample, least(samples, round_even((i + 1) * (samples / 16000.0::DOUBLE) / n * 16000, 0)::BIGINT) AS last_sample,
  array_to_string(list_slice(w, a + 1, b), ' ') AS text FROM y WHERE b - a >= 3"""
)
def segment_rows(spark, d):
    rows = clips(spark, d).select("row_id", "duration", tx.normalize_text(F.col("transcription")).alias("t"))
    return segment.segment_rows(rows, "row_id", "duration", "t")


@query("SELECT vec_id, i AS piece, list_slice(embedding, i * 24 + 1, i * 24 + 24) AS samples FROM embeddings, LATERAL (SELECT unnest(range(0, (len(embedding) + 23) // 24)) AS i)")
def array_chunks(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(segment.chunks(F.col("embedding"), 24)))
    return rows.select("vec_id", F.col("pos").cast("long").alias("piece"), F.col("col").alias("samples"))


@query("SELECT vec_id, len(embedding) / 16.0::DOUBLE AS seconds, CASE WHEN label % 3 = 0 THEN NULL ELSE len(embedding) / 16.0::DOUBLE > 3.5 END AS too_long FROM embeddings")
def array_durations(spark, d):
    seconds = F.size("embedding") / F.lit(16.0)
    return table(spark, d, "embeddings").select("vec_id", seconds.alias("seconds"), F.when(F.col("label") % 3 != 0, seconds > 3.5).alias("too_long"))


@query(
    """WITH f AS (SELECT vec_id, i, sqrt(list_sum(list_transform(list_slice(embedding, i * 4 + 1, i * 4 + 4), lambda x: x::DOUBLE * x::DOUBLE)) / 4) AS r FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding) // 4)) AS i)),
  t AS (SELECT vec_id, least(greatest(quantile_cont(r, 0.1) * 3, max(r) * 0.02), max(r) * 0.5) AS t, max(r) AS peak FROM f GROUP BY vec_id)
  SELECT vec_id, round(CASE WHEN peak <= 1e-8 THEN 0 ELSE avg((r >= t)::INT) END, 6) AS occupancy FROM f JOIN t USING (vec_id) GROUP BY vec_id, peak"""
)
def speech_occupancy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(segment.speech_occupancy(F.col("embedding"), 4), 6).alias("occupancy"))


@query("SELECT vec_id, list_transform(range(0, 8), lambda i: round(vec_id + (i + 0.5) * 2.0 / 8, 6)::DOUBLE) AS times FROM embeddings")
def frame_times(spark, d):
    rows = table(spark, d, "embeddings")
    times = segment.frame_times(F.col("vec_id").cast("double"), F.lit(2.0), F.lit(8))
    return rows.select("vec_id", F.transform(times, lambda t: F.round(t, 6)).alias("times"))


_TOKENS = """tokens AS (SELECT user_id AS utterance, event_id AS place, event_type = 'error' AS delimiter, event_id * 2 AS start_frame, event_id * 2 + 2 AS end_frame, value / 500 AS posterior FROM events)"""


@query(
    f"""WITH {_TOKENS}, g AS (SELECT *, sum(delimiter::INT) OVER (PARTITION BY utterance ORDER BY place) AS gap FROM tokens), i AS (SELECT *, dense_rank() OVER (PARTITION BY utterance ORDER BY gap) - 1 AS word_no FROM g WHERE NOT delimiter)
  SELECT utterance, word_no, arg_min(start_frame, place) AS start_frame, arg_max(end_frame, place) - 1 AS last_frame, round(avg(posterior), 9) AS posterior FROM i GROUP BY ALL"""
)
def word_islands(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("utterance"), F.col("event_id").alias("place"), (F.col("event_type") == "error").alias("delimiter"),
                    (F.col("event_id") * 2).alias("start_frame"), (F.col("event_id") * 2 + 2).alias("end_frame"), (F.col("value") / 500).alias("posterior"))
    out = segment.aligned_words(rows, "utterance", "place", F.col("delimiter"))
    return out.withColumn("posterior", F.round("posterior", 9))


_SPANS = """w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, (event_id / 10.0)::DOUBLE AS s, (event_id / 10.0 + 0.5)::DOUBLE AS e, event_type AS t, value / 500 AS p FROM events),
  seg AS (SELECT user_id, k, s, e, t, p, s AS first, 0 AS segment FROM w WHERE k = 1
    UNION ALL SELECT w.user_id, w.k, w.s, w.e, w.t, w.p, CASE WHEN w.e - seg.first > 60 THEN w.s ELSE seg.first END, seg.segment + (w.e - seg.first > 60)::INT FROM seg JOIN w ON w.user_id = seg.user_id AND w.k = seg.k + 1),
  grp AS (SELECT user_id, segment, greatest(0, min(s) - 0.15) AS start, least(1000, max(e) + 0.15) AS "end", string_agg(t, ' ' ORDER BY k) AS text, avg(p) AS posterior, count(*) AS n_words FROM seg GROUP BY user_id, segment)"""


@query(
    f"""WITH RECURSIVE {_SPANS} SELECT user_id, segment::BIGINT AS segment, round(start, 6) AS start, round("end", 6) AS "end", text, round(posterior, 9) AS posterior, n_words FROM grp WHERE "end" - start >= 1 AND "end" - start <= 60"""
)
def greedy_segments(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", "event_id", (F.col("event_id") / 10).alias("start"), (F.col("event_id") / 10 + 0.5).alias("end"), F.col("event_type").alias("text"), (F.col("value") / 500).alias("posterior"))
    out = segment.padded_segments(rows, "user_id", "event_id", F.lit(1000.0), 1.0, 60.0, 0.15)
    return out.select("user_id", "segment", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", F.round("posterior", 9).alias("posterior"), "n_words")


# ---------------------------------------------------------------- decoding and alignment


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE - list_max(embedding)::DOUBLE - ln(list_sum(list_transform(embedding, lambda y: exp(y::DOUBLE - list_max(embedding)::DOUBLE)))), 6)) AS log_probs FROM embeddings")
def log_softmax(spark, d):
    lp = decode.log_softmax(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(lp, lambda x: F.round(x, 6)).alias("log_probs"))


@query(
    """WITH b AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS s FROM embeddings), p AS (SELECT *, lag(s) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM b)
  SELECT label, list(s::BIGINT ORDER BY vec_id) FILTER (s <> 0 AND s IS DISTINCT FROM before) AS symbols FROM p GROUP BY label"""
)
def ctc_greedy(spark, d):
    out = decode.greedy_ctc(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", F.transform("symbols", lambda s: s.cast("long")).alias("symbols"))


@query(
    f"""WITH {_CLIPS} SELECT source_id, {_squeeze("string_agg(" + _norm('transcription') + ", ' ' ORDER BY row_id)")} AS text FROM clips WHERE source_id IS NOT NULL GROUP BY source_id"""
)
def ordered_concat(spark, d):
    return decode.joined_chunks(clips(spark, d).where("source_id IS NOT NULL"), "source_id", "row_id", "transcription")


@query(
    f"""WITH {_CLIPS}, t AS (SELECT source_id, {_squeeze("string_agg(" + _norm('transcription') + ", ' ' ORDER BY row_id)")} AS text, bool_or(duration IS NULL) AS bad FROM clips WHERE source_id IS NOT NULL GROUP BY source_id)
  SELECT source_id, text FROM t WHERE NOT bad AND text <> ''"""
)
def isolated_results(spark, d):
    c = clips(spark, d).where("source_id IS NOT NULL")
    texts = decode.joined_chunks(c, "source_id", "row_id", "transcription")
    failed = c.where("duration IS NULL").select("source_id", F.lit("no duration").alias("reason"))
    return decode.isolate_failures(texts, failed, "source_id")[0]


@query(
    """WITH f AS (SELECT vec_id, i, list_slice(embedding, i * 8 + 1, i * 8 + 8)::DOUBLE[] AS x FROM embeddings, LATERAL (SELECT unnest(range(0, 8)) AS i)),
  b AS (SELECT vec_id, i, list_position(x, list_max(x)) - 1 AS s, -ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) AS lp FROM f),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY vec_id ORDER BY i) AS run FROM (SELECT *, (s IS DISTINCT FROM lag(s) OVER (PARTITION BY vec_id ORDER BY i))::INT AS fresh FROM b)),
  t AS (SELECT vec_id, run, any_value(s) AS s, min(i) AS a, max(i) + 1 AS z, avg(lp) AS lp FROM r GROUP BY ALL)
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY run) - 1 AS place, s AS token_id, a AS start_frame, z AS end_frame, round(exp(lp), 6) AS posterior FROM t WHERE s <> 0"""
)
def forced_align(spark, d):
    """Alignment of eight frames of eight symbols cut from each vector to the row's own targets, its greedy path; a path of blanks only has no row."""
    rows = table(spark, d, "embeddings").select("vec_id", segment.chunks(F.col("embedding"), 8).alias("scores"))
    rows = rows.select("vec_id", F.transform("scores", decode.log_softmax).alias("emissions"))
    rows = rows.withColumn("best", F.transform("emissions", lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int")))
    path = F.filter(F.transform("best", lambda x, i: F.when((x != 0) & ((i == 0) | (x != F.get("best", i - 1))), x)), lambda x: x.isNotNull())
    out = align_utterances(rows.select("vec_id", "emissions", path.alias("targets")), "vec_id").where("reason IS NULL")
    return out.select("vec_id", "place", "token_id", "start_frame", "end_frame", F.round("posterior", 6).alias("posterior"))


@query(
    f"""SELECT s.source_shard, count(*) AS rows_left FROM manifest s WHERE s.source_shard IS NOT NULL AND s.source_shard NOT IN (SELECT source_shard FROM shard_status WHERE source_shard IS NOT NULL AND status IN ('prepared', 'existing')) GROUP BY s.source_shard"""
)
def unfinished_shards(spark, d):
    done = table(spark, d, "shard_status").where("status IN ('prepared', 'existing')")
    left = not_done(table(spark, d, "manifest").where("source_shard IS NOT NULL"), done, "source_shard")
    return left.groupBy("source_shard").agg(F.count(F.lit(1)).alias("rows_left"))


@query(
    f"""WITH b AS (SELECT row_id, language, transcription FROM manifest WHERE transcription IS NOT NULL), r AS (SELECT row_id, language, transcription, row_number() OVER (ORDER BY transcription, row_id) AS rn FROM b)
  SELECT row_id, rn AS place FROM r WHERE rn <= 100"""
)
def first_rows(spark, d):
    rows = table(spark, d, "manifest").where("transcription IS NOT NULL").orderBy("transcription", "row_id").limit(100)  # a top-k report
    return rows.select("row_id", F.row_number().over(Window.orderBy("transcription", "row_id")).cast("long").alias("place"))


@query(
    f"""WITH {_CLIPS}, v AS (SELECT language, source_shard, count(*) FILTER (duration IS NOT NULL AND {_norm('transcription')} <> '') AS valid_rows FROM clips WHERE source_shard IS NOT NULL GROUP BY ALL),
  b AS (SELECT *, coalesce(sum(valid_rows) OVER (PARTITION BY language ORDER BY source_shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
  SELECT language, source_shard, valid_rows FROM b WHERE before < 250"""
)
def shard_budget(spark, d):
    ok = F.col("duration").isNotNull() & (tx.normalize_text(F.col("transcription")) != "")
    rows = clips(spark, d).withColumn("ok", ok)
    return select.shard_budget(rows, ["language"], "source_shard", F.col("ok"), 250)


@query(f"WITH {_CLIPS} SELECT row_id, CASE language WHEN 'som' THEN 'ckpt-som' WHEN 'mas' THEN 'ckpt-mas' ELSE 'ckpt-all' END AS checkpoint FROM clips")
def language_checkpoint(spark, d):
    return clips(spark, d).select("row_id", select.choose_for(F.col("language"), {"som": "ckpt-som", "mas": "ckpt-mas"}, "ckpt-all").alias("checkpoint"))


@query(f"WITH {_CLIPS} SELECT count(*) AS n_rows FROM clips WHERE language = 'swa' AND subtype = 'scripted' AND dataset LIKE 'voices%'")
def count_matching(spark, d):
    return select.count_matching(clips(spark, d), {"language": "swa", "subtype": "scripted"}, {"dataset": "voices"})


@query(
    f"""WITH w AS (SELECT row_id, row_id // 32 AS batch, list_transform({_WORDS}, lambda x: length(x)::BIGINT) AS ids FROM manifest), m AS (SELECT batch, max(len(ids)) AS width FROM w GROUP BY batch)
  SELECT row_id, list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: -100::BIGINT)) AS labels FROM w JOIN m USING (batch)"""
)
def batch_padding(spark, d):
    """Label lists filled up to the longest of their batch of 32 rows."""
    w = tx.words(tx.normalize_text(F.col("transcription")))
    rows = table(spark, d, "manifest").select("row_id", F.floor(F.col("row_id") / 32).alias("batch"), F.transform(w, lambda x: F.length(x).cast("long")).alias("ids"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    return rows.select("row_id", vocab.padded(F.col("ids"), width, -100).alias("labels"))
