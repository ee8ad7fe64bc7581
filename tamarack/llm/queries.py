"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import table
from . import copies, encoding, grouping, leakage, letters, lookalike, mixing, overlap, percentiles, sampling, sentences


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.clip_percentiles(table(spark, sf_dir, "manifest"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.piece_percentiles(table(spark, sf_dir, "manifest"))


def p1_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.combined_percentiles(table(spark, sf_dir, "manifest"))


def p1_day_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the combinable day pieces: values kept and rows counted."""
    pieces = percentiles.clip_pieces(table(spark, sf_dir, "manifest"))
    return pieces.groupBy("language", "subtype", F.col("piece").alias("day")).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("n_rows")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.all_copy_pairs(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "raw_lines"))


def p2_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.clip_copies(table(spark, sf_dir, "manifest"))


def p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.line_copies(table(spark, sf_dir, "raw_lines"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.all_members(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "raw_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.unmet_targets(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_targets"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.clip_sample(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_targets"))


def p3_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.clip_sample(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_targets"), fill=True)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_report(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "sample_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unmet_sources(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "mix_targets"))


def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.clip_mix(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "mix_targets"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "mix_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.clip_overlaps(table(spark, sf_dir, "manifest"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "manifest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.broken_groups(grouping.clip_components(table(spark, sf_dir, "manifest")))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.clip_components(table(spark, sf_dir, "manifest"))
    return grouping.assign_splits(groups, "row_id", table(spark, sf_dir, "split_targets"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.clip_components(table(spark, sf_dir, "manifest"))
    return grouping.split_report(groups, "row_id", table(spark, sf_dir, "split_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.clip_lookalikes(table(spark, sf_dir, "manifest"))


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.clip_forms(table(spark, sf_dir, "manifest"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.clean_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id")


def p9_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.trimmed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_pieces, p1_percentiles, p1_combined, p1_day_pieces, p2_found, p2_clips, p2_lines, p2_members, p3_found, p3_sample, p3_filled, p3_report, p4_found, p4_mix,
        p4_report, p5_found, p5_report, p6_found, p6_splits, p6_report, p7_found, p7_forms, p8_ids, p8_roundtrip, p9_found, p9_spans, p9_clean, p9_trimmed, p10_found,
    )
}

_BLANK = r"[\s\x{A0}\x{2007}\x{202F}\x{3000}\x{FEFF}\x{200B}]+"
_SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}]+"


def _label(column: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace({column}, '^{_BLANK}|{_BLANK}$', '', 'g')), ''), 'unknown')"


def _letters(column: str) -> str:
    """The letters of a text in SQL: full-width forms and look-alikes by translation, marks kept, all else dropped."""
    wide = "".join(chr(c) for c in range(0xFF10, 0xFF5B) if chr(c).isalnum())
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    source, target = wide + "".join(letters.LOOKALIKE) + "\u212a", plain + "".join(letters.LOOKALIKE.values()) + "K"
    split = f"replace(replace({column}, '\ufb01', 'fi'), '\ufb00', 'ff')"
    low = f"nfc_normalize(lower(translate({split}, '{source}', '{target}')))"
    return f"regexp_replace({low}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"


def _visible(column: str) -> str:
    """The text as a reader sees it, in SQL."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide).replace("'", "''")
    source, target = wide + "".join(letters.LOOKALIKE) + "\u212a\u00a0\u2007\u202f", plain + "".join(letters.LOOKALIKE.values()) + "K   "
    bare = f"regexp_replace({column}, '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    return f"nfc_normalize(translate(replace(replace({bare}, '\ufb01', 'fi'), '\ufb00', 'ff'), '{source}', '{target}'))"


_FILE = f"""nullif(nullif(regexp_replace(regexp_replace(replace(lower(regexp_replace(source_shard, '^{_BLANK}|{_BLANK}$', '', 'g')), chr(92), '/'), '/(\\./|/)+', '/', 'g'), '^(\\./)+', ''), ''), 'unknown')"""
_USABLE = f"""c AS (SELECT row_id, {_label('language')} AS language, {_label('subtype')} AS subtype, {_label('dataset')} AS dataset, ingested_at,
  coalesce({_FILE}, 'unknown') AS shard, CASE WHEN duration > 0 AND isfinite(duration) THEN duration END AS duration FROM manifest)"""
_QS = "[0.25, 0.5, 0.75, 0.9, 0.95, 0.99]"
_MIX = f"""{_USABLE}, total AS (SELECT sum(duration) AS total FROM c), supply AS (SELECT dataset, language, sum(duration) AS supply FROM c WHERE duration IS NOT NULL GROUP BY ALL),
  plan AS (SELECT {_label('m.dataset')} AS dataset, {_label('m.language')} AS language, m.target_share, m.max_repeats FROM mix_targets m)"""
_WORDS = f"""m AS (SELECT 'manifest' AS origin, row_id AS k, {_label('language')} || chr(0) || {_letters('transcription')} AS w, {_letters('transcription')} AS l FROM manifest),
      j AS (SELECT line_id, CASE WHEN json_valid(raw) THEN raw END AS r FROM raw_lines),
      f AS (SELECT line_id, list_transform(list_sort(json_keys(r)), lambda x: [x, {_letters("coalesce(json_extract_string(r, concat('$.', chr(34), x, chr(34))), '')")}]) AS f FROM j WHERE r IS NOT NULL AND json_type(r) = 'OBJECT'),
      w AS (SELECT origin, k, w FROM m WHERE l <> '' UNION ALL SELECT 'raw_lines', line_id, f::VARCHAR FROM f WHERE len(list_filter(f, lambda x: x[2] <> '')) > 0)"""
_SAMPLE = f"""{_USABLE}, o AS (SELECT language, subtype, count(*) AS observed FROM c GROUP BY ALL), half AS (SELECT count(*) * 0.5::DOUBLE AS half FROM c),
  t AS (SELECT {_label('language')} AS language, {_label('subtype')} AS subtype, target_share, min_rows FROM sample_targets)"""

ORACLES: dict[str, str] = {
    "p1_pieces": f"""WITH {_USABLE}, g AS (SELECT language, subtype, shard AS piece, count(*) AS n, quantile_cont(duration, {_QS}) AS q FROM c WHERE duration IS NOT NULL GROUP BY ALL
      UNION ALL SELECT language, subtype, NULL, count(*), quantile_cont(duration, {_QS}) FROM c WHERE duration IS NOT NULL GROUP BY ALL)
      SELECT language, subtype, piece, unnest({_QS})::DOUBLE AS percentile, n, round(unnest(q), 6) AS value FROM g""",
    "p1_percentiles": f"""WITH {_USABLE}, g AS (SELECT language, subtype, count(*) AS n, quantile_cont(duration, {_QS}) AS q FROM c WHERE duration IS NOT NULL GROUP BY ALL)
      SELECT language, subtype, unnest({_QS})::DOUBLE AS percentile, n, round(unnest(q), 6) AS value FROM g""",
    "p1_combined": f"""WITH {_USABLE}, p AS (SELECT language, subtype, duration, 2.0::DOUBLE ** (floor(log2(duration)) - 10) AS unit FROM c WHERE duration IS NOT NULL),
      g AS (SELECT language, subtype, count(*) AS n, quantile_cont(floor(duration / unit) * unit, {_QS}) AS q FROM p GROUP BY ALL)
      SELECT language, subtype, unnest({_QS})::DOUBLE AS percentile, n, round(unnest(q) + 3e-8, 6) AS value FROM g""",
    "p1_day_pieces": f"""WITH {_USABLE} SELECT language, subtype, ingested_at::DATE AS day, count(DISTINCT duration) AS distinct_values, count(*) AS n_rows
      FROM c WHERE duration IS NOT NULL GROUP BY ALL""",
    "p2_clips": f"""SELECT min(row_id) AS row_id, count(*) AS copies FROM (SELECT row_id, {_label('language')} AS language, {_letters('transcription')} AS letters FROM manifest)
      WHERE letters <> '' GROUP BY language, letters""",
    "p3_found": f"WITH {_SAMPLE} SELECT language, subtype FROM t LEFT JOIN o USING (language, subtype), half WHERE coalesce(observed, 0) < greatest(min_rows, target_share * half)",
    "p3_report": f"""WITH {_SAMPLE}, a AS (SELECT language, subtype, sum(target_share) AS target_share, max(min_rows) AS min_rows FROM t GROUP BY ALL),
      i AS (SELECT a.*, coalesce(observed, 0) AS observed, target_share * half AS ideal FROM a LEFT JOIN o USING (language, subtype), half),
      g AS (SELECT *, greatest(floor(ideal)::BIGINT + (row_number() OVER (ORDER BY ideal - floor(ideal) DESC, language, subtype) <= round(sum(ideal) OVER () - sum(floor(ideal)) OVER ()))::BIGINT, min_rows) AS goal FROM i),
      k AS (SELECT *, least(goal, observed) AS sampled, CASE WHEN target_share > 0 THEN observed - least(goal, observed) ELSE 0 END AS spare,
        greatest(round(sum(ideal) OVER ())::BIGINT - sum(least(goal, observed)) OVER (), 0) AS lack FROM g),
      l AS (SELECT *, (lack - coalesce(sum(spare) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(target_share) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM k WINDOW w AS (ORDER BY CASE WHEN target_share > 0 THEN spare / target_share ELSE 0 END, language, subtype)),
      e AS (SELECT *, floor(least(spare, max(level) OVER () * target_share)) AS extra, least(spare, max(level) OVER () * target_share) AS wish FROM l),
      f AS (SELECT *, sampled + extra::BIGINT + (extra < spare AND row_number() OVER (ORDER BY CASE WHEN extra < spare THEN wish - extra ELSE -1 END DESC, language, subtype)
        <= least(lack, sum(spare) OVER ()) - sum(extra) OVER ())::BIGINT AS filled FROM e)
      SELECT language, subtype, target_share, min_rows, observed, goal, sampled, goal - sampled AS deficit, sampled = observed AND sampled < greatest(ideal, min_rows) AS short,
        sampled / sum(sampled) OVER () AS reached_share, filled, filled / sum(filled) OVER () AS filled_share FROM f""",
    "p4_found": f"WITH {_MIX} SELECT dataset, language FROM plan LEFT JOIN supply USING (dataset, language), total WHERE coalesce(supply, 0) * max_repeats < target_share * total",
    "p2_found": f"""WITH {_WORDS}
      SELECT a.origin, a.k AS key_a, b.k AS key_b FROM w a JOIN w b ON a.origin = b.origin AND a.w = b.w AND a.k < b.k""",
    "p2_members": f"""WITH {_WORDS} SELECT origin, k AS key, min(k) OVER same AS representative, count(*) OVER same AS copies FROM w WINDOW same AS (PARTITION BY origin, w)""",
    "p2_lines": f"""WITH {_WORDS} SELECT min(k) AS line_id, count(*) AS copies FROM w WHERE origin = 'raw_lines' GROUP BY w.w""",
    "p6_found": f"""WITH RECURSIVE r AS (SELECT row_id, {_label('split')} AS split,
        's' || {_FILE} AS s,
        'i' || CASE WHEN regexp_replace(id, '{_BLANK}', '', 'g') <> '' THEN id END AS i FROM manifest),
      n AS (SELECT row_id, split, coalesce(s, i, 'r' || row_id) AS a, i FROM r),
      k AS (SELECT DISTINCT a, coalesce(i, a) AS i FROM n), e AS (SELECT DISTINCT x.a, y.a AS b FROM k x JOIN k y USING (i)),
      lab AS (SELECT 0 AS step, a, a AS label FROM (SELECT DISTINCT a FROM n)
        UNION ALL SELECT step, a, min(label) FROM (SELECT l.step + 1 AS step, e.a, l.label FROM lab l JOIN e ON e.b = l.a WHERE l.step < 60) GROUP BY step, a),
      c AS (SELECT a, min(label) AS label FROM lab GROUP BY a)
      SELECT min(row_id) AS group_row_id FROM n JOIN c USING (a) GROUP BY label HAVING count(DISTINCT split) FILTER (split IN ('train', 'validation', 'test')) > 1""",
    "p7_found": f"""WITH v AS (SELECT row_id, {_label('language')} AS language, transcription AS t, {_visible('transcription')} AS seen FROM manifest WHERE {_letters('transcription')} <> '')
      SELECT a.row_id AS row_a, b.row_id AS row_b FROM v a JOIN v b ON a.language = b.language AND a.seen = b.seen AND a.row_id < b.row_id AND a.t <> b.t""",
}
