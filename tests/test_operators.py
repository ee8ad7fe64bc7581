import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.errors import ManifestError
from tamarack.functions.labels import label, usable_seconds
from tamarack.operators import audit, decode, gate, lookup, segment, select, splits, validate, vocab
from tamarack.plans.ordered import in_ranges, percentiles, rank_in_group, running_before
from tamarack.queries import QUERIES

FIELDS = "row int, record_id string, recording_id string, path string, lang string, actualSentence string, seconds string"


def test_labels(spark):
    rows = [(None,), ("",), (" \t",), (" Swa ",), ("SWA",)]
    out = [r[0] for r in spark.createDataFrame(rows, "x string").select(label("x")).collect()]
    assert out == ["unknown", "unknown", "unknown", "swa", "swa"]


def test_usable_seconds(spark):
    rows = [(1.5,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "x double").select(usable_seconds("x")).collect()]
    assert out == [1.5, None, None, None, None, None]


def test_aliases(spark):
    df = spark.createDataFrame([(1, "r1", "source-1", "/audio/a.flac", "KIK", "Nĩ wega!", "4.5")], FIELDS)
    row = validate.check_records(validate.resolve_aliases(df, ["row"])).first()
    assert (row.language, row.transcription, row.duration, row.reason, row.id) == ("kik", "nĩ wega", 4.5, None, "r1")


def test_ordered_reasons_and_duplicates(spark):
    rows = [
        (1, "a", "s", "p", "swa", "x", "1"), (2, "a", "s", "p", "swa", "y", "1"), (3, "b", "s", "p", "xxx", "", "0"), (4, "c", "s", "p", "som", "?!", "1"),
        (5, "d", None, "p", "som", "x", "1"), (6, "e", "s", " ", "som", "x", "1"), (7, "f", "s", "p", "som", "x", "one"), (8, "g", "s", "p", "som", "x", "-1"),
        (9, None, None, "p", "mas", "x", None), (10, "h", "s", "p", "som", "x", "NaN"), (11, " ", "s", "p", "som", "x", "1"),
    ]
    df = validate.check_records(validate.resolve_aliases(spark.createDataFrame(rows, FIELDS), ["row"]))
    out = {r.row: r for r in validate.reject_duplicates(df, "row").collect()}
    reasons = {k: r.reason for k, r in out.items()}
    assert reasons == {
        1: None, 2: "duplicate id", 3: "unsupported language", 4: "empty transcription", 5: None, 6: "audio_path is required", 7: "invalid duration",
        8: "duration must be positive", 9: "source_id is required", 10: None, 11: None,
    } | {5: "source_id is required" if out[5].source_id is None else None}
    assert math.isnan(out[10].duration)
    assert out[11].id.startswith("som-") and len(out[11].id) == 20


def test_json_records(spark):
    rows = [(1, '{"id": "x", "lang": "swa", "text": "a", "path": "p", "seconds": 2}'), (2, "{broken"), (3, None)]
    out = validate.resolve_json(spark.createDataFrame(rows, "n int, raw string"), "raw", ["n"]).orderBy("n").collect()
    assert (out[0].id, out[0].source_id, out[0].language, out[0].duration) == ("x", "x", "swa", "2")
    assert out[2].id is None


def test_limits_inclusive(spark):
    rows = [(0.5,), (2.0,), (0.4,), (2.1,), (None,), (float("nan"),)]
    out = [r.reason for r in validate.within_limits(spark.createDataFrame(rows, "duration double"), 0.5, 2.0).collect()]
    assert out == [None, None, "too short", "too long", "unreadable audio", "unreadable audio"]


def test_submission(spark):
    want = spark.createDataFrame([("1", "swa"), ("2", "som")], "id string, language string")
    good = spark.createDataFrame([("1", "swa", "a"), ("2", "som", "b")], "id string, language string, transcription string")
    assert validate.submission_problems(good, want).count() == 0
    bad = spark.createDataFrame([("1", "swa", " "), ("1", "swa", "x"), ("3", "xxx", None)], "id string, language string, transcription string")
    assert {r.problem: r.n_rows for r in validate.submission_problems(bad, want).collect()} == {
        "duplicate submission id": 1, "missing id and language": 1, "unexpected id and language": 1, "unsupported language": 1, "empty transcription": 2,
    }
    with pytest.raises(ValueError):
        validate.submission_problems(good.select("language", "id", "transcription"), want)


def clips(spark, languages, sources=4, speaker=None):
    rows = [(f"{x}-{s}-{k}", f"src{s}", speaker(s) if speaker else None, x, "scripted", 2.0, None) for x in languages for s in range(sources) for k in range(2)]
    return spark.createDataFrame(rows, "id string, source_id string, speaker_id string, language string, subtype string, duration double, split string")


def test_grouped_split(spark):
    df = clips(spark, validate.LANGUAGES)
    a = {r.id: r.new_split for r in splits.grouped_split(df, 0.25, 42).collect()}
    b = {r.id: r.new_split for r in splits.grouped_split(df.repartition(7), 0.25, 42).collect()}
    assert a == b
    for x in validate.LANGUAGES:
        assert sorted({v for k, v in a.items() if k.startswith(x)}) == ["train", "validation"]
        assert sum(v == "validation" for k, v in a.items() if k.startswith(x)) == 2
    assert splits.leaking_groups(splits.grouped_split(df, 0.25, 42)).count() == 0
    with pytest.raises(ValueError):
        splits.require_groups(clips(spark, ["swa"], sources=1), ["swa"])


def test_speakers_stay_together(spark):
    df = clips(spark, ["swa"], sources=6, speaker=lambda s: f"spk{s % 2}")
    out = splits.grouped_split(df, 0.5).groupBy("speaker_id").agg(F.countDistinct("new_split").alias("n")).collect()
    assert all(r.n == 1 for r in out) and len(out) == 2


def test_hours_leave_out_unknown_only_groups(spark):
    rows = [("train", "swa", 3600.0), ("train", "swa", None), ("test", "som", None)]
    out = splits.split_hours(spark.createDataFrame(rows, "split string, language string, duration double")).collect()
    assert [(r.split, r.hours, r.unknown_rows) for r in out] == [("train", 1.0, 1)]


def test_spread(spark):
    paths = [(f"som/train/unscripted/audios/shard_{i:02d}.parquet",) for i in range(10)] + [("som/x.parquet",), (None,)]
    listed = select.listed_shards(spark.createDataFrame(paths, "path string"), ["som"], "train", ["unscripted"])
    out = select.spread_sample(listed, ["language", "subtype"], "path", 3)
    assert sorted(r.path[-10:-8] for r in out.collect()) == ["00", "04", "09"]
    assert select.spread_sample(listed, ["language"], "path", 1).count() == 1
    assert select.spread_sample(listed.limit(0), ["language"], "path", 3).count() == 0


def test_budget_keeps_the_overshooting_row(spark):
    rows = [("swa", i, 40.0) for i in range(5)]
    df = spark.createDataFrame(rows, "language string, k int, d double")
    kept = select.budget_prefix(df, ["language"], ["k"], "d", 100.0)
    assert sorted(r.k for r in kept.collect()) == [0, 1, 2]


@pytest.mark.parametrize("given", [False, True])
def test_ranks_in_two_levels(spark, given):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    bucket = F.floor(F.col("k") / 50) if given else None
    out = rank_in_group(df, ["g"], ["k"], "r", bucket).collect()
    assert len(out) == 1000 and all(r.r == r.k // 3 + 1 for r in out)
    sums = running_before(df, ["g"], ["k"], {"s": F.col("k"), "n": F.lit(1)}, bucket).where("k = 999").first()
    assert (sums.s, sums.n) == (sum(range(0, 999, 3)), 333)


def test_a_hot_group_is_ranked_in_ranges(spark):
    df = spark.range(2000).select(F.lit("one").alias("g"), F.concat(F.lit("the/same/long/prefix/"), F.format_string("%05d", "id")).alias("k"))
    ranges = [r["count"] for r in in_ranges(df, ["g"], ["k"], "p").groupBy("p").count().collect()]
    assert len(ranges) > 2 and max(ranges) < 1000
    assert all(r.r == int(r.k[-5:]) + 1 for r in rank_in_group(df, ["g"], ["k"], "r").collect())


def test_percentiles_in_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, rng.uniform(-9, 9)])) for _ in range(400)] + [("none", None), ("one", 2.0)]
    out = percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()
    for r in out:
        own = [v for g, v in rows if g == r.g and v is not None]
        assert [r.low, r.mid, r.top] == pytest.approx([float(np.percentile(own, q)) for q in (10, 50, 100)])
    assert {r.g for r in out} == {"a", "b", None, "one"}


def test_rank_zip(spark):
    a = spark.createDataFrame([("s", i, f"a{i}") for i in (5, 1, 3)] + [("t", 1, "x"), (None, 1, "n")], "o string, p int, l string")
    b = spark.createDataFrame([("s", i, f"b{i}") for i in (9, 2)] + [("u", 1, "y"), (None, 1, "n")], "o string, p int, r string")
    assert sorted(tuple(r) for r in lookup.rank_zip(a, b, "o", "p", "l", "r").collect()) == [("s", 0, "a1", "b2"), ("s", 1, "a3", "b9")]


def test_quotas(spark):
    df = spark.createDataFrame([("swa", i, i % 2 == 0, None) for i in range(30)], "g string, k int, long boolean, note string")
    got = {r.k: r.uses for r in select.quota_harvest(df, ["g"], ["k"], 6, 2, F.col("long"), 4).collect()}
    want = {i: 1 + 2 * (i < 3) for i in range(6)}
    for i in (0, 2, 4, 6):
        want[i] = want.get(i, 0) + 1
    assert got == want


def test_samples_of_drops(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(40)], "k int, reason string")
    assert [(r.nth, r.k) for r in validate.drop_samples(df, F.col("reason"), "k", 3).orderBy("nth").collect()] == [(1, 1), (2, 2), (3, 4)]
    with pytest.raises(ManifestError):
        validate.require_train(spark.createDataFrame([("train",), (None,)], "split string"))
    validate.require_train(spark.createDataFrame([("train",)], "split string"))


def test_weights_and_draws(spark):
    df = spark.createDataFrame([(i, "swa" if i < 90 else "som", 36.0) for i in range(100)], "k long, language string, duration double")
    w = select.balance_weights(df)
    draws = select.weighted_draws(df, w, "k", 2000).groupBy("language").count().collect()
    got = {r.language: r["count"] for r in draws}
    assert sum(got.values()) == 2000
    assert abs(got["swa"] / 2000 - 0.75) < 0.05  # sqrt(0.9) : sqrt(0.1)


def test_slices(spark):
    def run(n_words, n):
        df = spark.createDataFrame([([f"w{i}" for i in range(n_words)],)], "w array<string>")
        return df.select(segment.word_slices(F.col("w"), F.lit(n)).alias("s")).first().s

    assert run(5, 2) == []
    assert run(0, 1) == []
    assert [len(x.split()) for x in run(10, 3)] == [3, 4, 3]


def test_windows(spark):
    df = spark.createDataFrame([(480000, 2), (48000, 2)], "s long, n int").select(segment.time_windows(F.col("s"), F.col("n")).alias("w"))
    assert [[tuple(x) for x in r.w] for r in df.collect()] == [[(0, 240000), (240000, 480000)], []]


def test_occupancy(spark):
    tone = [math.sin(2 * math.pi * 220 * i / 16000) for i in range(16000)]
    df = spark.createDataFrame([(0, [0.0] * 16000), (1, tone), (2, [0.5] * 10)], "k int, x array<double>")
    out = [r.o for r in df.select("k", segment.speech_occupancy(F.col("x"), 320).alias("o")).orderBy("k").collect()]
    assert out[0] == 0.0 and out[1] > 0.9 and out[2] == 0.0


def test_word_islands(spark):
    rows = [("u", i, t, i, i + 1, 0.8) for i, t in enumerate([3, 1, 2, 3, 3, 4])]
    df = spark.createDataFrame(rows, "u string, i int, t int, start_frame int, end_frame int, posterior double")
    out = segment.aligned_words(df, "u", "i", F.col("t") == 3).orderBy("word_no").collect()
    assert [(r.start_frame, r.last_frame) for r in out] == [(1, 2), (5, 5)]


WORDS = "u string, k int, start double, end double, text string, posterior double"


def test_segments(spark):
    words = [("u", 0, 0.2, 1.0, "one", 0.9), ("u", 1, 1.1, 2.0, "two", 0.8), ("u", 2, 5.0, 6.0, "three", 0.7), (None, 0, 1.0, 2.0, "x", 1.0), ("v", 0, None, 1.0, "x", 1.0)]
    out = segment.padded_segments(spark.createDataFrame(words, WORDS).repartition(3), "u", "k", F.lit(7.0), 0.5, 3.0, 0.1).orderBy("segment").collect()
    assert [r.text for r in out] == ["one two", "three"]
    assert all(r.end - r.start <= 3 for r in out)


def test_long_segment_vanishes_after_padding(spark):
    df = spark.createDataFrame([("u", 0, 0.5, 25.3, "x", 1.0)], WORDS)
    assert segment.padded_segments(df, "u", "k", F.lit(60.0), 1.0, 25.0, 0.15).count() == 0
    assert segment.padded_segments(df.limit(0), "u", "k", F.lit(60.0), 1.0, 25.0, 0.15).count() == 0


def test_one_long_recording_takes_time_in_proportion(spark):
    df = spark.range(200_000).select(F.lit("u").alias("u"), F.col("id").alias("k"), (F.col("id") / 2).alias("start"), (F.col("id") / 2 + 0.4).alias("end"), F.lit("w").alias("text"), F.lit(1.0).alias("posterior"))
    out = segment.padded_segments(df, "u", "k", F.lit(1e9), 0.5, 10.0, 0.0)
    row = out.agg(F.sum("n_words").alias("w"), F.count(F.lit(1)).alias("n"), F.max("segment").alias("m")).first()
    assert (row.w, row.n, row.m) == (200_000, 10_000, 9_999)


def test_vocabulary(spark):
    df = spark.createDataFrame([("train", "ab c"), ("validation", "z")], "split string, t string")
    got = {r.symbol: r.id for r in vocab.shared_vocabulary(df.where("split = 'train'"), "t").collect()}
    assert got == {"<pad>": 0, "<unk>": 1, "|": 2, "a": 3, "b": 4, "c": 5}
    plain = {r.symbol: r.id for r in vocab.plain_vocabulary(df.where("split = 'train'"), "t").collect()}
    assert plain == {"a": 0, "b": 1, "c": 2, "|": 3, "[UNK]": 4, "[PAD]": 5}


def test_padding(spark):
    row = spark.sql("SELECT array(1L, 2L) AS x").select(vocab.padded(F.col("x"), F.lit(4), -100).alias("p")).first()
    assert row.p == [1, 2, -100, -100]


def test_labels_up_to_the_decoder_limit(spark, tmp_path):
    rows = [(1, "a" * 220), (2, "a" * 221), (3, "a" * 444), (4, "a" * 445), (5, ""), (6, None)]
    spark.createDataFrame(rows, "row_id long, transcription string").write.parquet(str(tmp_path / "manifest.parquet"))
    got = {r.row_id: r.ids for r in QUERIES["label_build"](spark, str(tmp_path)).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 224, 2: 225, 3: 448}
    assert got[2] == [50258, 50359, 50363, *[ord("a")] * 221, 50257]


GATE = ["swa", "som", "kik", "luo", "mas", "kln"]


def run_gate(spark, aligned, hours, macro):
    rates = spark.createDataFrame([(x, 0.7, a) for x, a in zip(GATE, aligned, strict=True)], "language string, clean double, aligned double")
    return gate.evaluate_gate(rates, spark.createDataFrame([(x, float(h)) for x, h in hours.items()], "language string, hours double"), *macro).first()


def test_gate(spark):
    ok = run_gate(spark, [0.65, 0.66, 0.64, 0.68, 0.63, 0.64], dict.fromkeys(GATE, 2), (0.70, 0.65))
    assert ok.proceed and ok.languages_improved == 6 and ok.reasons == []
    no = run_gate(spark, [0.75, 0.68, 0.68, 0.68, 0.68, 0.67], dict.fromkeys(GATE, 2) | {"som": 0.5}, (0.70, 0.69))
    assert not no.proceed
    assert no.reasons == ["insufficient_aligned_hours:som", "macro_wer_improvement_below_threshold", "excessive_language_regression:swa"]


def test_hours_and_leaks(spark):
    df = spark.createDataFrame([(x, f"s{i}", 3600.0) for i, x in enumerate(GATE)], "language string, source_id string, duration double")
    assert {r.hours for r in gate.hours_by_language(df).collect()} == {1.0}
    assert gate.hours_by_language(df.limit(0)).count() == 6
    assert gate.leaking_sources(df, df.limit(1)).first().leaking_sources == 1


def test_lower_macro_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.5), ("c", 2, 0.6)], "name string, place int, macro_wer double")
    assert gate.lower_macro(df).first().name == "a"


def test_lr(spark):
    df = spark.createDataFrame([(50,), (100,), (1000,)], "step int")
    assert [round(r[0], 9) for r in df.select(audit.warmup_decay(F.col("step"), 100, 1000)).collect()] == [0.5, 1.0, 0.0]


def test_profile_needs_known_durations(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", None), ("b", None)], "s string, d double")
    out = audit.shard_profile(df, ["s"], "d").collect()
    assert [(r.s, r.n_rows, r.known, r.unknown, r.p50_sec) for r in out] == [("a", 2, 1, 1, 10.0)]


def test_probe_counts_unknown_rows(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", None)], "s string, d double")
    assert audit.duration_probe(df, "s", "d").first().pct_under_10s == 50.0


def test_two_tier(spark):
    members = spark.createDataFrame([("d/a.wav",), ("b.wav",), ("c.wav",)], "m string")
    texts = spark.createDataFrame([(1, "a", "old"), (2, "a", "new"), (3, "b.wav", "full")], "n int, k string, t string")
    got = {r.m: r.t for r in lookup.two_tier(members, texts, "m", "k", "n", "t").collect()}
    assert got == {"d/a.wav": "new", "b.wav": "full"}


def test_combined_rejects_repeats(spark):
    a = spark.createDataFrame([("1", 2)], "id string, x int")
    b = spark.createDataFrame([("2", "y")], "id string, z string")
    assert sorted(lookup.combined([a, b], "id").columns) == ["id", "x", "z"]
    with pytest.raises(ManifestError):
        lookup.combined([a, a], "id")


def test_greedy_ctc(spark):
    def hot(i):
        return [1.0 if j == i else 0.0 for j in range(4)]

    rows = [("u", k, hot(s)) for k, s in enumerate([1, 1, 0, 1, 2, 2, 0])]
    out = decode.greedy_ctc(spark.createDataFrame(rows, "u string, f int, e array<double>"), "u", "f", "e").first()
    assert out.symbols == [1, 1, 2]


def test_chunks_join_and_failures(spark):
    df = spark.createDataFrame([("a", 2, "World!"), ("a", 1, "Hello,"), ("b", 1, "?"), ("c", 1, "x")], "id string, n int, t string")
    texts = decode.joined_chunks(df, "id", "n", "t")
    failed = spark.createDataFrame([("c", "decoder")], "id string, reason string")
    ok, bad = decode.isolate_failures(texts, failed, "id")
    assert [(r.id, r.text) for r in ok.collect()] == [("a", "hello world")]
    assert {(r.id, r.reason) for r in bad.collect()} == {("b", "empty result"), ("c", "decoder")}


def _stub(frame):
    if (frame["x"] < 0).any():
        raise RuntimeError("bad")
    return frame["x"].map(lambda v: f"t{v}")


def test_infer_policies(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1, -1, 2])], "id int, x int").coalesce(1)
    strict = {r.id: (r.text, r.reason) for r in decode.infer(df, _stub, "id").collect()}
    assert strict == {0: ("t1", None), 1: (None, "RuntimeError"), 2: ("t2", None)}
    assert {r.id: r.text for r in decode.infer(df, _stub, "id", "fallback").collect()}[1] == "."
