import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import AlignmentError, ManifestError
from tamarack.operators.align import align_utterances, forced_alignment
from tamarack.operators.validate import LANGUAGES, resolve_aliases
from tamarack.operators import metrics, vocab
from tamarack.plans import config, flows, pipeline
from tamarack.plans.staging import broadcast_if_small, counted, fresh, release, small, stage, sweep, swept
from tamarack.sources import archive, audio, fetch, flac, records
from tamarack.streaming.resume import run_available

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n{"id": "c"\n', encoding="utf-8")
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(p), SCHEMA).collect()
    good, bad = records.read_jsonl_tolerant(spark, str(p), SCHEMA)
    assert [r.id for r in good.orderBy("id").collect()] == ["a", "b"]
    assert [r.preview for r in bad.collect()] == ['{"id": "c"']


def test_csv_with_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿id,text\n1,\"a,\"\"b\"\n".encode())
    df = records.read_manifest(spark, str(p))
    assert df.columns == ["id", "text"] and df.first().text == 'a,"b'
    with pytest.raises(ManifestError):
        records.read_manifest(spark, str(tmp_path / "a.xls"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b", None)], "id string, n int")
    records.write_jsonl(df, str(tmp_path / "j"))
    records.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    records.write_single_csv(df.orderBy("id"), f"file://{tmp_path}/one.csv")
    assert (tmp_path / "one.csv").read_text().splitlines()[0] == "id,n"
    records.write_json_file(tmp_path / "x" / "s.json", {"b": 1, "a": "é"})
    assert (tmp_path / "x" / "s.json").read_text().index('"a"') < 6
    made = []
    assert records.cached_files(spark, str(tmp_path / "c"), lambda d: (made.append(1), df.write.parquet(d))) and made == [1]
    assert records.cached_files(spark, str(tmp_path / "c"), lambda d: made.append(2)) and made == [1]
    assert records.column_choice(df, ["text", "n"]) == "n"
    with pytest.raises(ManifestError):
        records.read_column(spark, str(tmp_path / "c"), "audio")


def test_tar(spark, tmp_path):
    wav = audio.encode_wav(np.zeros(16000), 16000)
    for k in (1, 2):
        with tarfile.open(tmp_path / f"{k}.tar.xz", "w:xz") as t:
            for name in (f"d/{k}.wav", f"d/{k}.txt"):
                info = tarfile.TarInfo(name)
                info.size = len(wav)
                t.addfile(info, io.BytesIO(wav))
    archive.register(spark)
    df = spark.read.format("tar_members").load(str(tmp_path / "*.tar.xz"))
    assert df.rdd.getNumPartitions() == 2
    out = audio.probe_column(df, "member", "content").orderBy("member").collect()
    assert [(r.member, r.sample_rate, r.channels, r.duration) for r in out] == [("d/1.wav", 16000, 1, 1.0), ("d/2.wav", 16000, 1, 1.0)]


def test_audio():
    assert len(audio.to_mono({"array": np.zeros(8000), "sampling_rate": 8000}, 16000)) == 16000
    tone = np.sin(2 * np.pi * 220 * np.arange(8000) / 8000)
    up = audio.resample(tone, 8000, 16000)
    want = np.sin(2 * np.pi * 220 * np.arange(16000) / 16000)
    assert np.abs(up[200:-200] - want[200:-200]).max() < 0.01
    assert np.abs(audio.to_mono(audio.encode_wav(tone, 8000), 8000) - tone).max() < 1e-3
    assert audio.probe(b"junk") is None and audio.probe(None) is None
    with pytest.raises(ValueError):
        audio.to_mono({"array": [], "sampling_rate": 8000}, 8000)


def emissions(path, vocabulary=4):
    x = np.full((len(path), vocabulary), -8.0)
    x[np.arange(len(path)), path] = 8.0
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def test_forced_alignment():
    out = forced_alignment(emissions([0, 1, 0, 1, 0, 2, 0]), [1, 1, 2])
    assert [f[1] for f in out] == [1, 3, 5] and all(f[3] > 0.99 for f in out)
    with pytest.raises(AlignmentError, match="frames"):
        forced_alignment(np.zeros((2, 4)), [1, 2, 3])
    with pytest.raises(AlignmentError):
        forced_alignment(np.zeros((2, 4)), [])


def test_forced_alignment_beats_every_path():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(5, 3))
        found = forced_alignment(x, [1, 2])
        score = -np.inf
        for path in itertools.product(range(3), repeat=5):
            if [k for k, _ in itertools.groupby(path) if k] == [1, 2]:
                score = max(score, sum(x[t, s] for t, s in enumerate(path)))
        got = np.zeros(5, int)
        for token, a, b, _ in found:
            got[a:b] = token
        assert abs(sum(x[t, s] for t, s in enumerate(got)) - score) < 1e-9


def test_align_rows(spark):
    rows = [("a", emissions([0, 1, 0, 2]).tolist(), [1, 2]), ("b", emissions([0]).tolist(), [1, 2])]
    df = spark.createDataFrame(rows, "id string, emissions array<array<double>>, targets array<int>")
    out = align_utterances(df, "id").orderBy("id", "place").collect()
    assert [(r.id, r.token_id, r.start_frame) for r in out] == [("a", 1, 1), ("a", 2, 3), ("b", None, None)]
    assert "frames" in out[2].reason


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: FILL_ME}\nb: [1, FILL_ME]\nc: 1\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\na: {x: 2}\nc: {z: 3}\n")
    loaded = config.load_config(tmp_path / "own.yaml")
    assert loaded == {"a": {"x": 2, "y": "FILL_ME"}, "b": [1, "FILL_ME"], "c": {"z": 3}}
    assert config.unresolved(loaded) == ["a.y", "b[1]"]
    (tmp_path / "list.yaml").write_text("- 1\n")
    (tmp_path / "round.yaml").write_text("extends: round.yaml\n")
    for bad in ("list.yaml", "round.yaml"):
        with pytest.raises(ManifestError):
            config.load_config(tmp_path / bad)


def test_flac():
    rng = np.random.default_rng(2)
    for n in (1, 5, 4096, 4097, 9000):
        for x in (np.sin(np.arange(n) / 9) * 0.7, rng.uniform(-1, 1, n), np.zeros(n), np.full(n, -1.0)):
            content = flac.encode(x, 16000)
            got, rate = flac.decode(content)
            assert rate == 16000 and np.abs(got - (x * 32767).astype(int) / 32768).max() < 1e-7
            assert audio.probe(content) == (n, 16000, 1)
    for cut in (b"", content[:20], content[:60], content[:-9]):
        with pytest.raises((ValueError, EOFError)):
            flac.decode(cut)


def test_flac_subframes():
    """Two channels as middle and side, a linear predictor and verbatim samples, put together by hand."""
    def bits(*fields):
        text = "".join(format(v & ((1 << n) - 1), f"0{n}b") for n, v in fields)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")

    left, right = [10, 20, 30, 41], [8, 21, 26, 40]
    middle, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    info = bits((20, 8000), (3, 1), (5, 15), (36, 4))
    head = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(10) + info + bytes(16)
    frame = [(14, 0x3FFE), (2, 0), (4, 6), (4, 0), (4, 10), (3, 4), (1, 0), (8, 0), (8, 3), (8, 0)]
    residual = [m - ((2 * a) >> 1) for m, a in zip(middle[1:], middle)]
    frame += [(1, 0), (6, 32), (1, 0), (16, middle[0]), (4, 4), (5, 1), (5, 2), (2, 0), (4, 0), (4, 2)]
    for r in residual:
        v = 2 * r if r >= 0 else -2 * r - 1
        frame += [*[(1, 0)] * (v >> 2), (1, 1), (2, v)]
    frame += [(1, 0), (6, 1), (1, 0), *[(17, v) for v in side]]
    got, rate = flac.decode(head + bits(*frame) + bytes(2))
    assert rate == 8000 and got.tolist() == [(a + b) / 2 / 32768 for a, b in zip(left, right)]


def test_clips_of_archives(spark, tmp_path):
    tone = np.sin(np.arange(8000) / 20) * 0.5
    for k in (1, 2):
        with tarfile.open(tmp_path / f"{k}.tar.xz", "w:xz") as t:
            for name, body in ((f"d/a{k}.wav", audio.encode_wav(tone, 8000)), (f"d/b{k}.wav", b"junk"), (f"d/c{k}.wav", audio.encode_wav(tone, 8000)), ("x.txt", b"x")):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    (tmp_path / "broken.tar").write_bytes(b"no archive at all")
    files = spark.read.format("binaryFile").load([f"{tmp_path}/1.tar.xz", f"{tmp_path}/2.tar.xz", f"{tmp_path}/broken.tar"])
    assert archive.members(files).where("reason IS NOT NULL").count() == 1
    texts = spark.createDataFrame([("a1", 1, "Moja"), ("d/a2.wav", 2, "Mbili"), ("b1", 3, "Tatu"), ("c1", 4, "?!")], "key string, place int, text string")
    for _ in range(2):
        kept, report = flows.archive_clips(files, texts, "swa", f"{tmp_path}/clips", 16000)
        assert sorted((r.text, r.duration) for r in kept.collect()) == [("Mbili", 1.0), ("Moja", 1.0)]
    assert sorted((r.n_rows, r.rejected, r.status) for r in report.collect()) == [(1, 0, "prepared"), (1, 2, "prepared")]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/clips")
    assert all(r.frames == 16000 for r in audio.probe_column(listed, "path", "content").collect())


def test_shards_to_prepare(spark):
    rows = spark.createDataFrame([(i, f"swa/train/scripted/s{i % 5}.parquet") for i in range(20)] + [(99, "x/y.parquet"), (98, None)], "n int, shard string")
    finished = spark.createDataFrame([("swa/train/scripted/s0.parquet",)], "shard string")
    left = flows.listed_clips(rows, finished, 3, ["swa"], "train", ["scripted"])
    assert {r.shard[-10:-8] for r in left.collect()} == {"s2", "s4"}


def test_aligned_pilot(spark):
    ids = {"<pad>": 0, "<unk>": 1, "|": 2, "a": 3, "b": 4}
    path = [0, 3, 0, 4, 0, 2, 0, 4, 4, 0]
    rows = [("r1", "swa", 10.0, "ab b", emissions(path, 5).tolist()), ("r2", "swa", 10.0, "xyz", emissions(path, 5).tolist()), ("r3", "swa", 10.0, "ab b", emissions([0], 5).tolist())]
    df = spark.createDataFrame(rows, "id string, language string, duration double, transcription string, emissions array<array<double>>")
    made, failed = flows.aligned_pilot(df, ids, 1.0, 0.5, 20.0, 0.25)
    assert [(r.id, r.text, r.start, r.end, r.reasons) for r in made.collect()] == [("r1", "ab b", 0.75, 9.25, [])]
    assert {r.id for r in failed.collect()} == {"r2", "r3"}


def test_inference_flow(spark, tmp_path):
    chunks = spark.createDataFrame([("10", "swa", 1, "B"), ("10", "swa", 0, "a"), ("9", "som", 0, "c")], "id string, language string, place int, sound string")
    out = flows.infer_test(chunks, lambda part: part["sound"] + "!", None, f"{tmp_path}/out.csv")
    assert out["rows"] == 2 and (tmp_path / "out.csv").read_text().splitlines() == ["id,language,transcription", "10,swa,a b", "9,som,c"]
    with pytest.raises(ManifestError, match="failed"):
        flows.infer_test(chunks, lambda part: part["absent"], None, f"{tmp_path}/no.csv")
    done = spark.createDataFrame([("10", "swa", " ")], "id string, language string, transcription string")
    with pytest.raises(ManifestError, match="empty transcription"):
        flows.infer_test(chunks, lambda part: part["sound"], done, f"{tmp_path}/no.csv")
    with pytest.raises(ManifestError, match="place"):
        flows.infer_test(chunks.drop("place"), lambda part: part["sound"], None, f"{tmp_path}/no.csv")
    assert not (tmp_path / "no.csv").exists()


def test_strict_rules(spark):
    with pytest.raises(ManifestError):
        vocab.require_characters(spark.createDataFrame([(" ",), (None,)], "t string"), "t")
    counts = spark.createDataFrame([("swa", 1, 4), ("som", 0, 0)], "language string, word_edits long, ref_words long")
    with pytest.raises(ManifestError, match="som"):
        metrics.require_macro_rate(counts, "language", ["swa", "som"])
    assert metrics.require_macro_rate(counts, "language", ["swa"]) == 0.25


def test_single_csv_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, '  a "b", c \n d  '), (2, None)], "n long, t string")
    for _ in range(2):
        records.write_single_csv(df, f"file://{tmp_path}/one.csv")
    assert [r.t for r in records.read_csv(spark, f"file://{tmp_path}/one.csv").orderBy("n").collect()] == ['  a "b", c \n d  ', None]


def test_stages(tmp_path):
    runs = []
    stages = pipeline.Stages(tmp_path)
    with pytest.raises(ManifestError):
        stages.run("two", lambda d: {}, after=("one",))
    for _ in range(2):
        stages.run("one", lambda d: runs.append(1) or {"rows": 3})
    assert runs == [1] and json.loads((tmp_path / "one/status.json").read_text())["rows"] == 3
    stages.run("one", lambda d: runs.append(1) or {}, check=lambda d: False)
    assert runs == [1, 1]


def test_build_splits(spark, tmp_path):
    rows = [(i, f"id{i}", f"s{i % 8}", "p", LANGUAGES[i % 6], "text", "2") for i in range(96)] + [(96, "id1", "s", "p", "swa", "t", "1")]
    df = spark.createDataFrame(rows, "n long, id string, source_id string, path string, lang string, text string, seconds string")
    report = pipeline.build_splits(resolve_aliases(df, ["n"]), "n", str(tmp_path))
    assert report == {"accepted": 96, "rejected": 1}
    assert {r.split for r in spark.read.parquet(f"{tmp_path}/manifest").select("split").distinct().collect()} == {"train", "validation"}
    assert spark.read.parquet(f"{tmp_path}/rejected").first().reason == "duplicate id"


def test_stream_resumes(spark, tmp_path):
    source, results, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = T.StructType([T.StructField("id", T.StringType())])

    def work(df):
        return df.select("id", F.upper("id").alias("text"))

    spark.createDataFrame([("a",), ("b",)], schema).write.parquet(source)
    run_available(spark, source, schema, work, results, mark, "id")
    spark.createDataFrame([("b",), ("c",)], schema).write.mode("append").parquet(source)
    for _ in range(2):
        run_available(spark, source, schema, work, results, mark, "id")
    assert sorted(r.id for r in spark.read.parquet(results).collect()) == ["a", "b", "c"]


def test_stream_keeps_rows_without_id(spark, tmp_path):
    source, results, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 3)], schema).write.parquet(source)
    run_available(spark, source, schema, lambda df: df, results, mark, "id")
    assert sorted(r.n for r in spark.read.parquet(results).collect()) == [1, 2, 3]


def test_staging(spark):
    df = spark.range(10)
    assert stage(df).count() == 10 and small(df, 10) and not small(df, 9)
    assert [counted(df.where(c))[1] for c in ("id < 4", "id < 0")] == [4, 0] and counted(df.groupBy("id").count())[0].count() == 10
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert fresh("u", ["U", "_u"]) == "__u"
    kept = stage(df, "kept")
    with swept(spark):
        gone = stage(df, "gone")
        assert gone.count() == 10
    release(spark)
    assert kept.count() == 10
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()
    sweep(spark)


def test_clips_on_disk(spark, tmp_path):
    rows = [(f"{tmp_path}/wav/a.wav", [0.0, 0.5] * 400), (f"{tmp_path}/wav/b.wav", [0.1] * 800)]
    df = spark.createDataFrame(rows, "path string, samples array<float>")
    for _ in range(2):
        audio.write_clips(df, "path", "samples", 8000)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/wav")
    out = audio.decode_column(files.selectExpr("path", "content"), "path", "content", 8000).orderBy("path").collect()
    assert [len(r.samples) for r in out] == [800, 800] and abs(out[0].samples[1] - 0.5) < 1e-3
    bad = spark.createDataFrame([("x", b"junk"), ("y", None)], "path string, content binary")
    assert all(r.samples is None and r.reason for r in audio.decode_column(bad, "path", "content", 8000).collect())
    more = df.select("path").unionByName(spark.createDataFrame([(f"{tmp_path}/wav/c.wav",)], "path string"))
    assert [r.path[-5:] for r in audio.missing_files(more, "path", f"{tmp_path}/wav").collect()] == ["c.wav"]


def test_stretch():
    tone = np.sin(2 * np.pi * 220 * np.arange(16000) / 16000)
    for factor in (0.9, 1.1):
        assert abs(len(audio.stretch(tone, factor)) / (16000 / factor) - 1) < 0.1
    assert len(audio.stretch(np.zeros(10), 1.1)) == 10


def test_download(tmp_path):
    """A source that breaks off once and then goes on from the asked place."""
    import http.server
    import threading

    body, asked = bytes(range(256)) * 40, []

    class Source(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            asked.append(start)
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(body) - start))
            self.end_headers()
            self.wfile.write(body[start : start + 4000] if len(asked) == 1 else body[start:])

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Source)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/a.bin"
        for _ in range(2):
            assert fetch.download(url, tmp_path / "in/a.bin", pause=0).read_bytes() == body
        assert asked == [0, 4000]
    finally:
        server.shutdown()
    with pytest.raises(ManifestError):
        fetch.download(f"file://{tmp_path}/absent", tmp_path / "b.bin", attempts=2, pause=0)
    assert not (tmp_path / "b.bin").exists()


def test_fetch(tmp_path):
    calls = []

    def flaky(force):
        calls.append(force)
        if len(calls) < 3:
            raise OSError("gone")
        return "ok"

    assert fetch.with_retries(flaky, pause=0) == "ok" and calls == [False, True, True]
    with pytest.raises(ManifestError):
        fetch.with_retries(lambda force: 1 / 0, attempts=2, pause=0)
    (tmp_path / "in").write_text("x")
    assert not fetch.fresh(tmp_path / "out", tmp_path / "in")
    (tmp_path / "out").write_text("x")
    assert fetch.fresh(tmp_path / "out", tmp_path / "in")
    for d in ("step-1", "step-2", "step-3"):
        (tmp_path / "ck" / d).mkdir(parents=True)
    assert fetch.prune(tmp_path / "ck", {"step-3", "step-1"}) == ["step-2"]
    fetch.require_policy({"a": ("swa",)}, {"a": ["swa"]})
    with pytest.raises(ManifestError):
        fetch.require_policy({"a": ("swa",)}, {"a": ["swa", "som"]})
