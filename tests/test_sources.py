import datetime
import io
import json
import os
import struct
import uuid
import wave

import pytest
from pyspark.sql import functions as F

from wrackline.functions import text as T
from wrackline.operators import checkpoints as H
from wrackline.sources import files as S
from wrackline.sources import reports as P
from wrackline.sources import state as Z
from wrackline.streaming.metering import metering
from wrackline.streaming.sync import sent, sync


def test_editions_and_shards(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text(f"text {name}\n")
    assert sorted(r.source for r in S.editions(spark, str(tmp_path), 2).collect()) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        S.editions(spark, str(tmp_path / ".."))
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"b":2}\n')
    assert [(r.line_no, r.raw) for r in S.shards(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, '{"a":1}'), (3, '{"b":2}')]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "café   x"), ("s", 1, "y"), ("t", 0, "z")], "source string, ordinal int, content string")
    out = str(tmp_path / "out")
    assert S.write_shards(df, out) == 3
    lines = spark.read.text(out).select(F.col("value").alias("raw"))
    assert {json.loads(r.raw)["messages"][0]["content"] for r in lines.collect()} == {"café   x", "y", "z"}
    assert S.packed_digests(lines).count() == 3
    with pytest.raises(FileExistsError):
        S.write_shards(df, out)


def test_status_marker_report(spark, tmp_path):
    listing = spark.createDataFrame([("d/a.pdf", 9), ("d/a.jsonl", 1), ("d/b.pdf", 9), ("d/b.txt", 3), ("d/c.pdf", 9), ("d/c.txt", 0)], "path string, length bigint")
    assert {r.stem: r.status for r in S.edition_status(listing).collect()} == {"a": "skipped", "b": "reused", "c": "extracted"}
    files = spark.createDataFrame([("r", 5, "h", "i", 1.0, "b", 2), ("r", 5, "h", "i", 1.0, "a", 1)], "run_id string, step bigint, manifest_hash string, image_digest string, created_at double, path string, size bigint")
    assert [f["path"] for f in json.loads(S.marker(files).first()["marker"])["files"]] == ["a", "b"]


def test_metering_stream_equals_batch(spark, tmp_path):
    samples = spark.sql("select 'r' as run_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,t) as ts, w as watts from values (0, 50.0D), (10, 0.0D), (20, 60.0D), (25, 60.0D) v(t, w)")
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = metering(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")), cap_s=12)
    name = "m" + uuid.uuid4().hex
    stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    assert [tuple(r) for r in spark.table(name).collect()] == [("r", 4, 15.0, True)]


def test_sync_over_batches(spark, tmp_path):
    looks = "run_id string, folder string, path string, size bigint, seen_at timestamp"
    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    source, ledger, calls = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "calls")
    os.mkdir(calls)

    def put(run, step, paths):
        with open(f"{calls}/put-{step}", "a") as f:
            f.write(",".join(paths) + ";")
        if step == 3 and not os.path.exists(f"{calls}/mended"):
            raise OSError("no way")

    def marker(run, step):
        open(f"{calls}/marker-{step}", "w").close()

    pruned = []
    rounds = [
        [("r", "checkpoint-1", "big", 50, at(1)), ("r", "checkpoint-1", "small", 5, at(1)), ("r", "checkpoint-2", "w", 5, at(1)), ("r", "other", "w", 1, at(1))],
        [("r", "checkpoint-1", "big", 50, at(2)), ("r", "checkpoint-1", "small", 5, at(2)), ("r", "checkpoint-2", "w", 6, at(2)), ("r", "checkpoint-3", "w", 5, at(1))],
        [("r", "checkpoint-2", "w", 6, at(3)), ("r", "checkpoint-3", "w", 5, at(2)), ("r", "checkpoint-1", "big", 50, at(3))],
        [("r", "checkpoint-3", "w", 5, at(3))],
    ]
    for n, made in enumerate(rounds):
        spark.createDataFrame(made, looks).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(looks).parquet(source)
        if n == 3:
            open(f"{calls}/mended", "w").close()
        sync(stream, ledger, put, marker, str(tmp_path / "ck"), most_bytes=20, keep=2, prune=lambda old: pruned.append(sorted(r.step for r in old.collect())), tries=1).awaitTermination()
        sent_now = sorted(r.step for r in spark.read.parquet(ledger).collect())
        assert sent_now == [[], [1], [1, 2], [1, 2, 3]][n]
        assert sorted(os.listdir(calls)) == [[], ["marker-1", "put-1"], ["marker-1", "marker-2", "put-1", "put-2", "put-3"], ["marker-1", "marker-2", "marker-3", "mended", "put-1", "put-2", "put-3"]][n]
    # smallest first, in chunks of at most 20 bytes
    assert open(f"{calls}/put-1").read() == "small;big;"
    assert pruned == [[], [], [1]]


def test_sent_retries_and_marks_last(spark, tmp_path):
    out = str(tmp_path)

    def put(run, step, paths):
        n = len(os.listdir(out))
        open(f"{out}/{n}-{step}", "w").close()
        if n < 2:
            raise OSError("later")

    plan = H.upload_plan(spark.createDataFrame([("r", 1, "a", 5), ("r", 1, "_COMPLETE.json", 1), ("r", 1, "optimizer.pt", 9)], "run_id string, step bigint, path string, size bigint"), 100, ("optimizer.pt",))
    assert [r.path for r in plan.collect()] == ["a"]
    assert [tuple(r) for r in sent(plan, put, lambda r, s: None, 3, lambda t: None).collect()] == [("r", 1, 5, None)]
    assert [r.error for r in sent(plan, put, lambda r, s: 1 / 0, 1, lambda t: None).collect()] == ["ZeroDivisionError: division by zero"]


def test_checkpoints(spark):
    listing = spark.createDataFrame([("r", f"checkpoint-{n}", p, 5) for n in (1, 2, 3, 4) for p in ("w", "_COMPLETE.json") if not (n == 4 and p != "w")] + [("r", "x", "w", 1)], "run_id string, folder string, path string, size bigint")
    markers = spark.createDataFrame([("r", "checkpoint-1", '{"manifest_hash": "h"}'), ("r", "checkpoint-2", '{"manifest_hash": "h"}'), ("r", "checkpoint-3", "broken")], "run_id string, folder string, raw string")
    recipes = spark.createDataFrame([("r", "h")], "run_id string, manifest_hash string")
    found = H.checkpoints(listing, markers)
    assert [(r.step, r.bytes, r.complete, r.manifest_hash) for r in found.orderBy("step").collect()] == [(1, 10, True, "h"), (2, 10, True, "h"), (3, 10, True, ""), (4, 5, False, "")]
    assert H.newest(found).first()["step"] == 3 and H.newest(found, recipes).first()["step"] == 2
    assert sorted(r.step for r in H.seeded(found, recipes).collect()) == [1, 2, 3] and [r.step for r in H.stale(found).collect()] == [1]
    assert sorted(r.path for r in H.restored(listing, H.newest(found, recipes)).collect()) == ["_COMPLETE.json", "w"]


def test_lines_of_many_blocks(spark, tmp_path):
    for name, n in (("a", 700), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_bytes(b"".join(b"\r\n" if i % 50 == 7 else f'{{"n": {i}}}\r\n'.encode() for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = S.shards(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.shard, r.line_no, r.raw) for r in got) == sorted((f"{s}.jsonl", i + 1, f'{{"n": {i}}}') for s, n in (("a", 700), ("b", 3)) for i in range(n) if i % 50 != 7)


def test_listing_and_binaries(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for p in ("x.pdf", "b.pdf", "d/e/c.bin"):
        (tmp_path / p).write_bytes(b"12345")
    assert sorted((r.path, r.size) for r in S.listing(spark, str(tmp_path)).collect()) == [("b.pdf", 5), ("d/e/c.bin", 5), ("x.pdf", 5)]
    assert [r.path.rsplit("/", 1)[-1] for r in S.binaries(spark, str(tmp_path), ".pdf", 1).collect()] == ["b.pdf"]


def test_logs_and_first_messages(spark):
    lines = spark.createDataFrame([("l", 1, '{"loss": 0.5, "global_step/max_steps": "3/90"}'), ("l", 2, '{"loss": 0.5}'), ("l", 3, "x")], "shard string, line_no bigint, raw string")
    assert [(r.step, r.loss) for r in S.trainer_log(lines).collect()] == [(3, 0.5)]


def test_state(spark, tmp_path):
    at = str(tmp_path / "state.json")
    assert Z.read_state(spark, at, {"consumed_s": 0}) == {"consumed_s": 0}
    Z.write_state(spark, at, {"consumed_s": 7.5, "é": 1})
    Z.write_state(spark, at, {"consumed_s": 8.5})
    assert Z.read_state(spark, at, {"consumed_s": 0, "x": 1}) == {"consumed_s": 8.5, "x": 1}
    (tmp_path / "bad.json").write_text("{")
    assert Z.read_state(spark, str(tmp_path / "bad.json"), {"a": 1}) == {"a": 1}
    assert [Z.consumed_s({"consumed_s": v}) for v in (-1, "x", None, True, float("nan"), 3)] == [0, 0, 0, 0, 0, 3]
    rows = spark.createDataFrame([("r1", "plain", None), ("r2", "a", "b")], "recording_id string, literal string, stitched string")
    Z.write_transcripts(rows, str(tmp_path / "out"), ("literal", "stitched"))
    assert sorted(p.name for p in (tmp_path / "out" / "recording_id=r2").iterdir()) == ["name=literal.txt", "name=results.json", "name=stitched.txt"]
    assert sorted(p.name for p in (tmp_path / "out" / "recording_id=r1").iterdir()) == ["name=literal.txt", "name=results.json"]


def test_comparison_report(spark, tmp_path):
    made = [(i, t, "geo", "high", "train", "g", f"f{i // 2}", i % 2 == 0, True, 0.5, 0.5 - 0.25 * (i == 3)) for i, t in enumerate(["local"] * 4 + ["control"] * 2)]
    pairs = spark.createDataFrame(made, "probe_id int, track string, category string, exposure string, membership string, source_group string, fact_id string, base_correct boolean, adapter_correct boolean, base_margin double, adapter_margin double").withColumn("delta", F.col("adapter_margin") - F.col("base_margin"))
    P.write_comparison(pairs, str(tmp_path / "r"), "Results")
    text = (tmp_path / "r.md").read_text()
    assert "| local | 4 | 50.0% | 100.0% | +50.0% | -0.062 [" in text and "| rare_local | 0 | 0.0% | 0.0% | +0.0% | +0.000 [+0.000, +0.000] | 0/0/0 |" in text
    assert "| acquisition | 2 | 0/2 | 2/2 | 2 | 0 |" in text and "| 3 | local | +0.500 | +0.250 | -0.250 |" in text
    assert json.loads((tmp_path / "r.json").read_text())["family_groups"][0]["facts"] in (1, 2)
    P.write_snapshot(pairs.withColumn("correct", F.col("base_correct")), str(tmp_path / "s"), "One run")
    text = (tmp_path / "s.md").read_text()
    assert "| rare_local | 0 | 0 | - |" in text and "| overall | 6 | 3 | 50.0% |" in text and "| 1 | local |" in text


def test_wav_round_trip(spark):
    df = spark.createDataFrame([([0.0, 0.5, -1.0, 1.0],), (None,)], "s array<double>")
    raw = [r.w for r in df.select(T.wav(F.col("s"), 16000).alias("w")).collect()]
    with wave.open(io.BytesIO(bytes(raw[0]))) as f:
        assert (f.getframerate(), f.getnchannels()) == (16000, 1) and struct.unpack("<4h", f.readframes(4)) == (0, 16384, -32768, 32767)
    assert raw[1] is None
    clip = spark.createDataFrame([([[0.0, 2.0], [1.0, 3.0], [2.0, 4.0]], 2)], "f array<array<double>>, r int")
    assert clip.select(T.resampled(T.mono(F.col("f")), F.col("r"), 4, 1.0).alias("x")).first()["x"] == pytest.approx([1.0, 1.4, 1.8, 2.2])
