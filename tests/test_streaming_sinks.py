"""Streams equal their batch twins; the job table holds every write."""

import json
import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tuneframe import constants as K
from tuneframe import sinks
from tuneframe.operators import jobs as J
from tuneframe.operators import validation as V
from tuneframe.plans import fixtures as FX
from tuneframe.sources.files import list_datasets
from tuneframe.streaming import jobs as SJ
from tuneframe.streaming.validate import stream_validate


def _event_files(spark, tmp_path, n_files=4):
    ev = FX.job_events(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    d = str(tmp_path / "events")
    ev.repartition(n_files).write.json(d)
    return ev, d


def _run_memory(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_stream_job_state_equals_batch(spark, tmp_path):
    ev, d = _event_files(spark, tmp_path)
    stream = spark.readStream.schema(SJ.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(d)
    got = _run_memory(SJ.stream_job_state(stream), "job_state_stream", "complete")
    cols = ["job_id", "status", "step", "loss", "error"]
    want = J.fold_state(ev).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    # the null loss named by a progress update survives
    assert got.where(F.col("loss").isNull()).count() == want.where(F.col("loss").isNull()).count()


def test_stream_transitions_equal_batch(spark, tmp_path):
    # One file per seq range, read in order; the delay covers the whole range of
    # times, and one far later event of another job lets the watermark pass all.
    ev = FX.job_events(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    d = tmp_path / "ordered"
    d.mkdir()
    pdf = ev.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).toPandas()
    for i, lo in enumerate(range(0, int(pdf["seq"].max()) + 1, 5)):
        part = pdf[(pdf["seq"] > lo) & (pdf["seq"] <= lo + 5)]
        part.to_json(d / f"part-{i:04d}.json", orient="records", lines=True)
        os.utime(d / f"part-{i:04d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    (d / "part-9999.json").write_text(json.dumps({"job_id": -1, "seq": 1, "ts": "2099-01-01 00:00:00", "status": "queued"}))
    os.utime(d / "part-9999.json", (1_700_009_999, 1_700_009_999))
    d = str(d)
    stream = spark.readStream.schema(SJ.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(d)
    got = _run_memory(SJ.stream_transitions(stream, watermark="400 days"), "transitions_stream", "append")
    got_counts = got.groupBy("from_status", "to_status", "allowed").count()
    want = J.status_transitions(ev).select("from_status", "to_status", "allowed", "count")
    assert sorted(map(tuple, got_counts.collect())) == sorted(map(tuple, want.collect()))


def test_stream_interrupted_by_event_time(spark, tmp_path):
    d = tmp_path / "ev"
    d.mkdir()
    rows = [
        (1, 1, "2024-01-01 00:00:00", "queued"), (1, 2, "2024-01-01 00:01:00", "running"),
        (2, 1, "2024-01-01 00:00:00", "queued"), (2, 2, "2024-01-01 00:05:00", "completed"),
    ]
    late = [(3, 1, "2024-01-01 05:00:00", "running")]
    for i, batch in enumerate([rows, late]):
        with open(d / f"part-{i}.json", "w") as fh:
            for j, s, ts, st in batch:
                fh.write(json.dumps({"job_id": j, "seq": s, "ts": ts, "status": st}) + "\n")
        os.utime(d / f"part-{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SJ.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(d))
    q = SJ.stream_interrupted(stream, timeout="1 hour").writeStream.format("memory").queryName("interrupted") \
        .outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("interrupted").count() > 0:
                break
            # an extra empty-input batch lets the advanced watermark fire timers
            (d / f"tick-{_}.json").write_text("")
    finally:
        q.stop()
    out = spark.table("interrupted").collect()
    assert [(r.job_id, r.status) for r in out] == [(1, "failed")]


def test_stream_validate_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "not_an_id.jsonl").write_text("{}\n")
    hexid = "0123456789abcdef" * 2
    (src / f"{hexid}_x.jsonl.part").write_text("{}\n")
    good = "\n".join(json.dumps({"k": i}) for i in range(3)) + "\n"
    (src / f"{hexid}_a.jsonl").write_text(good)
    (src / f"{hexid}_b.jsonl").write_text(good + "[1]\n{bad\n")
    (src / f"{hexid}_c.jsonl").write_text("\n" + json.dumps({"q": 1}) + "\n")
    out = str(tmp_path / "out")
    q = stream_validate(spark, str(src), out, str(tmp_path / "ckpt"), required=("k",), expected=3,
                        max_files_per_trigger=1)
    q.awaitTermination(300)
    got = {os.path.basename(r.file_id): (r.error, r.record_count, r.valid)
           for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert {r.upload_id for r in spark.read.parquet(f"{out}/verdicts").collect()} == {hexid}
    batch = {r.filename: (r.error, r.record_count if r.error is None else None, r.valid)
             for r in V.validate_files(spark, str(src), ("k",), 3).collect()}
    assert {k.split("_", 1)[1]: (v[0], v[1] if v[0] is None else None, v[2] if v[0] is None else None)
            for k, v in got.items()} == {k: (v[0], v[1], v[2] if v[0] is None else None) for k, v in batch.items()}
    lines = spark.read.parquet(f"{out}/lines")
    assert {r.state for r in lines.collect()} == {"published", "quarantined"}
    assert spark.read.parquet(f"{out}/empty").count() == 0


def test_stream_validate_reports_empty_files_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    hexid = "0123456789abcdef" * 2
    (src / f"{hexid}_a.jsonl").write_text(json.dumps({"k": 1}) + "\n")
    (src / f"{hexid}_empty.jsonl").write_text("")
    out = str(tmp_path / "out")
    for run in range(2):  # a second run (new batches) must not report it again
        if run:
            (src / f"{hexid}_b.jsonl").write_text(json.dumps({"k": 2}) + "\n")
        q = stream_validate(spark, str(src), out, str(tmp_path / "ckpt"), required=("k",), expected=1,
                            max_files_per_trigger=1)
        q.awaitTermination(300)
    empty = spark.read.parquet(f"{out}/empty").collect()
    assert [(os.path.basename(r.file_id), r.record_count, r.valid) for r in empty] == \
        [(f"{hexid}_empty.jsonl", 0, False)]


def test_stream_validate_takes_a_backlog_in_few_batches_and_lists_it_once(spark, tmp_path, monkeypatch):
    from tuneframe.streaming import validate as SV
    src = tmp_path / "in"
    src.mkdir()
    names = [f"{i:032x}_a.jsonl" for i in range(12)]
    for i, name in enumerate(names):
        (src / name).write_text("" if i == 11 else json.dumps({"k": i}) + "\n")
    listings = []
    monkeypatch.setattr(SV, "list_datasets", lambda *a: listings.append(a) or list_datasets(*a))
    monkeypatch.setattr(SV, "BATCH_FILES", 2)
    monkeypatch.setattr(SV, "BACKLOG_BATCHES", 3)
    out = str(tmp_path / "out")
    stream_validate(spark, str(src), out, str(tmp_path / "ckpt"), required=("k",), expected=1).awaitTermination(300)
    rows = spark.read.parquet(f"{out}/verdicts").collect()
    assert sorted(os.path.basename(r.file_id) for r in rows if r.valid) == names[:11]
    assert len({r.batch_id for r in rows}) == 3 and len(listings) == 1
    assert [os.path.basename(r.file_id) for r in spark.read.parquet(f"{out}/empty").collect()] == names[11:]
    # A run over three files that come later lists the folder once more.
    for i in range(12, 15):
        (src / f"{i:032x}_a.jsonl").write_text(json.dumps({"k": i}) + "\n")
    (src / f"{15:032x}_a.jsonl").write_text("")
    stream_validate(spark, str(src), out, str(tmp_path / "ckpt"), required=("k",), expected=1).awaitTermination(300)
    assert spark.read.parquet(f"{out}/verdicts").count() == 14 and len(listings) == 2
    assert spark.read.parquet(f"{out}/empty").count() == 2


JOB_ROW = "job_id long, status string, updated_at double"


def _latest(spark, table):
    return {r.job_id: r.status for r in sinks.read_latest(spark, table, order="updated_at").collect()}


def test_appended_rows_latest_wins_and_replays_change_nothing(spark, tmp_path):
    table = str(tmp_path / "jobs")
    sinks.append_rows(spark.createDataFrame([(1, "running", 1.0), (2, "queued", 1.0)], JOB_ROW), table, "q", 0)
    second = spark.createDataFrame([(1, "completed", 2.0), (3, "queued", 2.0)], JOB_ROW)
    sinks.append_rows(second, table, "q", 1)
    before = _latest(spark, table)
    sinks.append_rows(second, table, "q", 1)  # a replayed batch
    sinks.append_rows(spark.createDataFrame([(3, "stale", 0.1)], JOB_ROW), table, "q", 2)
    assert _latest(spark, table) == before == {1: "completed", 2: "queued", 3: "queued"}
    sinks.append_rows(spark.createDataFrame([(3, "equal time, later batch", 2.0)], JOB_ROW), table, "q", 3)
    assert _latest(spark, table)[3] == "equal time, later batch"


def test_two_writers_and_later_columns(spark, tmp_path):
    table = str(tmp_path / "jobs")
    for i in range(8):
        sinks.append_rows(spark.createDataFrame([(i % 4, f"s{i}", float(i))], JOB_ROW), table, f"writer-{i % 2}", 0)
    more = spark.createDataFrame([(3, "s9", 9.0, "late column")], JOB_ROW + ", note string")
    sinks.append_rows(more, table, "writer-0", 1)
    assert _latest(spark, table) == {0: "s4", 1: "s5", 2: "s6", 3: "s9"}
    notes = {r.job_id: r.note for r in sinks.read_latest(spark, table, order="updated_at").collect()}
    assert notes == {0: None, 1: None, 2: None, 3: "late column"}


def test_compaction_writes_a_new_table(spark, tmp_path):
    table, new = str(tmp_path / "jobs"), str(tmp_path / "compacted")
    for i in range(6):
        sinks.append_rows(spark.createDataFrame([(i % 2, f"s{i}", float(i))], JOB_ROW), table, "q", i)
    sinks.compact(spark, table, new, order="updated_at")
    assert spark.read.parquet(new).count() == 2 and spark.read.parquet(table).count() == 6
    sinks.append_rows(spark.createDataFrame([(1, "s7", 7.0)], JOB_ROW), new, "q", 6)
    assert _latest(spark, new) == {0: "s4", 1: "s7"}


def test_new_checkpoint_over_an_old_job_table_loses_nothing(spark, tmp_path):
    table = str(tmp_path / "jobs")
    for n, (job, status) in enumerate([("a" * 32, "running"), ("b" * 32, "queued")]):
        d = tmp_path / f"ev{n}"
        d.mkdir()
        (d / "part.json").write_text(json.dumps({"job_id": job, "seq": 1, "ts": "2024-01-01T00:00:00Z", "status": status}))
        stream = spark.readStream.schema(SJ.event_schema()).json(str(d))
        SJ.sink_job_state(stream, table, str(tmp_path / f"ckpt{n}")).awaitTermination(300)
    got = {r.job_id: r.status for r in sinks.read_latest(spark, table).collect()}
    assert got == {"a" * 32: "running", "b" * 32: "queued"}


def _transitions_of(spark, d, name):
    stream = spark.readStream.schema(SJ.event_schema()).option("maxFilesPerTrigger", 1).json(str(d))
    out = _run_memory(SJ.stream_transitions(stream), name, "append")
    return sorted((r.job_id[0], r.from_status, r.to_status) for r in out.collect())


def test_stream_transitions_take_late_events_in_order(spark, tmp_path):
    d = tmp_path / "late"
    d.mkdir()
    job, tick = "a" * 32, "f" * 32
    files = [[(job, 1, "00:00", "queued"), (job, 3, "00:04", "running")], [(job, 2, "00:02", "loading")],
             [(tick, 1, "05:00", "queued")], [(tick, 2, "06:00", "loading")]]
    for i, rows in enumerate(files):
        (d / f"p{i}.json").write_text("\n".join(json.dumps(
            {"job_id": j, "seq": s, "ts": f"2024-01-01T{t}:00Z", "status": st}) for j, s, t, st in rows))
        os.utime(d / f"p{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    assert [x for x in _transitions_of(spark, d, "late_transitions") if x[0] == "a"] == \
        [("a", "loading", "running"), ("a", "queued", "loading")]


def _event_file(d, i, rows):
    (d / f"p{i}.json").write_text("\n".join(json.dumps(
        {"job_id": j * 32, "seq": s, "ts": f"2024-01-0{day}T{t}:00Z", "status": st}) for j, s, day, t, st in rows))
    os.utime(d / f"p{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def _append_run(spark, d, make, out):
    """One finite run of a stream over ``d``, from the checkpoint in ``out``."""
    stream = spark.readStream.schema(SJ.event_schema()).option("maxFilesPerTrigger", 1).json(str(d))
    make(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}/ckpt").option("path", f"{out}/rows") \
        .trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.parquet(f"{out}/rows").collect()


def test_transition_state_survives_a_restart(spark, tmp_path):
    d = tmp_path / "ev"
    d.mkdir()
    _event_file(d, 0, [("a", 1, 1, "00:00", "queued"), ("a", 3, 1, "00:04", "running")])
    assert _append_run(spark, d, SJ.stream_transitions, tmp_path / "out") == []
    _event_file(d, 1, [("a", 2, 1, "00:02", "loading"), ("b", 1, 1, "00:03", "queued")])
    _append_run(spark, d, SJ.stream_transitions, tmp_path / "out")
    _event_file(d, 2, [("f", 1, 2, "05:00", "queued")])
    _append_run(spark, d, SJ.stream_transitions, tmp_path / "out")
    _event_file(d, 3, [("a", 4, 2, "06:00", "completed"), ("f", 2, 3, "06:00", "loading")])
    got = _append_run(spark, d, SJ.stream_transitions, tmp_path / "out")
    assert sorted((r.job_id[0], r.from_status, r.to_status, r.allowed) for r in got) == [
        ("a", "loading", "running", True), ("a", "queued", "loading", True), ("a", "running", "completed", True)]


def test_silence_timer_fires_once_and_survives_a_restart(spark, tmp_path):
    d = tmp_path / "ev"
    d.mkdir()
    _event_file(d, 0, [("a", 2, 1, "00:01", "running"), ("b", 1, 1, "00:00", "queued"), ("c", 9, 1, "00:05", "completed")])
    assert _append_run(spark, d, SJ.stream_interrupted, tmp_path / "out") == []
    # an older event of a changes nothing; b moves on; the tick passes a's deadline only
    _event_file(d, 1, [("a", 1, 1, "00:02", "completed"), ("b", 2, 1, "01:00", "running"), ("f", 1, 1, "01:20", "completed")])
    got = _append_run(spark, d, SJ.stream_interrupted, tmp_path / "out")
    assert [(r.job_id[0], r.status, r.error) for r in got] == [("a", "failed", K.INTERRUPTED_ERROR)]
    _event_file(d, 2, [("a", 3, 1, "00:03", "running"), ("f", 2, 1, "09:00", "completed")])  # too late for a: dropped
    got = _append_run(spark, d, SJ.stream_interrupted, tmp_path / "out")
    assert sorted(r.job_id[0] for r in got) == ["a", "b"]
    _event_file(d, 3, [("f", 3, 2, "09:00", "completed")])
    assert len(_append_run(spark, d, SJ.stream_interrupted, tmp_path / "out")) == 2


def test_publish_split_and_training_text(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "{}"), (2, 1, "[")], "file_id long, line_no long, line string")
    states = spark.createDataFrame([(1, "published"), (2, "quarantined")], "file_id long, state string")
    out = str(tmp_path / "pub")
    sinks.publish_if_wellformed(lines, states, out)
    got = {(r.file_id, r.state) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "published"), (2, "quarantined")}
    tt = FX.records(spark, SF_SMALL).select("record_id", F.lit("x").alias("text"))
    sinks.write_training_text(tt, str(tmp_path / "tt"), 3)
    table = spark.read.parquet(str(tmp_path / "tt"))
    assert table.columns == ["text"] and table.count() == 34


def test_stream_job_state_into_the_job_table(spark, tmp_path):
    ev, d = _event_files(spark, tmp_path)
    stream = spark.readStream.schema(SJ.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(d)
    table = str(tmp_path / "jobs")
    q = SJ.sink_job_state(stream, table, str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    assert spark.read.parquet(table).select(sinks.BATCH).distinct().count() >= 2
    cols = ["job_id", "status", "step", "loss", "error"]
    got = sinks.read_latest(spark, table).select(*cols)
    want = J.fold_state(ev).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
