from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pathfold.operators import registry as reg
from pathfold.streaming import live
from pathfold.streaming.progress import ProgressListener, observed
from pathfold.streaming.uploads import CHANGES, _change, promotions, status_changes, told_in_order

T0 = datetime(2025, 1, 1)


def drain(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_live_sessions_stream_equals_batch(spark, tmp_path):
    rows = [(u, T0 + timedelta(minutes=m), -105.0 + m / 1000, 40.0) for u in (1, 2) for m in (0, 5, 9, 90, 95, 400)]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, lon double, lat double")
    frame.write.parquet(f"{tmp_path}/in")
    batch = live.live_sessions(frame, "30 minutes").select("user_id", "started", "points")
    assert {r.points for r in batch.collect()} == {3, 2, 1}
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    drain(live.live_sessions(stream, "30 minutes", "0 seconds"), "sessions", "append")
    closed = spark.table("sessions").select("user_id", "started", "points")
    # The last session stays open until the watermark passes it.
    done = batch.where(F.col("points") > 1)
    assert closed.exceptAll(done).count() == 0 and done.exceptAll(closed).count() == 0


def test_status_and_once_only_streams(spark, tmp_path):
    rows = [("u1", "uploading", 1, T0), ("u1", "ready", 3, T0), ("u2", "queued", 2, T0), ("u1", "pending", 2, T0)]
    changes = spark.createDataFrame(rows, "upload_id string, status string, n long, at timestamp")
    changes.write.parquet(f"{tmp_path}/c")
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/c")
    drain(live.latest_status(stream), "status", "complete")
    assert {r.upload_id: r.status for r in spark.table("status").collect()} == {"u1": "ready", "u2": "queued"}
    marks = stream.select(F.col("upload_id").alias("subject"), "at")
    drain(live.notify_once(marks), "marks", "append")
    assert sorted(r.subject for r in spark.table("marks").collect()) == ["u1", "u2"]


def test_watch_archives_hands_over_new_files_once(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    seen = []

    def batch(files, _):
        seen.append(sorted(r.path.rsplit("/", 1)[-1] for r in files.select("path").collect()))

    def run():
        live.watch_archives(spark, str(folder), f"{tmp_path}/state", batch).awaitTermination(60)

    (folder / "1.gpx").write_text("<gpx/>")
    run()
    (folder / "2.gpx").write_text("<gpx/>")
    run()
    assert seen == [["1.gpx"], ["2.gpx"]]


def test_progress(spark):
    frame, seen = observed(spark.range(10))
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get["completed"] == 10
    reports = []
    listener = ProgressListener(10, lambda done, total: reports.append((done, total)))
    listener.onQueryStarted(None)
    assert reports == [(0, 10)]


def test_promotion_and_views(spark):
    uploads = spark.createDataFrame(
        [(1, "s", "ready", 1), (2, "s", "queued", 2), (3, "s", "pending", 3), (4, "s", "failed", 4)],
        "upload_id long, subject string, status string, created_at long",
    )
    counts = spark.createDataFrame([("s", 2)], "subject string, datasets long")
    rows = {r.upload_id: r.status for r in reg.promote_uploads(uploads, counts).collect()}
    assert rows == {1: "ready", 2: "ready", 3: "pending", 4: "failed"}
    none = reg.promote_uploads(uploads, counts.withColumn("datasets", F.lit(0).cast("long")))
    assert none.where("promoted").count() == 0
    ok = spark.createDataFrame([("a.ZIP", 5), ("a.zip", 0), ("b.tar", 5)], "f string, n long")
    assert [r[0] for r in ok.select(reg.valid_upload("f", "n")).collect()] == [True, False, False]


def delivered(spark, parts, folder, run):
    """Rows told by a stream that is started anew, from its checkpoint, for each delivery of rows."""
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        query = run(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        query.start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_status_changes_stream_equals_batch(spark, tmp_path):
    """Out of order within the delay, equal times, repeated rows, states passed twice, unknown and null ones."""
    def at(m):
        return T0 + timedelta(minutes=m)

    schema = "upload_id long, changed_at timestamp, status string"
    first = [(1, at(20), "queued"), (1, at(0), "uploading"), (2, at(5), "ready"), (1, at(20), "queued"), (3, at(7), None), (2, at(9), "failed")]
    second = [(1, at(12), "pending"), (1, at(70), "ready"), (1, at(75), "queued"), (3, at(71), "lost"), (3, at(71), "compiling"), (4, at(72), "failed")]
    third = [(3, at(130), "queued"), (4, at(140), "failed"), (2, at(135), "ready")]
    clock = [(None, at(1000), None)]
    parts = [spark.createDataFrame(rows, schema) for rows in (first, second, third + clock)]
    got = delivered(spark, parts, f"{tmp_path}/s", lambda s: status_changes(s, "1 hour"))
    want = reg.upload_transitions(spark.createDataFrame(first + second + third, schema))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r.allowed for r in got.collect()} == {True, False}


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    schema = "upload_id long, changed_at timestamp, status string"
    story = [[(1, T0, "uploading"), (None, T0 + timedelta(days=1), None)], [(1, T0 - timedelta(minutes=5), "failed"), (None, T0 + timedelta(days=2), None)]]
    got = delivered(spark, [spark.createDataFrame(rows, schema) for rows in story], f"{tmp_path}/s", status_changes)
    assert [(r.previous, r.status, r.allowed) for r in got.collect()] == [(None, "uploading", True)]


def test_promotions_take_the_oldest_waiting(spark, tmp_path):
    schema = "subject string, at timestamp, upload_id long, dataset_id long"

    def at(m):
        return T0 + timedelta(minutes=m)

    first = [("a", at(9), 2, None), ("a", at(3), 1, None), ("b", at(4), None, 70), ("a", at(30), None, 71)]
    second = [("a", at(100), None, 72), ("a", at(101), None, 73), ("b", at(99), 5, None), ("a", at(160), 9, None), (None, at(900), None, None)]
    parts = [spark.createDataFrame(rows, schema) for rows in (first, second)]
    got = {tuple(r) for r in delivered(spark, parts, f"{tmp_path}/s", promotions).collect()}
    assert got == {("a", 1, 71, at(30)), ("a", 2, 72, at(100)), ("b", 5, 70, at(99)), ("a", 9, 73, at(160))}


def test_uploads_share_a_state(spark, tmp_path):
    """State is kept for groups of uploads, not for each; every upload has its own memory in it."""
    schema = "upload_id string, changed_at timestamp, status string"
    rows = [(f"u{n}", T0 + timedelta(seconds=n % 7 + 60 * i), s) for n in range(300) for i, s in enumerate(("queued", "ready", "lost"))]
    clock = [(None, T0 + timedelta(days=1), None)]
    parts = [spark.createDataFrame(part, schema) for part in (rows[::2], rows[1::2] + clock)]
    states = []

    def run(stream):
        kind = CHANGES.format("string")
        return told_in_order(stream, "upload_id", "changed_at", ["status"], _change, kind, "1 hour", groups=8)

    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        told = run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet")
        query = told.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        states.append(max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]))
    assert 0 < max(states) <= 8
    got = spark.read.parquet(f"{tmp_path}/out")
    want = reg.upload_transitions(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
