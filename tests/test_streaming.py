import json
import random

from pyspark.sql import functions as F

from leafmill.operators import changefeed
from leafmill.streaming import notes


def run_stream(spark, df, tmp_path, name, schema=None, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def events_of(spark, tmp_path, rows, schema, files=3):
    src = tmp_path / "src"
    src.mkdir()
    step = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * step : (n + 1) * step]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"{n:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))


def test_repeated_messages_in_a_stream(spark, tmp_path):
    rows = [(f"{'AB-' if i % 2 else 'ab'}{i // 2}", i) for i in range(60)]
    stream = events_of(spark, tmp_path, rows, "id string, n long").withColumn("at", F.timestamp_seconds("n"))
    got = run_stream(spark, notes.once(stream, "id", "at"), tmp_path, "once")
    assert len(got) == 30 and "message_key" not in got[0].asDict()


def test_state_table_follows_the_feed(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"e{i * 7 % 110}", rng.choice(["note.upserted", "note.deleted"]), json.dumps({"id": f"n{rng.randint(0, 12)}", "updated_at": rng.randint(0, 20)}) if i % 17 else "{", rng.choice([0, 5])) for i in range(150)]
    schema = "seq long, event_id string, type string, payload string, attempts int"
    stream = events_of(spark, tmp_path, rows, schema)
    state, dead = str(tmp_path / "state"), str(tmp_path / "dead")
    q = stream.writeStream.foreachBatch(notes.apply_batch(spark, state, dead)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = changefeed.fold(changefeed.read_changes(spark.createDataFrame(rows, schema)))
    assert {tuple(r) for r in notes.latest(spark, state).collect()} == {tuple(r) for r in want.collect()}
    assert spark.read.parquet(dead).count() == sum(p == "{" or a >= 5 for *_, p, a in rows)
    assert notes.latest(spark, str(tmp_path / "nowhere")) is None


def test_rows_without_identifier_and_late_rows_stay(spark, tmp_path):
    rows = [(None, 0), ("a", 0), (None, 1), ("b", 90 * 86400), ("A", 90 * 86400), ("c", 5)]
    stream = events_of(spark, tmp_path, rows, "id string, n long").withColumn("at", F.timestamp_seconds("n"))
    got = run_stream(spark, notes.once(stream, "id", "at"), tmp_path, "once_late")
    assert sorted((r.id or "").lower() for r in got) == ["", "", "a", "b", "c"]


def test_messages_repeated_in_later_batches_count_once(spark, tmp_path):
    change = lambda v, i="n": json.dumps({"id": i, "updated_at": v})
    schema = "seq long, event_id string, type string, payload string, attempts int"
    up = "note.upserted"
    rows = [(5, "a", up, change(1), 0), (6, "b", up, change(1), 0), (9, "A", up, change(1), 0), (8, "z", up, change(3, "m"), 0), (7, "c", up, change(2, "m"), 0), (3, "Z", up, change(1, "m"), 0)]
    apply = notes.apply_batch(spark, str(tmp_path / "state"))
    for n in range(3):
        apply(spark.createDataFrame(rows[2 * n : 2 * n + 2], schema), n)
    want = changefeed.fold(changefeed.read_changes(spark.createDataFrame(rows, schema)))
    got = {(r.note_id, r.version, r.seq) for r in notes.latest(spark, str(tmp_path / "state")).collect()}
    assert got == {(r.note_id, r.version, r.seq) for r in want.collect()} == {("n", 1, 6), ("m", 2, 7)}


def test_snapshot_displaced_messages_and_log(spark, tmp_path):
    """Copies in later batches with lower and higher seq, also under another note's id, over a snapshot: the state is that of one batch."""
    rng = random.Random(4)
    schema = "seq long, event_id string, type string, payload string, attempts int"
    rows = [(i, f"m{rng.randint(0, 30)}", rng.choice(["note.upserted", "note.deleted"]), json.dumps({"id": f"n{rng.randint(0, 5)}", "updated_at": rng.randint(0, 6)}), 0) for i in range(90)]
    rng.shuffle(rows)
    rows = [(95, "moved", "note.upserted", '{"id": "gone", "updated_at": 1}', 0), *rows[:-2], (94, "moved", "note.upserted", '{"id": "n1", "updated_at": 1}', 0)]
    base = spark.createDataFrame([("n0", 6, 1, changefeed.BASE_SEQ), ("old", 3, 0, changefeed.BASE_SEQ)], "note_id string, version long, is_delete int, seq long")
    folder = str(tmp_path / "state")
    notes.start(spark, folder, base)
    apply = notes.apply_batch(spark, folder)
    for n in range(3):
        apply(spark.createDataFrame(rows[30 * n : 30 * n + 30], schema), n)
    apply(spark.createDataFrame(rows[60:], schema), 2)  # run again
    want = changefeed.fold(base, changefeed.read_changes(spark.createDataFrame(rows, schema)))
    state = {tuple(r) for r in notes.latest(spark, folder).collect()}
    assert state == {tuple(r) for r in want.collect()}
    log = spark.read.parquet(f"{folder}/log").collect()
    newest = {}
    for r in log:
        newest[r.note_id] = max(newest.get(r.note_id, (-1,)), (r.batch, r.version, r.seq))
    assert {(k, v[1], v[2]) for k, v in newest.items()} == {(n, v, s) for n, v, d, s in state if n != "old"} | {("gone", 1, 95)} - {("n0", 6, changefeed.BASE_SEQ)}
