import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import changefeed, delivery, orphans

DAY = 86_400_000


def brute_orphans(chunks, notes):
    out = set()
    for n in notes:
        m = n["created_at"] if n["created_at"] is not None else n["ts"] * 1000 if n["ts"] is not None else None
        refs = [("chunk_id", "id", n["chunk_id"]), ("doc", "doc", n["doc"])]
        try:
            rel = json.loads(n["related"]) if n["related"] else []
        except ValueError:
            rel = []
        refs += [("related", "id", r.get("id")) for r in rel if isinstance(r, dict)]
        for field, col, key in refs:
            key = (key or "").strip()
            if not key:
                continue
            rows = [c for c in chunks if c[col] == key]
            if not rows:
                reason = "missing"
            elif m is None or any(c["first_seen_at"] is not None and c["first_seen_at"] <= m and (c["retired_at"] is None or m < c["retired_at"]) for c in rows):
                continue
            elif any(c["first_seen_at"] is not None and c["first_seen_at"] > m for c in rows):
                reason = "late"
            else:
                reason = "deleted"
            month = None if m is None else f"{1970 + (m // (365.25 * DAY)):.0f}"
            out.add((n["id"], field, key, reason, month is None))
    return out


@pytest.fixture(scope="module")
def linked(spark):
    rng = random.Random(7)
    t = lambda: rng.randint(0, 40) * DAY // 2
    chunks = [{"id": f"p{i % 28}", "doc": f"d{i % 5}", "first_seen_at": rng.choice([t(), t(), t(), None]), "retired_at": rng.choice([None, t()]), "moment": 1} for i in range(30)]
    rel = lambda: rng.choice([None, "", "[", "[]x", '[{"id":"p1"}] ', json.dumps([{"id": f" p{rng.randint(0, 35)}\t", "page": 3}, {"id": None}, {"page": 1}]), "{}", '[{"id":"p2"},{"id":"p2"}]'])
    notes = [{"id": f"n{i}", "chunk_id": rng.choice([None, "", " \t", f"p{rng.randint(0, 35)}", f"\tp{rng.randint(0, 35)} "]), "doc": rng.choice([None, f"d{rng.randint(0, 7)}", "hot", "d1 "]), "related": rel(), "created_at": rng.choice([t(), t(), None]), "ts": rng.choice([t() // 1000, None]), "reason": "x"} for i in range(250)]
    notes += notes[:20]
    cs = "id string, doc string, first_seen_at long, retired_at long, moment int"
    ns = "id string, chunk_id string, doc string, related string, created_at long, ts long, reason string"
    frame = lambda rows, s: spark.createDataFrame([tuple(r.values()) for r in rows], s)
    return chunks, notes, frame(chunks, cs), frame(notes, ns)


@pytest.mark.parametrize("cuts", [None, [], [3 * DAY, 9 * DAY]])
def test_orphans_against_plain_reading(linked, cuts):
    chunks, notes, c, n = linked
    got = orphans.orphans(orphans.replay(c, n, cuts=cuts)).collect()
    assert {(r.note_id, r.field_name, r.ref_key, r.reason, r.period is None) for r in got} == brute_orphans(chunks, notes)
    assert len(got) == len(set(got))


@pytest.mark.parametrize("hot_rows", [1, 5])
def test_hot_keys_are_spread_over_time_and_salts(linked, hot_rows):
    chunks, notes, c, n = linked
    events, refs = orphans.parent_events(c), orphans.references(n)
    got = orphans.judge(refs, events, hot_rows).collect()
    assert {(r.note_id, r.field_name, r.ref_key, r.reason, r.moment is None) for r in got if r.reason} == brute_orphans(chunks, notes)
    assert len(got) == refs.count()


def test_a_batch_writes_only_the_parts_it_touches(spark, linked):
    _, _, c, n = linked
    events, refs = orphans.parent_events(c), orphans.references(n)
    state = orphans.advance(None, events, refs)
    one = spark.createDataFrame([("doc", "hot", 10**12, 1, 10**12)], "kind string, ref_key string, at long, delta long, seen long")
    after = orphans.advance(state, one, refs.limit(0))
    part = one.select(F.pmod(F.xxhash64("kind", "ref_key"), F.lit(orphans.PARTS))).first()[0]
    assert {k: v for k, v in after.pending.items() if v == 2} == {part: 2}
    assert {r.reason for r in orphans.orphans(after).where("ref_key = 'hot' AND period IS NOT NULL").collect()} == {"late"}
    assert {r.reason for r in orphans.orphans(state).where("ref_key = 'hot'").collect()} == {"missing"}  # the state before is still there
    again = orphans.advance(after, one, refs)  # repeated input changes nothing
    assert {tuple(r) for r in orphans.orphans(again).collect()} == {tuple(r) for r in orphans.orphans(after).collect()} and orphans.orphans(again).count() == orphans.orphans(after).count()


def test_snapshots_follow_the_batches(linked):
    _, _, c, n = linked
    got = orphans.snapshots(c, n, cuts=[5 * DAY]).collect()
    last = {(r.field_name, r.period, r.reason, r.n_refs) for r in got if r.batch == 2}
    assert {r.batch for r in got} == {1, 2} and last == {tuple(r) for r in orphans.snapshot(orphans.replay(c, n)).collect()}


def test_late_parents_and_deletions_change_the_state(spark):
    ref = spark.createDataFrame([("n", "chunk_id", "page", "k", 10)], "note_id string, field_name string, kind string, ref_key string, moment long")
    ev = lambda *rows: spark.createDataFrame(list(rows), "kind string, ref_key string, at long, delta long, seen long")
    reasons = []
    state = orphans.advance(None, ev(), ref)
    reasons.append(orphans.orphans(state).first().reason)
    state = orphans.advance(state, ev(("page", "k", 20, 1, 20)), ref.limit(0))  # a parent arrives after the moment
    reasons.append(orphans.orphans(state).first().reason)
    state = orphans.advance(state, ev(("page", "k", 5, 1, 5)), ref.limit(0))  # one was there, its record came late
    reasons.append(orphans.orphans(state).first())
    state = orphans.advance(state, ev(("page", "k", 8, -1, None)), ref.limit(0))  # but it had been deleted
    reasons.append(orphans.orphans(state).first().reason)
    assert reasons == ["missing", "late", None, "late"]


def test_orphans_of_empty_tables(linked):
    _, _, c, n = linked
    assert orphans.orphans(orphans.replay(c, n.limit(0))).count() == 0
    assert {r.reason for r in orphans.orphans(orphans.replay(c.limit(0), n, cuts=[DAY])).select("reason").distinct().collect()} == {"missing"}


def test_periods_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(1735689600000,), (-1,), (None,)], "m long")
        assert [r.p for r in df.select(orphans.period(F.col("m")).alias("p")).collect()] == ["2025-01", "1969-12", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def feed(spark, rows):
    return spark.createDataFrame(rows, "seq long, event_id string, type string, payload string, note_id string")


def test_one_object(spark):
    texts = {'{"id":"a"}': "a", ' {"id":"a"} \n': "a", '{"id":"a"} x': None, '{"id":"a"}{"id":"b"}': None, '{"id":"a"': None, '{"id":"a"}}': None, "[1]": None, "{'id':'a'}": None, "": None, "null": None, '"id": "a"}': None, None: None}
    df = spark.createDataFrame([(k,) for k in texts], "p string")
    assert {r.p: r.i for r in df.select("p", changefeed.one_object(F.col("p"), "id: STRING")["id"].alias("i")).collect()} == texts


def test_versions_and_repeats(spark):
    rows = [
        (1, "A-1", "note.upserted", '{"id":"n","updated_at":5}', ""), (2, "a1", "note.upserted", '{"id":"n","updated_at":99}', ""),
        (3, "b", " NOTE.Deleted\t", '{"id":"n","updated_at":"7"}', ""), (4, "c", "note.upserted", '{"id":"n","updated_at":"7x","ts":8}', ""),
        (5, "d", "note.upserted", '{"id":"m","updated_at":null}', ""), (6, None, "note.upserted", '{"id":"m","updated_at":12.0}', ""),
        (7, None, "note.upserted", '{"id":"m","updated_at":12}', ""), (8, "e", "session.renamed", '{"id":"m","updated_at":50}', ""), (9, "f", None, None, ""), (10, "g", "note.upserted", '{"updated_at":5}', ""),
        (11, "h", "note.upserted", '{"id":"m","updated_at":true}', ""),
    ]
    got = {(r.note_id, r.seq, r.version, r.is_delete) for r in changefeed.read_changes(feed(spark, rows)).collect()}
    assert got == {("n", 1, 5, 0), ("n", 3, 7, 1), ("n", 4, 8000, 0), ("m", 6, 12, 0), ("m", 7, 12, 0)}


def test_fold_does_not_depend_on_order_or_batches(spark):
    rng = random.Random(3)
    rows = [(i, f"e{rng.randint(0, 150)}", rng.choice(["note.upserted", "note.deleted"]), json.dumps({"id": rng.choice(["hot", f"n{rng.randint(0, 20)}"]), "updated_at": rng.randint(0, 9)}), "") for i in range(300)]
    notes = spark.createDataFrame([(f"n{i % 25}", rng.randint(0, 9), None) for i in range(30)] + [("old", None, 2), ("none", None, None), (None, 3, 3)], "id string, updated_at long, ts long")
    tombs = spark.createDataFrame([("n3", 9), ("n3", 9), ("gone", 1), ("late", None)], "id string, updated_at long")
    once, best = {}, {}
    for s, e, t, p, _ in rows:
        once.setdefault(e, (s, t, json.loads(p)))
    for s, t, o in once.values():
        k = (o["updated_at"], t == "note.deleted", s)
        best[o["id"]] = max(best.get(o["id"], k), k)
    base = changefeed.base_rows(notes, tombs)
    for r in base.collect():
        k = (r.version, r.is_delete == 1, r.seq)
        best[r.note_id] = max(best.get(r.note_id, k), k)
    changes = changefeed.read_changes(feed(spark, rows))
    whole = {r.note_id: (r.version, r.is_delete == 1, r.seq) for r in changefeed.fold(base, changes).collect()}
    assert whole == best
    parts = [changes.where(F.pmod("seq", F.lit(3)) == k) for k in (2, 0, 1)]
    state = changefeed.fold(parts[0])
    for p in [*parts[1:], base, parts[0]]:
        state = changefeed.fold(state, p)
    assert {r.note_id: (r.version, r.is_delete == 1, r.seq) for r in state.collect()} == best
    assert changefeed.fold(base.limit(0), changes.limit(0)).count() == 0


def test_current_notebook_keeps_deletions_out(spark):
    cols = "id string, doc string, page int, mode string, selection string, session string, status string, updated_at long, ts long, payload string"
    notes = spark.createDataFrame([("a", "d", 1, "ask", "s", "", "done", 5, None, "z"), ("b", "d", 1, "ask", "s", "", "done", 5, None, "z")], cols)
    tombs = spark.createDataFrame([("c", 9)], "id string, updated_at long")
    rows = [(1, "x", "note.upserted", '{"id":"c","updated_at":8}', ""), (2, "y", "note.deleted", '{"id":"b","updated_at":5}', ""), (3, "z", "note.upserted", '{"id":"a","updated_at":6,"page":2,"doc":"q"}', "")]
    got = changefeed.current_notebook(notes, tombs, feed(spark, rows)).collect()
    assert [(r.note_id, r.version, r.decided_by, r.doc, r.page) for r in got] == [("a", 6, 3, "q", 2)]


@pytest.mark.parametrize("most", [delivery.MAX_BITSETS, 1])
def test_one_row_per_message(spark, tmp_path, most):
    rng = random.Random(1)
    ids = ["AB-C", "abc", None, "", "hot", "HOT", *[f"m{i}" for i in range(40)]]
    rows = [(i if i % 50 else None, rng.choice(ids), "wide" * 3, i) for i in range(1, 700)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "n long, id string, dv_key string, dv_file int").repartition(5).write.parquet(path)
    kept = delivery.one_row_per_message(spark, path, "id", "n", most)
    gone = delivery.surplus_rows(spark, path, "id", "n", most)
    assert kept.columns == gone.columns == ["n", "id", "dv_key", "dv_file"]
    k, g = kept.collect(), gone.collect()
    assert sorted(r.dv_file for r in k + g) == list(range(1, 700))
    first = {}
    for n, i, _, x in rows:
        if i is not None:
            key = i.lower().replace("-", "")
            first[key] = min(first.get(key, (True, 0)), (n is None, n or 0))
    named = [r for r in k if r.id is not None]
    assert {(r.id.lower().replace("-", ""), r.n) for r in named} == {(key, None if v[0] else v[1]) for key, v in first.items()} and len(named) == len(first)
    assert all(r.id is not None for r in g)
    delivery.write_one_row_per_message(spark, path, "id", "n", str(tmp_path / "out.parquet"), most)
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == len(k)


def test_one_file_of_more_rows_than_a_broadcast_holds(spark, tmp_path):
    path = str(tmp_path / "big.parquet")
    n = 5 * delivery.CHUNK + 100
    spark.range(n).select("id", F.when(F.col("id") % 3 != 0, (F.col("id") - F.col("id") % 3).cast("string")).otherwise(F.col("id").cast("string")).alias("m")).coalesce(1).write.parquet(path)
    vectors = delivery.deletion_vectors(spark, path, "m", "id").cache()
    assert vectors.count() == 6 and delivery._grouping(vectors, 2) == (1, 1, {0: 6})
    assert sorted(r.id for r in delivery.one_row_per_message(spark, path, "m", "id", 2).collect()) == list(range(0, n, 3))
    assert delivery.surplus_rows(spark, path, "m", "id", 2).count() == n - len(range(0, n, 3))


def test_a_group_reads_only_its_files(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(80).select("id", F.lit("a").alias("m")).repartition(8).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # at least a partition per file
    try:
        scan = spark.read.parquet(path)
        parts = [scan.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(4)) == g).rdd.getNumPartitions() for g in range(4)]
        assert sum(parts) == scan.rdd.getNumPartitions() and max(parts) < sum(parts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_messages(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "n long, id string").write.parquet(path)
    assert delivery.one_row_per_message(spark, path, "id", "n").count() == 0 and delivery.surplus_rows(spark, path, "id", "n").count() == 0


def test_repeated_rows_with_equal_order(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    spark.createDataFrame([(1, "a")] * 7 + [(None, "b")] * 3, "n long, id string").coalesce(1).write.parquet(path)
    assert sorted(r.id for r in delivery.one_row_per_message(spark, path, "id", "n").collect()) == ["a", "b"]
