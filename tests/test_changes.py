"""Change envelopes, running tables, pointers and counted ingest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyweir.sources.shared import Conflict, Pointer
from tallyweir.streaming import changes as ch
from tallyweir.streaming import jobs

FIELDS = "id long, name string, minute int"


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in rows))


def _envelope(op, ms, before=None, after=None, lsn=None, wrapped=False):
    body = {"before": before, "after": after, "op": op, "source": {"ts_ms": ms} | ({"lsn": lsn} if lsn is not None else {}), "ts_ms": ms + 5}
    return {"schema": {}, "payload": body} if wrapped else body


def test_envelopes_under_schemas_that_change(spark):
    rows = [
        _envelope("c", 1000, after={"id": 1, "name": "a", "minute": 7}),
        _envelope("u", 2000, before={"id": 1}, after={"id": 1, "name": "b", "minute": 8, "added": "x"}, lsn=4, wrapped=True),  # a column that is new
        _envelope("u", 3000, after={"id": 1, "name": "c", "minute_of_hour": 9}),  # renamed
        _envelope("u", 4000, after={"id": 1, "minute": 9}),  # dropped
        _envelope("d", 5000, before={"id": 1, "name": "c"}),  # no after
        _envelope("d", 6000, before={"id": 2}, after={}),  # an empty one
        {"id": 3, "name": "flat", "minute": 1, "__op": "r", "__source_ts_ms": 7000},
        "{broken", "[1]", _envelope("x", 1, after={}), {"op": "c", "after": {"id": 1}}, _envelope("c", 9000), "{}",
    ]
    raw = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in rows] + [(None,)], "value string")
    got = [(r.id, r.name, r.minute, r.op, r.source_ms, r.sequence, r.reason) for r in ch.decode_changes(raw, FIELDS).collect()]
    assert got[:7] == [
        (1, "a", 7, "c", 1000, 0, None), (1, "b", 8, "u", 2000, 4, None), (1, "c", None, "u", 3000, 0, None), (1, None, 9, "u", 4000, 0, None),
        (1, "c", None, "d", 5000, 0, None), (2, None, None, "d", 6000, 0, None), (3, "flat", 1, "r", 7000, 0, None),
    ]
    assert [r[-1] for r in got[7:]] == ["malformed", "malformed", "no_op", "no_time", "no_row", "no_op", "tombstone"]
    renamed = ch.decode_changes(raw, FIELDS, {"minute": ["minute_of_hour"]}).collect()
    assert renamed[2].minute == 9 and renamed[0].minute == 7
    assert ch.decode_changes(raw.limit(0), FIELDS).count() == 0


def _changes(seed, n, keys):
    """Changes with one time each, some late, some twice."""
    rng, rows = random.Random(seed), []
    for ms in range(1, n + 1):
        k, op = rng.randrange(keys), rng.choice("cuuud")
        image = {"id": k, "name": f"n{ms}", "minute": ms % 60}
        rows.append(_envelope(op, ms, before={"id": k} if op == "d" else None, after=None if op == "d" else image))
    for _ in range(n // 10):
        rows.insert(rng.randrange(len(rows)), rng.choice(rows))
    for _ in range(n // 5):
        a, b = rng.randrange(len(rows)), rng.randrange(len(rows))
        rows[a], rows[b] = rows[b], rows[a]
    return rows


def _last_by_key(rows):
    newest = {}
    for r in rows:
        k = (r["after"] or r["before"])["id"]
        if k not in newest or r["source"]["ts_ms"] > newest[k]["source"]["ts_ms"]:
            newest[k] = r
    return sorted((k, r["after"]["name"], r["after"]["minute"]) for k, r in newest.items() if r["op"] != "d")


def test_running_table_equals_the_batch_after_restarts(spark, tmp_path):
    rows = _changes(1, 300, 40)
    table = lambda: ch.KeyedTable(spark, str(tmp_path / "table"), FIELDS, ["id"], buckets=4)
    stream = lambda: ch.decode_changes(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), FIELDS).where("reason is null")
    for part in range(6):
        _put(tmp_path / "in", f"{part}.json", rows[part * 60 : part * 60 + 60])
        if part % 2:
            ch.materialise(stream(), table(), str(tmp_path / "mark"), compact_every=3).awaitTermination(120)  # a new query each time
    got = sorted(map(tuple, table().current().collect()))
    assert got == _last_by_key(rows)
    batch = jobs.current_rows(ch.decode_changes(spark.read.text(str(tmp_path / "in")), FIELDS).where("reason is null"), ["id"], ["source_ms", "sequence"])
    assert sorted(map(tuple, batch.select("id", "name", "minute").collect())) == got
    # a batch that comes again, before and after it was folded, changes nothing
    again = ch.decode_changes(spark.read.text(str(tmp_path / "in" / "5.json")), FIELDS).where("reason is null")
    for number in (5, 0):
        table().merge(again, number)
        assert sorted(map(tuple, table().current().collect())) == got
    table().compact()
    assert sorted(map(tuple, table().current().collect())) == got


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "id long, name string, minute int, op string, source_ms long, sequence long")


def test_readers_see_one_state_and_storage_is_bounded(spark, tmp_path):
    table = ch.KeyedTable(spark, str(tmp_path / "t"), FIELDS, ["id"], buckets=8)
    assert table.current().count() == 0 and not table.compact()
    for n in range(4):
        table.merge(_rows(spark, *[(k, f"v{n}", n, "u", n, 0) for k in range(20)]), n)
    before = table.current()
    assert table.compact()
    during = table.current()
    table.merge(_rows(spark, (3, "v9", 9, "u", 9, 0)), 4)
    assert before.count() == during.count() == 20 and {r.name for r in before.collect()} == {"v3"}  # the old files are still there
    base = table.pointer.read()[1]["base"]
    table.compact()
    now = table.pointer.read()[1]["base"]
    assert sum(base[b] != now[b] for b in base) == 1  # only the bucket that was touched
    assert {r.name for r in table.current().where("id = 3").collect()} == {"v9"}
    for n in range(5, 9):
        table.merge(_rows(spark, *[(k, f"w{n}", n, "u", n * 10, 0) for k in range(20)]), n)
        table.compact()
        table.vacuum()
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert len(files) <= 3 * 8 + 2 and {r.name for r in table.current().collect()} == {"w8"}
    # of two that compact at the same time one fails
    version, value = table.pointer.read()
    table.pointer.swap(version, value)
    with pytest.raises(Conflict):
        table.pointer.swap(version, value)


def test_tombstones_hold_late_changes_back_until_their_horizon(spark, tmp_path):
    table = ch.KeyedTable(spark, str(tmp_path / "t"), FIELDS, ["id"], buckets=2)
    table.merge(_rows(spark, (1, "a", 1, "c", 10, 0), (1, None, None, "d", 20, 0), (2, "b", 1, "c", 30, 0)), 0)
    table.compact()
    table.merge(_rows(spark, (1, "late", 1, "u", 15, 0), (2, "b2", 1, "u", 30, 1)), 1)
    assert [tuple(r) for r in table.current().collect()] == [(2, "b2", 1)]
    table.compact(horizon=25)
    assert table.current(tombstones=True).count() == 1  # the tombstone is gone
    refused = table.merge(_rows(spark, (1, "later", 1, "u", 16, 0), (1, "new", 1, "c", 40, 0), (5, "no time", 1, "c", None, 0)), 2)
    assert sorted(r.name for r in refused.collect()) == ["later", "no time"]
    assert sorted(tuple(r) for r in table.current().collect()) == [(1, "new", 1), (2, "b2", 1)]


def test_an_aggregation_is_kept_by_key(spark, tmp_path):
    events = [{"account_id": a, "event_ts": f"2026-01-01T00:0{k % 3}:00Z"} for k in range(9) for a in "xy"]
    table = lambda: ch.KeyedTable(spark, str(tmp_path / "t"), "account_id string, n long", ["account_id"], order=("batch_no",), buckets=2)
    for part in range(3):
        _put(tmp_path / "in", f"{part}.json", events[part * 6 : part * 6 + 6])
        stream = jobs.parse_json(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), "account_id string, event_ts timestamp")
        ch.upsert_sink(stream.groupBy("account_id").agg(F.count("*").alias("n")), table(), str(tmp_path / "mark"), compact_every=2).awaitTermination(120)
    assert sorted(map(tuple, table().current().collect())) == [("x", 9), ("y", 9)]


def test_losses_are_counted_once(spark, tmp_path):
    ingest = lambda: ch.CountedIngest(spark, str(tmp_path / "out"), "event_id string, event_ts timestamp, n int", ["event_ts"], "event_ts")
    event = lambda k, ts: {"event_id": f"e{k}", "event_ts": ts, "n": k, "unknown": 1}
    _put(tmp_path / "in", "1.json", [event(1, "2026-01-01 00:05:00.000"), event(2, "2026-01-01 00:00:00.000"), event(3, "2026-01-01T00:05:00"), event(4, None), "{broken", "[1]"])
    run = lambda: ingest().start(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), str(tmp_path / "mark")).awaitTermination(120)
    run()
    _put(tmp_path / "in", "2.json", [event(5, "2026-01-01 00:04:29.999"), event(6, "2026-01-01 00:04:30.000"), event(7, "2026-01-01 00:09:00.000")])
    run()
    first = {"batch": 0, "messages": 6, "valid": 2, "malformed": 2, "bad_time": 2, "late": 0}
    second = {"batch": 1, "messages": 3, "valid": 2, "malformed": 0, "bad_time": 0, "late": 1}

    def state():
        counts = [{c: r[c] for c in first} for r in ingest().counts().orderBy("batch").collect()]
        return counts, sorted(r.event_id for r in ingest().events().collect()), sorted((r.batch, r.reason) for r in ingest().dead_letters().collect())

    expected = ([first, second], ["e1", "e2", "e6", "e7"], [(0, "bad_time"), (0, "bad_time"), (0, "malformed"), (0, "malformed"), (1, "late")])
    assert state() == expected
    # both batches come again, the second one first
    for number, name in ((1, "2.json"), (0, "1.json")):
        ingest().take(spark.read.text(str(tmp_path / "in" / name)), number)
        assert state() == expected


def test_rows_behind_a_watermark_are_counted(spark, tmp_path):
    losses = ch.WatermarkLosses()
    spark.streams.addListener(losses)
    try:
        event = lambda m: {"event_id": f"e{m}", "account_id": "a", "event_type": "agent_response", "event_ts": f"2026-01-01T00:{m:02d}:00Z", "latency_ms": 1}
        stream = lambda: jobs.parse_json(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), "event_id string, account_id string, event_type string, event_ts timestamp, latency_ms long")
        for part, minutes in enumerate(([1, 30], [40], [2, 3, 50])):
            _put(tmp_path / "in", f"{part}.json", [event(m) for m in minutes])
            jobs.append_sink(jobs.minute_rollup(jobs.watermarked(stream())), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        import time

        for _ in range(50):
            if sum(losses.by_batch.values()) >= 2:
                break
            time.sleep(0.1)
        assert losses.rows(spark).agg(F.sum("dropped")).first()[0] == 2
    finally:
        spark.streams.removeListener(losses)


def test_pointer_takes_over_what_a_dead_writer_claimed(spark, tmp_path):
    pointer = Pointer(spark, str(tmp_path / "p"))
    assert pointer.read() == (0, {}) and pointer.swap(0, {"a": 1}) == 1
    pointer.folder.write_new(f"{2:020d}.claim", "")
    with pytest.raises(Conflict):
        pointer.swap(1, {"a": 2})
    assert pointer.read() == (1, {"a": 1})
    assert Pointer(spark, str(tmp_path / "p"), stale_s=-1).swap(1, {"a": 3}) == 2 and pointer.read() == (2, {"a": 3})
    pointer.forget(keep=1)
    assert pointer.read() == (2, {"a": 3})
