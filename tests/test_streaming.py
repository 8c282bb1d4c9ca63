"""Streams over files: windows, replays, malformed records, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from tallyweir.streaming import jobs

DDL = "event_id string, account_id string, event_type string, event_ts timestamp, latency_ms long"


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in rows))


def _event(k, at, kind="agent_response", ms=10):
    return {"event_id": f"e{k}", "account_id": "a", "event_type": kind, "event_ts": f"2026-01-01T00:{at}Z", "latency_ms": ms, "unknown": 1}


@pytest.fixture()
def source(spark, tmp_path):
    return lambda: jobs.parse_json(spark.readStream.text(str(tmp_path / "in")), DDL)


def test_malformed_records_go_aside(spark, tmp_path):
    _put(tmp_path / "in", "1.json", [_event(1, "00:01"), "{broken", "[1"])
    raw = spark.read.text(str(tmp_path / "in"))
    assert [r.event_id for r in jobs.parse_json(raw, DDL).collect()] == ["e1"]
    assert sorted(r.value for r in jobs.malformed(raw).collect()) == ["[1", "{broken"]


def test_closed_windows_are_appended_once(spark, source, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    _put(tmp_path / "in", "1.json", [_event(1, "00:01"), _event(1, "00:01"), _event(2, "00:30", ms=30), _event(3, "05:00", "escalation")])
    run = lambda: jobs.append_sink(jobs.minute_rollup(jobs.deduplicated(jobs.watermarked(source()))), out, mark).awaitTermination(90)
    run()
    _put(tmp_path / "in", "2.json", [_event(4, "00:40"), _event(5, "09:00")])
    run()
    rows = {(r.window_start.minute, r.event_type): r for r in spark.read.parquet(out).collect()}
    first = rows[0, "agent_response"]
    assert (first.events, first.avg_latency, first.max_latency) == (2, 20.0, 30)
    assert rows[5, "escalation"].escalated == 1 and rows[5, "escalation"].avg_latency == 0.0
    assert spark.read.parquet(out).count() == len(rows)


def test_distinct_impressions_in_a_stream(spark, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    rows = [{"op": o, "page_type": 1, "impression_id": i, "event_ts": f"2026-01-01T00:{t}Z"} for o, i, t in [("c", "x", "00:01"), ("u", "x", "00:02"), ("c", "y", "00:03"), ("d", "z", "00:04"), ("c", "q", "09:00")]]
    _put(tmp_path / "in", "1.json", rows)
    stream = jobs.parse_json(spark.readStream.text(str(tmp_path / "in")), "op string, page_type int, impression_id string, event_ts timestamp")
    jobs.append_sink(jobs.cdc_minute_counts(jobs.watermarked(stream, delay="15 seconds")), out, mark).awaitTermination(90)
    assert [(r.events, r.impressions) for r in spark.read.parquet(out).orderBy("window_start").collect()][:1] == [(3, 2)]


def test_batches_replace_themselves(spark, source, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    state = lambda b: b.groupBy("account_id").agg(F.count("*").alias("n"))
    _put(tmp_path / "in", "1.json", [_event(1, "00:01"), _event(2, "00:02")])
    jobs.batch_sink(source(), out, mark, state).awaitTermination(90)
    _put(tmp_path / "in", "2.json", [_event(3, "00:03")])
    jobs.batch_sink(source(), out, mark, state).awaitTermination(90)
    jobs.batch_sink(source(), out, mark, state).awaitTermination(90)
    rows = spark.read.parquet(out)
    assert rows.agg(F.sum("n")).first()[0] == 3
    assert jobs.latest_versions(rows, ["account_id"]).first().n == 1
