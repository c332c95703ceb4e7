"""Readers and sinks on small files."""

from __future__ import annotations

import os


from conftest import rows
from tidegauge.plans import catalog
from tidegauge.sources import readers as R, sinks as S


def test_jsonl_bom_blank_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"run_id": "x", "n": 1, "ts": "b"}\n\n{"run_id": "y", "n": 2, "ts": "a"}\n[3]\n{"run_id": "x", "n"', encoding="utf-8")
    schema = "run_id string, n bigint, ts string"
    assert [r.n for r in R.read_jsonl(spark, str(tmp_path), schema, order_by="ts").collect()] == [2, 1]
    assert rows(R.read_jsonl(spark, str(tmp_path), schema, run_id="x"), "n") == [(1,)]
    marked = rows(R.read_jsonl(spark, str(tmp_path), schema, on_bad="mark"), "n", "parse_error", "raw")
    assert marked == sorted([(1, False, None), (2, False, None), (None, True, "[3]"), (None, True, '{"run_id": "x", "n"')], key=repr)


def test_segments_open_and_sealed(spark, tmp_path):
    good = '{"schema_version":1,"event_version":1,"event_id":"a","timestamp_utc":"t","event_type":"e","trace_id":"t","span_id":"s","source":{},"data":{}}'
    (tmp_path / "1.jsonl").write_text(f"{good}\n{{oops\n\n{good.replace(',\"data\":{}', '')}\n{good.replace('\"source\":{}', '\"source\":1')}\n[1]\n")
    (tmp_path / "2.open.jsonl").write_text(f"{good}\n{good[:30]}")
    ok, bad, stats = R.read_segments(spark, str(tmp_path))
    assert rows(ok, "file", "line") == [("1.jsonl", 1), ("2.open.jsonl", 1)]
    assert rows(bad, "file", "line", "fate") == [("1.jsonl", 2, "malformed"), ("1.jsonl", 4, "malformed"), ("1.jsonl", 5, "malformed"), ("1.jsonl", 6, "malformed"),
                                                 ("2.open.jsonl", 2, "truncated")]
    s = stats.first()
    assert (s.good, s.blank, s.malformed, s.truncated) == (2, 1, 4, 1)
    assert s.errors == ["1.jsonl:2: malformed JSON", "1.jsonl:4: missing data", "2.open.jsonl:2: malformed JSON"]


def test_every_line_has_one_fate(spark):
    lines = ['{"event":"status"}', '{"event":"Object"}', '{"event":"zdo","dir":"send"}', '{"event":"zdo","dir":"recv"}', "", "{x", "7"]
    parts = R.split_candidates(spark.createDataFrame(list(enumerate(lines)), "line bigint, value string"))
    assert [rows(p, "line") for p in parts] == [[(1,), (2,)], [(0,), (3,), (4,)], [(5,), (6,)]]


def test_recent_files_by_time_then_name(spark, tmp_path):
    for n, name in enumerate(["c", "a", "b", "d"]):
        path = tmp_path / f"{name}.jsonl"
        path.write_text(f"{name}1\n\n{name}2\n")
        os.utime(path, (1000 + n, 1000 + n))
    got = R.scan_recent_files(spark, str(tmp_path), max_files=3, max_rows=5)
    assert [v for _, v in rows(got, "row", "value")] == ["a1", "a2", "b1", "b2", "d1"]


def test_chat_export(spark, tmp_path):
    (tmp_path / "stem.json").write_text('{"channel": {"id": "1"}, "messages": [{"id": "1", "type": "Default", "content": "x", "author": {"name": "bob"}},\n'
                                        '{"id": "2", "type": "Join", "content": "y", "author": {"name": "al"}}, {"id": "3", "type": "Reply", "content": "z", "author": {"name": "op", "nickname": "Boss"}}]}')
    got = R.explode_messages(R.read_chat_exports(spark, str(tmp_path)), "boss")
    assert rows(got, "thread", "id", "author") == [("stem", "1", "bob")]


def test_sheet_header_mismatch_is_an_anomaly(spark):
    df = spark.createDataFrame([(1, "Name", "Typ"), (2, "a", "b"), (3, None, " ")], "row bigint, c0 string, c1 string")
    data, anomalies = R.scan_sheet_rows(df, "row", ["name", "kind"], ["name", "kind"])
    assert rows(data, "row", "name", "kind") == [(2, "a", "b")] and anomalies.count() == 1


def test_union_reports_twice_used_ids(spark):
    a = spark.createDataFrame([("x", "story")], "id string, kind string")
    b = spark.createDataFrame([("x", "odd", 5)], "id string, kind string, extra int")
    records, violations = R.union_sources({"a": a, "b": b, "c": None}, ["story"])
    assert records.count() == 2 and rows(violations, "rule", "key") == [("duplicate_id", "x"), ("unknown_kind", "x")]


def test_window_export_edges_and_unbounded_runs(spark):
    receipts = spark.createDataFrame([("r", 100), ("r", 200)], "run_id string, at bigint")
    logs = spark.createDataFrame([("a", 55), ("a", 54), ("a", 245), ("b", 246)], "file string, at bigint")
    kept, counts = R.window_export(logs, receipts, pad=45)
    assert rows(kept, "at") == [(245,), (55,)] and rows(counts, "file", "rows") == [("a", 2), ("b", 0)]
    runs = spark.createDataFrame([("r",), ("lost",)], "run_id string")
    assert rows(R.runs_without_receipts(runs, receipts), "run_id") == [("lost",)]


def test_append_refuses_events_without_id_and_snapshots_replace(spark, tmp_path):
    ev = spark.createDataFrame([("1", "a", None), ("", "a", "{}"), ("2", None, "{}")], "event_id string, event_type string, payload string")
    refused = S.append_event(ev, str(tmp_path / "log"))
    assert refused.count() == 2
    S.append_event(ev.filter("event_id = '1'"), str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")), "event_id", "payload") == [("1", "{}"), ("1", "{}")]
    for version, value in ((1, "old"), (2, "new")):
        S.write_snapshot(spark.createDataFrame([(2, value), (1, value)], "k bigint, v string"), str(tmp_path / "state"), ["k"], version)
    assert rows(S.read_snapshot(spark, str(tmp_path / "state")), "k", "v") == [(1, "new"), (2, "new")]


def test_extract_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc")], "k bigint, label string").coalesce(1)
    for fmt in ("json", "csv", "tsv"):
        S.write_extract(df, str(tmp_path / fmt), fmt, ["label", "k"])
    text = "".join(p.read_text() for p in (tmp_path / "tsv").glob("part-*"))
    assert text == "label\tk\na b c\t1\n"


def test_candidates_are_counted_in_one_pass(spark):
    df = catalog.QUERIES["split_candidates"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
