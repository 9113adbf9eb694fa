"""Recall's short ways to the archive's artifacts give what the whole upsert gives."""

from datetime import datetime, timedelta

from annalist.operators import artifacts
from annalist.plans.derivation import documents
from annalist.sources import payloads
from annalist.sources.archive import settled

T = datetime(2024, 1, 1)
SILENT = ['{"event_id": "s1", "arrival": 1, "kind": "state_update", "session_id": "a", "hints": {"entities": ["the Pump", null, "pump"]}, "structured_payload": {"key": "k", "ttl": 5}}', '{"event_id": "s2", "kind": "Note", "raw_text": " ", "session_id": "a"}', '{"event_id": "s3", "kind": "note", "hints": {"episode_hint": "Repairs"}, "session_id": "b"}', '{"event_id": "s4", "kind": "note", "session_id": "b", "hints": {"entities": ["Gate", "Pump"], "relations": [{"src": "gate", "dst": "pump", "type": "uses"}]}}']


def test_events_that_say_nothing_give_the_same_artifacts_by_the_short_way(spark, monkeypatch):
    docs = documents(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([(s,) for s in SILENT], "doc string"))
    events = settled(payloads.events_of(payloads.parsed(docs)))
    rows = lambda df: sorted(map(repr, df.collect()))
    short = rows(artifacts.unqueued(events))
    assert len(short) > 1000 and short == rows(artifacts.artifacts_of(events).where("artifact <> 'queue'"))
    monkeypatch.setattr(artifacts, "MOST_LISTS", 0)
    assert short == rows(artifacts.unqueued(events))


def test_rows_of_many_rules_leave_the_session_as_it_was(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    assert settled(spark.range(3), many_rules=True).count() == 3 and spark.conf.get(limit) == before


def test_ends_and_latest_rows_give_the_upsert_with_ties_and_nulls(spark):
    row = lambda n, event, arrival, day, confidence=None, pinned=None: ("s", "claim", n, "is", f"o {event}", event, confidence, pinned, None, None, day, event, "x", None if day is None else T + timedelta(days=day), arrival)
    rows = [row("A", "e1", 1, 9, 0.5), row("a ", "e2", 1, 3, 0.9, True), row("a", "e2", 1, 3), row("a", "e3", 1, 1), row("B", "e4", None, 2, 0.1), row("b", "e5", 4, 1), row("b", "e6", 2, 8, None, False), row("C", "e7", None, None), row("c", "e8", None, 5), row("d", None, 3, 1)]
    names = "scope_key string, artifact string, name string, predicate string, object string, canonical string, confidence double, pinned boolean, trigger string, priority double, ttl long, event_id string, session_id string, ts timestamp, arrival long"
    df = spark.createDataFrame(rows, names).withColumn("object", artifacts.F.lit("o")).withColumn("key", artifacts.key())
    got = lambda x: sorted(map(repr, x.collect()))
    whole = artifacts.upserted(df)
    assert whole.count() == 4 and got(artifacts.described(df).select(whole.columns)) == got(whole)
    assert got(artifacts.latest(df)) == got(whole.select("scope_key", "artifact", "key", "last_seen", "ttl"))
