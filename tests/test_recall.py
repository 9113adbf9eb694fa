"""Bundles of a small memory: narrowing, filters, scopes and awkward queries."""

from datetime import datetime, timedelta

import pytest

from annalist.operators import recall
from annalist.sources.archive import settled

T = datetime(2024, 1, 1)
ARTIFACT = "scope_key string, kind string, ref string, name string, predicate string, object string, canonical string, confidence double, evidence long, pinned boolean, last_seen timestamp, remember string, activation string, weight double, state_pinned boolean"
EVENT = "scope_key string, ref string, session_id string, ts timestamp, arrival long, raw_text string, normalized_text string, p_raw string, route_domain string, route_action string, importance double, confidence double"


def artifact(kind, ref, name=None, predicate=None, object_=None, canonical=None, day=0, remember="remembered", activation="active", scope="s", evidence=2, confidence=0.9, pinned=False):
    return (scope, kind, ref, name, predicate, object_, canonical, confidence, evidence, pinned, T + timedelta(days=day), remember, activation, 1.0 if remember else None, False)


@pytest.fixture(scope="module")
def memory(spark):
    rows = [artifact("claim", f"c{i:02}", "gate", "is", f"open {i}", f"gate is open {i}", day=i) for i in range(20)]
    rows += [artifact("claim", "c-old", "pump", "is", "blue", "pump is blue", day=-9), artifact("claim", "c-unsure", "pump", "is", "red", "pump is red", day=30, remember="candidate", activation="suppressed"), artifact("claim", "c-none", "pump", "is", "x", "pump is x", day=31, remember=None, activation=None)]
    rows += [artifact("entity", "e-pump", "Deep Pump", day=-50, remember=None, activation=None), artifact("entity", "e-user", "user", day=40, remember=None, activation=None)] + [artifact("entity", f"e{i:02}", f"Tank {i}", day=i, remember=None, activation=None) for i in range(30)]
    rows += [artifact("relation", "r-pump", "Gate", "depends_on", "Deep Pump", day=-50, remember="candidate", activation="suppressed", confidence=0.7), artifact("relation", "r-uses", "Gate", "uses", "Deep Pump", day=-50)] + [artifact("relation", f"r{i:02}", "Tank", "uses", f"Hull {i}", day=i) for i in range(40)]
    rows += [artifact("episode", f"p{i}", f"talk-{i}", day=i) for i in range(12)] + [artifact("claim", "other", "gate", "is", "shut", "gate is shut", scope="o", day=99)]
    events = [("s", f"v{i:02}", "live" if i % 2 else "old", T + timedelta(hours=i), i, "the gate was open" if i % 4 == 0 else f"turn {i} was said here", None, None, None, None, 0.5, 0.5) for i in range(40)]
    events += [("o", "v-other", "x", T, 1, "the gate was open", None, None, None, None, 0.5, 0.5)]
    sessions = [("s", "live", "interaction", T, None), ("s", "old", "import", T, T)]
    support = [("s", "claim", "c-old", "live"), ("s", "claim", "c03", "live"), ("s", "relation", "r05", "live")]
    return recall.Stored(
        spark.createDataFrame(rows, ARTIFACT), spark.createDataFrame(support, "scope_key string, kind string, ref string, session_id string"), spark.createDataFrame(events, EVENT),
        spark.createDataFrame(sessions, "scope_key string, session_id string, kind string, opened_at timestamp, closed_at timestamp"), spark.createDataFrame([("s", f"l{i}", T + timedelta(hours=i)) for i in range(5)], "scope_key string, ref string, refreshed_at timestamp"),
    )


@pytest.fixture(scope="module")
def found(spark, memory):
    asks = {"claim": "what is the gate", "proof": "what is the gate, with evidence", "depends": "what depends on deep pump", "archive": "history of the gate", "session": "in this session: gate", "recent": "what happened lately", "all": "the gate was open", "null": None, "empty": "", "marks": "?!", "long": "gate " * 20_000}
    q = spark.createDataFrame([(k, "s", v) for k, v in asks.items()] + [("other", "o", "what is the gate"), ("unknown", "nowhere", "gate")], "qid string, scope_key string, query string")
    out = {}
    for r in recall.bundles(q, memory).orderBy("qid", "kind", "place").collect():
        out.setdefault(r["qid"], {}).setdefault(r["kind"], []).append(r["ref"])
    return out


def test_a_question_for_a_claim_hides_the_rest(found):
    assert set(found["claim"]) == {"claim", "lease"} and len(found["claim"]["claim"]) == 5
    assert {"claim", "event", "lease"} <= set(found["proof"])
    assert found["claim"]["lease"] == ["l4", "l3", "l2"]


def test_an_index_finds_what_is_too_old_to_be_among_the_newest(found):
    assert found["depends"]["relation"] == ["r-pump"] and "entity" not in found["depends"]  # the asked type, though a candidate; no entities beside relations
    assert "e-pump" not in found["recent"].get("entity", []) and "e-user" not in found["all"].get("entity", [])


def test_modes_and_sessions(found):
    assert [len(found["archive"][k]) for k in ("claim", "episode", "entity", "relation", "event")] == [2, 1, 3, 5, 8] or len(found["archive"]["event"]) <= 8
    assert set(found["session"]["claim"]) == {"c-old", "c03"} and set(found["session"]["relation"]) == {"r05"}
    assert all(int(e[1:]) % 2 for e in found["session"]["event"]) and all(int(e[1:]) % 2 for e in found["recent"]["event"])  # of the session; live ones


def test_events_with_all_words_are_told_once(found):
    assert len([e for e in found["all"]["event"] if int(e[1:]) % 4 == 0]) == 1


def test_scopes_and_awkward_queries(found):
    assert found["other"].get("claim", []) in ([], ["other"]) and "unknown" not in found
    assert found["long"]["event"] == ["v36"]  # all of one text
    for q in ("null", "empty", "marks"):
        assert len(found[q]["claim"]) == 5 and len(found[q]["event"]) == 8, q
    assert not any("other" in refs or "v-other" in refs for q, kinds in found.items() if q != "other" for refs in kinds.values())


def test_empty_tables(spark, memory):
    none = recall.Stored(*(getattr(memory, f).limit(0) for f in ("artifacts", "support", "events", "sessions", "leases")))
    q = spark.createDataFrame([("a", "s", "what is the gate")], "qid string, scope_key string, query string")
    assert recall.bundles(q, none).count() == 0 and recall.bundles(q.limit(0), memory).count() == 0


def test_readers_of_settled_rows_read_their_columns_alone(spark):
    rows = settled(spark.createDataFrame([("a", [("x", 1.5)], None), (None, None, T)], "k string, pairs array<struct<n:string,w:double>>, ts timestamp"))
    assert {(r["k"], r["pairs"] and r["pairs"][0]["w"], r["ts"]) for r in rows.collect()} == {("a", 1.5, None), (None, None, T)}
    assert "ReadSchema: struct<k:string>" in rows.select("k")._jdf.queryExecution().toString()
