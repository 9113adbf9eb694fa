"""Derivation of stored payloads: awkward documents, nested exports, and episodes of the tables against a plain fold."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from annalist.operators import artifacts
from annalist.plans.all import QUERIES
from annalist.sources import payloads
from tests.test_folds import plain

SF = "/root/testdata/sf0.001"
SCOPE = {"tenant": "T", "namespace": "n", "workspace": "w", "project": "p"}


def event(i, kind, text=None, **more):
    return {"event_id": f"e{i}", "arrival": i, "timestamp": f"2024-01-01T00:{i:02}:00Z", "scope": SCOPE, "session_id": "s", "kind": kind, "raw_text": text, "scores": {"importance": 0.4, "confidence": 0.9}, **more}


def derived(spark, docs):
    found = artifacts.artifacts_of(payloads.events_of(payloads.parsed(spark.createDataFrame([(d if isinstance(d, str) or d is None else json.dumps(d),) for d in docs], "doc string"))))
    return [r.asDict() for r in found.collect()]


def of(rows, event_id, artifact):
    return [r for r in rows if r["event_id"] == event_id and r["artifact"] == artifact]


def test_kinds_of_events(spark):
    docs = [
        event(1, "fact_assertion", "remember my name is Ines"), event(2, "message", "The gate is open"), event(3, "message", "what is the gate"), event(4, "message", "The gate is open", scores={"confidence": 0.5}),
        event(5, "state_update", structured_payload={"key": "mode", "value": [1, 2], "ttl": 0, "ttl_seconds": "60"}), event(6, "state_update", structured_payload={"lease_key": " ", "value": 1}),
        event(7, "note", "Gate depends on Pump", hints={"entities": ["Pump", "Gate"]}), event(8, "note", "x", hints={"entities": ["Gate", "gate", " the Pump ", 7, None], "relations": [{"source": "Gate", "target": "pump", "relation_type": "uses"}, "no", {"src": "Gate", "dst": "Tank", "type": "uses"}]}),
        event(9, "note", "x", structured_payload={"fact": {"predicate": "likes", "object": "tea", "pinned": True}}, hints={"entities": ["Ines"], "pin": False}),
        event(10, "note", "x", structured_payload={"claims": [{"subject": "we", "predicate": "own", "object": "it"}, {"predicate": "", "object": "x"}, 5, {"subject_name": "Ines", "predicate": "has name", "object_text": "Ines."}]}),
        event(11, "tool_result", "x", structured_payload={"tool_observation_text": "The pump means trouble"}), event(12, "message", "The gate is open", structured_payload={"needs_clarification": True}), event(13, "note", "The gate is open", session_id=None),
    ]
    rows = derived(spark, docs)
    claim = lambda i: [(r["name"], r["predicate"], r["object"], r["canonical"], r["pinned"]) for r in of(rows, f"e{i}", "claim")]
    assert claim(1) == [("operator", "has name", "Ines", "operator has name Ines", False)]
    assert claim(2) == [("The gate", "is", "open", "The gate is open", False)] and claim(3) == claim(4) == claim(12) == []
    assert [(r["name"], r["object"], r["ttl"]) for r in of(rows, "e5", "lease")] == [("mode", '{"value":[1,2]}', 60)] and of(rows, "e6", "lease") == []
    assert [(r["name"], r["predicate"], r["object"], r["confidence"]) for r in of(rows, "e7", "relation")] == [("Gate", "depends_on", "Pump", 0.65)]
    assert [r["name"] for r in of(rows, "e8", "entity")] == ["Gate", "Pump", "7"] and [(r["name"], r["predicate"], r["object"]) for r in of(rows, "e8", "relation")] == [("Gate", "uses", "pump")]
    assert claim(9) == [("Ines", "likes", "tea", "likes tea", True)] and not [r for r in of(rows, "e9", "queue") if r["name"] == "claim"]
    assert claim(10) == [("we", "own", "it", "own it", False), ("operator", "has name", "Ines", "operator has name Ines", False)]
    assert {(r["name"], r["predicate"]) for r in of(rows, "e10", "entity")} >= {("we", "subject"), ("operator", "subject")}
    assert claim(11) == [("The pump", "means", "trouble", "The pump means trouble", False)]
    assert of(rows, "e13", "episode") == [] and len(of(rows, "e2", "episode")) == 1
    assert {r["name"] for r in rows if r["artifact"] == "queue"} == {"relation", "claim", "episode"}


def test_awkward_documents(spark):
    docs = [None, "", "{", "5", "[]", "{}", '{"kind": null}', {"kind": "note"}, {"kind": "note", "structured_payload": 3, "hints": [], "scope": "x", "scores": None, "timestamp": "never"}, event(1, "note", "pump " * 30_000), event(2, "message", 7)]
    rows = derived(spark, docs)
    assert {r["event_id"] for r in rows} == {"e1", "e2"} and all(r["ts"] is not None for r in rows)
    assert derived(spark, []) == []
    events = payloads.events_of(payloads.parsed(spark.createDataFrame([(json.dumps(d),) for d in docs[7:9]], "doc string"))).collect()
    assert [(r["kind"], r["ts"], r["importance"], r["hint_entities"]) for r in events] == [("note", None, 0.5, None)] * 2


def test_hosts_nest_events_in_sessions(spark):
    doc = {"session": {"session_id": "a", "scope": SCOPE}, "events": [event(1, "note", "The gate is open", session_id=None, scope=None), event(2, "note", "The tank is full", session_id="own"), {"raw_text": "no kind"}]}
    docs = spark.createDataFrame([(json.dumps(doc),), ('{"session": {}, "events": 3}',), ("{",)], "doc string")
    found = {r["event_id"]: (r["session_id"], r["scope_key"]) for r in payloads.events_of(payloads.host_events(docs)).collect()}
    assert found == {"e1": ("a", "t::n::w::p"), "e2": ("own", "t::n::w::p")}


def test_upsert_counts_repeats_once_and_goes_by_arrival(spark):
    docs = [event(3, "note", "The Gate is open", timestamp="2024-01-01T05:00:00Z"), event(4, "note", "the gate is OPEN", timestamp="2024-01-01T01:00:00Z"), event(4, "note", "the gate is OPEN", timestamp="2024-01-01T01:00:00Z")]
    found = artifacts.upserted(artifacts.artifacts_of(payloads.events_of(payloads.parsed(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"))))).where("artifact = 'claim'").collect()
    assert [(r["name"], r["object"], r["evidence"], r["first_seen"], r["last_seen"]) for r in found] == [("The Gate", "OPEN", 2, datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 1))]


def test_episodes_of_the_tables(spark):
    from annalist.plans.derivation import derived as rows_of

    rows = rows_of(spark, SF).where("artifact = 'episode'").select(F.xxhash64("event_id").alias("i"), F.xxhash64("session_id").alias("s"), "ts", "name", F.split("object", ", ").alias("e"), "confidence", "session_id").collect()
    events = [(r["i"], r["s"], r["ts"], r["name"], [e for e in r["e"] if e], r["confidence"]) for r in rows]
    ends = {}
    for r in rows:
        if r["session_id"].startswith("conv-"):
            ends[r["s"]] = max(ends.get(r["s"], r["ts"]), r["ts"])
    _, expected = plain(events, list(ends.items()))
    names = "title status start_at end_at updated_at entities confidence events".split()
    assert {(r["session_id"], r["episode"]): tuple(r[n] for n in names) for r in QUERIES["derived_episodes"](spark, SF).collect()} == expected
    assert sum(v[1] == "closed" for v in expected.values()) == len({k for k in expected if k[0] in ends})


def test_a_document_is_parsed_and_walked_once(spark):
    events = payloads.events_of(payloads.parsed(spark.createDataFrame([("{}",)], "doc string")))
    plan = events._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson(") == 1 and plan.count("variant_get(") == 2  # the event, and a single claim


def test_fields_of_other_types_leave_the_rest_alone(spark):
    doc = event(1, "note", structured_payload={"needs_clarification": [1], "claims": {"predicate": "x"}, "claim": {}, "fact": {"subject": "not read", "predicate": " p ", "object": 3, "confidence": "0.5", "pinned": {}}, "ttl": "x"}, hints={"pin": [], "entities": 4, "relations": [[1], {"src": 1, "target": "b"}]}, scores={"importance": {}, "confidence": "0.25"})
    (row,) = payloads.events_of(payloads.parsed(spark.createDataFrame([(json.dumps(doc),)], "doc string"))).collect()
    assert (row["unclear"], row["pin"], row["hint_entities"], row["ttl"], row["importance"], row["confidence"]) == (False, False, None, 3600, 0.5, 0.25)
    assert [tuple(c) for c in row["told_claims"]] == [(None, "p", "3", None, 0.5, False)] and [tuple(r) for r in row["hint_relations"]] == [("1", "b", None, None)]


def test_episodes_work_out_no_relations_or_claims(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = QUERIES["derived_episodes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "tool_observation_text" in plan and "depends upon" not in plan and "has name" not in plan
