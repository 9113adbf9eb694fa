"""What SQL cannot express: the episode fold, streaming, readers and writers, against plain Python."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from annalist.functions.rules import TOPIC_STOP_WORDS
from annalist.operators.derive import derive_relations
from annalist.operators.episodes import assign_episodes
from annalist.plans.memory import QUERIES
from annalist.sources.archive import read_events, write_events
from annalist.streaming import ingest

SF = "/root/testdata/sf0.001"


def topics(title):
    long = {w for w in re.findall("[a-z0-9_']+", title.lower()) if len(w) >= 4 and w not in TOPIC_STOP_WORDS}
    return long | {w[:-1] for w in long if w[-1] == "s" and len(w) >= 6}


def plain_fold(events, gap, related):
    """Every rule as it is told, over all episodes of a session."""
    out, episodes = {}, []
    for event_id, session, ts, title, entities in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        own = sorted((e for e in episodes if e["session"] == session), key=lambda e: (e["updated"], e["touched"]), reverse=True)
        found = next((e for e in own if e["title"].lower() == title.lower() and e["updated"] >= ts - gap), None)
        if found is None:
            best = 0
            for e in own[:12]:
                if e["updated"] >= ts - related and e["title"].lower() != title.lower():
                    t, n = len(topics(e["title"]) & topics(title)), len(set(e["entities"]) & set(entities))
                    if (t >= 2 or (t >= 1 and n >= 1)) and 2 * t + n > best:
                        best, found = 2 * t + n, e
        if found is None:
            found = {"session": session, "title": title, "entities": entities, "number": sum(e["session"] == session for e in episodes) + 1}
            episodes.append(found)
        found["updated"], found["touched"] = ts, len(out)
        found["entities"] = entities or found["entities"]
        out[event_id] = found["number"]
    return out


def test_episode_fold(spark):
    rng = random.Random(3)
    titles = ["marble harbor", "harbor marbles plan", "blue lantern", "lantern plan", "gates", "the harbor of marble plan", "Blue Lantern"]
    start = datetime(2024, 1, 1)
    events = [(i, rng.randrange(4), start + timedelta(minutes=rng.randrange(600)), rng.choice(titles), rng.sample(["a", "b", "c"], rng.randrange(3))) for i in range(300)]
    df = spark.createDataFrame(events, "event_id long, session_id long, ts timestamp, title string, entities array<string>").repartition(5)
    got = {r["event_id"]: r["episode"] for r in assign_episodes(df).collect()}
    assert got == plain_fold(events, timedelta(minutes=20), timedelta(minutes=10))
    assert assign_episodes(df.limit(0)).count() == 0
    awkward = spark.createDataFrame([(1, None, start, "x", None), (2, 1, None, "x", None), (3, 1, start, None, None), (4, 1, start, None, [None])], df.schema)
    assert sorted((r["event_id"], r["episode"]) for r in assign_episodes(awkward).collect()) == [(3, 1), (4, 1)]


def test_related_episodes_over_the_tables(spark):
    out = QUERIES["related_episode_merge"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/events.parquet").count() and out.agg(F.max("episode")).first()[0] > 3


def test_relations_over_the_tables(spark):
    kinds = {r["type"]: r["n"] for r in QUERIES["derive_relations_text"](spark, SF).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds.get("depends_on", 0) > 5 and kinds.get("uses", 0) > 5


def test_relations_need_a_name_in_the_text_and_hints_win(spark):
    rows = [(1, "it depends on that", ["Gate", "Pump"], None), (2, "Gate depends on that", ["Gate", "Pump"], None), (3, "Gate depends on Pump", ["Gate", "Pump"], [("A", "B", "uses", None), ("A", "B", "likes", 0.5), (" ", "B", "uses", 0.5)])]
    df = spark.createDataFrame(rows, "i int, text string, entities array<string>, hint_relations array<struct<src:string,dst:string,type:string,confidence:double>>")
    found = {(r["i"], r["src"], r["dst"], r["type"], r["confidence"]) for r in derive_relations(df).collect()}
    assert found == {(2, "Gate", "Pump", "depends_on", 0.65), (3, "A", "B", "uses", 0.8)}


def test_ingest_keeps_the_first_arrival(spark, tmp_path):
    schema = "session_id long, kind string, ts timestamp, event_id long, scope string"
    ts = datetime(2024, 1, 1)
    added = []
    write = ingest.ingest_batch(str(tmp_path / "archive"), ["session_id", "kind", "ts"], "event_id", "scope", lambda new, i: added.append((i, new.count())))
    batch = spark.createDataFrame([(1, "a", ts, 9, "s"), (1, "a", ts, 3, "s"), (1, "b", ts, 4, "t")], schema)
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(1, "a", ts, 1, "s"), (2, "a", ts, 5, "s")], schema), 1)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "archive")).collect()) == [3, 4, 5]
    assert added == [(0, 2), (0, 0), (1, 1)]


def run_stream(spark, tmp_path, batches, schema, make, mode):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    seen = []
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(rows))
        query = make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return seen


def test_leases_refresh_and_end(spark, tmp_path):
    row = lambda key, at, value: f'{{"session_id": 1, "lease_key": "{key}", "ts": "2024-01-01T{at}", "ttl": 600, "value": {value}}}'
    batches = [[row("a", "00:00:00", 1), row("a", "00:05:00", 2)], [row("a", "00:12:00", 3), row("a", "00:01:00", 9)], [row("b", "05:00:00", 4)], [row("b", "05:00:01", 5)]]
    seen = run_stream(spark, tmp_path, batches, "session_id long, lease_key string, ts timestamp, ttl long, value double", ingest.leases, "update")
    a = [(r["status"], r["value"], str(r["issued_at"])[11:], str(r["refreshed_at"])[11:]) for r in seen if r["lease_key"] == "a"]
    assert a == [("active", 2.0, "00:00:00", "00:05:00"), ("active", 3.0, "00:00:00", "00:12:00"), ("expired", 3.0, "00:00:00", "00:12:00")]
    assert [r["value"] for r in seen if r["lease_key"] == "b" and r["status"] == "active"] == [4.0, 5.0]


def test_stream_windows_and_duplicates(spark, tmp_path):
    row = lambda s, at: f'{{"session_id": {s}, "kind": "k", "ts": "2024-01-01T{at}"}}'
    batches = [[row(1, "00:00:00"), row(1, "00:20:00"), row(1, "00:45:00"), row(1, "00:00:00")], [row(2, "09:00:00")], [row(2, "09:00:01")]]
    schema = "session_id long, kind string, ts timestamp"
    told = []
    feed = ingest.ChangeFeed(lambda name, batch, rows: told.append(rows))
    spark.streams.addListener(feed)
    (tmp_path / "w").mkdir()
    (tmp_path / "d").mkdir()
    windows = run_stream(spark, tmp_path / "w", batches, schema, lambda s: ingest.episodes(s), "append")
    assert sorted(r["n"] for r in windows if r["session_id"] == 1) == [1, 3]
    once = run_stream(spark, tmp_path / "d", batches, schema, lambda s: ingest.deduplicated(s, ["session_id", "kind", "ts"]), "append")
    assert len([r for r in once if r["session_id"] == 1]) == 3
    spark.streams.removeListener(feed)
    assert sum(told) >= 6


def test_archive_files(spark, tmp_path):
    line = '{"event_id": "e1", "timestamp": "2024-01-01T10:00:00+02:00", "scope": {"tenant": " T ", "namespace": "n", "workspace": "w", "project": "P"}, "session_id": "s", "kind": "message", "raw_text": "hi", "hints": {"entities": ["Gate"], "pin": true}}'
    (tmp_path / "events.jsonl").write_text(line + "\n")
    events = read_events(spark, str(tmp_path / "events.jsonl"))
    r = events.first()
    assert r["scope_key"] == "t::n::w::p" and r["ts"] == datetime(2024, 1, 1, 8) and r["hints"]["entities"] == ["Gate"]
    write_events(events, str(tmp_path / "archive"))
    found = spark.read.parquet(str(tmp_path / "archive")).where("scope_key = 't::n::w::p'")
    assert found.count() == 1 and "PartitionFilters: [isnotnull(scope_key" in found._jdf.queryExecution().toString()


def test_policies_and_second_opinions(spark):
    import pandas as pd

    from annalist.functions.policy import Policy, policy_of, second_opinion

    assert policy_of("{}") == Policy() and policy_of('{"adjudication": {"enabled": false}}').mode == "off"
    p = policy_of('{"name": "p", "factor_weights": {"identity_relevance": 0.5, "consequence": 0.5}, "kind_biases": {"note": 0.3}, "adjudication": {"mode": "assist"}}')
    df = spark.createDataFrame([("note", 1.0, 0.2), ("message", 0.4, 0.2), (None, 2.0, 2.0)], "kind string, a double, b double")
    scores = [r[0] for r in df.select(p.score({"identity": F.col("a"), "consequence": F.col("b"), "other": F.col("a")}, F.col("kind"))).collect()]
    assert [round(s, 6) for s in scores] == [0.9, 0.3, 1.0]
    rows = [("1", "claim", "promote", False, 0.65), ("2", "claim", "promote", True, 0.65), ("3", "relation", "retire", False, 0.1), ("4", "episode", "leave_candidate", False, 0.5), ("5", "claim", "retire", False, 0.25)]
    decisions = spark.createDataFrame(rows, "artifact_id string, artifact_type string, action string, locked boolean, score double")

    def adjudicator(batch):
        return pd.DataFrame({"action": ["retire" if a == "promote" else "pin" for a in batch["action"]], "confidence": 0.9, "rationale": "because"})

    told = {r["artifact_id"]: (r["eligible"], r["suggested"], r["final"], r["applied"]) for r in second_opinion(decisions, p, adjudicator).collect()}
    assert told == {"1": (True, "retire", "retire", True), "2": (False, None, "promote", False), "3": (False, None, "retire", False), "4": (True, "pin", "leave_candidate", False), "5": (True, "pin", "retire", False)}
    assert not any(r["applied"] for r in second_opinion(decisions, Policy(), adjudicator).collect()) and not any(r["applied"] for r in second_opinion(decisions, p).collect())


def test_memory_from_events_to_recall(spark, tmp_path):
    import pytest

    from annalist.engine import TOOLS, Memory

    m = Memory(spark, str(tmp_path / "m"))
    t = lambda h, day=1: datetime(2024, 1, day, h)
    assert m.claims("s").count() == 0 and m.recall("s", "what is the gate").count() == 0
    m.open_session("a", "s", t(1))
    m.open_session("b", "s", t(2))
    m.close_session("b", "s", t(9))
    assert [(r["session_id"], r["closed_at"]) for r in m.sessions("s").orderBy("session_id").collect()] == [("a", None), ("b", t(9))] and m.preferred_session("s").first()["session_id"] == "a"
    rows = [
        ("e1", "s", "a", t(1), "message", "The gate is open", 0.5, 0.9, False, "k1", 1), ("e2", "s", "a", t(2), "message", "the gate is OPEN", 0.5, 0.9, False, "k2", 2), ("e3", "s", "b", t(3, 2), "message", "The gate is open", 0.5, 0.9, False, "k3", 3),
        ("e4", "s", "b", t(4), "fact_assertion", "remember my name is Ines", 0.9, 0.9, False, "k4", 4), ("e5", "s", "b", t(5), "message", "The pump is blue", 0.1, 0.9, False, "k5", 5), ("e6", "other", "b", t(5), "message", "The pump is red", 0.1, 0.9, True, "k5", 6), ("e7", "s", "a", t(6), "message", "again", 0.1, 0.9, False, "k1", 7),
    ]
    events = spark.createDataFrame(rows, "event_id string, scope string, session_id string, ts timestamp, kind string, raw_text string, importance double, confidence double, pinned boolean, idempotency_key string, arrival long")
    assert tuple(m.ingest_events(events).first()) == (7, 6, 1) and tuple(m.ingest_events(events).first()) == (7, 0, 7)
    keyless = spark.createDataFrame([(i, "k", "a", t(1), "message", "x", 0.1, 0.1, False, None, 1) for i in ("a", "b", "b")], events.schema)
    assert tuple(m.ingest_events(keyless).first()) == (3, 2, 1) and tuple(m.ingest_events(keyless).first()) == (3, 0, 3)
    found = {r["canonical"]: (r["evidence"], r["claim_id"]) for r in m.claims("s").collect()}
    assert {k: v[0] for k, v in found.items()} == {"The gate is open": 3, "operator has name Ines": 1, "The pump is blue": 1}
    assert m.review_queue("s").count() == 3
    decided = {r["claim_id"]: r["action"] for r in m.review("s", t(10, 2)).collect()}
    gate, name, pump = (found[k][1] for k in ("The gate is open", "operator has name Ines", "The pump is blue"))
    assert decided == {gate: "promote", name: "promote", pump: "leave_candidate"} and m.review_queue("s").count() == 0
    assert [r["claim_id"] for r in m.recall("s", "what is my name").collect()] == [name]
    m.apply_decision("s", pump, "pin", t(11, 2))
    assert [r["claim_id"] for r in m.recall("s", "what is the pump").collect()] == [pump] and m.recall("s", "pump and gate").count() == 3
    assert m.recall("s", "archive of the gate").count() == 3
    assert [d["action"] for d in m.explain("s", pump).first()["decisions"]] == ["pin", "leave_candidate"] and m.explain("s", "clm_none").count() == 0
    with pytest.raises(ValueError):
        m.apply_decision("s", pump, "forget", t(12, 2))
    m.upsert_state("s", "mode", "busy", t(1), 3600)
    m.upsert_state("s", "mode", "idle", t(2), 3600)
    assert [(r["value"], r["issued_at"]) for r in m.states("s", t(2)).collect()] == [("idle", t(1))] and m.states("s", t(3)).count() == 0
    assert [r["event_id"] for r in m.timeline("s", "PUMP").collect()] == ["e5"] and m.timeline("s", limit=2).count() == 2
    assert [r["said"] for r in m.patterns("s").collect()] == ["the gate is open"] and all(hasattr(m, tool) for tool in TOOLS)
    assert m.get_events("s", events.select("event_id")).count() == 5
