"""The episode fold with closes, and the same as keyed state of a stream, restarts included."""

import json
import random
from datetime import datetime, timedelta

import pytest

from annalist.operators.episodes import CHANGE, episode_changes, episodes_of
from annalist.streaming import folds

START = datetime(2024, 1, 1)
TITLES = ["marble harbor", "harbor marbles plan", "blue lantern", "lantern plan", "gates", "the harbor of marble plan", "Blue Lantern"]
EVENT = "event_id long, session_id long, ts timestamp, title string, entities array<string>, confidence double"
COLUMNS = [part.split()[0] for part in CHANGE.split(", ")]


def steps(n, seed):
    """Events in order of time over four sessions, some of which close, go on and close again."""
    rng = random.Random(seed)
    at, events, closes = START, [], []
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 3, 9, 30]), seconds=rng.randrange(60))
        session = rng.randrange(4)
        if rng.random() < 0.06:
            closes.append((session, at))
        else:
            events.append((i, session, at, rng.choice(TITLES), rng.sample(["Gate", "Pump", "Valve", "Tank", "Hull"], rng.randrange(6)), round(rng.random(), 2)))
    return events, closes


def plain(events, closes, gap=20, related=10):
    """Every rule as it is told, with all episodes kept."""
    from tests.test_memory import topics

    out, episodes, n = {}, [], 0
    minutes = lambda m: timedelta(minutes=m)
    for ts, closing, x in sorted([(e[2], False, e) for e in events] + [(c[1], True, c) for c in closes], key=lambda s: (s[0], s[1], s[2][0])):
        n += 1
        if closing:
            for k, e in enumerate(e for e in episodes if e["session"] == x[0] and e["status"] == "open"):
                e |= {"status": "closed", "end": ts, "updated": ts, "touched": n + k / 1000}
            continue
        i, session, _, title, entities, confidence = x
        entities = entities[:4]
        own = sorted((e for e in episodes if e["session"] == session), key=lambda e: (e["updated"], e["touched"]), reverse=True)
        found = next((e for e in own if e["title"].lower() == title.lower() and e["status"] == "open" and e["updated"] >= ts - minutes(gap)), None)
        if found is None:
            best = 0
            for e in own[:12]:
                t, m = len(topics(e["title"]) & topics(title)), len({a.lower() for a in e["entities"]} & {a.lower() for a in entities})
                if e["updated"] >= ts - minutes(related) and e["title"].lower() != title.lower() and (t >= 2 or (t and m)) and 2 * t + m > best:
                    best, found = 2 * t + m, e
        if found is None:
            found = {"session": session, "title": title, "number": sum(e["session"] == session for e in episodes) + 1, "start": ts, "status": "open", "end": None, "entities": [], "confidence": 0.0, "events": 0}
            episodes.append(found)
        found |= {"updated": ts, "touched": n, "entities": entities or found["entities"], "confidence": max(found["confidence"], confidence), "events": found["events"] + 1}
        out[i] = found["number"]
    return out, {(e["session"], e["number"]): (e["title"], e["status"], e["start"], e["end"], e["updated"], e["entities"], e["confidence"], e["events"]) for e in episodes}


def table(changes):
    names = "title status start_at end_at updated_at entities confidence events".split()
    return {(r["session_id"], r["episode"]): tuple(r[n] for n in names) for r in episodes_of(changes).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_with_closes(spark, seed):
    events, closes = steps(400, seed)
    df = spark.createDataFrame(events, EVENT).repartition(5)
    changes = episode_changes(df, spark.createDataFrame(closes, "session_id long, ts timestamp"))
    assigned, episodes = plain(events, closes)
    assert {r["event_id"]: r["episode"] for r in changes.where("event_id is not null").collect()} == assigned
    assert table(changes) == episodes
    assert sum(e[1] == "closed" for e in episodes.values()) > 20 and any(e[1] == "open" for e in episodes.values())


def test_fold_of_awkward_rows(spark):
    rows = [(1, None, START, "x", None, None), (2, 1, None, "x", None, None), (3, 1, START, None, None, None), (4, 1, START, None, [None, "A"], 0.5), (4, 1, START, None, ["A"], None), (5, 2, START, "", [], 0.1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], EVENT + ", episode string")
    out = episode_changes(df).collect()
    assert sorted((r["event_id"], r["session_id"], r["episode"], r["events"]) for r in out) == [(3, 1, 1, 1), (4, 1, 1, 2), (4, 1, 1, 3), (5, 2, 1, 1)]
    assert {r["confidence"] for r in out if r["session_id"] == 1} == {None, 0.5}
    assert episode_changes(df.limit(0)).count() == 0 and episodes_of(episode_changes(df.limit(0))).count() == 0


def lines(events, closes, leases=()):
    at = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")
    rows = [(e[2], 0, {"session_id": e[1], "event_id": e[0], "ts": at(e[2]), "title": e[3], "entities": e[4], "confidence": e[5]}) for e in events]
    rows += [(t, 2, {"session_id": s, "ts": at(t), "closes": True}) for s, t in closes]
    rows += [(t, 1, {"session_id": s, "ts": at(t), "lease_key": k, "value": v, "ttl": ttl}) for s, t, k, v, ttl in leases]
    return [json.dumps(x) for _, _, x in sorted(rows, key=lambda r: (r[0], r[1], r[2].get("event_id", -1)))]


def run(spark, folder, batches):
    """Feeds the batches one by one, with a query that is stopped and started anew from its checkpoint in between."""
    source = folder / "in"
    source.mkdir(parents=True)
    seen = []
    for i, batch in enumerate(batches):
        (source / f"{i:03}.json").write_text("\n".join(batch))
        query = folds.session_changes(folds.stream_steps(spark, str(source))).writeStream.outputMode("append").option("checkpointLocation", str(folder / "state")).foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
    return seen


def test_stream_equals_the_fold_for_any_split(spark, tmp_path):
    events, closes = steps(160, 7)
    _, expected = plain(events, closes)
    changes = episode_changes(spark.createDataFrame(events, EVENT), spark.createDataFrame(closes, "session_id long, ts timestamp"))
    batch = sorted(repr(tuple(r[c] for c in COLUMNS)) for r in changes.collect())
    rows = lines(events, closes)
    for k, cuts in enumerate(([0], [0, 40, 41, 100], [0, 1, 150])):
        got = run(spark, tmp_path / str(k), [rows[a:b] for a, b in zip(cuts, [*cuts[1:], None], strict=True)])
        assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in got if r["what"] == "episode") == batch, cuts
        latest = {}
        for r in sorted((r for r in got if r["what"] == "episode"), key=lambda r: r["seq"]):
            latest[r["session_id"], r["episode"]] = (r["title"], r["status"], r["start_at"], r["end_at"], r["updated_at"], r["entities"], r["confidence"], r["events"])
        assert latest == expected


def test_stream_ends_leases_by_time_and_by_close(spark, tmp_path):
    m = lambda x: START + timedelta(minutes=x)
    leases = [(1, m(0), "a", "x", 600), (1, m(5), "a", "y", 600), (1, m(6), "b", "z", 60_000), (2, m(6), "a", "w", 60_000), (1, m(30), "a", "v", 600)]
    first = lines([], [], leases)
    batches = [first[:2], first[2:], lines([(9, 1, m(40), "gates", [], 0.5)], [(1, m(41))]), lines([(10, 3, m(600), "gates", [], 0.5)], []), lines([(11, 3, m(601), "gates", [], 0.5), (12, 1, m(601), "gates", [], 0.5)], [], [(1, m(602), "b", "new", 60)])]
    told = [(r["session_id"], r["lease_key"], r["status"], r["value"], r["issued_at"], r["expires_at"]) for r in run(spark, tmp_path, batches) if r["what"] == "lease"]
    of = lambda s, k: [t[2:] for t in told if t[:2] == (s, k)]
    # a lease that was held past its end begins anew; the session's close ends what it holds, other sessions' leases stay
    assert of(1, "a") == [("active", "x", m(0), m(10)), ("active", "y", m(0), m(15)), ("active", "v", m(30), m(40)), ("closed", "v", m(30), m(41))]
    assert of(1, "b") == [("active", "z", m(6), m(1006)), ("closed", "z", m(6), m(41)), ("active", "new", m(602), m(603))]
    assert of(2, "a") == [("active", "w", m(6), m(1006))]


def test_stream_expires_leases_once_the_watermark_passes(spark, tmp_path):
    m = lambda x: START + timedelta(minutes=x)
    batches = [lines([], [], [(1, m(0), "a", "x", 600), (1, m(0), "b", "y", 60 * 600)]), lines([], [], [(2, m(200), "c", "z", 6000)]), lines([(1, 2, m(201), "gates", [], 0.5)], [])]
    told = [(r["lease_key"], r["status"]) for r in run(spark, tmp_path, batches) if r["what"] == "lease"]
    assert sorted(told) == [("a", "active"), ("a", "expired"), ("b", "active"), ("c", "active")]


def test_fold_shuffles_once(spark):
    changes = episode_changes(spark.createDataFrame(steps(50, 4)[0], EVENT))
    assert changes._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
