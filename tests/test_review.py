"""The review's cascade: every reason, and factors and scores against plain Python over the derived archive."""

from datetime import datetime, timedelta

import pytest

from annalist.functions import ranking, rules
from annalist.operators import review

T = datetime(2024, 1, 1)
ARTIFACT = "scope_key string, kind string, ref string, name string, predicate string, canonical string, pinned boolean, evidence long, ts string"
STATE = "scope_key string, kind string, ref string, remember string, state_pinned boolean"
#: kind, name, predicate, canonical, pinned, events (kind, text and other fields), state before, action, locked, reason
CASES = [
    ("claim", "gate", "is", "gate is open", False, [("note", "x")], ("retired", True), "pin", True, "current_pinned"),
    ("claim", "gate", "is", "gate is open", True, [("note", "x")], None, "pin", True, "artifact_pinned"),
    ("claim", "it", "is", "it is asking about gates", False, [("note", "x")], None, "retire", True, "speech_act_claim"),
    ("claim", "btc", "is", "buy btc", False, [("note", "x")], ("remembered", False), "retire", True, "trading_claim_missing_ledger_evidence"),
    ("claim", "btc", "is", "it rose", False, [("note", "sell the position"), ("note", "x")], None, "leave_candidate", True, "trading_claim_requires_ledger_evidence"),
    ("claim", "btc", "is", "buy btc at a profit", False, [("trading_outcome", "sold"), ("decision", "sold")], None, "promote", False, "promotion_threshold"),
    ("claim", "what", "is", "what is the gate", False, [("note", "x")], ("remembered", False), "retire", True, "remembered_question_claim"),
    ("relation", "a", "related_to", "a related_to b", False, [("note", "x")] * 3, ("remembered", False), "retire", True, "weak_related_to_relation"),
    ("relation", "a", "related_to", "a related_to b", False, [("note", "x")] * 3, None, "leave_candidate", True, "weak_related_to_relation"),
    ("episode", "conversation", None, None, False, [("note", "x")] * 3, ("remembered", False), "retire", True, "low_quality_remembered_episode"),
    ("episode", "crypto-regime-cycle", None, None, False, [("trading_market_state", "x")] * 2, None, "leave_candidate", True, "trading_routine_episode_requires_consolidation"),
    ("episode", "crypto-regime-cycle", None, None, False, [("trading_market_state", "x", {"regime_shift": True}), ("decision", "y")], None, "promote", False, "promotion_threshold"),
    ("episode", rules.PROFILE_TITLES[0], None, None, False, [("note", "x")] * 2, ("remembered", False), "retire", True, "personal_profile_episode_requires_consolidation"),
    ("episode", rules.ROUTINE_TITLES[0], None, None, False, [("note", "x")] * 2, None, "leave_candidate", True, "operational_routine_episode_requires_consolidation"),
    ("claim", "gate", "is", "gate is open", False, [("note", "x")], None, "leave_candidate", True, "hold_as_candidate"),
    ("claim", "gate", "is", "gate is open", False, [("note", "x", {"route_domain": "Memory"})], None, "promote", False, "promotion_threshold"),
    ("episode", "open gates", None, None, False, [("note", "open the gates")] * 2 + [("note", "show gates, open")], None, "leave_candidate", True, "hold_as_candidate"),
    ("episode", "marble harbor", None, None, False, [("note", "a")], None, "leave_candidate", True, "hold_as_candidate"),
    ("relation", "a", "uses", "a uses b", False, [("note", "x", {"relation_hint": True})], None, "leave_candidate", False, "below_promotion_threshold"),
    ("relation", "a", "uses", "a uses b", False, [("note", "x")], None, "leave_candidate", True, "hold_as_candidate"),
    ("claim", "gate", "is", "gate is open", False, [("note", "x")] * 3, ("remembered", False), "reinforce", False, "remembered_reinforce"),
    ("relation", "a", "uses", "a uses b", False, [("note", "x", {"importance": 0.1})], ("remembered", False), "retire", False, "remembered_retire"),
    ("episode", "marble harbor", None, None, False, [("note", "a"), ("state_update", "b")], ("remembered", False), "fade", False, "remembered_fade"),
    ("episode", "marble harbor", None, None, False, [], ("remembered", False), "retire", False, "remembered_retire"),
]
FIELDS = "scope_key string, kind string, ref string, event_id string, ts timestamp, event_kind string, raw_text string, importance double, route_domain string, relation_hint boolean, regime_shift boolean"


@pytest.fixture(scope="module")
def decided(spark):
    rows, support, states = [], [], []
    for i, (kind, name, predicate, canonical, pinned, events, state, *_) in enumerate(CASES):
        rows.append(("s", kind, f"a{i}", name, predicate, canonical, pinned, len(events), "clash"))
        for j, (event, said, *more) in enumerate(events):
            x = more[0] if more else {}
            support += [("s", kind, f"a{i}", f"e{i}-{j}", T + timedelta(hours=j), event, said, x.get("importance", 0.6), x.get("route_domain"), x.get("relation_hint"), x.get("regime_shift"))] * 2  # each event twice
        if state:
            states.append(("s", kind, f"a{i}", *state))
    rows.append(("s", "entity", "a-none", "x", None, None, False, 1, ""))
    return review.decide(spark.createDataFrame(rows, ARTIFACT), spark.createDataFrame(support, FIELDS), spark.createDataFrame(states, STATE))


def test_every_reason(spark, decided):
    got = {r["ref"]: (r["action"], r["locked"], r["reason"]) for r in decided.collect()}
    assert len(got) == len(CASES)
    for i, case in enumerate(CASES):
        assert got[f"a{i}"] == case[-3:], case
    assert len({c[-1] for c in CASES}) == 17  # all reasons there are


def test_states_stamps_and_queue_follow(spark, decided):
    rows = {r["ref"]: r for r in decided.collect()}
    assert all((r["remember"], r["activation"]) == ranking.ACTION_STATES[r["action"]] for r in rows.values())
    assert rows["a0"]["pinned"] and rows["a1"]["pinned"] and not rows["a2"]["pinned"] and rows["a23"]["reviewed_at"] is None and rows["a22"]["reviewed_at"] == T + timedelta(hours=1)
    stamped = {r["ref"]: r["last_reinforced_at"] for r in review.stamps(decided, T).collect()}
    assert stamped["a0"] == T and stamped["a14"] is None and "a9" not in stamped
    queue = spark.createDataFrame([("s", "claim", "a0"), ("s", "claim", "later"), ("o", "claim", "a0")], "scope_key string, kind string, ref string")
    assert sorted((r["scope_key"], r["ref"]) for r in review.due(queue, decided).collect()) == [("o", "a0"), ("s", "later")]
    empty = review.decide(spark.createDataFrame([], ARTIFACT), spark.createDataFrame([], FIELDS), spark.createDataFrame([], STATE))
    assert empty.count() == 0


def plain(kind, title, predicate, canonical, pinned, evidence, kinds, importance, state):
    """Factors, score and action of artifacts without trading words and imports. kinds: of the events, newest first."""
    n, primary = len(kinds), kinds[0]
    first = canonical.lower().split()[0] if canonical else ""
    question = kind == "claim" and first in rules.REVIEW_STARTERS
    explicit, repeated = pinned or primary in ranking.EXPLICIT_KINDS, n >= 2 or (kind == "claim" and evidence >= 2)
    pick = lambda a, b, c: a if explicit else b if repeated else c
    if kind == "claim":
        identity, utility = (0.9, 0.95) if explicit else (0.15, 0.1) if question else (0.75, 0.75) if repeated else (0.2, 0.15)
    elif kind == "episode":
        identity = utility = 0.1 if title in rules.GENERIC_TITLES else pick(0.8, 0.7, 0.1)
    else:
        identity, utility = pick(0.75, 0.65, 0.25), pick(0.75, 0.55, 0.2)
    f = {"consequence": 1.0 if pinned else pick(0.85, 0.65, min(0.25, importance * 0.35)), "recurrence": 1.0 if n >= 3 else 0.7 if n == 2 else 0.0, "identity": identity, "utility": utility, "user_emphasis": 1.0 if pinned else pick(0.85, min(0.75, importance), min(0.2, importance * 0.2))}
    score = max(0.0, min(1.0, ranking.KIND_BIAS.get(primary, 0.0) + sum(ranking.WEIGHTS[k] * v for k, v in f.items())))
    return score, question


def test_scores_of_the_derived_archive(spark):
    from annalist.plans.all import QUERIES
    from annalist.plans.review import pieces

    sf = "/root/testdata/sf0.001"
    known, support, states = pieces(spark, sf)
    events = {}
    for r in support.dropDuplicates(["scope_key", "ref", "event_id"]).collect():
        events.setdefault((r["scope_key"], r["ref"]), []).append((r["ts"], r["event_id"], r["event_kind"], r["importance"]))
    rows = {(r["scope_key"], r["ref"]): r for r in QUERIES["review_decisions"](spark, sf).collect()}
    checked = 0
    for a in known.collect():
        own = sorted(events[a["scope_key"], a["ref"]], reverse=True)
        score, _ = plain(a["kind"], (a["name"] or "").lower(), a["predicate"], a["canonical"], a["pinned"], a["evidence"], [e[2] for e in own], max(e[3] for e in own), None)
        got = rows[a["scope_key"], a["ref"]]
        assert got["score"] == pytest.approx(score, abs=1e-4), a
        checked += 1
    assert checked == len(rows) > 300 and len({r["reason"] for r in rows.values()}) >= 6
