"""The recall bundle for a table of queries over the derived archive, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import derivation as dv
from annalist.functions import ranking, rules, text
from annalist.operators import artifacts, recall
from annalist.plans.catalogue import ORACLE, QUERIES, _r, query
from annalist.plans.derivation import _DOCS, _RULES, _UPSERT, documents
from annalist.plans.memory import OPENINGS
from annalist.sources import payloads
from annalist.sources.archive import settled, table

__all__ = ["ORACLE", "QUERIES"]

#: The scopes of the archive's documents.
SCOPES = tuple(f"acme::memory::{w}::p" for w in "automobile building furniture household machinery orders parts supply user assistant system".split())


def asked(spark, d) -> DataFrame:
    """qid, scope_key and query: every benchmark item in one of several wordings, and questions for what the archive names, in each scope."""
    c = F.col
    items = table(spark, d, "benchmark").select(F.concat_ws(":", F.lit("item"), "item_id").alias("of"), F.concat_ws(" ", F.get(F.array(*map(F.lit, OPENINGS)), (c("item_id") % len(OPENINGS)).cast("int")), F.coalesce("text", F.lit(""))).alias("query"))
    part = table(spark, d, "part")
    named = lambda column, opening: part.select(c(column).alias("n")).distinct().select(F.concat_ws(":", F.lit(opening), "n").alias("of"), F.concat_ws(" ", F.lit(opening), "n").alias("query"))
    every = items.unionByName(named("p_name", "what is")).unionByName(named("p_brand", "what uses")).unionByName(named("p_name", "what do we know lately about")).unionByName(named("p_brand", "archive of"))
    return every.withColumn("scope_key", F.explode(F.array(*map(F.lit, SCOPES)))).select(F.concat_ws("@", "of", "scope_key").alias("qid"), "scope_key", "query")


def stored(spark, d) -> recall.Stored:
    """The derived archive as recall reads it. Editorial states follow confidence and pins, as of a review that has passed."""
    c, lit = F.col, F.lit
    events = settled(payloads.events_of(payloads.parsed(documents(spark, d))).drop("idempotency_key").withColumn("lease_value", lit(None).cast("string")), many_rules=True)  # no bundle shows what a lease holds
    rows = settled(artifacts.unqueued(events).withColumn("key", artifacts.key()), many_rules=True)
    ref = F.concat_ws(":", "artifact", "key").alias("ref")
    last = settled(artifacts.latest(rows.where("artifact <> 'relation'")))
    # an entity is found by its folded name, which is its key
    found = last.where(c("artifact").isin(*recall.RANKED)).select("scope_key", c("artifact").alias("kind"), ref, F.when(c("artifact") == "entity", c("key")).alias("name"), lit(None).cast("string").alias("predicate"), lit(None).cast("string").alias("object"), "last_seen")
    edges = artifacts.upserted(rows.where("artifact = 'relation'")).select("scope_key", c("artifact").alias("kind"), ref, "name", "predicate", "object", "last_seen")

    def described(wanted: DataFrame) -> DataFrame:
        of = wanted.select("scope_key", c("kind").alias("artifact"), "ref")
        up = artifacts.described(settled(rows.withColumn("ref", ref).join(of, ["scope_key", "artifact", "ref"], "left_semi").drop("ref")))
        sure = c("confidence")
        state = lambda *of: F.when(c("kind") == "entity", None).when(c("pinned"), of[0]).when(sure >= 0.9, of[1]).when(sure >= 0.8, of[2]).when(sure >= 0.62, of[3]).when(sure >= 0.5, of[4])
        known = up.select("scope_key", c("artifact").alias("kind"), ref, "name", "predicate", "object", "canonical", "confidence", "evidence", F.coalesce("pinned", lit(False)).alias("pinned"), "last_seen")
        return known.withColumns({
            "remember": state(lit("remembered"), lit("remembered"), lit("remembered"), lit("candidate"), lit("retired")), "activation": state(lit("active"), lit("active"), lit("dormant"), lit("suppressed"), lit("suppressed")),
            "weight": state(lit(2.0), sure * 1.5, sure, lit(0.0), lit(0.2)), "state_pinned": F.coalesce(state(lit(True), lit(False), lit(False), lit(False), lit(False)), lit(False)),
        })

    leases = last.where("artifact = 'lease'").select("scope_key", ref, c("last_seen").alias("refreshed_at"), "ttl")
    now = leases.agg(F.max("refreshed_at").alias("now"))  # one row
    active = leases.join(F.broadcast(now)).where(F.expr("refreshed_at + make_dt_interval(0, 0, 0, ttl) > now")).select("scope_key", "ref", "refreshed_at")
    support = rows.where(c("artifact").isin(*recall.RANKED) & c("session_id").isNotNull()).select("scope_key", c("artifact").alias("kind"), ref, "session_id")
    kind = F.when(F.startswith("session_id", lit("conv-")), "interaction").when(F.startswith("session_id", lit("NATION")), "import").otherwise("runtime")
    sessions = events.where(c("session_id").isNotNull()).groupBy("scope_key", "session_id").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("last")).select("scope_key", "session_id", kind.alias("kind"), "opened_at", F.when(kind == "interaction", c("last")).alias("closed_at"))
    return recall.Stored(found.unionByName(settled(edges)), support, events.withColumn("ref", F.concat_ws(":", lit("event"), "event_id")), settled(sessions), settled(active), described)


def _has_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def _has(*words: str) -> str:
    return f"list_has_any(tok, [{', '.join(repr(w) for w in words)}])"


def _starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


_STOPPED = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_'']+')"
_content = lambda x: f"list_filter(list_distinct({x}), lambda w: length(w) >= 3 AND w NOT IN ({_STOPPED}))"
_D = lambda v: f"CAST({v} AS DOUBLE)"
_SESSION = f"({_has_any('low', rules.SESSION_MARKERS)} OR ({_has('session')} AND {_has('this', 'current', 'latest')}) OR ({_has('conversation')} AND {_has('this', 'current')}) OR ({_has('just')} AND {_has('now')}))"
_RECENT = f"({_has_any('low', rules.RECENT_MARKERS)} OR {_has('recently', 'lately')} OR ({_has('recent', 'recently')} AND {_has('talk', 'talked', 'discuss', 'discussing')}))"
_PROJECT = f"({_has_any('low', rules.PROJECT_MARKERS)} OR {_has('project', 'workspace', 'codebase', 'repo')})"
_ASKED = f"""items AS (SELECT 'item:' || item_id AS of_, [{", ".join(f"'{o}'" for o in OPENINGS)}][item_id % {len(OPENINGS)} + 1] || ' ' || coalesce(text, '') AS query FROM benchmark
  UNION ALL SELECT DISTINCT 'what is:' || p_name, 'what is ' || p_name FROM part UNION ALL SELECT DISTINCT 'what uses:' || p_brand, 'what uses ' || p_brand FROM part
  UNION ALL SELECT DISTINCT 'what do we know lately about:' || p_name, 'what do we know lately about ' || p_name FROM part UNION ALL SELECT DISTINCT 'archive of:' || p_brand, 'archive of ' || p_brand FROM part),
 q0 AS (SELECT of_ || '@' || scope_key AS qid, scope_key, lower(trim(regexp_replace(query, '{dv.SPACE}', ' ', 'g'))) AS low FROM (SELECT *, unnest([{", ".join(f"'{s}'" for s in SCOPES)}]) AS scope_key FROM items)),
 q1 AS (SELECT *, {_TOKENS.format("low")} AS tok FROM q0),
 q2 AS (SELECT *, list_distinct(tok) AS qw, {_content("tok")} AS qc, {_SESSION} AS session, {_RECENT} AS recent_w, {_PROJECT} AS project_w,
  CASE WHEN {_has_any("low", rules.ARCHAEOLOGY_MARKERS)} THEN 'archaeology' WHEN {_has_any("low", rules.ARCHIVE_MARKERS)} THEN 'archive' WHEN {_SESSION} THEN 'this_session' WHEN {_RECENT} THEN 'recent' WHEN {_has_any("low", rules.IDENTITY_MARKERS)} THEN 'identity' WHEN {_PROJECT} THEN 'project' ELSE 'topic' END AS intent,
  ({_has_any("low", rules.RELATION_MARKERS)} OR ({_has("how", "what")} AND {_has(*rules.RELATION_VERBS)}) OR ({_has("between")} AND {_has("related", "relation", "relationship")})) AS relations,
  ({_has_any("low", rules.EVIDENCE_MARKERS)} OR {_has("evidence", "source", "sources", "provenance", "prove")}) AS proof,
  CASE {" ".join(f"WHEN starts_with(low, '{o}') THEN '{k}'" for o, k in rules.RELATION_QUESTIONS.items())} END AS rk, CASE {" ".join(f"WHEN starts_with(low, '{o}') THEN trim(substr(low, {len(o) + 1}))" for o in rules.RELATION_QUESTIONS)} END AS rt FROM q1),
 q3 AS (SELECT *, CASE WHEN relations AND rk IS NOT NULL AND len({_content(_TOKENS.format("rt"))}) > 0 THEN rk END AS ak, CASE WHEN relations AND rk IS NOT NULL AND len({_content(_TOKENS.format("rt"))}) > 0 THEN rt END AS at_, CASE WHEN intent IN ('archive', 'archaeology') THEN 'archive' ELSE 'default' END AS mode,
  intent = 'identity' OR (low <> '' AND NOT (session OR recent_w OR project_w) AND ({_starts("low", rules.CLAIM_MARKERS)} OR (len(tok) >= 2 AND ((tok[1] || ' ' || tok[2]) IN ({", ".join(f"'{o}'" for o in rules.CLAIM_OPENINGS)}) OR ({_has("remember")} AND {_has("about")})))) AND NOT relations) AS claims FROM q2),
 ses AS (SELECT scope_key, session_id, CASE WHEN starts_with(session_id, 'conv-') THEN 'interaction' WHEN starts_with(session_id, 'NATION') THEN 'import' ELSE 'runtime' END AS kind, min(ts) AS opened_at, CASE WHEN starts_with(session_id, 'conv-') THEN max(ts) END AS closed_at FROM x WHERE session_id IS NOT NULL GROUP BY scope_key, session_id),
 pref AS (SELECT scope_key, session_id AS preferred FROM ses WHERE kind = 'interaction' QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY closed_at IS NOT NULL, coalesce(closed_at, opened_at) DESC, opened_at DESC, session_id) = 1),
 q AS MATERIALIZED (SELECT q3.*, CASE WHEN session THEN preferred END AS preferred, CASE WHEN ak IS NOT NULL THEN {_content(_TOKENS.format("at_"))} ELSE qc END AS sought FROM q3 LEFT JOIN pref USING (scope_key))"""
_LIMIT = "CASE kind WHEN 'claim' THEN 15 WHEN 'episode' THEN 9 WHEN 'entity' THEN 18 ELSE 30 END"
_state = lambda *of: f"CASE WHEN kind = 'entity' THEN NULL WHEN pinned THEN {of[0]} WHEN confidence >= 0.9 THEN {of[1]} WHEN confidence >= 0.8 THEN {of[2]} WHEN confidence >= 0.62 THEN {of[3]} WHEN confidence >= 0.5 THEN {of[4]} END"
_KNOWN = f"""art0 AS (SELECT scope_key, artifact AS kind, artifact || ':' || key AS ref, arg_min(name, o) AS name, arg_min(predicate, o) AS predicate, arg_max(object, o) AS object, arg_min(canonical, o) AS canonical, max(confidence) AS confidence, count(DISTINCT event_id) AS evidence, coalesce(bool_or(pinned), false) AS pinned, arg_max(ts, o) AS last_seen
   FROM u WHERE artifact IN ('claim', 'episode', 'entity', 'relation') GROUP BY scope_key, artifact, key),
 art AS MATERIALIZED (SELECT *, {_state("'remembered'", "'remembered'", "'remembered'", "'candidate'", "'retired'")} AS remember, {_state("'active'", "'active'", "'dormant'", "'suppressed'", "'suppressed'")} AS activation, {_state(_D(2), f"confidence * {_D(1.5)}", "confidence", _D(0), _D(0.2))} AS score, coalesce({_state("true", "false", "false", "false", "false")}, false) AS spinned FROM art0),
 sup AS MATERIALIZED (SELECT DISTINCT scope_key, artifact AS kind, artifact || ':' || key AS ref, session_id FROM u WHERE session_id IS NOT NULL),
 newest AS (SELECT scope_key, kind, ref, last_seen FROM art QUALIFY row_number() OVER (PARTITION BY scope_key, kind ORDER BY last_seen DESC, ref) <= {_LIMIT}),
 in_session AS (SELECT scope_key, session_id, kind, ref, last_seen FROM sup JOIN art USING (scope_key, kind, ref) QUALIFY row_number() OVER (PARTITION BY scope_key, session_id, kind ORDER BY last_seen DESC, ref) <= {_LIMIT}),
 named AS (SELECT qid, kind, ref, last_seen FROM q JOIN art USING (scope_key) WHERE kind = 'entity' AND len(list_filter(qc, lambda w: contains(lower(name), w))) > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY last_seen DESC, ref) <= 18),
 related AS (SELECT qid, kind, ref, last_seen FROM q JOIN art USING (scope_key) WHERE kind = 'relation' AND relations AND len(sought) > 0 AND (ak IS NULL OR predicate = ak) AND len(list_filter(sought, lambda w: NOT (contains(lower(name), w) OR contains(lower(object), w)))) = 0
   QUALIFY row_number() OVER (PARTITION BY qid ORDER BY last_seen DESC, ref) <= 30),
 cand0 AS (SELECT qid, kind, ref, last_seen, 2 AS place FROM q JOIN newest USING (scope_key) UNION ALL SELECT qid, kind, ref, last_seen, 0 FROM q JOIN in_session i ON i.scope_key = q.scope_key AND i.session_id = preferred UNION ALL SELECT *, 1 FROM named UNION ALL SELECT *, 1 FROM related),
 cand1 AS (SELECT qid, kind, ref, max(last_seen) AS last_seen, min(place) AS place FROM cand0 GROUP BY ALL),
 cand2 AS (SELECT c.*, q.intent = 'this_session' AND q.preferred IS NOT NULL AS narrow, bool_or(place = 0) OVER (PARTITION BY qid, c.kind) AS any_own FROM cand1 c JOIN q USING (qid)),
 cand3 AS (SELECT * FROM cand2 WHERE NOT (narrow AND (kind IN ('claim', 'relation') OR (kind = 'episode' AND any_own))) OR place = 0 QUALIFY row_number() OVER (PARTITION BY qid, kind ORDER BY place, last_seen DESC, ref) <= CASE WHEN narrow AND kind = 'relation' THEN 10 ELSE {_LIMIT} END),
 cand AS (SELECT qid, kind, ref, place = 0 AS own, row_number() OVER (PARTITION BY qid, kind ORDER BY last_seen DESC, ref) - 1 AS age, count(*) OVER (PARTITION BY qid, kind) AS n FROM cand3)"""


def _modifier() -> str:
    def one(archive: bool) -> str:
        out = _D(0 if archive else -0.5)
        return f"(score + CASE remember WHEN 'remembered' THEN {_D(0.6)} WHEN 'candidate' THEN {_D(-0.05)} WHEN 'retired' THEN {out} ELSE {_D(0)} END + CASE activation WHEN 'active' THEN {_D(0.25)} WHEN 'dormant' THEN {_D(-0.05)} ELSE {_D(-0.1)} END + CASE WHEN spinned THEN {_D(0.5)} ELSE {_D(0)} END)"

    return f"CASE WHEN remember IS NULL THEN {_D(0)} WHEN mode = 'archive' THEN {one(True)} ELSE {one(False)} END"


def _bonus(most: float) -> str:
    return f"(CASE WHEN n <= 1 THEN {_D(most)} ELSE (1 - age / CAST(n - 1 AS DOUBLE)) * {_D(most)} END)"


def _if(test: str, value: float) -> str:
    return f"CASE WHEN {test} THEN {_D(value)} ELSE {_D(0)} END"


_TOPICAL = f"CASE WHEN len(qc) > 0 AND con <= 0 THEN lex * {_D(0.1)} WHEN con > 0 THEN greatest(con, lex * {_D(0.5)}) ELSE lex END"
_PASSES = "(mode = 'archive' OR (remember IS NOT NULL AND remember NOT IN ('retired', 'superseded') AND NOT (remember = 'candidate' AND activation = 'suppressed')))"
_QUESTION = f"(contains(canonical, '?') OR regexp_extract(regexp_replace(lower(trim(canonical)), '^(({'|'.join(p.strip() for p in rules.FILLER_PREFIXES)}) +)+', ''), '[a-z0-9_'']+') IN ({', '.join(repr(w) for w in text.QUESTION_STARTERS)}))"
_BASE = lambda importance: f"lex + ({importance}) * {_D(0.3)} + confidence * {_D(0.2)} + {_D(ranking.RECENCY_BIAS)}"
_ENTITY_PENALTY = f"CASE WHEN mode = 'archive' THEN {_D(0)} ELSE {_if('lower(name) IN (' + ', '.join(repr(w) for w in (*text.STOP_WORDS, *rules.LOW_SIGNAL_NAMES)) + ')', -1.0)} + {_if('evidence <= 1 AND claims', -0.25)} + {_if('evidence <= 1 AND recent', -0.15)} END"
_MET = "greatest(topical, coalesce(match, 0))"
_LET_IN = f"(mode = 'default' AND relations AND lower(predicate) <> 'related_to' AND remembered = 'candidate' AND coalesce(activation, 'suppressed') = 'suppressed' AND {_MET} >= 0.2 AND confidence >= 0.65)"
_HELD = f"list_filter(list_distinct({_TOKENS.format('object')}), lambda w: length(w) >= 3 AND w NOT IN ({_STOPPED}))"
_RANKED = f"""r0 AS (SELECT c.*, q.* EXCLUDE (qid, scope_key), a.* EXCLUDE (kind, ref), q.intent = 'recent' AS recent, coalesce(remember, 'candidate') AS remembered,
   list_distinct({_TOKENS.format("CASE c.kind WHEN 'relation' THEN concat_ws(' ', name, replace(predicate, '_', ' '), object) WHEN 'claim' THEN canonical ELSE name END")}) AS tw FROM cand c JOIN q ON q.qid = c.qid JOIN art a ON a.scope_key = q.scope_key AND a.kind = c.kind AND a.ref = c.ref),
 r1 AS (SELECT *, CASE WHEN len(qw) = 0 THEN {_D(0)} ELSE len(list_intersect(qw, tw)) / CAST(len(qw) AS DOUBLE) END AS lex, CASE WHEN len(qc) = 0 THEN {_D(0)} ELSE len(list_intersect(qc, tw)) / CAST(len(qc) AS DOUBLE) END AS con,
   CASE WHEN ak IS NOT NULL AND kind = 'relation' THEN CASE WHEN lower(predicate) <> ak THEN {_D(0)} WHEN lower(object) = at_ THEN {_D(1)} WHEN contains(lower(object), at_) THEN {_D(0.95)} WHEN len(list_intersect(sought, {_HELD})) = len(sought) THEN {_D(0.85)} ELSE {_D(0)} END END AS match FROM r0),
 r2 AS (SELECT *, {_TOPICAL} AS topical, {_modifier()} AS modifier, evidence < 2 AND NOT pinned AS few, kind = 'claim' AND {_QUESTION} AS question, lower(name) IN ({", ".join(repr(t) for t in rules.GENERIC_TITLES)}) AND NOT own AS generic FROM r1),
 r3 AS (SELECT qid, kind, ref, mode, claims, relations, proof, CASE kind
   WHEN 'claim' THEN {_PASSES} AND NOT (mode = 'default' AND (question OR (evidence < 2 AND confidence < 0.85 AND length(canonical) > 90))) AND NOT (recent AND NOT own AND few) AND NOT (claims AND mode = 'default' AND NOT own AND NOT pinned AND topical < 0.15)
   WHEN 'episode' THEN {_PASSES} OR (mode = 'default' AND recent AND remembered = 'candidate' AND coalesce(activation, 'suppressed') = 'suppressed' AND evidence >= 1 AND confidence >= 0.9)
   WHEN 'entity' THEN NOT (mode = 'default' AND {_ENTITY_PENALTY} <= -0.9) AND NOT (claims AND mode = 'default' AND topical < 0.15) AND NOT (relations AND mode = 'default')
   ELSE ({_LET_IN} OR {_PASSES}) AND NOT (relations AND match IS NOT NULL AND match <= 0) AND NOT (relations AND {_MET} < 0.15) END AS shown,
  {_r("CASE kind WHEN 'claim' THEN " + _BASE("evidence / CAST(3 AS DOUBLE)") + " + modifier + " + _if("own", 1.0) + f" + CASE WHEN recent THEN {_bonus(0.35)} ELSE {_bonus(0.2)} END + CASE WHEN mode = 'archive' THEN {_D(0)} ELSE {_if('few', -0.35)} + {_if('question', -0.9)} END"
      + f" + CASE WHEN intent <> 'identity' THEN {_D(0)} WHEN lower(predicate) IN ('has name', 'asserts') AND regexp_matches(lower(canonical), 'name|live') THEN {_D(0.45)} WHEN starts_with(lower(canonical), 'operator has ') THEN {_D(0.35)} ELSE {_D(0)} END"
      + f" + CASE WHEN claims THEN CASE remembered WHEN 'remembered' THEN {_D(0.75)} WHEN 'candidate' THEN {_D(-0.1)} ELSE {_D(0)} END + {_if('activation IS NOT DISTINCT FROM ' + repr('active'), 0.15)} + {_if('pinned', 0.15)} + least({_D(0.35)}, topical * {_D(0.7)}) ELSE {_D(0)} END"
      + " WHEN 'episode' THEN " + _BASE("confidence") + " + modifier + " + _if("own", 1.0) + f" + CASE WHEN recent THEN {_bonus(0.8)} ELSE {_bonus(0.2)} END + {_if('evidence < 2', -0.25)} + {_if('generic AND evidence < 2', -0.45)} + {_if('generic AND recent', -0.35)}"
      + f" WHEN 'entity' THEN topical + {_if('own', 0.5)} + least({_D(0.6)}, evidence / {_D(25)}) + {_bonus(0.2)} + {_ENTITY_PENALTY}"
      + " ELSE " + _BASE("confidence") + " + modifier + " + _if("own", 0.7) + f" + {_bonus(0.2)} + CASE WHEN mode = 'archive' THEN {_D(0)} ELSE {_if('evidence <= 1 AND remembered <> ' + repr('remembered'), -0.25)} + {_if('confidence < 0.7', -0.1)} END"
      + f" + {_if('relations AND topical > 0', 0.6)} + CASE WHEN match IS NULL THEN {_D(0)} ELSE {_D(0.45)} + CASE WHEN match >= 0.5 THEN {_D(0.85)} ELSE {_D(0.35)} END END END")} AS score FROM r2),
 r4 AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, ref) AS place FROM r3 WHERE shown QUALIFY place <= CASE WHEN mode = 'archive' THEN CASE kind WHEN 'claim' THEN 2 WHEN 'episode' THEN 1 WHEN 'entity' THEN 3 ELSE 5 END ELSE CASE kind WHEN 'claim' THEN 5 WHEN 'episode' THEN 3 WHEN 'entity' THEN 6 ELSE 10 END END),
 r5 AS (SELECT *, bool_or(kind = 'claim') OVER (PARTITION BY qid) AND claims AND NOT relations AND mode = 'default' AND NOT proof AS quiet FROM r4)"""
_EVENTS = f"""ev AS MATERIALIZED (SELECT scope_key, 'event:' || event_id AS ref, session_id, ts, arrival, lower(coalesce(own, '')) AS said, coalesce(own, '') AS own_text, coalesce(x.said, '') AS p_said, importance, confidence, concat_ws(' ', x.said, own) AS st, list_distinct({_TOKENS.format("concat_ws(' ', x.said, own)")}) AS tw FROM x),
 eq AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM r5 WHERE quiet)),
 met AS (SELECT qid, ref, ts FROM eq JOIN ev USING (scope_key) WHERE intent <> 'recent' AND len(qw) > 0 AND list_has_all(tw, qw) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY arrival, ref) <= 32),
 en AS (SELECT scope_key, ref, ts FROM ev QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY ts DESC, ref) <= 32),
 es AS (SELECT scope_key, session_id, ref, ts FROM ev WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope_key, session_id ORDER BY ts DESC, ref) <= 32),
 e0 AS (SELECT *, 1 AS place FROM met UNION ALL SELECT qid, ref, ts, 1 FROM eq JOIN en USING (scope_key) WHERE qid NOT IN (SELECT qid FROM met) UNION ALL SELECT qid, ref, ts, 0 FROM eq JOIN es ON es.scope_key = eq.scope_key AND es.session_id = preferred),
 e1 AS (SELECT qid, ref, max(ts) AS ts, min(place) AS place FROM e0 GROUP BY ALL),
 e2 AS (SELECT e1.*, intent = 'this_session' AND preferred IS NOT NULL AND mode = 'default' AND bool_or(place = 0) OVER (PARTITION BY qid) AS alone FROM e1 JOIN eq USING (qid)),
 e3 AS (SELECT * FROM e2 WHERE NOT alone OR place = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place, ts DESC, ref) <= 32),
 e4 AS (SELECT e3.qid, e3.ref, e3.ts, eq.* EXCLUDE (qid, scope_key), ev.* EXCLUDE (ref, ts, scope_key), ses.kind AS session_kind, CASE WHEN len(qw) = 0 THEN {_D(0)} ELSE len(list_intersect(qw, tw)) / CAST(len(qw) AS DOUBLE) END AS lex, CASE WHEN len(qc) = 0 THEN {_D(0)} ELSE len(list_intersect(qc, tw)) / CAST(len(qc) AS DOUBLE) END AS con,
   {_has_any("lower(st)", rules.PROJECT_EVENT_MARKERS)} AS project FROM e3 JOIN eq ON eq.qid = e3.qid JOIN ev ON ev.scope_key = eq.scope_key AND ev.ref = e3.ref LEFT JOIN ses ON ses.scope_key = eq.scope_key AND ses.session_id = ev.session_id),
 e4b AS (SELECT *, {_TOPICAL} >= 0.15 AS on_topic, con > 0 OR list_has_any(tw, ['name', 'live']) AS of_name, coalesce(session_kind <> 'import', true) AS live FROM e4),
 e5 AS (SELECT * FROM e4b QUALIFY NOT (intent = 'recent' AND mode = 'default') OR live OR NOT bool_or(live) OVER (PARTITION BY qid)),
 e6 AS (SELECT * FROM e5 QUALIFY NOT (claims AND mode = 'default') OR on_topic OR NOT bool_or(on_topic) OVER (PARTITION BY qid)),
 e7 AS (SELECT * FROM e6 QUALIFY NOT (intent = 'identity' AND mode = 'default') OR of_name OR NOT bool_or(of_name) OVER (PARTITION BY qid)),
 e8 AS (SELECT * FROM e7 QUALIFY NOT (intent = 'project' AND mode = 'default') OR project OR NOT bool_or(project) OVER (PARTITION BY qid)),
 e9 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ts DESC, ref) - 1 AS age, count(*) OVER (PARTITION BY qid) AS n FROM e8),
 ea AS (SELECT qid, ref, said, {_r(_BASE("importance") + " + " + _if("preferred IS NOT NULL AND coalesce(session_id = preferred, false)", 1.0) + f" + CASE WHEN intent = 'recent' THEN {_bonus(0.9)} ELSE {_bonus(0.25)} END + CASE WHEN mode = 'archive' THEN {_D(0)} ELSE " + _if("said IN (" + ", ".join(repr(w) for w in rules.LOW_SIGNAL_EVENTS) + ")", -0.6)
   + " + " + _if("p_said <> '' AND p_said <> own_text AND " + _starts("said", ("the user is ", "you are asking ", "the operator is ", "the operator wants ", "the operator may be ")), -0.55) + " + " + _if(f"len({_TOKENS.format('said')}) <= 2", -0.35) + " + " + _if("session_kind = 'import'", -0.35)
   + " + " + _if("session_kind = 'import' AND intent = 'recent'", -0.8) + " + " + _if("session_kind = 'import' AND intent = 'this_session'", -1.25) + " END + " + _if("intent = 'project' AND project", 0.7))} AS score FROM e9),
 eb AS (SELECT * FROM ea QUALIFY said = '' OR row_number() OVER (PARTITION BY qid, said ORDER BY score DESC, ref) = 1),
 lz AS (SELECT scope_key, 'lease:' || key AS ref, arg_max(ts, o) AS refreshed_at, arg_max(ttl, o) AS ttl FROM u WHERE artifact = 'lease' GROUP BY scope_key, key),
 la AS (SELECT scope_key, ref, row_number() OVER (PARTITION BY scope_key ORDER BY refreshed_at DESC, ref) AS place FROM lz WHERE refreshed_at + to_seconds(ttl) > (SELECT max(refreshed_at) FROM lz) QUALIFY place <= 3)"""


@query(f"""WITH {_DOCS}, {_RULES}, {_UPSERT}, {_ASKED}, {_KNOWN}, {_RANKED}, {_EVENTS} SELECT qid, kind, ref, score, place FROM r5 WHERE NOT quiet OR kind = 'claim'
 UNION ALL SELECT qid, 'event', ref, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ref) AS place FROM eb QUALIFY place <= 8 UNION ALL SELECT qid, 'lease', ref, NULL, place FROM q JOIN la USING (scope_key)""")
def recall_bundles(spark, d):
    return recall.bundles(asked(spark, d), stored(spark, d))
