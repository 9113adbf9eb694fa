"""Registered queries over a synthesized memory: events with payloads and hints, their derivation, review and recall.

The given tables hold no payloads, hints or decisions, so they are made from events by fixed rules, the same in SQL: what
an event says goes by its number, what it is about is its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions import ranking, rules, text, trading
from annalist.functions.policy import policy_of
from annalist.functions.text import rounded
from annalist.operators import archive as ops
from annalist.operators import episodes as folds
from annalist.plans.catalogue import _EDGES, _STATES, ORACLE, QUERIES, _edges, _r, query
from annalist.sources.archive import editorial_states, messages, table

__all__ = ["ORACLE", "QUERIES"]

KINDS = ("message", "decision", "note", "state_update", "summary", "fact_assertion", "tool_result")
ACTIONS = ("promote", "reinforce", "leave_candidate", "fade", "pin", "retire", "mark_disputed", "mark_superseded")
_W = r"""w AS (SELECT event_id, user_id AS session_id, ts, event_type AS thing, value, least(1.0, value / 500) AS importance,
 ['message', 'decision', 'note', 'state_update', 'summary', 'fact_assertion', 'tool_result'][event_id % 7 + 1] AS kind,
 CASE event_id % 10 WHEN 0 THEN 'so The ' || event_type || '  is open' WHEN 1 THEN 'what is the ' || event_type WHEN 2 THEN 'My ' || event_type || ' is item ' || user_id || '.'
  WHEN 3 THEN 'The user is asking about ' || event_type WHEN 4 THEN 'ok' WHEN 5 THEN 'Gate uses ' || event_type WHEN 6 THEN 'remember my name is Name' || user_id
  WHEN 7 THEN event_type || ' failed due to pumps' WHEN 8 THEN '' ELSE 'we have ' || event_type || ' ready?' END AS raw_text,
 CASE WHEN event_id % 6 = 3 THEN 'plain ' || event_type ELSE '' END AS p_raw,
 CASE WHEN event_id % 10 = 4 THEN 'the speaker agrees with everything that was said about the ' || event_type ELSE '' END AS p_interpreted,
 CASE WHEN event_id % 2 = 0 THEN ' seen  ' || event_type ELSE '' END AS observation,
 CASE event_id % 11 WHEN 3 THEN 'Memory' WHEN 5 THEN 'mcp' WHEN 7 THEN 'session_mode' ELSE '' END AS route_domain,
 CASE WHEN event_id % 11 = 5 THEN 'observe' WHEN event_id % 13 = 1 THEN 'remember_fact' ELSE '' END AS route_action,
 event_id % 97 = 0 AS pinned, user_id % 5 = 0 AS imported, CAST(0.6 + 0.1 * (event_id % 4) AS DOUBLE) AS confidence FROM events)"""


def archive(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    at = lambda n: F.col("event_id") % n
    thing, user = F.col("event_type"), F.col("user_id").cast("string")
    said = F.array(
        F.concat(F.lit("so The "), thing, F.lit("  is open")), F.concat(F.lit("what is the "), thing), F.concat(F.lit("My "), thing, F.lit(" is item "), user, F.lit(".")),
        F.concat(F.lit("The user is asking about "), thing), F.lit("ok"), F.concat(F.lit("Gate uses "), thing), F.concat(F.lit("remember my name is Name"), user),
        F.concat(thing, F.lit(" failed due to pumps")), F.lit(""), F.concat(F.lit("we have "), thing, F.lit(" ready?")),
    )
    domain = F.when(at(11) == 3, "Memory").when(at(11) == 5, "mcp").when(at(11) == 7, "session_mode").otherwise("")
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), "ts", thing.alias("thing"), "value", F.least(F.lit(1.0), F.col("value") / 500).alias("importance"),
        F.get(F.array(*map(F.lit, KINDS)), at(7).cast("int")).alias("kind"), F.get(said, at(10).cast("int")).alias("raw_text"),
        F.when(at(6) == 3, F.concat(F.lit("plain "), thing)).otherwise("").alias("p_raw"),
        F.when(at(10) == 4, F.concat(F.lit("the speaker agrees with everything that was said about the "), thing)).otherwise("").alias("p_interpreted"),
        F.when(at(2) == 0, F.concat(F.lit(" seen  "), thing)).otherwise("").alias("observation"), domain.alias("route_domain"),
        F.when(at(11) == 5, "observe").when(at(13) == 1, "remember_fact").otherwise("").alias("route_action"),
        (at(97) == 0).alias("pinned"), (F.col("user_id") % 5 == 0).alias("imported"), (F.lit(0.6) + F.lit(0.1) * at(4)).alias("confidence"),
    )


def _text() -> F.Column:
    none = F.lit("")
    return rules.derivation_text(F.col("kind"), F.col("raw_text"), none, F.col("p_raw"), none, F.col("p_interpreted"), F.col("observation"))


def derived(spark, d) -> DataFrame:
    return archive(spark, d).withColumn("text", _text())


# What the rules say of each template: 3 is an interpretation (its payload's text counts if there is one), 4 a short reaction.
_X = """x AS (SELECT *, CASE WHEN kind = 'tool_result' AND observation <> '' THEN 'seen ' || thing WHEN event_id % 10 = 3 AND p_raw <> '' THEN p_raw
 WHEN event_id % 10 = 4 AND p_raw = '' AND kind <> 'fact_assertion' THEN p_interpreted WHEN event_id % 10 = 0 THEN 'so The ' || thing || ' is open'
 WHEN event_id % 10 = 8 AND p_raw <> '' THEN p_raw ELSE raw_text END AS text FROM w)"""


@query(f"WITH {_W}, {_X} SELECT event_id, text FROM x")
def derivation_text(spark, d):
    return derived(spark, d).select("event_id", "text")


@query(f"""WITH {_W}, {_X} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Hinted  title' WHEN event_id % 9 = 1 THEN 'marble-harbor'
 WHEN text <> '' THEN array_to_string(string_split(lower(text), ' ')[1:4], '-') ELSE kind END AS title FROM x""")
def episode_titles(spark, d):
    hint = F.when(F.col("event_id") % 9 == 0, "Hinted  title").when(F.col("event_id") % 9 == 2, "Conversation")
    entity = F.when(F.col("event_id") % 9 == 1, "Marble Harbor")
    return derived(spark, d).select("event_id", rules.episode_title(hint, entity, F.col("text"), F.col("kind")).alias("title"))


@query(f"""WITH {_W}, u AS (SELECT session_id, 'thing-' || thing AS lease_key, event_id, ts, CASE WHEN event_id % 3 = 0 THEN 3600 ELSE 86400 * (event_id % 3) END AS ttl, value FROM w WHERE kind = 'state_update'),
 l AS (SELECT session_id, lease_key, min(ts) AS issued_at, max(ts) AS refreshed_at, arg_max(value, ts) AS value, max(ts) + to_seconds(arg_max(ttl, ts)) AS expires_at FROM u GROUP BY ALL), n AS (SELECT max(ts) AS now FROM w)
 SELECT session_id, lease_key, issued_at, refreshed_at, value, row_number() OVER (PARTITION BY session_id ORDER BY refreshed_at DESC, lease_key) AS place FROM l, n WHERE expires_at > now QUALIFY place <= 3""")
def leases_active_newest(spark, d):
    w = archive(spark, d)
    ttl = F.when(F.col("event_id") % 3 == 0, 3600).otherwise(86400 * (F.col("event_id") % 3))
    u = w.where("kind = 'state_update'").withColumn("lease_key", F.concat(F.lit("thing-"), "thing")).withColumn("ttl", ttl)
    leases = u.groupBy("session_id", "lease_key").agg(F.min("ts").alias("issued_at"), F.max("ts").alias("refreshed_at"), F.max_by("value", "ts").alias("value"), F.max_by("ttl", "ts").alias("ttl"))
    now = w.agg(F.max("ts").alias("now"))  # one row
    live = leases.join(F.broadcast(now)).where(F.expr("refreshed_at + make_dt_interval(0, 0, 0, ttl) > now"))
    return ops.top_by(live, ["session_id"], [F.desc("refreshed_at"), "lease_key"], 3, "place").select("session_id", "lease_key", "issued_at", "refreshed_at", "value", "place")


@query(f"""WITH {_W}, {_X}, f AS (SELECT event_id, session_id, thing, text, event_id % 10 AS t, confidence, pinned FROM x WHERE kind = 'fact_assertion' AND text <> '')
 SELECT event_id, CASE WHEN t IN (2, 6) THEN 'operator' END AS subject, CASE WHEN t = 6 THEN 'has name' WHEN t = 2 THEN 'has ' || thing ELSE 'asserts' END AS predicate,
 CASE WHEN t = 6 THEN 'Name' || session_id WHEN t = 2 THEN 'item ' || session_id WHEN t = 0 THEN 'The ' || thing || ' is open' ELSE text END AS object, greatest(CAST(0.7 AS DOUBLE), confidence) AS confidence, pinned FROM f""")
def fact_claims(spark, d):
    f = derived(spark, d).where("kind = 'fact_assertion' and text <> ''").withColumn("said", F.regexp_replace("text", "(?i)^(so|well|but|like|ok|okay|right|actually|alright|all right) ", ""))
    fact = rules.memory_fact(F.col("said"))
    return f.withColumn("f", fact).select(
        "event_id", F.col("f.subject").alias("subject"), F.coalesce("f.predicate", F.lit("asserts")).alias("predicate"),
        F.coalesce("f.object", "said").alias("object"), F.greatest(F.lit(0.7), F.col("confidence")).alias("confidence"), "pinned",
    )


@query(f"""WITH {_W} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'operator' WHEN 1 THEN 'operator' WHEN 2 THEN 'Ines' WHEN 3 THEN 'operator' ELSE 'we' END AS subject,
 CASE event_id % 5 WHEN 0 THEN 'has name' WHEN 1 THEN 'lives in' WHEN 2 THEN 'likes' WHEN 3 THEN 'has name' ELSE 'lives in' END AS predicate,
 CASE event_id % 5 WHEN 0 THEN thing WHEN 1 THEN thing WHEN 2 THEN thing WHEN 3 THEN 'Tomas' ELSE thing END AS object,
 CASE event_id % 5 WHEN 0 THEN 'operator has name ' || thing WHEN 1 THEN 'operator lives in ' || thing WHEN 2 THEN 'Ines likes ' || thing WHEN 3 THEN 'operator has name Tomas' ELSE 'we lives in ' || thing END AS canonical FROM w""")
def payload_claims(spark, d):
    # claims of a payload: the operator's own name and home, those of a named speaker, and others
    case = lambda *xs: F.get(F.array(*xs), (F.col("event_id") % 5).cast("int"))
    thing = F.col("thing")
    subject = case(F.lit("operator"), F.lit("Ines"), F.lit("Ines"), F.lit("tomas"), F.lit("we"))
    predicate = case(F.lit("has  name"), F.lit("lives in"), F.lit("likes"), F.lit("Has name"), F.lit("lives in"))
    said = case(F.concat(thing, F.lit("..")), thing, thing, F.lit("Tomas"), thing)
    canonical = case(F.lit("x"), F.concat(F.lit("Ines lives in "), thing), F.concat(F.lit("Ines likes "), thing, F.lit(".")), F.lit("y"), F.concat(F.lit("we lives in "), thing))
    return archive(spark, d).withColumn("c", rules.profile_claim(subject, predicate, said, canonical)).select("event_id", "c.*")


@query(f"WITH {_W} SELECT event_id, event_id % 10 IN (1, 9) AS asks, event_id % 10 = 1 AS review_asks, event_id % 10 = 3 AS interpretive, event_id % 10 IN (2, 9) AS asserts, event_id % 4 = 1 AS speech FROM w")
def text_tests(spark, d):
    claim = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("It is wondering about "), "thing")).otherwise(F.concat(F.lit("The gate is wondering about "), "thing"))
    t = F.col("raw_text")
    return archive(spark, d).select("event_id", rules.asks(t).alias("asks"), rules.review_asks(t).alias("review_asks"), rules.interpretive(t).alias("interpretive"), rules.asserts_a_fact(t).alias("asserts"), rules.speech_act(claim).alias("speech"))


@query(f"""WITH {_W}, q AS (SELECT session_id, 'relation' AS artifact_type, thing AS artifact, 'derived_relation' AS trigger, CAST(0.35 AS DOUBLE) AS priority, event_id FROM w WHERE event_id % 10 IN (5, 7)
  UNION ALL SELECT session_id, 'claim', thing, 'derived_claim', importance, event_id FROM w WHERE kind = 'fact_assertion' AND NOT pinned UNION ALL SELECT session_id, 'episode', thing, 'episode_activity', CAST(0.3 AS DOUBLE), event_id FROM w)
 SELECT session_id, artifact_type, artifact, trigger, priority, event_id FROM q QUALIFY row_number() OVER (PARTITION BY session_id, artifact_type, artifact, trigger ORDER BY event_id) = 1""")
def queue_triggers(spark, d):
    # a pinned claim is remembered at once and not queued; of pending duplicates the first stays
    w = archive(spark, d)
    row = lambda kind, trigger, priority: (F.lit(kind).alias("artifact_type"), F.col("thing").alias("artifact"), F.lit(trigger).alias("trigger"), priority.alias("priority"), "event_id")
    relations = w.where(F.col("event_id") % 10 % 2 == 1).where((F.col("event_id") % 10).isin(5, 7)).select("session_id", *row("relation", "derived_relation", F.lit(0.35)))
    claims = w.where("kind = 'fact_assertion' and not pinned").select("session_id", *row("claim", "derived_claim", F.col("importance")))
    found = relations.unionByName(claims).unionByName(w.select("session_id", *row("episode", "episode_activity", F.lit(0.3))))
    return ops.first_by(found, ["session_id", "artifact_type", "artifact", "trigger"], ["event_id"])


@query(r"""WITH t AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_'']+')), lambda x: length(x) >= 4 AND x NOT IN ('from', 'into', 'that', 'this', 'with', 'what', 'when', 'where', 'which', 'your', 'about')) AS l FROM benchmark)
 SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(l, list_transform(list_filter(l, lambda x: suffix(x, 's') AND length(x) >= 6), lambda x: left(x, length(x) - 1))))), ' ') AS topics FROM t""")
def topic_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(rules.topic_tokens(F.col("text"))), " ").alias("topics"))


@query("")
def related_episode_merge(spark, d):
    titled = derived(spark, d).select("event_id", "session_id", "ts", rules.episode_title(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text"), F.col("kind")).alias("title"), F.array("thing").alias("entities"), "confidence")
    return folds.assign_episodes(titled, gap_minutes=600, related_minutes=300)


# Queries of all wordings: one for each benchmark item, its opening by its number.
OPENINGS = (
    "walk the chain of", "history of", "just now in this session:", "lately", "what is my name and", "the codebase", "tell me of", "what is", "how is related to",
    "what uses widget", "what depends on cold", "show the evidence of", "recent talk of", "remember anything about", "where do", "what caused the",
)
_ASKED = f"""asked AS (SELECT item_id, item_id % {len(OPENINGS)} AS t, [{", ".join(f"'{o}'" for o in OPENINGS)}][item_id % {len(OPENINGS)} + 1] || ' ' || left(coalesce(text, ''), 40) AS query FROM benchmark)"""


def asked(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.concat_ws(" ", F.get(F.array(*map(F.lit, OPENINGS)), (F.col("item_id") % len(OPENINGS)).cast("int")), F.left(F.coalesce("text", F.lit("")), F.lit(40))).alias("query"))


@query(f"""WITH {_ASKED} SELECT item_id, ['archaeology', 'archive', 'this_session', 'recent', 'identity', 'project', 'topic', 'topic', 'topic', 'topic', 'topic', 'topic', 'recent', 'topic', 'topic', 'topic'][t + 1] AS intent,
 t IN (8, 9, 10, 15) AS relation_focused, t IN (4, 7, 9, 10, 11, 13, 14, 15) AND t NOT IN (9, 10, 11, 15) AS claim_focused, t = 11 AS evidence_asked FROM asked""")
def query_intents(spark, d):
    q = F.col("query")
    return asked(spark, d).select("item_id", rules.intent(q).alias("intent"), rules.relation_focus(q).alias("relation_focused"), rules.claim_focus(q).alias("claim_focused"), rules.evidence_focus(q).alias("evidence_asked"))


_SHAPE = "s AS (SELECT item_id, query, CASE t WHEN 9 THEN 'uses' WHEN 10 THEN 'depends_on' WHEN 15 THEN 'causes' END AS relation, CASE WHEN t IN (9, 10, 15) THEN regexp_replace(trim(regexp_replace(lower(query), '[ \\n\\t]+', ' ', 'g')), '^what (uses|depends on|caused) ', '') END AS target FROM asked WHERE t IN (9, 10, 15))"


@query(f"WITH {_ASKED}, {_SHAPE} SELECT item_id, relation, target FROM s")
def asked_relations(spark, d):
    kind, target = rules.asked_relation(F.col("query"))
    return asked(spark, d).select("item_id", kind.alias("relation"), target.alias("target")).where("relation is not null")


_STOPPED = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_PART_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9_'']+')), lambda x: length(x) >= 3 AND x NOT IN ({_STOPPED}))"


@query(f"""WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS low, {_PART_TOKENS.format("p_name")} AS held, ['cold widget', 'widget', 'widget cold', 'large', 'the of'][p_partkey % 5 + 1] AS target FROM part), m AS (SELECT *, {_PART_TOKENS.format("target")} AS wanted FROM n)
 SELECT p_partkey, CASE WHEN len(wanted) = 0 THEN CAST(0 AS DOUBLE) WHEN low = target THEN CAST(1 AS DOUBLE) WHEN contains(low, target) THEN CAST(0.95 AS DOUBLE) WHEN len(list_intersect(wanted, held)) = len(wanted) THEN CAST(0.85 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS match FROM m""")
def relation_target_match(spark, d):
    target = F.get(F.array(*map(F.lit, ("cold widget", "widget", "widget cold", "large", "the of"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", rules.target_match(F.col("p_name"), target).alias("match"))


# Decisions of a review: every fifth event is one, on the claim (session, thing).
_D = "d AS (SELECT event_id AS decision_id, session_id, thing, ['promote', 'reinforce', 'leave_candidate', 'fade', 'pin', 'retire', 'mark_disputed', 'mark_superseded'][event_id // 5 % 8 + 1] AS action, ts AS decided_at, importance AS score, event_id % 15 = 0 AS manual FROM w WHERE event_id % 5 = 0)"


def decisions(spark, d) -> DataFrame:
    action = F.get(F.array(*map(F.lit, ACTIONS)), F.expr("cast(event_id div 5 % 8 as int)"))
    return archive(spark, d).where("event_id % 5 = 0").select(F.col("event_id").alias("decision_id"), "session_id", "thing", action.alias("action"), F.col("ts").alias("decided_at"), F.col("importance").alias("score"), (F.col("event_id") % 15 == 0).alias("manual"))


@query(f"WITH {_W}, {_D} SELECT session_id, thing, decision_id, action, decided_at, row_number() OVER (PARTITION BY session_id, thing ORDER BY decided_at DESC, decision_id) AS place FROM d")
def decision_log(spark, d):
    w = Window.partitionBy("session_id", "thing").orderBy(F.desc("decided_at"), "decision_id")
    return decisions(spark, d).withColumn("place", F.row_number().over(w)).select("session_id", "thing", "decision_id", "action", "decided_at", "place")


@query(f"WITH {_W}, {_D} SELECT decision_id, session_id, action, decided_at FROM d WHERE thing IN ('click', 'view') ORDER BY decided_at DESC, decision_id LIMIT 20")
def recent_decisions(spark, d):
    return decisions(spark, d).where(F.col("thing").isin("click", "view")).select("decision_id", "session_id", "action", "decided_at").orderBy(F.desc("decided_at"), "decision_id").limit(20)


_L = """l AS (SELECT session_id, thing, arg_max(action, decided_at) AS action, CASE WHEN arg_max(manual, decided_at) THEN CAST(0 AS DOUBLE) ELSE arg_max(score, decided_at) END AS score, bool_or(action = 'pin' AND manual) OR arg_max(action, decided_at) = 'pin' AS pinned, max(decided_at) AS reviewed_at FROM d GROUP BY ALL),
 st AS (SELECT *, CASE WHEN action IN ('promote', 'reinforce', 'pin', 'fade') THEN 'remembered' WHEN action = 'retire' THEN 'retired' WHEN action = 'mark_disputed' THEN 'disputed' WHEN action = 'mark_superseded' THEN 'superseded' ELSE 'candidate' END AS remember,
  CASE WHEN action IN ('promote', 'reinforce', 'pin') THEN 'active' WHEN action = 'fade' THEN 'dormant' ELSE 'suppressed' END AS activation FROM l)"""


def states(spark, d) -> DataFrame:
    """Editorial state of each claim: its latest decision overwrites all, a manual pin stays, a manual decision has no score."""
    latest = lambda c: F.max_by(c, "decided_at")
    found = decisions(spark, d).groupBy("session_id", "thing").agg(
        latest("action").alias("action"), F.when(latest("manual"), 0.0).otherwise(latest("score")).alias("score"),
        (F.bool_or((F.col("action") == "pin") & F.col("manual")) | (latest("action") == "pin")).alias("pinned"), F.max("decided_at").alias("reviewed_at"),
    )
    remember, activation = ranking.states_of(F.col("action"))
    return found.withColumn("remember", remember).withColumn("activation", activation)


@query(f"WITH {_W}, {_D}, {_L} SELECT session_id, thing, remember, activation, score, pinned, reviewed_at FROM st")
def editorial_state_latest(spark, d):
    return states(spark, d).select("session_id", "thing", "remember", "activation", "score", "pinned", "reviewed_at")


@query(f"""WITH {_W}, {_D}, {_L}, o AS (SELECT session_id, thing, remember, reviewed_at, CASE remember WHEN 'candidate' THEN 0 WHEN 'disputed' THEN 1 WHEN 'remembered' THEN 2 WHEN 'superseded' THEN 3 ELSE 4 END AS rank FROM st WHERE NOT pinned)
 SELECT session_id, thing, remember, row_number() OVER (PARTITION BY session_id ORDER BY rank, reviewed_at DESC, thing) AS place FROM o""")
def state_order(spark, d):
    # reconsidered states, without pinned ones: candidates first
    rank = F.array_position(F.array(*map(F.lit, ("candidate", "disputed", "remembered", "superseded", "retired"))), F.col("remember"))
    s = states(spark, d).where("not pinned").withColumn("rank", rank)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("rank", F.desc("reviewed_at"), "thing"))).select("session_id", "thing", "remember", "place")


@query(f"""WITH {_W}, {_D}, g AS (SELECT session_id, thing, min(ts) AS first_seen FROM w GROUP BY ALL), a AS (SELECT *, NOT manual AND action IN ('promote', 'reinforce', 'pin') AS kept FROM d)
 SELECT session_id, thing, CASE WHEN bool_or(kept) THEN any_value(first_seen) END AS valid_from, max(decided_at) FILTER (kept) AS last_reinforced_at, min(decided_at) FILTER (NOT manual AND action = 'mark_disputed') AS disputed_at,
 min(decided_at) FILTER (NOT manual AND action = 'mark_superseded') AS superseded_at, min(decided_at) FILTER (NOT manual AND action = 'mark_superseded') AS valid_until FROM g LEFT JOIN a USING (session_id, thing) GROUP BY ALL""")
def temporal_actions(spark, d):
    # manual decisions, retiring and fading stamp nothing
    g = archive(spark, d).groupBy("session_id", "thing").agg(F.min("ts").alias("first_seen"))
    kept = F.col("action").isin("promote", "reinforce", "pin")
    at = lambda agg, test: agg(F.when(test, F.col("decided_at")))
    stamps = decisions(spark, d).where("not manual").groupBy("session_id", "thing").agg(
        F.bool_or(kept).alias("kept"), at(F.max, kept).alias("last_reinforced_at"), at(F.min, F.col("action") == "mark_disputed").alias("disputed_at"), at(F.min, F.col("action") == "mark_superseded").alias("superseded_at"),
    )
    return g.join(stamps, ["session_id", "thing"], "left").select("session_id", "thing", F.when(F.col("kept"), F.col("first_seen")).alias("valid_from"), "last_reinforced_at", "disputed_at", "superseded_at", F.col("superseded_at").alias("valid_until"))


# Sessions of the archive: their kind and parent go by number, those of even number are closed after their last event.
_SESSIONS = "ses AS (SELECT session_id, ['runtime', 'interaction', 'import'][session_id % 3 + 1] AS kind, CASE WHEN session_id % 3 = 1 THEN session_id // 4 * 4 END AS parent, min(ts) AS opened_at, CASE WHEN session_id % 2 = 0 THEN max(ts) END AS closed_at FROM w GROUP BY session_id)"


def sessions(spark, d) -> DataFrame:
    kind = F.get(F.array(F.lit("runtime"), F.lit("interaction"), F.lit("import")), (F.col("session_id") % 3).cast("int"))
    g = archive(spark, d).groupBy("session_id").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("last"))
    return g.select("session_id", kind.alias("kind"), F.when(F.col("session_id") % 3 == 1, F.expr("session_id div 4 * 4")).alias("parent"), "opened_at", F.when(F.col("session_id") % 2 == 0, F.col("last")).alias("closed_at"))


@query(f"WITH {_W}, {_SESSIONS} SELECT session_id, kind, opened_at, closed_at, coalesce(closed_at, opened_at) AS recency, closed_at IS NULL AS open FROM ses")
def session_table(spark, d):
    return sessions(spark, d).select("session_id", "kind", "opened_at", "closed_at", F.coalesce("closed_at", "opened_at").alias("recency"), F.col("closed_at").isNull().alias("open"))


@query(f"""WITH {_W}, {_SESSIONS}, ep AS (SELECT session_id, thing, min(ts) AS start_at, max(ts) AS updated_at, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT a.session_id, coalesce(b.session_id, a.session_id) AS continuity FROM ses a LEFT JOIN ses b ON a.parent = b.session_id)
 SELECT ep.session_id, thing, continuity, start_at, CASE WHEN continuity = ep.session_id THEN closed_at END AS end_at, CASE WHEN continuity = ep.session_id AND closed_at IS NOT NULL THEN closed_at ELSE updated_at END AS updated_at,
 CASE WHEN continuity = ep.session_id AND closed_at IS NOT NULL THEN 'closed' ELSE 'open' END AS status FROM ep JOIN k USING (session_id) JOIN ses USING (session_id)""")
def close_episodes(spark, d):
    # episodes belong to the session that an interaction continues; closing the interaction closes none of them
    s = sessions(spark, d)
    parents = s.select(F.col("session_id").alias("p"))
    k = s.join(parents, F.col("parent") == F.col("p"), "left").select("session_id", F.coalesce("p", "session_id").alias("continuity"), "closed_at")
    ep = archive(spark, d).groupBy("session_id", "thing").agg(F.min("ts").alias("start_at"), F.max("ts").alias("updated_at"))
    closing = F.when(F.col("continuity") == F.col("session_id"), F.col("closed_at"))
    return ep.join(k, "session_id").select("session_id", "thing", "continuity", "start_at", closing.alias("end_at"), F.coalesce(closing, "updated_at").alias("updated_at"), F.when(closing.isNotNull(), "closed").otherwise("open").alias("status"))


_SCOPED = "sc AS (SELECT lower(r_name || '::' || n_name) AS scope, o_orderkey, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def scoped(spark, d) -> DataFrame:
    """Orders as events of a scope, the region and nation of their customer."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    scopes = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.lower(F.concat("r_name", F.lit("::"), "n_name")).alias("scope"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return o.join(c.join(scopes, c["c_nationkey"] == scopes["n_nationkey"]), F.col("o_custkey") == F.col("c_custkey")).select("scope", "o_orderkey", "o_orderdate", "o_totalprice")


@query(f"WITH {_SCOPED} SELECT scope, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY scope ORDER BY o_orderdate DESC, o_orderkey) AS place FROM sc WHERE scope IN (SELECT DISTINCT scope FROM sc WHERE o_totalprice > 200000) QUALIFY place <= 5")
def scope_lists(spark, d):
    s = scoped(spark, d)
    asked_for = s.where("o_totalprice > 200000").select("scope").distinct()
    return ops.top_by(s.join(asked_for, "scope", "left_semi").select("scope", "o_orderkey", "o_orderdate"), ["scope"], [F.desc("o_orderdate"), "o_orderkey"], 5, "place")


@query(f"WITH {_SCOPED}, p AS (SELECT unnest(['region_0::nation_0', 'REGION_0::NATION_0', 'nowhere::at all']) AS probe) SELECT probe, EXISTS (SELECT 1 FROM sc WHERE scope = probe) AS found FROM p")
def scope_probe(spark, d):
    probes = spark.createDataFrame([("region_0::nation_0",), ("REGION_0::NATION_0",), ("nowhere::at all",)], "probe string")
    known = scoped(spark, d).select("scope").distinct().withColumn("found", F.lit(True))
    return probes.join(known, F.col("probe") == F.col("scope"), "left").select("probe", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {_W} SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS arrival FROM w QUALIFY arrival <= 40")
def replay_order(spark, d):
    # a full replay, in order of time within each session, up to a limit
    return ops.top_by(archive(spark, d).select("session_id", "event_id", "ts"), ["session_id"], ["ts", "event_id"], 40, "arrival").drop("ts")


@query("SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations")
def host_export(spark, d):
    # a host's export, one JSON document for each session, written and read back
    event = F.struct("turn", "role", "text")
    docs = messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(event)).alias("events")).select(F.to_json(F.struct(F.struct(F.col("conv_id").alias("session_id")).alias("session"), "events")).alias("doc"))
    parsed = docs.select(F.from_json("doc", "session struct<session_id:long>, events array<struct<turn:long,role:string,text:string>>").alias("d"))
    return parsed.select(F.col("d.session.session_id").alias("conv_id"), F.explode("d.events").alias("e")).select("conv_id", "e.turn", "e.role", "e.text")


@query(f"""WITH {_W}, {_D}, r AS (SELECT decision_id, unnest(list_filter([CASE WHEN manual THEN 'manual' END, CASE WHEN score >= 0.5 THEN 'strong' END, 'action:' || action], lambda x: x IS NOT NULL)) AS reason FROM d) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def reason_histogram(spark, d):
    reasons = F.filter(F.array(F.when(F.col("manual"), "manual"), F.when(F.col("score") >= 0.5, "strong"), F.concat(F.lit("action:"), "action")), lambda x: x.isNotNull())
    return decisions(spark, d).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_W}, {_D}, s AS (SELECT decision_id, unnest([decision_id, decision_id + 1, decision_id + 2]) AS event_id FROM d) SELECT decision_id, count(*) AS found, max(ts) AS latest FROM s JOIN w USING (event_id) GROUP BY decision_id")
def decision_evidence(spark, d):
    ids = decisions(spark, d).select("decision_id", F.explode(F.array(*(F.col("decision_id") + k for k in range(3)))).alias("event_id"))
    return ids.join(archive(spark, d).select("event_id", "ts"), "event_id").groupBy("decision_id").agg(F.count("*").alias("found"), F.max("ts").alias("latest"))


@query(f"WITH {_W} SELECT kind, count(*) AS events, count(DISTINCT session_id) AS sessions, min(ts) AS first_at, max(ts) AS last_at FROM w GROUP BY kind")
def archive_density(spark, d):
    return archive(spark, d).groupBy("kind").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(f"WITH {_EDGES}, n AS (SELECT 's' || src AS node FROM e UNION SELECT 'p' || dst FROM e) SELECT (SELECT count(*) FROM n) AS endpoints, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT src) FROM e) AS sources")
def graph_summary(spark, d):
    e = _edges(spark, d)
    end = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("key"))
    # each end once with its edges, so that nothing is told apart but by one aggregation
    ends = e.select(F.explode(F.array(end("src"), end("dst"))).alias("of")).groupBy("of.side", "of.key").agg(F.count("*").alias("n"))
    source = F.col("side") == "src"
    return ends.agg(F.count("key").alias("endpoints"), F.coalesce(F.sum(F.when(source, F.col("n"))), F.lit(0)).alias("edges"), F.count(F.when(source, F.col("key"))).alias("sources"))


@query(f"""WITH {_W}, {_D}, {_L} SELECT layer, count(*) AS n FROM (SELECT 'archive' AS layer FROM w UNION ALL SELECT 'belief' FROM st WHERE remember = 'remembered' UNION ALL SELECT 'candidate' FROM st WHERE remember = 'candidate' UNION ALL SELECT 'graph' FROM lineitem) GROUP BY layer""")
def layer_counts(spark, d):
    s = states(spark, d).select(F.when(F.col("remember") == "remembered", "belief").when(F.col("remember") == "candidate", "candidate").alias("layer")).where("layer is not null")
    one = lambda df, name: df.select(F.lit(name).alias("layer"))
    return s.unionByName(one(archive(spark, d), "archive")).unionByName(one(table(spark, d, "lineitem"), "graph")).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"""WITH {_W}, {_X}, g AS (SELECT session_id, thing, count(*) AS events, bool_and(imported) AS imported FROM x GROUP BY ALL), t AS (SELECT *, ['conversation', 'the file', 'marble harbor plan', 'Open', 'what', 'research'][(session_id + length(thing)) % 6 + 1] AS title FROM g)
 SELECT session_id, thing, title IN ('conversation', 'the file', 'Open', 'research') OR (imported AND title = 'what') AS low FROM t""")
def episode_quality(spark, d):
    # the texts of these episodes aren't all commands or all questions, so titles and imports decide
    titles = F.array(*map(F.lit, ("conversation", "the file", "marble harbor plan", "Open", "what", "research")))
    g = derived(spark, d).groupBy("session_id", "thing").agg(F.count("*").alias("events"), F.bool_and("imported").alias("imported"), F.collect_set("text").alias("texts"))
    title = F.get(titles, ((F.col("session_id") + F.length("thing")) % 6).cast("int"))
    return g.select("session_id", "thing", rules.low_quality_episode(title, F.col("texts"), F.col("imported"), F.col("events")).alias("low"))


@query(f"WITH {_W} SELECT session_id, thing, bool_or(route_domain = 'Memory' OR route_action = 'remember_fact') AS explicit, bool_or(route_domain = 'mcp') AS observed, bool_and(imported) AS imported FROM w GROUP BY ALL")
def explicit_memories(spark, d):
    signal = rules.explicit_memory(F.col("route_domain"), F.col("route_action"), F.lit(None).cast("string"))
    return archive(spark, d).groupBy("session_id", "thing").agg(F.bool_or(signal).alias("explicit"), F.bool_or(F.col("route_domain") == "mcp").alias("observed"), F.bool_and("imported").alias("imported"))


_EVENT_SCORE = """v AS (SELECT event_id, session_id, CASE WHEN route_domain = 'mcp' AND route_action = 'observe' THEN CAST(-1.1 AS DOUBLE) WHEN route_domain = 'session_mode' THEN CAST(-0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
 + CASE WHEN raw_text = 'ok' THEN CAST(-0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN event_id % 10 = 3 AND p_raw <> '' THEN CAST(-0.55 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
 + CASE WHEN event_id % 10 IN (4, 8) THEN CAST(-0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN session_id % 3 = 2 THEN CAST(-0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS penalty FROM w)"""


@query(f"WITH {_W}, {_EVENT_SCORE} SELECT event_id, {_r('penalty')} AS penalty FROM v")
def event_penalties(spark, d):
    return scored_events(spark, d).select("event_id", rounded(F.col("penalty")).alias("penalty"))


def scored_events(spark, d) -> DataFrame:
    w = archive(spark, d).join(sessions(spark, d).select("session_id", F.col("kind").alias("session_kind")), "session_id", "left")
    own, said = rules.compact(F.col("raw_text")), rules.compact(F.col("p_raw"))
    retold = rules.starts_with_any(F.lower(own), ("the user is ", "you are asking ", "the operator is ", "the operator wants ", "the operator may be "))
    terms = (
        F.when((F.col("route_domain") == "mcp") & (F.col("route_action") == "observe"), -1.1).when(F.col("route_domain") == "session_mode", -0.5).otherwise(0.0),
        F.when(F.lower(own).isin(*rules.LOW_SIGNAL_EVENTS), -0.6).otherwise(0.0), F.when((said != "") & (said != own) & retold, -0.55).otherwise(0.0),
        F.when(F.size(text.tokens(own)) <= 2, -0.35).otherwise(0.0), F.when(F.col("session_kind") == "import", -0.35).otherwise(0.0),
    )
    return w.withColumn("penalty", sum(terms[1:], terms[0]))


@query(f"WITH {_W}, {_SESSIONS}, j AS (SELECT w.event_id, w.session_id, w.thing, ses.kind <> 'import' AS live, w.ts FROM w JOIN ses USING (session_id)), k AS (SELECT *, bool_or(live AND thing = 'view') OVER (PARTITION BY session_id) AS any_kept FROM j) SELECT event_id FROM k WHERE (live AND thing = 'view') OR NOT any_kept")
def events_keep_if_any(spark, d):
    # a filter that is kept only where it leaves rows
    j = archive(spark, d).join(sessions(spark, d).select("session_id", F.col("kind").alias("session_kind")), "session_id")
    flag = (F.col("session_kind") != "import") & (F.col("thing") == "view")
    some = j.groupBy("session_id").agg(F.bool_or(flag).alias("some"))
    return j.join(some, "session_id").where(flag | ~F.col("some")).select("event_id")


@query(f"WITH {_W} SELECT event_id, CASE WHEN event_id % 10 = 3 AND p_raw <> '' THEN p_raw ELSE raw_text END AS shown, coalesce(nullif(trim(raw_text), ''), nullif(trim(p_raw), ''), kind) AS label FROM w")
def display_texts(spark, d):
    swap = rules.interpretive(F.col("raw_text")) & (F.trim("p_raw") != "")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return archive(spark, d).select("event_id", F.when(swap, F.col("p_raw")).otherwise(F.col("raw_text")).alias("shown"), F.coalesce(filled("raw_text"), filled("p_raw"), "kind").alias("label"))


# Claims of the archive: one for each session and thing.
_C = f"""c AS (SELECT session_id, thing, 'user ' || session_id || ' has ' || thing AS canonical, count(*) AS evidence, max(confidence) AS confidence, bool_or(pinned) AS cpinned, min(ts) AS first_seen, max(ts) AS last_seen FROM w GROUP BY ALL),
 j AS (SELECT c.*, remember, activation, score, coalesce(st.pinned, false) AS pinned FROM c LEFT JOIN st USING (session_id, thing))"""


def claims(spark, d) -> DataFrame:
    c = archive(spark, d).groupBy("session_id", "thing").agg(F.count("*").alias("evidence"), F.max("confidence").alias("confidence"), F.bool_or("pinned").alias("cpinned"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    c = c.withColumn("canonical", F.concat_ws(" ", F.lit("user"), "session_id", F.lit("has"), "thing"))
    s = states(spark, d).select("session_id", "thing", "remember", "activation", "score", F.col("pinned").alias("spinned"))
    return c.join(s, ["session_id", "thing"], "left").withColumn("pinned", F.coalesce("spinned", F.lit(False))).drop("spinned")


def _mod(mode: str) -> str:
    deep, arch = mode == "deep", mode == "archive"
    x = lambda v: f"CAST({v} AS DOUBLE)"
    return f"""CASE WHEN remember IS NULL THEN {x(0.2 if deep else 0)} ELSE score + CASE remember WHEN 'remembered' THEN {x(0.6)} WHEN 'candidate' THEN {x(0.15 if deep else -0.05)} WHEN 'retired' THEN {x(0 if arch else -0.5)} WHEN 'superseded' THEN {x(0 if arch else -0.5)} ELSE {x(0)} END
 + CASE activation WHEN 'active' THEN {x(0.25)} WHEN 'dormant' THEN {x(0.05 if deep else -0.05)} ELSE {x(-0.1)} END + CASE WHEN pinned THEN {x(0.5)} ELSE {x(0)} END END"""


def _admit(mode: str) -> str:
    return {"archive": "true", "deep": "true"}.get(mode, "remember IS NOT NULL AND remember NOT IN ('retired', 'superseded') AND NOT (remember = 'candidate' AND activation = 'suppressed')")


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, session_id, thing, {_admit(m)} AS admitted, {_r(_mod(m))} AS modifier FROM j" for m in ("default", "deep", "archive")).join((f"WITH {_W}, {_D}, {_L}, {_C} SELECT * FROM (", ")")))
def recall_modes(spark, d):
    c = claims(spark, d)
    out = None
    for mode in ("default", "deep", "archive"):
        one = c.select(F.lit(mode).alias("mode"), "session_id", "thing", ranking.admitted(F.col("remember"), F.col("activation"), mode).alias("admitted"), rounded(ranking.editorial_modifier(F.col("remember"), F.col("activation"), F.col("score"), F.col("pinned"), mode)).alias("modifier"))
        out = one if out is None else out.unionByName(one)
    return out


_CLAIM_RANK = f"""q AS (SELECT unnest(['who is user 3', 'what is click', 'recently view', 'error of users']) AS query, unnest([true, true, false, false]) AS claim_focused, unnest([false, false, true, false]) AS recent, unnest([4, 3, 2, 3]) AS n, unnest([3, 3, 2, 2]) AS wn),
 qt AS (SELECT *, list_distinct(regexp_extract_all(query, '[a-z0-9_'']+')) AS qw, list_filter(list_distinct(regexp_extract_all(query, '[a-z0-9_'']+')), lambda x: length(x) >= 3 AND x NOT IN ({_STOPPED})) AS qc FROM q),
 m AS (SELECT query, claim_focused, recent, j.*, len(list_intersect(qw, ct)) / CAST(len(qw) AS DOUBLE) AS lex, CASE WHEN len(qc) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(qc, ct)) / CAST(len(qc) AS DOUBLE) END AS con, len(qc) > 0 AS need
  FROM qt, (SELECT *, list_distinct(regexp_extract_all(lower(canonical), '[a-z0-9_'']+')) AS ct FROM j) j),
 p AS (SELECT *, CASE WHEN need AND con <= 0 THEN lex * CAST(0.1 AS DOUBLE) WHEN con > 0 THEN greatest(con, lex * CAST(0.5 AS DOUBLE)) ELSE lex END AS topical FROM m),
 s AS (SELECT query, session_id, thing, {_r("lex + CAST(0.3 AS DOUBLE) * (evidence / CAST(3 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * confidence + CAST(0.1 AS DOUBLE) + " + _mod("default") + " + CASE WHEN evidence < 2 AND NOT cpinned THEN CAST(-0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN claim_focused THEN CASE remember WHEN 'remembered' THEN CAST(0.75 AS DOUBLE) WHEN 'candidate' THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN activation = 'active' THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN cpinned THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + least(CAST(0.35 AS DOUBLE), topical * CAST(0.7 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END")} AS total
  FROM p WHERE {_admit("default")} AND NOT (recent AND evidence < 2 AND NOT cpinned) AND NOT (claim_focused AND NOT cpinned AND topical < 0.15))"""


def ranked_claims(spark, d) -> DataFrame:
    q = spark.createDataFrame([("who is user 3", True, False), ("what is click", True, False), ("recently view", False, True), ("error of users", False, False)], "query string, claim_focused boolean, recent boolean")
    q = q.withColumn("qw", text.token_set(F.col("query"))).withColumn("qc", text.content_set(F.col("query")))
    admitted = claims(spark, d).where(ranking.admitted(F.col("remember"), F.col("activation"))).withColumn("ct", text.token_set(F.col("canonical")))
    share = lambda c: F.when(F.size(c) == 0, 0.0).otherwise(F.size(F.array_intersect(F.col(c), F.col("ct"))) / F.size(c))
    # a stated set of four queries against all claims
    j = admitted.join(F.broadcast(q)).withColumn("lex", share("qw")).withColumn("con", share("qc"))
    j = j.withColumn("topical", text.topical(F.col("con"), F.col("lex"), F.size("qc") > 0))
    few = (F.col("evidence") < 2) & ~F.col("cpinned")
    focus = F.col("claim_focused")
    j = j.where(~(F.col("recent") & few) & ~(focus & ~F.col("cpinned") & (F.col("topical") < 0.15)))
    bonus = F.when(F.col("remember") == "remembered", 0.75).when(F.col("remember") == "candidate", -0.1).otherwise(0.0) + F.when(F.col("activation") == "active", 0.15).otherwise(0.0) + F.when(F.col("cpinned"), 0.15).otherwise(0.0) + F.least(F.lit(0.35), F.col("topical") * 0.7)
    total = ranking.base_score(F.col("lex"), F.col("evidence") / 3, F.col("confidence")) + ranking.editorial_modifier(F.col("remember"), F.col("activation"), F.col("score"), F.col("pinned")) + F.when(few, -0.35).otherwise(0.0) + F.when(focus, bonus).otherwise(0.0)
    return j.withColumn("total", rounded(total))


@query(f"WITH {_W}, {_D}, {_L}, {_C}, {_CLAIM_RANK} SELECT query, session_id, thing, total, row_number() OVER (PARTITION BY query ORDER BY total DESC, session_id, thing) AS rank FROM s QUALIFY rank <= 15")
def recall_claims(spark, d):
    # candidates are three times the budget of five
    return ops.top_by(ranked_claims(spark, d).select("query", "session_id", "thing", "total"), ["query"], [F.desc("total"), "session_id", "thing"], 15)


# Relations of the archive with a type, an editorial state and the names of both sides.
_REL = f"""r AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'related_to' WHEN 'A' THEN 'depends_on' ELSE 'uses' END AS type, max(l_discount * 10) AS confidence, count(*) AS support, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL),
 {_STATES}, rel AS (SELECT r.*, s_name AS src_name, p_name AS dst_name, remember, activation, coalesce(weight, CAST(0 AS DOUBLE)) AS score, false AS pinned FROM r LEFT JOIN supplier ON src = s_suppkey LEFT JOIN part ON dst = p_partkey LEFT JOIN s ON doc_id = dst)"""


def relations(spark, d) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "related_to").when(F.col("l_returnflag") == "A", "depends_on").otherwise("uses")
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("type")).agg(F.max(F.col("l_discount") * 10).alias("confidence"), F.count("*").alias("support"), F.max("l_shipdate").alias("last_seen"))
    s, p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("src_name")), table(spark, d, "part").select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("dst_name"))
    states_ = editorial_states(spark, d).select(F.col("doc_id").alias("dst"), "remember", "activation", F.col("weight").alias("score"))
    return r.join(s, "src", "left").join(p, "dst", "left").join(states_, "dst", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


_RELAXED = "remember = 'candidate' AND activation = 'suppressed' AND type <> 'related_to' AND topical >= 0.2 AND confidence >= 0.65"


@query(f"""WITH {_REL}, m AS (SELECT *, CASE WHEN contains(dst_name, 'cold') THEN CAST(0.95 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS match, CASE WHEN contains(dst_name, 'cold') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS topical FROM rel WHERE type = 'depends_on'),
 a AS (SELECT * FROM m WHERE match > 0 AND (({_RELAXED}) OR ({_admit("default")}))),
 sc AS (SELECT src, dst, {_r("CAST(0.5 AS DOUBLE) * least(CAST(1 AS DOUBLE), confidence) + CAST(0.1 AS DOUBLE) + " + _mod("default") + " + CASE WHEN support <= 1 AND remember <> 'remembered' THEN CAST(-0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN confidence < 0.7 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(1.9 AS DOUBLE)")} AS total FROM a)
 SELECT src, dst, total, row_number() OVER (ORDER BY total DESC, src, dst) AS rank FROM sc ORDER BY rank LIMIT 30""")
def recall_relations(spark, d):
    # 'what depends on cold': the type and the target's match gate, candidates are let in if sure enough, 0.6 for focus, 0.45 + 0.85 for shape
    r = relations(spark, d).where("type = 'depends_on'").withColumn("match", rules.target_match(F.col("dst_name"), F.lit("cold"))).where("match > 0")
    topical = F.lit(0.5)
    relaxed = (F.col("remember") == "candidate") & (F.col("activation") == "suppressed") & (topical >= 0.2) & (F.col("confidence") >= 0.65)
    r = r.where(F.coalesce(relaxed, F.lit(False)) | ranking.admitted(F.col("remember"), F.col("activation")))
    conf = F.least(F.lit(1.0), F.col("confidence"))
    total = conf * 0.5 + 0.1 + ranking.editorial_modifier(F.col("remember"), F.col("activation"), F.col("score"), F.lit(False)) + F.when((F.col("support") <= 1) & (F.col("remember") != "remembered"), -0.25).otherwise(0.0) + F.when(F.col("confidence") < 0.7, -0.1).otherwise(0.0) + F.lit(1.9)
    top = r.select("src", "dst", rounded(total).alias("total")).orderBy(F.desc("total"), "src", "dst").limit(30)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "src", "dst")))  # over thirty rows


@query(f"""WITH {_REL} SELECT src, dst, type, lower(concat_ws(' ', src_name, replace(type, '_', ' '), dst_name)) AS label, NOT (remember = 'candidate' AND activation = 'suppressed' AND type = 'related_to') IS TRUE AS visible, coalesce(remember, 'unreviewed') AS remember, support FROM rel""")
def relation_display(spark, d):
    hidden = (F.col("remember") == "candidate") & (F.col("activation") == "suppressed") & (F.col("type") == "related_to")
    return relations(spark, d).select("src", "dst", "type", F.lower(F.concat_ws(" ", "src_name", F.replace("type", F.lit("_"), F.lit(" ")), "dst_name")).alias("label"), (~F.coalesce(hidden, F.lit(False))).alias("visible"), F.coalesce("remember", F.lit("unreviewed")).alias("remember"), "support")


@query(f"WITH {_REL}, o AS (SELECT DISTINCT o_custkey, l_suppkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_custkey, src, dst, last_seen, row_number() OVER (PARTITION BY o_custkey ORDER BY last_seen DESC, src, dst) AS rank FROM o JOIN (SELECT src, dst, max(last_seen) AS last_seen FROM rel GROUP BY ALL) USING (src, dst) QUALIFY rank <= 10")
def relations_by_session(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    pairs = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_custkey", "src", "dst").distinct()
    seen = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_shipdate").alias("last_seen"))
    return ops.top_by(pairs.join(seen, ["src", "dst"]), ["o_custkey"], [F.desc("last_seen"), "src", "dst"], 10)


@query(f"""WITH {_W}, h AS (SELECT event_id, 'SUPPLIER#' || lpad(CAST(session_id AS VARCHAR), 9, '0') AS src_name, CASE WHEN event_id % 4 = 0 THEN 'nobody' ELSE 'Supplier#' || lpad(CAST(event_id % 5 AS VARCHAR), 9, '0') END AS dst_name FROM w WHERE event_id % 10 = 5)
 SELECT event_id, a.s_suppkey AS src, b.s_suppkey AS dst FROM h JOIN supplier a ON lower(a.s_name) = lower(src_name) JOIN supplier b ON lower(b.s_name) = lower(dst_name)""")
def hinted_relations(spark, d):
    # a hint whose either side is no known entity is dropped
    name = lambda c: F.concat(F.lit("supplier#"), F.lpad(c.cast("string"), 9, "0"))
    h = archive(spark, d).where("event_id % 10 = 5").select("event_id", name(F.col("session_id")).alias("src_name"), F.when(F.col("event_id") % 4 == 0, "nobody").otherwise(name(F.col("event_id") % 5)).alias("dst_name"))
    known = lambda side: table(spark, d, "supplier").select(F.lower("s_name").alias(f"{side}_name"), F.col("s_suppkey").alias(side))
    return h.join(known("src"), "src_name").join(known("dst"), "dst_name").select("event_id", "src", "dst")


@query(f"""WITH {_W}, m AS (SELECT session_id AS subject, count(*) AS n FROM w WHERE kind = 'fact_assertion' GROUP BY ALL) SELECT coalesce(s_name, 'user ' || subject) AS entity, s_suppkey IS NULL AS fresh, n FROM m LEFT JOIN supplier ON s_suppkey = subject""")
def claim_subjects(spark, d):
    # a subject that is no entity becomes one
    m = archive(spark, d).where("kind = 'fact_assertion'").groupBy(F.col("session_id").alias("subject")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return m.join(s, F.col("s_suppkey") == F.col("subject"), "left").select(F.coalesce("s_name", F.concat_ws(" ", F.lit("user"), "subject")).alias("entity"), F.col("s_suppkey").isNull().alias("fresh"), "n")


@query(f"""WITH {_EDGES}, f AS (SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 4), b AS (SELECT e.src, e.dst, confidence, last_seen FROM e JOIN f USING (src)) SELECT src, dst, row_number() OVER (ORDER BY last_seen DESC, confidence DESC, src, dst) AS place FROM b ORDER BY place LIMIT 24""")
def artifact_graph(spark, d):
    e = _edges(spark, d)
    focal = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(4).select("src")
    top = e.join(focal, "src", "left_semi").select("src", "dst", "confidence", "last_seen").orderBy(F.desc("last_seen"), F.desc("confidence"), "src", "dst").limit(24)
    return top.select("src", "dst", F.row_number().over(Window.orderBy(F.desc("last_seen"), F.desc("confidence"), "src", "dst")).alias("place"))  # over 24 rows


@query(f"""WITH {_W}, {_D}, {_L}, {_C}, g AS (SELECT session_id, thing, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT kind) AS kinds, count(*) AS n, array_to_string(list(event_id ORDER BY ts, event_id)[1:5], ',') AS samples FROM w GROUP BY ALL),
 p AS (SELECT session_id, thing, samples, days, coalesce(score, CAST(0 AS DOUBLE)) AS source, least(CAST(1 AS DOUBLE), days / CAST(10 AS DOUBLE)) AS consistency, least(CAST(1 AS DOUBLE), n / CAST(20 AS DOUBLE)) AS grounding FROM g JOIN j USING (session_id, thing) WHERE days >= 2 AND coalesce(score, CAST(0 AS DOUBLE)) >= 0.2),
 o AS (SELECT *, {_r("CAST(0.4 AS DOUBLE) * source + CAST(0.35 AS DOUBLE) * consistency + CAST(0.25 AS DOUBLE) * grounding")} AS confidence FROM p)
 SELECT 'pat_' || left(sha256('recurring_claim_cluster|' || session_id || '|' || thing), 16) AS pattern_id, thing, days, samples, confidence, row_number() OVER (PARTITION BY thing ORDER BY confidence DESC, consistency DESC, session_id DESC) AS place FROM o QUALIFY place <= 12""")
def pattern_projection(spark, d):
    # recurring claims with a weight, first five samples, blended confidence, and an id from what they are
    g = archive(spark, d).groupBy("session_id", "thing").agg(F.count_distinct(F.col("ts").cast("date")).alias("days"), F.count("*").alias("n"), F.min_by(F.lit(1), "ts"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("all"))
    weights = states(spark, d).select("session_id", "thing", "score")
    one = F.lit(1.0)
    p = g.join(weights, ["session_id", "thing"], "left").withColumn("source", F.coalesce("score", F.lit(0.0))).where("days >= 2 and source >= 0.2")
    p = p.withColumn("consistency", F.least(one, F.col("days") / 10)).withColumn("confidence", rounded(F.lit(0.4) * F.col("source") + F.lit(0.35) * F.col("consistency") + F.lit(0.25) * F.least(one, F.col("n") / 20)))
    ids = F.concat(F.lit("pat_"), F.left(F.sha2(F.concat_ws("|", F.lit("recurring_claim_cluster"), "session_id", "thing"), 256), F.lit(16)))
    shown = p.select("session_id", ids.alias("pattern_id"), "thing", "days", F.array_join(F.transform(F.slice("all", 1, 5), lambda x: x["event_id"].cast("string")), ",").alias("samples"), "confidence", "consistency")
    return ops.top_by(shown, ["thing"], [F.desc("confidence"), F.desc("consistency"), F.desc("session_id")], 12, "place").drop("session_id", "consistency")


@query(f"WITH {_W}, {_D}, {_L}, {_C}, t AS (SELECT session_id, thing, remember, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, thing) AS r FROM j QUALIFY r <= 4) SELECT session_id, thing FROM t WHERE remember = 'remembered'")
def timeline_after_limit(spark, d):
    # the filter comes after the limit and may leave fewer rows
    t = ops.top_by(claims(spark, d).select("session_id", "thing", "remember", "last_seen"), ["session_id"], [F.desc("last_seen"), "thing"], 4)
    return t.where("remember = 'remembered'").select("session_id", "thing")


@query(f"WITH {_W}, {_D}, {_L}, {_C} SELECT session_id, thing, coalesce(remember, 'unreviewed') AS remember, row_number() OVER (PARTITION BY session_id ORDER BY thing) AS place FROM j WHERE remember IN ('retired', 'superseded') QUALIFY place <= 5")
def notable_divergences(spark, d):
    c = claims(spark, d).where(F.col("remember").isin("retired", "superseded")).select("session_id", "thing", "remember")
    return ops.top_by(c, ["session_id"], ["thing"], 5, "place")


@query(f"WITH {_W}, {_D}, {_L}, {_C} SELECT j.session_id, thing FROM j WHERE EXISTS (SELECT 1 FROM w JOIN conversations ON conv_id = w.session_id WHERE w.session_id = j.session_id AND w.thing = j.thing AND turn = 1)")
def review_session_filter(spark, d):
    # artifacts with some supporting event in a session under review
    reviewed = table(spark, d, "conversations").where("turn = 1").select(F.col("conv_id").alias("session_id")).distinct()
    support = archive(spark, d).join(reviewed, "session_id", "left_semi").select("session_id", "thing").distinct()
    return claims(spark, d).select("session_id", "thing").join(support, ["session_id", "thing"], "left_semi")


@query(f"""WITH {_W}, {_D}, {_L}, {_C}, {_CLAIM_RANK}, e1 AS (SELECT 'claim' AS kind, query, 'claim:' || session_id || ':' || thing AS ref, total, row_number() OVER (PARTITION BY query ORDER BY total DESC, session_id, thing) AS rank FROM s QUALIFY rank <= 5),
 {_EVENT_SCORE}, e2 AS (SELECT 'event' AS kind, query, 'event:' || event_id AS ref, {_r("penalty")} AS total, row_number() OVER (PARTITION BY query ORDER BY {_r("penalty")} DESC, event_id) AS rank FROM v, q WHERE NOT q.claim_focused AND session_id = 3 QUALIFY rank <= 8),
 u AS (SELECT *, 0 AS pos FROM e1 UNION ALL SELECT *, 1 FROM e2) SELECT query, kind, ref, total, row_number() OVER (PARTITION BY query ORDER BY pos, rank) AS place FROM u QUALIFY place <= 6""")
def recall_bundle(spark, d):
    # kinds in a fixed order, each within its budget, six cards; a question for a claim that has one hides the rest
    named = ranked_claims(spark, d).select("query", F.lit("claim").alias("kind"), F.concat_ws(":", F.lit("claim"), "session_id", "thing").alias("ref"), "total", F.struct("session_id", "thing").alias("tie"))
    found = ops.top_by(named, ["query"], [F.desc("total"), "tie"], 5).drop("tie").withColumn("pos", F.lit(0))
    open_ = spark.createDataFrame([("recently view",), ("error of users",)], "query string")
    events = scored_events(spark, d).where("session_id = 3").select(rounded(F.col("penalty")).alias("total"), "event_id")
    best = ops.top_by(events.withColumn("s", F.lit(1)), ["s"], [F.desc("total"), "event_id"], 8).drop("s")  # the best events of one session, eight rows
    shown = best.join(F.broadcast(open_)).select("query", F.lit("event").alias("kind"), F.concat_ws(":", F.lit("event"), "event_id").alias("ref"), "total", "rank", F.lit(1).alias("pos"))
    return ops.top_by(found.unionByName(shown), ["query"], ["pos", "rank"], 6, "place").select("query", "kind", "ref", "total", "place")


@query(f"""WITH {_W}, {_D}, {_L}, {_C} SELECT session_id, thing, 'Remembered as ' || coalesce(remember, 'unreviewed') || ' on ' || evidence || CASE WHEN evidence = 1 THEN ' event' ELSE ' events' END || CASE WHEN cpinned THEN ', pinned' ELSE '' END AS explanation FROM j""")
def explanations(spark, d):
    c = claims(spark, d)
    words = F.concat(F.lit("Remembered as "), F.coalesce("remember", F.lit("unreviewed")), F.lit(" on "), F.col("evidence").cast("string"), F.when(F.col("evidence") == 1, " event").otherwise(" events"), F.when(F.col("cpinned"), ", pinned").otherwise(""))
    return c.select("session_id", "thing", words.alias("explanation"))


@query("""WITH q AS (SELECT unnest(['  Cold   WIDGET', 'small widget', 'no such thing']) AS asked), n AS (SELECT p_partkey, lower(p_name) AS low FROM part), f AS (SELECT asked, min(p_partkey) AS part FROM q LEFT JOIN n ON low = lower(trim(regexp_replace(asked, ' +', ' ', 'g'))) GROUP BY asked)
 SELECT asked, part, count(l_orderkey) AS mentions FROM f LEFT JOIN lineitem ON l_partkey = part GROUP BY ALL""")
def entity_resolve(spark, d):
    q = spark.createDataFrame([("  Cold   WIDGET",), ("small widget",), ("no such thing",)], "asked string").withColumn("low", rules.folded(F.col("asked")))
    names = table(spark, d, "part").groupBy(rules.folded(F.col("p_name")).alias("low")).agg(F.min("p_partkey").alias("part"))
    found = q.join(names, "low", "left").select("asked", "part")
    return found.join(table(spark, d, "lineitem").select("l_partkey", "l_orderkey"), F.col("l_partkey") == F.col("part"), "left").groupBy("asked", "part").agg(F.count("l_orderkey").alias("mentions"))


@query(f"""WITH {_W}, {_D}, {_L}, {_C}, e AS (SELECT session_id, thing, event_id, ts, row_number() OVER (PARTITION BY session_id, thing ORDER BY ts DESC, event_id) AS r FROM w QUALIFY r <= 8)
 SELECT session_id, thing, any_value(coalesce(remember, 'unreviewed')) AS remember, array_to_string(list(event_id ORDER BY r), ',') AS events, (SELECT count(*) FROM d WHERE d.session_id = e.session_id AND d.thing = e.thing) AS decisions FROM e JOIN j USING (session_id, thing) GROUP BY session_id, thing, e.session_id, e.thing""")
def inspect_artifact(spark, d):
    e = ops.top_by(archive(spark, d).select("session_id", "thing", "event_id", "ts"), ["session_id", "thing"], [F.desc("ts"), "event_id"], 8)
    shown = e.groupBy("session_id", "thing").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("events"))
    n = decisions(spark, d).groupBy("session_id", "thing").agg(F.count("*").alias("decisions"))
    out = claims(spark, d).select("session_id", "thing", F.coalesce("remember", F.lit("unreviewed")).alias("remember")).join(shown, ["session_id", "thing"]).join(n, ["session_id", "thing"], "left")
    return out.select("session_id", "thing", "remember", "events", F.coalesce("decisions", F.lit(0)).cast("long").alias("decisions"))


@query(f"""WITH {_W}, {_D}, {_L}, n AS (SELECT decision_id, session_id, thing, action, score, CASE WHEN score >= 0.7 THEN 'promote' WHEN score <= 0.2 THEN 'retire' ELSE 'leave_candidate' END AS again FROM d ORDER BY decided_at DESC, decision_id LIMIT 200)
 SELECT action, again, count(*) AS n, count(*) FILTER (CASE again WHEN 'promote' THEN score >= 0.6 WHEN 'retire' THEN score <= 0.28 ELSE score BETWEEN 0.35 AND 0.82 END) AS in_band FROM n GROUP BY ALL""")
def shadow_report(spark, d):
    # the last decisions decided anew by score alone, and which of them a second opinion would have been asked for
    last = decisions(spark, d).orderBy(F.desc("decided_at"), "decision_id").limit(200)
    again = F.when(F.col("score") >= ranking.PROMOTION, "promote").when(F.col("score") <= ranking.RETIRE, "retire").otherwise("leave_candidate")
    n = last.withColumn("again", again)
    return n.groupBy("action", "again").agg(F.count("*").alias("n"), F.count_if(ranking.in_band(F.col("again"), F.lit(False), F.col("score"))).alias("in_band"))


@query(f"WITH {_W}, {_D}, f AS (SELECT thing AS family, action IN ('promote', 'pin', 'reinforce') AS passed FROM d) SELECT family, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM f GROUP BY family")
def family_totals(spark, d):
    passed = F.col("action").isin("promote", "pin", "reinforce")
    return decisions(spark, d).groupBy(F.col("thing").alias("family")).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))


# Trading memories: three events each, of trading kinds by number.
_TRADES = """tr AS (SELECT event_id // 3 AS g, CASE event_id % 17 WHEN 0 THEN 'trading_outcome' WHEN 1 THEN 'trading_scorecard' WHEN 2 THEN 'trading_execution_result' WHEN 3 THEN 'trading_market_state' WHEN 4 THEN 'trading_risk_envelope' ELSE 'message' END AS tkind,
 event_id % 5 AS failed, event_id % 2 AS vetoes, event_id % 3 = 0 AS shift FROM events), tg AS (SELECT g, bool_or(tkind <> 'message') AS routed, bool_or(tkind NOT IN ('message', 'trading_scorecard')) AS fact, bool_or(tkind = 'trading_outcome') AS outcome,
 bool_or(tkind = 'trading_execution_result' AND failed > 0) AS failure, bool_or(tkind = 'trading_risk_envelope' AND vetoes > 0) AS veto, bool_or(tkind = 'trading_market_state' AND shift) AS shifted FROM tr GROUP BY g)"""
CLAIM_TEXTS = ("buy long btc", "order book", "btc report", "risk and profit", "calm sea")
TRADE_TITLES = ("trade-outcome-review", "Risk-Envelope", "crypto-regime-cycle", "execution-cycle", "marble harbor", "learner-state-update")


def trades(spark, d) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 17 == 0, "trading_outcome").when(n % 17 == 1, "trading_scorecard").when(n % 17 == 2, "trading_execution_result").when(n % 17 == 3, "trading_market_state").when(n % 17 == 4, "trading_risk_envelope").otherwise("message")
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    event = F.struct(
        kind.alias("kind"), none.alias("route_domain"), none.alias("route_action"), none.alias("source_app"), none.alias("text"), no.alias("fact_eligible"), F.lit(0).alias("submitted"),
        (n % 5).alias("failed"), (n % 2).alias("vetoes"), no.alias("approved"), (n % 3 == 0).alias("regime_shift"),
    )
    return table(spark, d, "events").groupBy(F.expr("event_id div 3").alias("g")).agg(F.collect_list(event).alias("events"))  # three each


@query(f"WITH {_TRADES} SELECT g, routed OR g % 5 IN (0, 3) AS trading, fact, (routed OR g % 5 IN (0, 3)) AND NOT fact AS held FROM tg")
def trading_claims(spark, d):
    claim = F.get(F.array(*map(F.lit, CLAIM_TEXTS)), (F.col("g") % 5).cast("int"))
    t = trades(spark, d).select("g", trading.about_trading(claim, F.col("events")).alias("trading"), trading.has_fact(F.col("events")).alias("fact"))
    return t.withColumn("held", F.col("trading") & ~F.col("fact"))


@query(f"WITH {_TRADES} SELECT g, CASE g % 6 WHEN 0 THEN NOT outcome WHEN 1 THEN NOT veto WHEN 2 THEN NOT shifted WHEN 3 THEN NOT (failure OR outcome) WHEN 4 THEN false ELSE true END AS held FROM tg")
def trading_episodes(spark, d):
    title = F.get(F.array(*map(F.lit, TRADE_TITLES)), (F.col("g") % 6).cast("int"))
    return trades(spark, d).select("g", trading.held_back(title, F.col("events")).alias("held"))


@query(f"""WITH {_W}, {_D}, x AS (SELECT decision_id, action, score, action = 'pin' AS locked, ['claim', 'episode', 'relation'][decision_id // 5 % 3 + 1] AS type FROM d),
 y AS (SELECT *, CASE WHEN action = 'promote' THEN score >= 0.58 WHEN action = 'retire' THEN score <= 0.28 ELSE score BETWEEN 0.35 AND 0.82 END AS near FROM x)
 SELECT decision_id, array_to_string(list_filter([CASE WHEN locked THEN 'hard_locked' END, CASE WHEN type = 'relation' THEN 'artifact_type_ineligible' END, CASE WHEN action NOT IN ('promote', 'leave_candidate', 'retire') THEN 'action_ineligible' END,
 CASE WHEN NOT near THEN 'score_outside_ambiguity_band' END], lambda r: r IS NOT NULL), ',') AS reasons FROM y""")
def adjudication_reasons(spark, d):
    # under a policy whose promotion threshold is 0.68
    personal = policy_of('{"name": "personal", "promotion_threshold": 0.68, "adjudication": {"enabled": true, "mode": "shadow"}}')
    kind = F.get(F.array(F.lit("claim"), F.lit("episode"), F.lit("relation")), F.expr("cast(decision_id div 5 % 3 as int)"))
    reasons = personal.reasons(kind, F.col("action"), F.col("action") == "pin", F.col("score"))
    return decisions(spark, d).select("decision_id", F.array_join(reasons, ",").alias("reasons"))
