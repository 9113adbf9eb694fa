"""Registered queries of the memory engine, each beside the SQL that another engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions import derivation as dv
from annalist.functions import ranking, text
from annalist.functions.text import rounded
from annalist.operators import archive as ops
from annalist.operators import derive
from annalist.sources.archive import editorial_states, messages, table, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Shared SQL: the archive over events, messages, tokens and editorial states.
_T = "t AS (SELECT event_id, user_id AS session_id, event_type AS kind, ts, value, least(1.0, value / 500) AS importance, props FROM events)"
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_'']+')"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_STATES = """s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'retired' WHEN quality = 1 THEN 'remembered' ELSE 'candidate' END AS remember,
 CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 'active' ELSE 'suppressed' END AS activation, CASE WHEN quality = 1 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS weight FROM labels)"""
_EDGES = "e AS (SELECT l_suppkey AS src, l_partkey AS dst, max(l_discount * 10) AS confidence, count(*) AS support, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL)"


def _r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + CAST(0.5 AS DOUBLE)) / 1e{digits}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {_T} SELECT event_id, session_id, kind, ts FROM t QUALIFY row_number() OVER (PARTITION BY session_id, kind, ts ORDER BY event_id) = 1")
def ingest_dedupe(spark, d):
    return ops.ingest(telemetry(spark, d)).select("event_id", "session_id", "kind", "ts")


@query(f"WITH {_T} SELECT count(*) AS offered, count(DISTINCT (session_id, kind, ts)) AS accepted, count(*) - count(DISTINCT (session_id, kind, ts)) AS duplicates FROM t")
def ingest_counters(spark, d):
    keys = telemetry(spark, d).groupBy("session_id", "kind", "ts").count()
    return keys.agg(F.sum("count").alias("offered"), F.count("*").alias("accepted"), (F.sum("count") - F.count("*")).alias("duplicates"))


@query(f"WITH {_T} SELECT event_id, kind, ts FROM t ORDER BY ts DESC, event_id LIMIT 50")
def archive_scope_latest(spark, d):
    return telemetry(spark, d).select("event_id", "kind", "ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query(f"WITH {_T} SELECT session_id, event_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) AS rank FROM t QUALIFY rank <= 3")
def archive_session_latest(spark, d):
    return ops.top_by(telemetry(spark, d).select("session_id", "event_id", "ts"), ["session_id"], [F.desc("ts"), "event_id"], 3)


@query("SELECT event_id, event_type, ts FROM events WHERE event_id IN (SELECT doc_id FROM labels)")
def event_multi_get(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"))
    return table(spark, d, "events").join(ids, "event_id", "left_semi").select("event_id", "event_type", "ts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\r\x0b\f]+', ' ', 'g')))) AS digest FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM conversations) GROUP BY token")
def text_tokenize_counts(spark, d):
    return messages(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _benchmark(spark, d) -> DataFrame:
    """Query tokens: item_id, token, n (distinct tokens of the item)."""
    q = table(spark, d, "benchmark").select("item_id", text.token_set(F.col("text")).alias("ts"))
    return q.select("item_id", F.size("ts").alias("n"), F.explode("ts").alias("token"))


_Q = f"q AS (SELECT item_id, len(list_distinct({_TOKENS.format('text')})) AS n, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM benchmark)"


@query(f"WITH {_Q}, t AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM documents) SELECT item_id, doc_id FROM q JOIN t USING (token) GROUP BY item_id, doc_id, n HAVING count(*) = n")
def fts_and_search(spark, d):
    # each item is looked up by its rarest token alone, then all its tokens must be in the text
    q = table(spark, d, "benchmark").select("item_id", text.token_set(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    docs = table(spark, d, "documents").select("doc_id", text.token_set(F.col("text")).alias("words"))
    asked = q.select("item_id", F.explode("ts").alias("token"))
    known = asked.select("token").distinct()
    index = docs.select("doc_id", F.explode("words").alias("token")).join(known, "token", "left_semi")
    found = index.groupBy("token").agg(F.count("*").alias("n"))
    rarest = asked.join(found, "token", "left").groupBy("item_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    keyed = q.join(rarest, "item_id")
    wanted = keyed.select("token").distinct()
    return index.join(wanted, "token", "left_semi").join(keyed, "token").join(docs, "doc_id").where(F.size(F.array_except("ts", "words")) == 0).select("item_id", "doc_id")


_M = f"m AS (SELECT conv_id, turn, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM conversations)"


@query(f"WITH {_Q}, {_M}, o AS (SELECT item_id, conv_id, turn, {_r('count(*) / CAST(n AS DOUBLE)')} AS overlap FROM q JOIN m USING (token) GROUP BY item_id, conv_id, turn, n) SELECT item_id, conv_id, turn, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, conv_id, turn) AS rank FROM o QUALIFY rank <= 5")
def lexical_overlap_topk(spark, d):
    m = messages(spark, d).select("conv_id", "turn", F.explode(text.token_set(F.col("text"))).alias("token"))
    hits = m.join(_benchmark(spark, d), "token").groupBy("item_id", "conv_id", "turn", "n").agg(F.count("*").alias("hit"))
    scored = hits.select("item_id", "conv_id", "turn", rounded(F.col("hit") / F.col("n")).alias("overlap"))
    return ops.top_by(scored, ["item_id"], [F.desc("overlap"), "conv_id", "turn"], 5)


def _content(column: str) -> str:
    return f"list_filter(list_distinct({_TOKENS.format(column)}), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))"


@query(f"""WITH q AS (SELECT item_id, list_distinct({_TOKENS.format('text')}) AS qt, {_content('text')} AS qc FROM benchmark), m AS (SELECT conv_id, turn, list_distinct({_TOKENS.format('text')}) AS mt FROM conversations),
 qe AS (SELECT item_id, unnest(qt) AS token FROM q), me AS (SELECT conv_id, turn, unnest(mt) AS token FROM m),
 hit AS (SELECT item_id, conv_id, turn, count(*) AS lex, count(*) FILTER (length(token) >= 3 AND token NOT IN ({_STOP})) AS con FROM qe JOIN me USING (token) GROUP BY ALL),
 v AS (SELECT item_id, conv_id, turn, lex / CAST(len(qt) AS DOUBLE) AS l, CASE WHEN len(qc) = 0 THEN CAST(0 AS DOUBLE) ELSE con / CAST(len(qc) AS DOUBLE) END AS c, len(qc) > 0 AS need FROM hit JOIN q USING (item_id)),
 s AS (SELECT item_id, conv_id, turn, {_r("CASE WHEN need AND c <= 0 THEN l * CAST(0.1 AS DOUBLE) WHEN c > 0 THEN greatest(c, l * CAST(0.5 AS DOUBLE)) ELSE l END")} AS topical FROM v)
 SELECT item_id, conv_id, turn, topical, row_number() OVER (PARTITION BY item_id ORDER BY topical DESC, conv_id, turn) AS rank FROM s QUALIFY rank <= 5""")
def topical_match(spark, d):
    q = table(spark, d, "benchmark").select("item_id", text.token_set(F.col("text")).alias("qt"), F.size(text.content_set(F.col("text"))).alias("nc"))
    qe = q.select("item_id", F.size("qt").alias("n"), "nc", F.explode("qt").alias("token"))
    me = messages(spark, d).select("conv_id", "turn", F.explode(text.token_set(F.col("text"))).alias("token"))
    is_content = (F.length("token") >= 3) & ~F.col("token").isin(*text.STOP_WORDS)
    hit = me.join(qe, "token").groupBy("item_id", "conv_id", "turn", "n", "nc").agg(F.count("*").alias("lex"), F.count_if(is_content).alias("con"))
    content = F.when(F.col("nc") == 0, F.lit(0.0)).otherwise(F.col("con") / F.col("nc"))
    scored = hit.select("item_id", "conv_id", "turn", rounded(text.topical(content, F.col("lex") / F.col("n"), F.col("nc") > 0)).alias("topical"))
    return ops.top_by(scored, ["item_id"], [F.desc("topical"), "conv_id", "turn"], 5)


@query("SELECT p_partkey, lower(p_name) AS name FROM part WHERE lower(p_name) LIKE '%ar%' OR lower(p_name) LIKE '%_1%'")
def entity_search_like(spark, d):
    name = F.lower("p_name")
    return table(spark, d, "part").where(name.like("%ar%") | name.like("%_1%")).select("p_partkey", name.alias("name"))


@query("SELECT s_suppkey, p_partkey, max(l_discount * 10) AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE (lower(s_name) LIKE '%1%' OR lower(p_name) LIKE '%1%') AND (lower(s_name) LIKE '%2%' OR lower(p_name) LIKE '%2%') GROUP BY ALL")
def relation_search(spark, d):
    li, s, p = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "part")
    both = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    side = lambda t: F.lower("s_name").like(f"%{t}%") | F.lower("p_name").like(f"%{t}%")
    return both.where(side("1") & side("2")).groupBy("s_suppkey", "p_partkey").agg(F.max(F.col("l_discount") * 10).alias("confidence"))


def _edges(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max(F.col("l_discount") * 10).alias("confidence"), F.count("*").alias("support"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))


@query(f"WITH {_EDGES} SELECT * FROM e")
def relation_upsert(spark, d):
    return _edges(spark, d)


@query(f"WITH {_EDGES}, b AS (SELECT 's' || src AS node, 'p' || dst AS neighbour, confidence FROM e UNION ALL SELECT 'p' || dst, 's' || src, confidence FROM e) SELECT node, neighbour, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, neighbour) AS rank FROM b QUALIFY rank <= 5")
def relation_neighborhood(spark, d):
    # rows are dealt over tasks of a fixed size, edges before they are added up and nodes before they are ranked, so that a task's memory doesn't grow with the table
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_discount")
    dealt = ops.dealing(li)
    edges = dealt(li, "src", "dst").groupBy("src", "dst").agg(F.max(F.col("l_discount") * 10).alias("confidence"))
    e = edges.select(F.concat(F.lit("s"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"), "confidence")
    return ops.top_by(dealt(ops.neighbourhood(e, "src", "dst"), "node"), ["node"], [F.desc("confidence"), "neighbour"], 5)


@query(f"WITH {_T} SELECT session_id, arg_min(kind, event_id) AS name, arg_max(ts, event_id) AS last_seen, array_to_string(list_sort(list(DISTINCT kind)), ',') AS aliases, count(*) AS mentions FROM t GROUP BY session_id")
def entity_upsert(spark, d):
    return ops.upsert_entities(telemetry(spark, d))


_CLAIMS = "SELECT session_id, kind, greatest(1, count(DISTINCT event_id)) AS evidence, max(importance) AS confidence, bool_or(value > 490) AS pinned, arg_min(ts, event_id) AS first_seen, arg_max(ts, event_id) AS last_seen FROM t GROUP BY ALL"


@query(f"WITH {_T} {_CLAIMS}")
def claim_upsert(spark, d):
    return ops.upsert_claims(telemetry(spark, d))


@query(f"WITH {_T}, c AS ({_CLAIMS}) SELECT session_id, kind, last_seen, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, kind) AS rank FROM c QUALIFY rank <= 3")
def claims_by_session(spark, d):
    return ops.top_by(ops.upsert_claims(telemetry(spark, d)).select("session_id", "kind", "last_seen"), ["session_id"], [F.desc("last_seen"), "kind"], 3)


@query("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def entities_by_session(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_custkey", "l_partkey").distinct()


_EPISODES = "x AS (SELECT *, CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id, kind ORDER BY ts, event_id) AS p FROM t)), ep AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM x)"


def _episodes(spark, d) -> DataFrame:
    return ops.sessionise(telemetry(spark, d), ["session_id", "kind"], 6 * 3600)


@query(f"WITH {_T}, {_EPISODES} SELECT session_id, kind, CAST(episode AS BIGINT) AS episode, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n FROM ep GROUP BY ALL")
def episode_sessionize(spark, d):
    return _episodes(spark, d).groupBy("session_id", "kind", "episode").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count("*").alias("n"))


@query(f"WITH {_T}, {_EPISODES} SELECT n, count(*) AS episodes FROM (SELECT count(*) AS n FROM ep GROUP BY session_id, kind, episode) GROUP BY n")
def episode_event_counts(spark, d):
    return _episodes(spark, d).groupBy("session_id", "kind", "episode").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("episodes"))


@query(f"WITH {_T}, {_EPISODES} SELECT DISTINCT session_id, kind, CAST(episode AS BIGINT) AS episode FROM ep WHERE event_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def episodes_by_events(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("event_id"))
    return _episodes(spark, d).join(ids, "event_id", "left_semi").select("session_id", "kind", "episode").distinct()


@query("SELECT DISTINCT l_suppkey AS artifact, l_orderkey AS event FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def evidence_artifacts(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("artifact"), F.col("l_orderkey").alias("event")).join(seen, "event", "left_semi").distinct()


_ADMIT = "CASE WHEN remember IS NULL OR remember IN ('retired', 'superseded') THEN false WHEN remember = 'candidate' AND activation = 'suppressed' THEN false ELSE true END"
_MOD = """CASE WHEN remember IS NULL THEN CAST(0 AS DOUBLE) ELSE weight + CASE remember WHEN 'remembered' THEN CAST(0.6 AS DOUBLE) WHEN 'candidate' THEN CAST(-0.05 AS DOUBLE) WHEN 'retired' THEN CAST(-0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
 + CASE activation WHEN 'active' THEN CAST(0.25 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END END"""


def _judged(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    j = docs.join(editorial_states(spark, d), "doc_id", "left")
    return j.withColumn("admitted", ranking.admitted(F.col("remember"), F.col("activation"))).withColumn("modifier", rounded(ranking.editorial_modifier(F.col("remember"), F.col("activation"), F.col("weight"), F.lit(False))))


@query(f"WITH {_STATES} SELECT doc_id, remember, activation, {_ADMIT} AS admitted, {_r(_MOD)} AS modifier FROM documents LEFT JOIN s USING (doc_id)")
def editorial_left_join(spark, d):
    return _judged(spark, d).select("doc_id", "remember", "activation", "admitted", "modifier")


@query("WITH s AS (SELECT DISTINCT conv_id FROM conversations), p AS (SELECT conv_id, conv_id // 10 * 10 AS parent FROM s) SELECT a.conv_id, coalesce(b.conv_id, a.conv_id) AS continuity FROM p a LEFT JOIN s b ON a.parent = b.conv_id")
def session_continuity(spark, d):
    s = table(spark, d, "conversations").select("conv_id").distinct()
    parents = s.select(F.col("conv_id").alias("parent"))
    return s.join(parents, F.expr("conv_id div 10 * 10") == F.col("parent"), "left").select("conv_id", F.coalesce("parent", "conv_id").alias("continuity"))


@query(f"WITH {_T}, c AS (SELECT session_id, max(ts) AS opened, bool_or(kind = 'purchase') AS closed FROM t GROUP BY ALL) SELECT session_id, opened, closed FROM c ORDER BY closed, opened DESC, session_id LIMIT 1")
def preferred_session(spark, d):
    c = telemetry(spark, d).groupBy("session_id").agg(F.max("ts").alias("opened"), F.bool_or(F.col("kind") == "purchase").alias("closed"))
    return c.orderBy("closed", F.desc("opened"), "session_id").limit(1)


@query(f"WITH {_T}, m AS (SELECT max(ts) AS now FROM t) SELECT session_id, kind, arg_min(ts, event_id) AS issued_at, arg_max(ts, event_id) AS refreshed_at, arg_max(value, event_id) AS value, arg_max(ts, event_id) + INTERVAL 86400 SECOND <= any_value(now) AS expired FROM t, m GROUP BY session_id, kind")
def state_lease_active(spark, d):
    t = telemetry(spark, d)
    now = t.agg(F.max("ts").alias("now"))  # one row
    leases = ops.active_leases(t, 86400, F.lit(None).cast("timestamp_ntz")).drop("expired")
    return leases.join(F.broadcast(now)).withColumn("expired", F.col("refreshed_at") + F.expr("INTERVAL 86400 SECONDS") <= F.col("now")).drop("now")


@query(f"WITH {_T}, r AS (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) - 1 AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM t) SELECT event_id, rank, {_r('CASE WHEN n <= 1 THEN CAST(0.35 AS DOUBLE) ELSE (1 - rank / CAST(n - 1 AS DOUBLE)) * CAST(0.35 AS DOUBLE) END')} AS bonus FROM r")
def recency_rank_bonus(spark, d):
    w = Window.partitionBy("session_id")
    r = telemetry(spark, d).withColumn("rank", F.row_number().over(w.orderBy(F.desc("ts"), "event_id")) - 1).withColumn("n", F.count("*").over(w))
    return r.select("event_id", "rank", rounded(ranking.rank_bonus(F.col("rank"), F.col("n"), 0.35)).alias("bonus"))


@query(f"WITH {_T}, b AS (SELECT *, 0 AS p FROM t WHERE kind = 'purchase' UNION ALL SELECT *, 1 FROM t), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p) = 1) SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY p, ts DESC, event_id) AS rank FROM f QUALIFY rank <= 4")
def merge_preferred(spark, d):
    t = telemetry(spark, d).select("event_id", "session_id", "kind", "ts")
    return ops.merge_preferred(t.where("kind = 'purchase'"), t, "event_id", [F.desc("ts"), F.col("event_id")], 4).select("event_id", "session_id", "rank")


@query(r"SELECT doc_id FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\f]+', ' ', 'g'))) AS k FROM documents) QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1")
def dedupe_text_output(spark, d):
    # blank texts are never each other's copies
    norm = text.normalise(F.coalesce("text", F.lit("")))
    keyed = table(spark, d, "documents").select("doc_id", F.when(norm == "", F.concat(F.lit("blank "), "doc_id")).otherwise(F.md5(norm)).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT lower(r_name || '::' || n_name) AS scope, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY n DESC, scope LIMIT 1")
def populated_scope(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy(F.lower(F.concat("r_name", F.lit("::"), "n_name")).alias("scope")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope").limit(1)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, d):
    out = None
    for t in _TABLES:
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Review: claims over telemetry with the factor table, the action cascade and the adjudication band. A claim's events stand
# for kinds of the review: purchases are decisions, errors failures, sign-ups fact assertions, views summaries, clicks
# messages; every third session's claims are remembered already, and clicks of every seventh session are questions.
_FACTORS = f"""c AS ({_CLAIMS}), k AS (SELECT *, CASE kind WHEN 'purchase' THEN 'decision' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'fact_assertion' WHEN 'view' THEN 'summary' ELSE 'message' END AS told,
 session_id % 3 = 0 AS remembered, session_id % 7 = 0 AND kind = 'click' AS question FROM c),
 x AS (SELECT *, told IN ('decision', 'failure', 'fact_assertion') AS spoken FROM k),
 f AS (SELECT *,
 CASE WHEN pinned THEN CAST(1.0 AS DOUBLE) WHEN spoken THEN CAST(0.85 AS DOUBLE) WHEN evidence >= 2 THEN CAST(0.65 AS DOUBLE) ELSE least(CAST(0.25 AS DOUBLE), CAST(0.35 AS DOUBLE) * confidence) END AS consequence,
 CASE WHEN evidence >= 3 THEN CAST(1.0 AS DOUBLE) WHEN evidence = 2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recurrence,
 CASE WHEN pinned OR spoken THEN CAST(0.9 AS DOUBLE) WHEN question THEN CAST(0.15 AS DOUBLE) WHEN evidence >= 2 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS identity,
 CASE WHEN pinned OR spoken THEN CAST(0.95 AS DOUBLE) WHEN question THEN CAST(0.1 AS DOUBLE) WHEN evidence >= 2 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS utility,
 CASE WHEN pinned THEN CAST(1.0 AS DOUBLE) WHEN spoken THEN CAST(0.85 AS DOUBLE) WHEN evidence >= 2 THEN least(CAST(0.75 AS DOUBLE), confidence) ELSE least(CAST(0.2 AS DOUBLE), CAST(0.2 AS DOUBLE) * confidence) END AS user_emphasis,
 CASE told WHEN 'decision' THEN CAST(0.25 AS DOUBLE) WHEN 'failure' THEN CAST(0.25 AS DOUBLE) WHEN 'fact_assertion' THEN CAST(0.2 AS DOUBLE) WHEN 'summary' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS bias FROM x),
 v AS (SELECT *, {_r("greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), bias + CAST(0.25 AS DOUBLE) * consequence + CAST(0.2 AS DOUBLE) * recurrence + CAST(0.2 AS DOUBLE) * identity + CAST(0.2 AS DOUBLE) * utility + CAST(0.15 AS DOUBLE) * user_emphasis))")} AS remember_score FROM f),
 a AS (SELECT *, {_r("least(CAST(1 AS DOUBLE), remember_score + CASE WHEN recurrence > 0.5 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS influence,
  CASE WHEN pinned THEN 'pin' WHEN question AND remembered THEN 'retire' WHEN question THEN 'leave_candidate' WHEN NOT remembered AND NOT spoken AND evidence < 2 THEN 'leave_candidate'
  WHEN remembered AND remember_score >= 0.55 THEN 'reinforce' WHEN remembered AND remember_score <= 0.2 THEN 'retire' WHEN remembered THEN 'fade' WHEN remember_score >= 0.7 THEN 'promote' ELSE 'leave_candidate' END AS action FROM v)"""


def _reviewed(spark, d) -> DataFrame:
    c = ops.upsert_claims(telemetry(spark, d))
    told = F.create_map(*(F.lit(x) for x in ("purchase", "decision", "error", "failure", "signup", "fact_assertion", "view", "summary", "click", "message")))[F.col("kind")]
    k = c.withColumn("told", told).withColumn("remembered", F.col("session_id") % 3 == 0).withColumn("question", (F.col("session_id") % 7 == 0) & (F.col("kind") == "click"))
    f = k.withColumns(ranking.claim_factors(F.col("pinned"), F.col("told").isin(*ranking.EXPLICIT_KINDS), F.col("question"), F.col("evidence"), F.col("confidence")))
    total = ranking.kind_bias(F.col("told"))
    for name, w in ranking.WEIGHTS.items():
        total = total + F.lit(w) * F.col(name)
    v = f.withColumn("remember_score", rounded(text.clamp(total)))
    score = F.col("remember_score")
    action = ranking.claim_action(F.col("pinned"), F.col("told"), F.col("question"), F.col("evidence"), F.col("remembered"), score)
    return v.withColumn("influence", rounded(F.least(F.lit(1.0), score + F.when(F.col("recurrence") > 0.5, 0.1).otherwise(0.0)))).withColumn("action", action)


@query(f"WITH {_T}, {_FACTORS} SELECT session_id, kind, remember_score, influence FROM a")
def factor_scores(spark, d):
    return _reviewed(spark, d).select("session_id", "kind", "remember_score", "influence")


_STATE_OF = "CASE WHEN action IN ('promote', 'reinforce', 'pin', 'fade') THEN 'remembered' WHEN action = 'retire' THEN 'retired' WHEN action = 'mark_disputed' THEN 'disputed' WHEN action = 'mark_superseded' THEN 'superseded' ELSE 'candidate' END"
_ACTIVE_OF = "CASE WHEN action IN ('promote', 'reinforce', 'pin') THEN 'active' WHEN action = 'fade' THEN 'dormant' ELSE 'suppressed' END"


@query(f"WITH {_T}, {_FACTORS} SELECT session_id, kind, action, {_STATE_OF} AS remember, {_ACTIVE_OF} AS activation FROM a")
def action_cascade(spark, d):
    remember, activation = ranking.states_of(F.col("action"))
    return _reviewed(spark, d).select("session_id", "kind", "action", remember.alias("remember"), activation.alias("activation"))


@query(f"WITH {_T}, {_FACTORS} SELECT session_id, kind, NOT (pinned OR question) AND action IN ('promote', 'leave_candidate', 'retire') AND CASE action WHEN 'promote' THEN remember_score >= 0.6 WHEN 'retire' THEN remember_score <= 0.28 ELSE remember_score BETWEEN 0.35 AND 0.82 END AS eligible FROM a")
def adjudication_band(spark, d):
    return _reviewed(spark, d).select("session_id", "kind", ranking.in_band(F.col("action"), F.col("pinned") | F.col("question"), F.col("remember_score")).alias("eligible"))


@query(f"WITH {_T}, {_FACTORS} SELECT action, count(*) AS n FROM a GROUP BY action")
def review_counters(spark, d):
    return _reviewed(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_T} SELECT session_id, kind, max(importance) AS priority, min(ts) AS created, row_number() OVER (ORDER BY max(importance) DESC, min(ts), session_id, kind) AS place FROM t GROUP BY session_id, kind ORDER BY place LIMIT 100")
def review_queue_order(spark, d):
    q = telemetry(spark, d).groupBy("session_id", "kind").agg(F.max("importance").alias("priority"), F.min("ts").alias("created"))
    top = q.orderBy(F.desc("priority"), "created", "session_id", "kind").limit(100)  # the rank is over these hundred rows alone
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "created", "session_id", "kind")))


@query(f"WITH {_STATES}, p AS (SELECT doc_id FROM s WHERE remember = 'candidate') SELECT doc_id, 'pending' AS origin FROM p UNION ALL SELECT doc_id, 'state' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM p)")
def review_full_merge(spark, d):
    s = editorial_states(spark, d)
    pending = s.where("remember = 'candidate'").select("doc_id")
    return pending.withColumn("origin", F.lit("pending")).unionByName(s.select("doc_id").join(pending, "doc_id", "left_anti").withColumn("origin", F.lit("state")))


@query("SELECT l_suppkey, l_partkey, min(o_orderdate) AS valid_from, max(l_shipdate) AS valid_until, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS superseded_at, max(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS last_reinforced_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def temporal_stamps(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag")
    at = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_shipdate")))
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("l_suppkey", "l_partkey").agg(F.min("o_orderdate").alias("valid_from"), F.max("l_shipdate").alias("valid_until"), at("R").alias("superseded_at"), at("A").alias("last_reinforced_at"))


# Retrieval rankers.
@query(f"""WITH {_Q}, {_M}, o AS (SELECT item_id, conv_id, turn, count(*) / CAST(n AS DOUBLE) AS lex FROM q JOIN m USING (token) GROUP BY item_id, conv_id, turn, n),
 s AS (SELECT item_id, conv_id, turn, {_r("lex + CAST(0.5 AS DOUBLE) * CAST(0.3 AS DOUBLE) + CASE role WHEN 'user' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) - CASE WHEN length(coalesce(text, '')) < 20 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")} AS score FROM o JOIN conversations USING (conv_id, turn))
 SELECT item_id, conv_id, turn, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn) AS rank FROM s QUALIFY rank <= 8""")
def rank_events(spark, d):
    m = messages(spark, d).select("conv_id", "turn", "role", F.length("text").alias("size"), F.explode(text.token_set(F.col("text"))).alias("token"))
    hits = m.join(_benchmark(spark, d), "token").groupBy("item_id", "conv_id", "turn", "role", "size", "n").agg(F.count("*").alias("hit"))
    confidence = F.when(F.col("role") == "user", 0.9).otherwise(0.5)
    score = ranking.base_score(F.col("hit") / F.col("n"), F.lit(0.5), confidence) - F.when(F.col("size") < 20, 0.35).otherwise(0.0)
    return ops.top_by(hits.select("item_id", "conv_id", "turn", rounded(score).alias("score")), ["item_id"], [F.desc("score"), "conv_id", "turn"], 8)


@query(f"WITH {_T}, {_FACTORS}, s AS (SELECT session_id, kind, {_r('CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), evidence / CAST(3 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * confidence + CAST(0.1 AS DOUBLE) + remember_score - CASE WHEN evidence < 2 AND NOT pinned THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END')} AS score FROM a) SELECT session_id, kind, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, kind) AS rank FROM s QUALIFY rank <= 5")
def rank_claims(spark, d):
    a = _reviewed(spark, d)
    score = F.lit(0.3) * F.least(F.lit(1.0), F.col("evidence") / 3) + F.lit(0.2) * F.col("confidence") + F.lit(0.1) + F.col("remember_score") - F.when((F.col("evidence") < 2) & ~F.col("pinned"), 0.35).otherwise(0.0)
    return ops.top_by(a.select("session_id", "kind", rounded(score).alias("score")), ["session_id"], [F.desc("score"), "kind"], 5)


@query("WITH m AS (SELECT l_suppkey AS node, count(*) AS mentions FROM lineitem GROUP BY ALL) SELECT node, mentions, floor((least(CAST(0.6 AS DOUBLE), mentions / CAST(25 AS DOUBLE)) - CASE WHEN mentions <= 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 1e4 + CAST(0.5 AS DOUBLE)) / 1e4 AS score FROM m")
def rank_entities(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("mentions"))
    return m.withColumn("score", rounded(F.least(F.lit(0.6), F.col("mentions") / 25) - F.when(F.col("mentions") <= 1, 0.25).otherwise(0.0)))


@query(f"WITH {_EDGES}, s AS (SELECT src, dst, {_r('least(CAST(1 AS DOUBLE), confidence) * CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) - CASE WHEN support <= 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END - CASE WHEN confidence < 0.7 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END')} AS score FROM e) SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s QUALIFY rank <= 10")
def rank_relations(spark, d):
    c = F.col("confidence")
    score = F.least(F.lit(1.0), c) * 0.5 + 0.1 - F.when(F.col("support") <= 1, 0.25).otherwise(0.0) - F.when(c < 0.7, 0.1).otherwise(0.0)
    return ops.top_by(_edges(spark, d).select("src", "dst", rounded(score).alias("score")), ["src"], [F.desc("score"), "dst"], 10)


@query(f"WITH {_T}, {_EPISODES}, g AS (SELECT session_id, kind, CAST(episode AS BIGINT) AS episode, count(*) AS n, max(importance) AS confidence, max(ts) AS updated FROM ep GROUP BY ALL), s AS (SELECT session_id, kind, episode, updated, {_r('confidence * CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) - CASE WHEN n < 2 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END')} AS score FROM g) SELECT session_id, kind, episode, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, updated DESC, kind, episode) AS rank FROM s QUALIFY rank <= 3")
def rank_episodes(spark, d):
    g = _episodes(spark, d).groupBy("session_id", "kind", "episode").agg(F.count("*").alias("n"), F.max("importance").alias("confidence"), F.max("ts").alias("updated"))
    s = g.withColumn("score", rounded(F.col("confidence") * 0.5 + 0.1 - F.when(F.col("n") < 2, 0.25).otherwise(0.0)))
    return ops.top_by(s, ["session_id"], [F.desc("score"), F.desc("updated"), "kind", "episode"], 3).select("session_id", "kind", "episode", "score", "rank")


@query(f"WITH {_STATES} SELECT doc_id, coalesce(remember, 'unreviewed') AS remember, coalesce(remember = 'remembered' AND activation = 'active' AND weight >= 0.2, false) AS active FROM documents LEFT JOIN s USING (doc_id) WHERE NOT coalesce(remember = 'remembered' AND activation = 'active' AND weight >= 0.2, false) OR remember IN ('retired', 'superseded', 'disputed')")
def divergence(spark, d):
    j = _judged(spark, d)
    active = F.coalesce((F.col("remember") == "remembered") & (F.col("activation") == "active") & (F.col("weight") >= 0.2), F.lit(False))
    return j.withColumn("active", active).where(~F.col("active") | F.col("remember").isin("retired", "superseded", "disputed")).select("doc_id", F.coalesce("remember", F.lit("unreviewed")).alias("remember"), "active")


@query("SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders QUALIFY place <= 16")
def timeline_entity(spark, d):
    return ops.top_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 16, "place")


@query(f"WITH {_T}, {_FACTORS} SELECT a.session_id, a.kind, a.action, count(*) AS events, max(t.ts) AS latest FROM a JOIN t ON a.session_id = t.session_id AND a.kind = t.kind GROUP BY ALL")
def explain_artifact(spark, d):
    a = _reviewed(spark, d).select("session_id", "kind", "action")
    return a.join(telemetry(spark, d).select("session_id", "kind", "ts"), ["session_id", "kind"]).groupBy("session_id", "kind", "action").agg(F.count("*").alias("events"), F.max("ts").alias("latest"))


@query(f"WITH {_T} SELECT kind, session_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS support, floor(least(CAST(1 AS DOUBLE), count(DISTINCT CAST(ts AS DATE)) / CAST(count(*) AS DOUBLE)) * 1e4 + CAST(0.5 AS DOUBLE)) / 1e4 AS consistency FROM t GROUP BY ALL HAVING count(DISTINCT CAST(ts AS DATE)) >= 2")
def pattern_claims(spark, d):
    g = telemetry(spark, d).groupBy("kind", "session_id").agg(F.count_distinct(F.col("ts").cast("date")).alias("days"), F.count("*").alias("support"))
    return g.where("days >= 2").withColumn("consistency", rounded(F.least(F.lit(1.0), F.col("days") / F.col("support"))))


@query(f"WITH {_T}, {_EPISODES}, g AS (SELECT session_id, kind, episode, max(importance) AS confidence FROM ep GROUP BY ALL) SELECT kind, count(*) AS episodes, count(DISTINCT session_id) AS sessions, floor(CAST(avg(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) * 1e3 + CAST(0.5 AS DOUBLE)) / 1e3 AS confidence FROM g GROUP BY kind HAVING count(*) >= 2")
def pattern_episodes(spark, d):
    g = _episodes(spark, d).groupBy("session_id", "kind", "episode").agg(F.max("importance").alias("confidence"))
    out = g.groupBy("kind").agg(F.count("*").alias("episodes"), F.count_distinct("session_id").alias("sessions"), F.avg(F.col("confidence").cast("decimal(18,6)")).cast("double").alias("confidence"))
    return out.where("episodes >= 2").withColumn("confidence", rounded(F.col("confidence"), 3))


@query(f"WITH {_EDGES}, g AS (SELECT src AS anchor, count(*) AS support, count(DISTINCT dst) AS neighbours FROM e GROUP BY src) SELECT anchor, support, neighbours, greatest(least(CAST(1 AS DOUBLE), support / CAST(3 AS DOUBLE)), least(CAST(1 AS DOUBLE), neighbours / CAST(4 AS DOUBLE))) AS consistency FROM g WHERE support >= 2")
def pattern_relations(spark, d):
    # edges are one for each pair, so those of a source that have an end are as many as its neighbours
    g = _edges(spark, d).groupBy(F.col("src").alias("anchor")).agg(F.count("*").alias("support"), F.count("dst").alias("neighbours")).where("support >= 2")
    return g.withColumn("consistency", F.greatest(F.least(F.lit(1.0), F.col("support") / 3), F.least(F.lit(1.0), F.col("neighbours") / 4)))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'host_only' WHEN a.k IS NULL THEN 'engine_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def shadow_compare(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')")
    g = li.groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    return g.select("k", F.when(~F.col("a"), "host_only").when(~F.col("r"), "engine_only").otherwise("both").alias("side"))


@query("SELECT 'supplier:' || l_suppkey AS node, count(*) AS weight FROM lineitem GROUP BY ALL UNION ALL SELECT 'part:' || l_partkey, count(*) FROM lineitem GROUP BY ALL")
def scene_nodes(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda kind, c: li.groupBy(F.concat(F.lit(kind), F.col(c)).alias("node")).agg(F.count("*").alias("weight"))
    return side("supplier:", "l_suppkey").unionByName(side("part:", "l_partkey"))


@query(f"WITH {_EDGES} SELECT 'supplier:' || src AS source, 'part:' || dst AS target, support FROM e")
def scene_edges(spark, d):
    return _edges(spark, d).select(F.concat(F.lit("supplier:"), "src").alias("source"), F.concat(F.lit("part:"), "dst").alias("target"), "support")


@query("")
def derive_entities_text(spark, d):
    found = derive.derive_entities(messages(spark, d))
    return found.select("conv_id", "turn", F.posexplode("entities").alias("place", "name"))


@query("")
def derive_relations_text(spark, d):
    # every third turn is told as a relation between its first two words, every fifth has a hint
    m = messages(spark, d).withColumn("w", F.split(F.initcap(F.regexp_replace("text", "[^A-Za-z ]", "")), " +"))
    two = F.array(F.get("w", F.lit(0)), F.get("w", F.lit(1)))
    told = F.when(F.col("turn") % 3 == 0, F.concat_ws(" depends on ", two)).otherwise(F.col("text"))
    hint = F.when(F.col("turn") % 5 == 1, F.array(F.struct(F.lit("Gate").alias("src"), F.lit("Pump").alias("dst"), F.lit("uses").alias("type"), F.lit(None).cast("double").alias("confidence"))))
    events = m.withColumn("entities", F.when(F.col("turn") % 3 == 0, two).otherwise(F.array())).withColumn("hint_relations", hint).withColumn("text", told)
    return derive.derive_relations(events).select("conv_id", "turn", "src", "dst", "type", "confidence")


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(rf"""WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS raw, regexp_replace(trim(regexp_replace(coalesce(text, ''), '{dv.SPACE}', ' ', 'g')), '{dv.FILLER_PATTERN}', '', 'i') AS t FROM conversations),
 s AS (SELECT conv_id, turn, regexp_extract(t, '{dv.COPULA_PATTERN}', ['subject', 'predicate', 'object'], 'i') AS c FROM m
  WHERE NOT contains(raw, '?') AND NOT ({" OR ".join(f"starts_with(lower(t), '{r}')" for r in dv.REQUESTS)}) AND regexp_extract(lower(t), '[a-z0-9_'']+') NOT IN ({_words(dv.QUESTION_STARTERS)})),
 p AS (SELECT conv_id, turn, trim(c.subject) AS subject, lower(c.predicate) AS predicate, regexp_replace(trim(c.object), '\.+$', '') AS object FROM s WHERE c.predicate <> '')
 SELECT conv_id, turn, subject, predicate, object, subject || ' ' || predicate || ' ' || object AS canonical FROM p
 WHERE lower(subject) NOT IN ({_words((*dv.QUESTION_STARTERS, *dv.OTHER_GENERIC_SUBJECTS))}) AND NOT (lower(subject) IN ({_words(dv.PRONOUNS)}) AND regexp_matches(lower(object), '{dv.SPEECH_PATTERN}')) AND length(object) <= {dv.LONGEST_OBJECT}""")
def derive_claims_text(spark, d):
    return derive.derive_claims(messages(spark, d).withColumn("confidence", F.lit(1.0))).select("conv_id", "turn", "subject", "predicate", "object", "canonical")
