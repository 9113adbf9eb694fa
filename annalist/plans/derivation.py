"""Derivation in one pass over stored JSON: documents of several kinds made of the given tables, and every artifact that they give.

What a document holds follows from the row that it is made of, its names, texts, balances and types. The SQL reads the
same JSON by path and applies the rules to what it finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import derivation as dv
from annalist.functions import rules
from annalist.operators import artifacts, episodes
from annalist.plans.catalogue import ORACLE, QUERIES, query
from annalist.sources import payloads
from annalist.sources.archive import table

__all__ = ["ORACLE", "QUERIES"]


def documents(spark, d) -> DataFrame:
    """doc, the JSON line of each event: customers assert and claim, orders hold leases, parts are told of, suppliers depend, turns are said."""
    lit, col = F.lit, F.col
    t = lambda name: table(spark, d, name)
    scope = lambda workspace: F.struct(lit("Acme ").alias("tenant"), lit("memory").alias("namespace"), workspace.alias("workspace"), lit("p").alias("project"))
    score = lambda importance, confidence: F.struct(importance.cast("double").alias("importance"), confidence.cast("double").alias("confidence"))

    def line(df: DataFrame, **fields) -> DataFrame:
        return df.select(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("doc"))

    nation = t("nation").select("n_nationkey", "n_name")
    c = t("customer").join(nation, col("c_nationkey") == col("n_nationkey"))
    rich = col("c_acctbal") >= 5000
    home = F.struct(col("c_name").alias("subject_name"), lit("lives  in").alias("predicate"), F.concat("n_name", lit("..")).alias("object_text"), F.concat("c_name", lit(" lives in "), "n_name").alias("canonical_claim"), lit(None).cast("double").alias("confidence"), lit(None).cast("boolean").alias("pinned"))
    segment = F.struct(lit(None).cast("string").alias("subject_name"), lit("buys").alias("predicate"), col("c_mktsegment").alias("object_text"), lit(None).cast("string").alias("canonical_claim"), lit(0.95).alias("confidence"), (col("c_acctbal") >= 9000).alias("pinned"))
    nothing = F.struct(lit("nobody").alias("subject_name"), lit(" ").alias("predicate"), lit("x").alias("object_text"), lit(None).cast("string").alias("canonical_claim"), lit(0.1).alias("confidence"), lit(True).alias("pinned"))
    customers = line(
        c, event_id=F.concat(lit("c"), "c_custkey"), arrival=col("c_custkey"), timestamp=F.date_format(F.timestamp_seconds(1_700_000_000 + col("c_custkey") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"), scope=scope(col("c_mktsegment")),
        session_id=col("n_name"), kind=lit("fact_assertion"), raw_text=F.when(col("c_acctbal") < 0, F.concat(lit("So remember that my name is "), "c_name", lit("."))).otherwise(F.concat(lit("well  "), "c_name", lit(" owes "), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))),
        structured_payload=F.struct(F.when(rich, F.array(home, nothing, segment)).alias("claims")), hints=F.struct(F.array(col("c_name"), F.concat(lit("the "), "n_name"), F.upper("n_name")).alias("entities"), (col("c_acctbal") < -500).alias("pin")), scores=score(col("c_acctbal") / 10000, lit(0.6)),
    )
    status = col("o_orderstatus")
    value = F.when(status == "P", F.concat(lit('{"value":{"status":"P"},"key":"status-of-'), "o_custkey", lit('"'))).when(status == "F", F.concat(lit('{"value":"F","lease_key":" status-of-'), "o_custkey", lit(' "'))).otherwise(F.concat(lit('{"value":0,"key":"status-of-'), "o_custkey", lit('"')))
    ttl = F.when(F.startswith("o_orderpriority", lit("1")), ',"ttl_seconds":600}').when(F.startswith("o_orderpriority", lit("2")), ',"ttl":7200}').otherwise("}")
    orders = line(
        t("orders"), event_id=F.concat(lit("o"), "o_orderkey"), arrival=col("o_orderkey"), timestamp=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), scope=scope(lit("orders")), session_id=F.concat(lit("c"), "o_custkey"),
        kind=lit("state_update"), structured_payload=F.parse_json(F.concat(value, ttl)), hints=F.struct(F.array("o_orderpriority").alias("entities")), scores=score(lit(0.2), lit(0.5)),
    )
    kind = F.when(col("p_type") == "PROMO", "tool_result").when(col("p_type") == "ECONOMY", "note").when(col("p_type") == "LARGE", "decision").otherwise("message")
    hint = lambda src, dst, type_, confidence: F.struct(src.alias("src"), dst.alias("dst"), lit(type_).alias("type"), confidence.cast("double").alias("confidence"))
    hints = F.array(hint(col("p_name"), col("p_brand"), "uses", col("p_retailprice") / 2000), hint(col("p_brand"), lit("elsewhere"), "depends_on", lit(0.9)), hint(col("p_name"), col("p_brand"), "likes", lit(0.9)), hint(lit(" "), col("p_brand"), "uses", lit(0.9)), hint(col("p_brand"), col("p_name"), "causes", lit(None)))
    parts = line(
        t("part"), event_id=F.concat(lit("p"), "p_partkey"), arrival=col("p_partkey"), timestamp=F.date_format(F.timestamp_seconds(1_710_000_000 - col("p_partkey") * 30), "yyyy-MM-dd'T'HH:mm:ss'Z'"), scope=scope(lit("Parts")),
        session_id=F.when(col("p_size") > 5, F.concat(lit("size-"), "p_size")), kind=kind, raw_text=F.when(col("p_type") == "SMALL", F.concat(lit("what is "), "p_name")).otherwise(F.concat("p_name", lit(" is "), "p_brand", lit("."))),
        structured_payload=F.struct(F.when(col("p_type") == "PROMO", F.concat(lit(" "), "p_name", lit("  means "), "p_type")).alias("tool_observation_text"), (col("p_size") > 40).alias("needs_clarification")),
        hints=F.struct(F.array("p_name", "p_brand").alias("entities"), F.when(col("p_type") == "LARGE", hints).alias("relations"), F.when(col("p_size") < 3, "Small  goods").when(col("p_size") < 5, "note").alias("episode_hint")), scores=score(col("p_size") / 50, F.least(lit(1.0), col("p_retailprice") / 2000)),
    )
    s = t("supplier").join(nation, col("s_nationkey") == col("n_nationkey"))
    low = col("s_acctbal") < 3000
    told = F.concat("s_name", lit(" depends on "), "n_name")
    suppliers = line(
        s, event_id=F.concat(lit("s"), "s_suppkey"), arrival=col("s_suppkey"), timestamp=F.date_format(F.timestamp_seconds(1_720_000_000 + col("s_suppkey") * 400), "yyyy-MM-dd'T'HH:mm:ss'Z'"), scope=scope(lit("supply")), session_id=col("n_name"),
        kind=lit(" Message"), raw_text=F.when(low, "ok nice").otherwise(F.concat(lit("The operator is asking about "), "s_name")),
        structured_payload=F.struct(F.when(low, F.concat(lit("The speaker agrees with all that was said of "), "s_name", lit(" and "), "n_name")).alias("interpreted_text"), F.when(~low, told).alias("raw_text"), F.when(~low & (col("s_acctbal") > 7000), F.concat(lit("goods caused by "), "s_name", lit(" reach "), "n_name")).alias("normalized_text")),
        hints=F.struct(F.when(~low, F.array("s_name", "n_name")).alias("entities")), scores=score(lit(0.4), lit(0.9)),
    )
    turns = line(
        t("conversations"), event_id=F.concat_ws("-", lit("t"), "conv_id", "turn"), arrival=col("conv_id") * 1000 + col("turn"), timestamp=F.date_format(F.timestamp_seconds(1_730_000_000 + col("conv_id") * 3600 + col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"), scope=scope(col("role")),
        session_id=F.concat(lit("conv-"), "conv_id"), kind=F.when(col("role") == "user", "message").when(col("role") == "assistant", "summary").otherwise("note"), raw_text=col("text"),
        hints=F.struct(F.array(F.concat_ws(" ", lit("conv"), "conv_id", "role")).alias("entities")), scores=score(lit(0.3), F.when(col("turn") == 0, 0.8).otherwise(0.9)),
    )
    every = customers.unionByName(orders).unionByName(parts).unionByName(suppliers).unionByName(turns)
    return every.repartition(F.xxhash64("doc"))  # as lines of one archive: what reads them is planned once, not for each table that they are made of


_SCOPE = "{{'tenant': 'Acme ', 'namespace': 'memory', 'workspace': {}, 'project': 'p'}}"
_AT = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_SECONDS = "make_timestamp(CAST(({}) * 1000000 AS BIGINT))"
_DOCS = f"""docs AS (
 SELECT to_json({{'event_id': 'c' || c_custkey, 'arrival': c_custkey, 'timestamp': {_AT.format(_SECONDS.format("1700000000 + c_custkey * 60"))}, 'scope': {_SCOPE.format("c_mktsegment")}, 'session_id': n_name, 'kind': 'fact_assertion',
  'raw_text': CASE WHEN c_acctbal < 0 THEN 'So remember that my name is ' || c_name || '.' ELSE 'well  ' || c_name || ' owes ' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END,
  'structured_payload': {{'claims': CASE WHEN c_acctbal >= 5000 THEN [{{'subject_name': c_name, 'predicate': 'lives  in', 'object_text': n_name || '..', 'canonical_claim': c_name || ' lives in ' || n_name, 'confidence': CAST(NULL AS DOUBLE), 'pinned': CAST(NULL AS BOOLEAN)}},
   {{'subject_name': 'nobody', 'predicate': ' ', 'object_text': 'x', 'canonical_claim': NULL, 'confidence': CAST(0.1 AS DOUBLE), 'pinned': true}}, {{'subject_name': NULL, 'predicate': 'buys', 'object_text': c_mktsegment, 'canonical_claim': NULL, 'confidence': CAST(0.95 AS DOUBLE), 'pinned': c_acctbal >= 9000}}] END}},
  'hints': {{'entities': [c_name, 'the ' || n_name, upper(n_name)], 'pin': c_acctbal < -500}}, 'scores': {{'importance': c_acctbal / 10000, 'confidence': CAST(0.6 AS DOUBLE)}}}}) AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT to_json({{'event_id': 'o' || o_orderkey, 'arrival': o_orderkey, 'timestamp': {_AT.format("o_orderdate")}, 'scope': {_SCOPE.format("'orders'")}, 'session_id': 'c' || o_custkey, 'kind': 'state_update',
  'structured_payload': CAST(CASE o_orderstatus WHEN 'P' THEN '{{"value":{{"status":"P"}},"key":"status-of-' || o_custkey || '"' WHEN 'F' THEN '{{"value":"F","lease_key":" status-of-' || o_custkey || ' "' ELSE '{{"value":0,"key":"status-of-' || o_custkey || '"' END
   || CASE WHEN starts_with(o_orderpriority, '1') THEN ',"ttl_seconds":600}}' WHEN starts_with(o_orderpriority, '2') THEN ',"ttl":7200}}' ELSE '}}' END AS JSON), 'hints': {{'entities': [o_orderpriority]}}, 'scores': {{'importance': CAST(0.2 AS DOUBLE), 'confidence': CAST(0.5 AS DOUBLE)}}}}) FROM orders
 UNION ALL SELECT to_json({{'event_id': 'p' || p_partkey, 'arrival': p_partkey, 'timestamp': {_AT.format(_SECONDS.format("1710000000 - p_partkey * 30"))}, 'scope': {_SCOPE.format("'Parts'")}, 'session_id': CASE WHEN p_size > 5 THEN 'size-' || p_size END,
  'kind': CASE p_type WHEN 'PROMO' THEN 'tool_result' WHEN 'ECONOMY' THEN 'note' WHEN 'LARGE' THEN 'decision' ELSE 'message' END, 'raw_text': CASE WHEN p_type = 'SMALL' THEN 'what is ' || p_name ELSE p_name || ' is ' || p_brand || '.' END,
  'structured_payload': {{'tool_observation_text': CASE WHEN p_type = 'PROMO' THEN ' ' || p_name || '  means ' || p_type END, 'needs_clarification': p_size > 40}},
  'hints': {{'entities': [p_name, p_brand], 'relations': CASE WHEN p_type = 'LARGE' THEN [{{'src': p_name, 'dst': p_brand, 'type': 'uses', 'confidence': p_retailprice / 2000}}, {{'src': p_brand, 'dst': 'elsewhere', 'type': 'depends_on', 'confidence': CAST(0.9 AS DOUBLE)}},
    {{'src': p_name, 'dst': p_brand, 'type': 'likes', 'confidence': CAST(0.9 AS DOUBLE)}}, {{'src': ' ', 'dst': p_brand, 'type': 'uses', 'confidence': CAST(0.9 AS DOUBLE)}}, {{'src': p_brand, 'dst': p_name, 'type': 'causes', 'confidence': NULL}}] END,
   'episode_hint': CASE WHEN p_size < 3 THEN 'Small  goods' WHEN p_size < 5 THEN 'note' END}}, 'scores': {{'importance': CAST(p_size AS DOUBLE) / 50, 'confidence': least(CAST(1 AS DOUBLE), p_retailprice / 2000)}}}}) FROM part
 UNION ALL SELECT to_json({{'event_id': 's' || s_suppkey, 'arrival': s_suppkey, 'timestamp': {_AT.format(_SECONDS.format("1720000000 + s_suppkey * 400"))}, 'scope': {_SCOPE.format("'supply'")}, 'session_id': n_name, 'kind': ' Message',
  'raw_text': CASE WHEN s_acctbal < 3000 THEN 'ok nice' ELSE 'The operator is asking about ' || s_name END, 'structured_payload': {{'interpreted_text': CASE WHEN s_acctbal < 3000 THEN 'The speaker agrees with all that was said of ' || s_name || ' and ' || n_name END,
   'raw_text': CASE WHEN s_acctbal >= 3000 THEN s_name || ' depends on ' || n_name END, 'normalized_text': CASE WHEN s_acctbal > 7000 THEN 'goods caused by ' || s_name || ' reach ' || n_name END}},
  'hints': {{'entities': CASE WHEN s_acctbal >= 3000 THEN [s_name, n_name] END}}, 'scores': {{'importance': CAST(0.4 AS DOUBLE), 'confidence': CAST(0.9 AS DOUBLE)}}}}) FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT to_json({{'event_id': 't-' || conv_id || '-' || turn, 'arrival': conv_id * 1000 + turn, 'timestamp': {_AT.format(_SECONDS.format("1730000000 + conv_id * 3600 + turn * 60"))}, 'scope': {_SCOPE.format("role")}, 'session_id': 'conv-' || conv_id,
  'kind': CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'summary' ELSE 'note' END, 'raw_text': text, 'hints': {{'entities': ['conv ' || conv_id || ' ' || role]}}, 'scores': {{'importance': CAST(0.3 AS DOUBLE), 'confidence': CAST(CASE WHEN turn = 0 THEN 0.8 ELSE 0.9 END AS DOUBLE)}}}}) FROM conversations)"""


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _compact(x: str) -> str:
    return f"nullif(trim(regexp_replace(coalesce({x}, ''), '{dv.SPACE}', ' ', 'g')), '')"


def _bare(x: str) -> str:
    return f"regexp_replace({_compact(x)}, '{dv.FILLER_PATTERN}', '', 'i')"


_REACTIONS = _list(dict.fromkeys((*rules.REACTION_WORDS, *rules.EMPTY_REACTION_WORDS)))
_INTERPRETIVE = "^(" + "|".join(p for p in rules.INTERPRETIVE_PREFIXES) + ")"
_CUES = ", ".join(f"{{'cue': '{c}', 'type': '{t}', 'swap': {str(s).lower()}}}" for c, t, s in dv.RELATION_CUES)
_TYPES = _list(dv.RELATION_TYPES)
# Each rule over what the paths give: the text that counts, names (hints without weak edges, each once), relations, claims.
_RULES = rf"""x AS (SELECT doc ->> '$.event_id' AS event_id, lower(concat_ws('::', trim(doc ->> '$.scope.tenant'), trim(doc ->> '$.scope.namespace'), trim(doc ->> '$.scope.workspace'), trim(doc ->> '$.scope.project'))) AS scope_key,
  nullif(trim(doc ->> '$.session_id'), '') AS session_id, CAST(doc ->> '$.timestamp' AS TIMESTAMP) AS ts, CAST(doc ->> '$.arrival' AS BIGINT) AS arrival, lower(trim(doc ->> '$.kind')) AS kind, {_compact("doc ->> '$.raw_text'")} AS own, coalesce(doc ->> '$.raw_text', '') AS raw,
  {_compact("doc ->> '$.structured_payload.raw_text'")} AS said, {_compact("doc ->> '$.structured_payload.normalized_text'")} AS p_normal, {_compact("doc ->> '$.structured_payload.interpreted_text'")} AS meant, {_compact("doc ->> '$.structured_payload.tool_observation_text'")} AS seen,
  coalesce(CAST(doc ->> '$.structured_payload.needs_clarification' AS BOOLEAN), false) AS unclear, coalesce(CAST(doc ->> '$.hints.pin' AS BOOLEAN), false) AS pin, doc ->> '$.hints.entities[*]' AS hints, doc -> '$.hints.relations[*]' AS rels, doc ->> '$.hints.episode_hint' AS hint,
  CAST(doc ->> '$.scores.importance' AS DOUBLE) AS importance, CAST(doc ->> '$.scores.confidence' AS DOUBLE) AS confidence, doc -> '$.structured_payload.claims[*]' AS told, nullif(trim(coalesce(doc ->> '$.structured_payload.lease_key', doc ->> '$.structured_payload.key')), '') AS lease_key,
  doc -> '$.structured_payload.value' AS value, coalesce(nullif(CAST(doc ->> '$.structured_payload.ttl_seconds' AS BIGINT), 0), nullif(CAST(doc ->> '$.structured_payload.ttl' AS BIGINT), 0), 3600) AS ttl FROM docs),
 y AS (SELECT *, list_transform(hints, lambda h: regexp_replace(trim(h), '^(the|a|an|of|to|for|and|or|by) ', '')) AS spelled, regexp_extract_all(lower(coalesce(said, own)), '[a-z0-9_''-]+') AS words, len(regexp_extract_all(lower(coalesce(meant, '')), '[a-z0-9_''-]+')) AS n_meant FROM x),
 z AS (SELECT *, coalesce(len(hints) = 0 AND meant IS NOT NULL AND kind <> 'fact_assertion' AND len(words) BETWEEN 1 AND 4 AND n_meant >= greatest(8, 3 * len(words)) AND len(list_filter(words, lambda w: w NOT IN ({_REACTIONS}))) = 0, false) AS reacts FROM y),
 t AS (SELECT *, CASE WHEN kind = 'tool_result' AND seen IS NOT NULL THEN seen WHEN said IS NOT NULL AND (coalesce(regexp_matches(lower(own), '{_INTERPRETIVE}'), false) OR coalesce(lower(own) = lower(meant), false)) THEN said WHEN reacts THEN meant ELSE coalesce(own, said, p_normal, meant, '') END AS text,
  list_filter(spelled, lambda h, i: list_position(list_transform(spelled, lambda g: lower(g)), lower(h)) = i) AS names FROM z),
 n AS (SELECT *, CASE WHEN p_normal IS NOT NULL AND lower(text) = lower(said) THEN p_normal ELSE lower(text) END AS normal, regexp_replace(text, '{dv.FILLER_PATTERN}', '', 'i') AS bare, list_transform(names, lambda h: lower(h)) AS low FROM t),
 c AS (SELECT *, list_filter([{_CUES}], lambda k: contains(normal, k.cue))[1] AS cue FROM n),
 e AS (SELECT *, left(normal, instr(normal, cue.cue) - 1) AS before, substr(normal, instr(normal, cue.cue) + length(cue.cue)) AS after FROM c),
 g AS (SELECT *, list_filter(names, lambda h: contains(before, lower(h))) AS lefts, list_filter(names, lambda h: contains(after, lower(h))) AS rights FROM e),
 k AS (SELECT *, list_sort(list_transform(lefts, lambda h: {{'far': instr(reverse(before), reverse(lower(h))), 'name': h}}))[1].name AS l, list_sort(list_transform(rights, lambda h: {{'far': instr(after, lower(h)), 'name': h}}))[1].name AS r FROM g),
 p AS (SELECT *, CASE WHEN l IS NOT NULL AND r IS NOT NULL AND lower(l) <> lower(r) THEN l ELSE names[1] END AS a, CASE WHEN l IS NOT NULL AND r IS NOT NULL AND lower(l) <> lower(r) THEN r ELSE names[2] END AS b FROM k),
 hinted AS (SELECT event_id, trim(h ->> '$.src') AS src, trim(h ->> '$.dst') AS dst, h ->> '$.type' AS type, coalesce(CAST(h ->> '$.confidence' AS DOUBLE), CAST(0.8 AS DOUBLE)) AS confidence FROM (SELECT event_id, unnest(rels) AS h FROM p) WHERE trim(h ->> '$.src') <> '' AND trim(h ->> '$.dst') <> '' AND (h ->> '$.type') IN ({_TYPES})),
 rel AS (SELECT h.event_id, src, dst, type, h.confidence FROM hinted h JOIN p USING (event_id) WHERE list_contains(low, lower(src)) AND list_contains(low, lower(dst))
  UNION ALL SELECT event_id, CASE WHEN cue.swap THEN b ELSE a END, CASE WHEN cue.swap THEN a ELSE b END, cue.type, CAST(0.65 AS DOUBLE) FROM p WHERE cue IS NOT NULL AND len(names) >= 2 AND len(list_filter(low, lambda h: contains(normal, h))) > 0 AND event_id NOT IN (SELECT event_id FROM hinted)),
 listed AS (SELECT event_id, nullif(trim(j ->> '$.subject_name'), '') AS s, nullif(trim(j ->> '$.predicate'), '') AS pr, nullif(trim(j ->> '$.object_text'), '') AS o, j ->> '$.canonical_claim' AS ca, CAST(j ->> '$.confidence' AS DOUBLE) AS co, coalesce(CAST(j ->> '$.pinned' AS BOOLEAN), false) AS pi FROM (SELECT event_id, unnest(told) AS j FROM p)),
 own_claims AS (SELECT p.event_id, {_compact("coalesce(s, names[1])")} AS s, {_compact("pr")} AS pr, regexp_replace({_compact("o")}, '\.+$', '') AS o, coalesce(ca, pr || ' ' || o) AS ca, coalesce(co, p.confidence) AS co, pi OR pin AS pi FROM listed JOIN p USING (event_id) WHERE pr IS NOT NULL AND o IS NOT NULL),
 profiled AS (SELECT event_id, co, pi, CASE WHEN lower(pr) IN ('lives in', 'lives') AND (lower(s) = 'operator' OR starts_with(lower(ca), lower(s) || ' lives ')) THEN {{'s': 'operator', 'p': 'lives in', 'o': o, 'c': 'operator lives in ' || o}} ELSE {{'s': s, 'p': pr, 'o': o, 'c': ca}} END AS q FROM own_claims),
 stated AS (SELECT event_id, kind, bare, names, confidence, pin, regexp_extract(regexp_replace(regexp_replace(bare, '\.+$', ''), '^remember (that )?', '', 'i'), '^my +([a-zA-Z][a-zA-Z0-9_ -]{{1,40}}?) +is +(.+)$', ['attr', 'value'], 'i') AS f,
   regexp_extract(bare, '{dv.COPULA_PATTERN}', ['subject', 'predicate', 'object'], 'i') AS m, raw, unclear, coalesce(nullif({_bare("meant")}, ''), nullif(bare, ''), raw) AS asked FROM p WHERE bare <> '' AND event_id NOT IN (SELECT event_id FROM own_claims)),
 facts AS (SELECT event_id, CASE WHEN f.attr <> '' THEN 'operator' ELSE names[1] END AS s, CASE WHEN lower(f.attr) = 'name' THEN 'has name' WHEN f.attr <> '' THEN 'has ' || f.attr ELSE 'asserts' END AS p, CASE WHEN f.attr <> '' THEN f.value ELSE bare END AS o,
   CASE WHEN lower(f.attr) = 'name' THEN 'operator has name ' || f.value WHEN f.attr <> '' THEN 'operator has ' || f.attr || ' ' || f.value ELSE regexp_replace(bare, '\.+$', '') END AS c, greatest(CAST(0.7 AS DOUBLE), confidence) AS co, pin AS pi FROM stated WHERE kind = 'fact_assertion'),
 open_ AS (SELECT *, trim(m.subject) AS s, regexp_replace(trim(m.object), '\.+$', '') AS o FROM stated WHERE m.predicate <> '' AND kind IN ('message', 'decision', 'summary', 'note', 'tool_result')
   AND NOT (kind = 'message' AND (unclear OR confidence < 0.85 OR contains(raw, '?') OR contains(asked, '?') OR {" OR ".join(f"starts_with(lower(asked), '{r}')" for r in dv.REQUESTS)} OR regexp_extract(lower(asked), '[a-z0-9_'']+') IN ({_list(dv.QUESTION_STARTERS)}))) AND NOT (kind = 'tool_result' AND confidence < 0.7)),
 claims AS (SELECT event_id, q.s AS s, q.p AS p, q.o AS o, q.c AS c, co, pi FROM profiled UNION ALL SELECT event_id, s, p, o, c, co, pi FROM facts
  UNION ALL SELECT event_id, s, lower(m.predicate), o, s || ' ' || lower(m.predicate) || ' ' || o, confidence, pin FROM open_ WHERE lower(s) NOT IN ({_list((*dv.QUESTION_STARTERS, *dv.OTHER_GENERIC_SUBJECTS))}) AND NOT (lower(s) IN ({_list(dv.PRONOUNS)}) AND regexp_matches(lower(o), '{dv.SPEECH_PATTERN}')) AND length(o) <= {dv.LONGEST_OBJECT}),
 titled AS (SELECT *, coalesce(CASE WHEN trim(hint) <> '' AND lower(trim(hint)) NOT IN ({_list(rules.LOW_SIGNAL_HINTS)}) THEN trim(hint) END, replace(lower(names[1]), ' ', '-'), CASE WHEN text <> '' THEN lower(array_to_string(string_split(text, ' ')[1:4], '-')) END, kind) AS title FROM p),
 a AS (SELECT event_id, 'lease' AS artifact, lease_key AS name, NULL AS predicate, CASE WHEN json_type(value) = 'OBJECT' THEN CAST(value AS VARCHAR) WHEN CAST(value AS VARCHAR) IN ('0', '""', 'null', 'false') OR value IS NULL THEN '{{}}' ELSE '{{"value":' || CAST(value AS VARCHAR) || '}}' END AS object, lease_key AS canonical, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BOOLEAN) AS pinned, NULL AS trigger, CAST(NULL AS DOUBLE) AS priority, ttl FROM p WHERE kind = 'state_update' AND lease_key IS NOT NULL
  UNION ALL SELECT event_id, 'entity', h, 'mentioned', NULL, h, NULL, NULL, NULL, NULL, NULL FROM (SELECT event_id, unnest(names) AS h FROM p)
  UNION ALL SELECT DISTINCT event_id, 'entity', s, 'subject', NULL, s, NULL, NULL, NULL, NULL, NULL FROM claims JOIN p USING (event_id) WHERE s IS NOT NULL AND NOT coalesce(list_contains(low, lower(s)), false)
  UNION ALL SELECT event_id, 'relation', src, type, dst, src || ' ' || type || ' ' || dst, confidence, NULL, NULL, NULL, NULL FROM rel UNION ALL SELECT event_id, 'queue', 'relation', NULL, NULL, src || ' ' || type || ' ' || dst, NULL, NULL, 'derived_relation', CAST(0.35 AS DOUBLE), NULL FROM rel
  UNION ALL SELECT event_id, 'claim', s, p, o, c, co, pi, NULL, NULL, NULL FROM claims UNION ALL SELECT event_id, 'queue', 'claim', NULL, NULL, c, NULL, NULL, 'derived_claim', importance, NULL FROM claims JOIN (SELECT event_id, importance FROM p) USING (event_id) WHERE NOT pi
  UNION ALL SELECT event_id, 'episode', title, NULL, coalesce(array_to_string(names[1:4], ', '), ''), title, confidence, NULL, NULL, NULL, NULL FROM titled WHERE session_id IS NOT NULL UNION ALL SELECT event_id, 'queue', 'episode', NULL, NULL, title, NULL, NULL, 'episode_activity', CAST(0.3 AS DOUBLE), NULL FROM titled WHERE session_id IS NOT NULL)"""


def derived(spark, d) -> DataFrame:
    return artifacts.artifacts_of(payloads.events_of(payloads.parsed(documents(spark, d))))


@query(f"WITH {_DOCS}, {_RULES} SELECT event_id, scope_key, session_id, a.* EXCLUDE (event_id) FROM a JOIN (SELECT event_id, scope_key, session_id FROM x) USING (event_id)")
def derived_artifacts(spark, d):
    return derived(spark, d).drop("ts", "arrival")


_FOLD = lambda x: f"lower(coalesce({_compact(x)}, ''))"
_UPSERT = f"""u AS (SELECT a.*, scope_key, session_id, ts, {{'arrival': arrival, 'event_id': event_id}} AS o, CASE WHEN artifact IN ('lease', 'entity') THEN {_FOLD("name")} WHEN artifact = 'episode' THEN {_FOLD("session_id")} || chr(31) || {_FOLD("name")}
 WHEN artifact = 'queue' THEN {_FOLD("name")} || chr(31) || {_FOLD("canonical")} || chr(31) || {_FOLD("trigger")} ELSE {_FOLD("name")} || chr(31) || {_FOLD("predicate")} || chr(31) || {_FOLD("object")} END AS key FROM a JOIN (SELECT event_id, scope_key, session_id, ts, arrival FROM x) USING (event_id))"""


@query(f"""WITH {_DOCS}, {_RULES}, {_UPSERT} SELECT scope_key, artifact, key, arg_min(name, o) AS name, max(confidence) AS confidence, bool_or(pinned) AS pinned, arg_max(object, o) AS object, arg_max(ttl, o) AS ttl, arg_min(priority, o) AS priority,
 count(DISTINCT event_id) AS evidence, arg_min(ts, o) AS first_seen, arg_max(ts, o) AS last_seen FROM u GROUP BY scope_key, artifact, key""")
def artifact_tables(spark, d):
    # parts come latest first, so their last_seen is overwritten by earlier times, as arrival decides
    up = artifacts.upserted(derived(spark, d))
    return up.select("scope_key", "artifact", "key", "name", "confidence", "pinned", "object", "ttl", "priority", "evidence", "first_seen", "last_seen")


@query("")
def derived_episodes(spark, d):
    # the episodes of all events of a session, related ones joined, in order of time; turns of a conversation end with their session
    every = payloads.events_of(payloads.parsed(documents(spark, d))).where("session_id is not null")
    session = F.xxhash64("session_id").alias("session_id")
    events = artifacts.titled(every).select(F.xxhash64("event_id").alias("event_id"), session, "ts", "title", F.split(artifacts.dominant(F.col("names")), ", ").alias("entities"), "confidence")
    closes = every.where(F.startswith("session_id", F.lit("conv-"))).groupBy(session).agg(F.max("ts").alias("ts"))
    return episodes.episodes_of(episodes.episode_changes(events, closes))
