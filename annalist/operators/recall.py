"""The bundle that answers each of a table of queries: leases, claims, episodes, entities, relations and events of its scope.

Candidates of a kind are few for every query: the newest of its scope, those of the preferred session, and what an
inverted index finds by the query's words. Postings whose order doesn't depend on the query are cut at the number that is
asked for, which loses nothing, as no later one can be among the first of a union; where all words must be met, only
the postings of the query's rarest word are read. Everything is a join by scope, or by scope and word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions import ranking, rules, text
from annalist.operators.archive import top_by
from annalist.sources.archive import settled

#: Rows of each kind in a bundle; candidates are three times as many, of events four times.
BUDGET = {"lease": 3, "claim": 5, "episode": 3, "entity": 6, "relation": 10, "event": 8}
OVER, OVER_EVENTS = 3, 4
RANKED = ("claim", "episode", "entity", "relation")
#: The least topical match of what answers a question for a claim, and the penalty from which an entity isn't shown.
LEAST_TOPICAL, WORST_ENTITY = 0.15, -0.9


@dataclass(frozen=True)
class Stored:
    """What recall reads.

    artifacts: scope_key, kind, ref, name, predicate, object, canonical, confidence, evidence, pinned, last_seen, remember,
    activation, weight (score and influence), state_pinned. support: scope_key, kind, ref, session_id. events: scope_key,
    ref, session_id, ts, arrival, raw_text, normalized_text, p_raw, route_domain, route_action, importance, confidence.
    sessions: scope_key, session_id, kind, opened_at, closed_at. leases: scope_key, ref, refreshed_at, active ones alone.
    described: where there is one, artifacts have no columns but scope_key, kind, ref, name, predicate, object and last_seen, of
    which an entity's name may be folded, and it gives all columns of those asked for (scope_key, kind, ref).
    """

    artifacts: DataFrame
    support: DataFrame
    events: DataFrame
    sessions: DataFrame
    leases: DataFrame
    described: Callable[[DataFrame], DataFrame] | None = None


def asked(queries: DataFrame) -> DataFrame:
    """queries (qid, scope_key, query) with what their wording asks for; null queries ask for nothing in particular."""
    q = F.coalesce("query", F.lit(""))
    low = rules.folded(q)
    kind, target = rules.asked_relation(q)
    out = queries.select("qid", "scope_key", low.alias("query"), rules.intent(q).alias("intent"), rules.relation_focus(q).alias("relations"), rules.evidence_focus(q).alias("proof"), rules.session_wording(low).alias("session"), rules.claim_focus(q).alias("_claims"), text.token_set(low).alias("qw"), text.content_set(low).alias("qc"), kind.alias("_kind"), target.alias("_target"))
    c = F.col
    shape = lambda x: F.when(c("relations"), c(x))
    out = out.withColumns({"asked_kind": shape("_kind"), "asked_target": shape("_target"), "mode": F.when(c("intent").isin("archive", "archaeology"), "archive").otherwise("default")})
    out = out.withColumn("claims", (c("intent") == "identity") | (c("_claims") & ~c("relations")))
    return out.withColumn("sought", F.when(c("asked_kind").isNotNull(), text.content_set(c("asked_target"))).otherwise(c("qc"))).drop("_claims", "_kind", "_target")


def preferred_sessions(sessions: DataFrame) -> DataFrame:
    """scope_key and preferred: the interaction opened last of those open, else the one closed last."""
    s = sessions.where("kind = 'interaction'")
    order = [F.col("closed_at").isNotNull(), F.desc(F.coalesce("closed_at", "opened_at")), F.desc("opened_at"), "session_id"]
    return top_by(s, ["scope_key"], order, 1).select("scope_key", F.col("session_id").alias("preferred"))


def _limit(kind: Column) -> Column:
    out = F.lit(0)
    for k in RANKED:
        out = F.when(kind == k, OVER * BUDGET[k]).otherwise(out)
    return out


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest of each key and kind, as many as its kind may have."""
    most = OVER * max(BUDGET[k] for k in RANKED)
    return top_by(df, [*keys, "kind"], [F.desc("last_seen"), "ref"], most).where(F.col("rank") <= _limit(F.col("kind"))).drop("rank")


def _found_names(queries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """qid, kind and ref of the newest entities whose name holds one of a query's words, by an index of the parts of names that are as long as some word."""
    words = queries.select("qid", "scope_key", F.explode("qc").alias("part"))
    lengths = sorted(r[0] for r in words.select(F.length("part")).distinct().collect() if r[0])  # a few numbers
    if not lengths:
        return artifacts.select(F.lit(None).cast("string").alias("qid"), "kind", "ref", "last_seen").limit(0)
    names = artifacts.where("kind = 'entity'").select("scope_key", "kind", "ref", "last_seen", rules.folded(F.col("name")).alias("low"))
    parts = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low") - n + 1)), lambda i: F.substr("low", i, n)))))
    asked_for = settled(words.select("scope_key", "part").distinct())
    # what no query asks for is left out before anything is sorted
    index = names.select("scope_key", "kind", "ref", "last_seen", F.explode(parts).alias("part")).join(asked_for, ["scope_key", "part"], "left_semi")
    postings = top_by(index, ["scope_key", "part"], [F.desc("last_seen"), "ref"], OVER * BUDGET["entity"]).drop("rank")
    found = words.join(postings, ["scope_key", "part"]).select("qid", "kind", "ref", "last_seen").distinct()
    return top_by(found, ["qid"], [F.desc("last_seen"), "ref"], OVER * BUDGET["entity"]).drop("rank")


def _rarest(words: DataFrame, n: DataFrame) -> DataFrame:
    """ask, scope_key and the word of fewest rows (n by scope_key and word) of each ask; asks with a word that no row holds have none."""
    rarest = words.join(n, ["scope_key", "word"], "left").groupBy("ask", "scope_key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
    return rarest.where("r.n > 0").select("ask", "scope_key", F.col("r.word").alias("word"))


def _by_rarest(asks: DataFrame, held: DataFrame) -> DataFrame:
    """ask, ref: rows (scope_key, word, ref) that hold the rarest word of each ask (ask, scope_key, words); asks with a word that none holds have none."""
    words = asks.select("ask", "scope_key", F.explode("words").alias("word"))
    wanted = held.join(words.select("scope_key", "word").distinct(), ["scope_key", "word"], "left_semi")
    rarest = _rarest(words, wanted.groupBy("scope_key", "word").agg(F.count("*").alias("n")))
    return rarest.join(wanted, ["scope_key", "word"]).select("ask", "ref")


def _found_relations(queries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """qid, kind and ref of the newest relations, of the asked type, whose sides hold all that is sought."""
    c = F.col
    asks = queries.where(c("relations") & (F.size("sought") > 0)).select("qid", "scope_key", "asked_kind", F.array_sort("sought").alias("words"))
    each = asks.select("scope_key", "asked_kind", "words").distinct().withColumn("ask", F.xxhash64("scope_key", "asked_kind", "words"))
    lengths = sorted(r[0] for r in each.select(F.explode("words").alias("w")).select(F.length("w")).distinct().collect())
    if not lengths:
        return artifacts.select(F.lit(None).cast("string").alias("qid"), "kind", "ref", "last_seen").limit(0)
    edges = artifacts.where("kind = 'relation'").select("scope_key", "kind", "ref", "last_seen", "predicate", rules.folded(c("name")).alias("src"), rules.folded(c("object")).alias("dst"))
    part = lambda side: F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(side) - n + 1)), lambda i: F.substr(side, i, n))))
    held = edges.select("scope_key", "ref", F.explode(F.array_union(part("src"), part("dst"))).alias("word"))
    met = _by_rarest(each, held).join(each, "ask").join(edges, ["scope_key", "ref"])
    met = met.where(F.forall("words", lambda w: F.contains("src", w) | F.contains("dst", w)) & (c("asked_kind").isNull() | (c("predicate") == c("asked_kind"))))
    best = top_by(met, ["ask"], [F.desc("last_seen"), "ref"], OVER * BUDGET["relation"]).select("ask", "kind", "ref", "last_seen")
    return asks.withColumn("ask", F.xxhash64("scope_key", "asked_kind", "words")).join(best, "ask").select("qid", "kind", "ref", "last_seen")


def _candidates(queries: DataFrame, m: Stored) -> DataFrame:
    """qid, kind, ref, own (of the preferred session), rank of newness (from 0) and n: the merged candidates of each query."""
    c = F.col
    slim = m.artifacts.select("scope_key", "kind", "ref", "last_seen")
    newest = _first(slim, ["scope_key"])
    keyed = queries.select("qid", "scope_key", "session", "preferred", "intent")
    by_scope = keyed.join(newest, "scope_key").select("qid", "kind", "ref", "last_seen", F.lit(2).alias("place"))
    in_session = m.support.join(queries.where(c("preferred").isNotNull()).select("scope_key", c("preferred").alias("session_id")).distinct(), ["scope_key", "session_id"], "left_semi").distinct().join(slim, ["scope_key", "kind", "ref"])
    own = keyed.join(_first(in_session, ["scope_key", "session_id"]), (keyed["scope_key"] == in_session["scope_key"]) & (keyed["preferred"] == in_session["session_id"])).select("qid", "kind", "ref", "last_seen", F.lit(0).alias("place"))
    found = _found_names(queries, m.artifacts).unionByName(_found_relations(queries, m.artifacts)).select("qid", "kind", "ref", "last_seen", F.lit(1).alias("place"))
    every = by_scope.unionByName(own).unionByName(found).groupBy("qid", "kind", "ref").agg(F.max("last_seen").alias("last_seen"), F.min("place").alias("place"))
    every = every.join(queries.select("qid", ((c("intent") == "this_session") & c("preferred").isNotNull()).alias("narrow")), "qid")
    w = Window.partitionBy("qid", "kind")
    every = every.withColumn("some", F.bool_or(c("place") == 0).over(w))
    # asked of this session, claims and relations come from it alone, episodes too if it has any
    alone = c("narrow") & (c("kind").isin("claim", "relation") | ((c("kind") == "episode") & c("some")))
    kept = every.where(~alone | (c("place") == 0))
    most = F.when(c("narrow") & (c("kind") == "relation"), BUDGET["relation"]).otherwise(_limit(c("kind")))
    kept = kept.withColumn("at", F.row_number().over(w.orderBy("place", F.desc("last_seen"), "ref"))).where(c("at") <= most)
    return kept.select("qid", "kind", "ref", (c("place") == 0).alias("own"), (F.row_number().over(w.orderBy(F.desc("last_seen"), "ref")) - 1).alias("age"), F.count("*").over(w).alias("n"))


def _share(words: str, held: str) -> Column:
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, held)) / F.size(words))


def _when(test: Column, value: float) -> Column:
    return F.when(test, value).otherwise(0.0)


def ranked(queries: DataFrame, m: Stored) -> DataFrame:
    """Shown artifacts of each query with their score, kind by kind: qid, kind, ref, score."""
    c = F.col
    rows = settled(_candidates(queries, m)).join(queries.drop("preferred", "session"), "qid")
    known = settled(m.described(settled(rows.select("scope_key", "kind", "ref").distinct()))) if m.described else m.artifacts
    rows = rows.join(known.drop("last_seen"), ["scope_key", "kind", "ref"])
    said = F.when(c("kind") == "relation", F.concat_ws(" ", "name", F.replace("predicate", F.lit("_"), F.lit(" ")), "object")).when(c("kind") == "claim", c("canonical")).otherwise(c("name"))
    rows = rows.withColumn("said", said).withColumn("tw", text.token_set(c("said")))
    rows = rows.withColumns({"lex": _share("qw", "tw"), "con": _share("qc", "tw")}).withColumn("topical", text.topical(c("con"), c("lex"), F.size("qc") > 0))
    match = F.when(c("asked_kind").isNotNull() & (c("kind") == "relation"), F.when(F.lower("predicate") == c("asked_kind"), rules.target_match(c("object"), c("asked_target"))).otherwise(0.0))
    rows = rows.withColumn("match", match)
    archive, recent, live = c("mode") == "archive", c("intent") == "recent", c("mode") == "default"
    remembered = F.coalesce("remember", F.lit("candidate"))
    passes = F.when(archive, True).otherwise(ranking.admitted(c("remember"), c("activation")))
    modifier = F.when(archive, ranking.editorial_modifier(c("remember"), c("activation"), c("weight"), c("state_pinned"), "archive")).otherwise(ranking.editorial_modifier(c("remember"), c("activation"), c("weight"), c("state_pinned")))
    bonus = lambda most: ranking.rank_bonus(c("age"), c("n"), most)
    by = lambda test, a, b: F.when(test, a).otherwise(b)
    base = ranking.base_score
    few = (c("evidence") < 2) & ~c("pinned")
    asks = rules.asks(c("canonical"))
    # claims
    identity = F.when(F.lower("predicate").isin("has name", "asserts") & F.lower("canonical").rlike("name|live"), 0.45).when(F.lower("canonical").startswith("operator has "), 0.35).otherwise(0.0)
    focus = F.when(remembered == "remembered", 0.75).when(remembered == "candidate", -0.1).otherwise(0.0) + _when(c("activation") == "active", 0.15) + _when(c("pinned"), 0.15) + F.least(F.lit(0.35), c("topical") * 0.7)
    claim_shown = passes & ~(live & (asks | ((c("evidence") < 2) & (c("confidence") < 0.85) & (F.length("canonical") > 90)))) & ~(recent & ~c("own") & few) & ~(c("claims") & live & ~c("own") & ~c("pinned") & (c("topical") < LEAST_TOPICAL))
    claim = base(c("lex"), c("evidence") / 3, c("confidence")) + modifier + _when(c("own"), 1.0) + by(recent, bonus(0.35), bonus(0.2)) + F.when(archive, 0.0).otherwise(_when(few, -0.35) + _when(asks, -0.9)) + F.when(c("intent") == "identity", identity).otherwise(0.0) + F.when(c("claims"), focus).otherwise(0.0)
    # episodes
    suppressed = (remembered == "candidate") & (F.coalesce("activation", F.lit("suppressed")) == "suppressed")
    relaxed = live & recent & suppressed & (c("evidence") >= 1) & (c("confidence") >= 0.9)
    generic = F.lower("name").isin(*rules.GENERIC_TITLES) & ~c("own")
    episode = base(c("lex"), c("confidence"), c("confidence")) + modifier + _when(c("own"), 1.0) + by(recent, bonus(0.8), bonus(0.2)) + _when(c("evidence") < 2, -0.25) + _when(generic & (c("evidence") < 2), -0.45) + _when(generic & recent, -0.35)
    # entities
    entity_penalty = F.when(archive, 0.0).otherwise(_when(rules.low_signal_name(c("name")), -1.0) + _when((c("evidence") <= 1) & c("claims"), -0.25) + _when((c("evidence") <= 1) & recent, -0.15))
    entity_shown = ~(live & (entity_penalty <= WORST_ENTITY)) & ~(c("claims") & live & (c("topical") < LEAST_TOPICAL)) & ~(c("relations") & live)
    entity = c("topical") + _when(c("own"), 0.5) + F.least(F.lit(0.6), c("evidence") / 25) + bonus(0.2) + entity_penalty
    # relations
    met = F.greatest(c("topical"), F.coalesce("match", F.lit(0.0)))
    let_in = live & c("relations") & (F.lower("predicate") != "related_to") & suppressed & (met >= 0.2) & (c("confidence") >= 0.65)
    relation_shown = (let_in | passes) & ~(c("relations") & (c("match") <= 0.0)) & ~(c("relations") & (met < LEAST_TOPICAL))
    relation_shown = F.when(c("match").isNull(), (let_in | passes) & ~(c("relations") & (met < LEAST_TOPICAL))).otherwise(relation_shown)
    relation_penalty = F.when(archive, 0.0).otherwise(_when(F.lower("predicate") == "related_to", -1.25) + _when((c("evidence") <= 1) & (remembered != "remembered"), -0.25) + _when(c("confidence") < 0.7, -0.1))
    shape = F.when(c("match").isNull(), 0.0).otherwise(F.lit(0.45) + by(c("match") >= 0.5, 0.85, 0.35))
    relation = base(c("lex"), c("confidence"), c("confidence")) + modifier + _when(c("own"), 0.7) + bonus(0.2) + relation_penalty + _when(c("relations") & (c("topical") > 0), 0.6) + shape
    pick = lambda **of: F.when(c("kind") == "claim", of["claim"]).when(c("kind") == "episode", of["episode"]).when(c("kind") == "entity", of["entity"]).otherwise(of["relation"])
    shown = rows.where(pick(claim=claim_shown, episode=relaxed | passes, entity=entity_shown, relation=relation_shown))
    return shown.select("qid", "kind", "ref", text.rounded(pick(claim=claim, episode=episode, entity=entity, relation=relation)).alias("score"), "mode", "claims", "relations", "proof")


def _search_text() -> Column:
    return F.concat_ws(" ", *(rules.or_null(F.col(n)) for n in ("p_raw", "raw_text", "normalized_text")))


def events_for(queries: DataFrame, m: Stored) -> DataFrame:
    """qid, ref, score and raw_text of the events that may be shown, the filters of a query's focus kept only where they leave some."""
    c = F.col
    most = OVER_EVENTS * BUDGET["event"]
    e = m.events.withColumn("st", _search_text())
    slim = e.select("scope_key", "session_id", "ref", "ts")
    recent, live = c("intent") == "recent", c("mode") == "default"
    # all words of the query in the event: first arrivals
    asks = queries.where(~recent & (F.size("qw") > 0)).select("qid", "scope_key", F.array_sort("qw").alias("words"))
    each = settled(asks.select("scope_key", "words").distinct().withColumn("ask", F.xxhash64("scope_key", "words")))
    told = settled(e.where("st <> ''").select("scope_key", "ref", "ts", "arrival", text.token_set(c("st")).alias("tw")))
    words = each.select("ask", "scope_key", F.explode("words").alias("word"))
    wanted = settled(words.select("scope_key", "word").distinct())
    n = told.select("scope_key", F.explode("tw").alias("word")).join(wanted, ["scope_key", "word"], "left_semi").groupBy("scope_key", "word").agg(F.count("*").alias("n"))
    # each event meets the asks whose rarest word it holds, and no event is sent anywhere before it is found to hold the others
    rarest = settled(_rarest(words, n).join(each.select("ask", "words"), "ask").select("ask", "scope_key", "word", "words"))
    held = told.select("scope_key", "ref", "ts", "arrival", "tw", F.explode("tw").alias("word"))
    met = held.join(rarest, ["scope_key", "word"]).where(F.size(F.array_except("words", "tw")) == 0).select("ask", "ref", "ts", "arrival")
    first = top_by(met, ["ask"], ["arrival", "ref"], most).select("ask", "ref", "ts")
    found = settled(asks.withColumn("ask", F.xxhash64("scope_key", "words")).join(first, "ask").select("qid", "ref", "ts", F.lit(1).alias("place")))
    newest = top_by(slim, ["scope_key"], [F.desc("ts"), "ref"], most).select("scope_key", "ref", "ts")
    keyed = queries.select("qid", "scope_key", "preferred")
    fallback = keyed.join(found.select("qid").distinct(), "qid", "left_anti").join(newest, "scope_key").select("qid", "ref", "ts", F.lit(1).alias("place"))
    chosen = queries.where(c("preferred").isNotNull()).select("scope_key", c("preferred").alias("session_id")).distinct()
    lately = top_by(slim.join(chosen, ["scope_key", "session_id"], "left_semi"), ["scope_key", "session_id"], [F.desc("ts"), "ref"], most).drop("rank")
    own = keyed.join(lately, (keyed["scope_key"] == lately["scope_key"]) & (keyed["preferred"] == lately["session_id"])).select("qid", "ref", "ts", F.lit(0).alias("place"))
    every = found.unionByName(fallback).unionByName(own).groupBy("qid", "ref").agg(F.max("ts").alias("ts"), F.min("place").alias("place")).join(queries, "qid")
    w = Window.partitionBy("qid")
    alone = (c("intent") == "this_session") & c("preferred").isNotNull() & live & F.bool_or(c("place") == 0).over(w)
    every = every.withColumn("alone", alone).where(~c("alone") | (c("place") == 0))
    every = settled(every.withColumn("at", F.row_number().over(w.orderBy("place", F.desc("ts"), "ref"))).where(c("at") <= most))
    kinds = m.sessions.select("scope_key", "session_id", c("kind").alias("session_kind"))
    shown = e.join(settled(every.select("scope_key", "ref").distinct()), ["scope_key", "ref"], "left_semi")
    rows = every.drop("ts").join(shown.withColumn("tw", text.token_set(c("st"))), ["scope_key", "ref"]).join(kinds, ["scope_key", "session_id"], "left")
    rows = rows.withColumns({"lex": _share("qw", "tw"), "con": _share("qc", "tw")}).withColumn("topical", text.topical(c("con"), c("lex"), F.size("qc") > 0))
    names = F.arrays_overlap("tw", F.array(F.lit("name"), F.lit("live")))
    project = rules.has_any(F.lower("st"), rules.PROJECT_EVENT_MARKERS)
    filters = ((recent, F.coalesce(c("session_kind") != "import", F.lit(True))), (c("claims"), c("topical") >= LEAST_TOPICAL), (c("intent") == "identity", (c("con") > 0) | names), (c("intent") == "project", project))
    for asks_it, keeps in filters:
        rows = _keep_if_any(rows.withColumn("_keeps", keeps), asks_it & live)
    rows = rows.withColumn("age", F.row_number().over(w.orderBy(F.desc("ts"), "ref")) - 1).withColumn("n", F.count("*").over(w))
    bonus = lambda most_: ranking.rank_bonus(c("age"), c("n"), most_)
    own_text = rules.folded(c("raw_text"))
    low = lambda n: F.lower(F.trim(F.coalesce(n, F.lit(""))))
    retold = rules.starts_with_any(own_text, ("the user is ", "you are asking ", "the operator is ", "the operator wants ", "the operator may be "))
    imported = c("session_kind") == "import"
    penalty = (
        F.when((low("route_domain") == "mcp") & (low("route_action") == "observe"), -1.1).when(low("route_domain") == "session_mode", -0.5).otherwise(0.0) + _when(own_text.isin(*rules.LOW_SIGNAL_EVENTS), -0.6)
        + _when((rules.compact(c("p_raw")) != "") & (rules.compact(c("p_raw")) != rules.compact(c("raw_text"))) & retold, -0.55) + _when(F.size(text.tokens(own_text)) <= 2, -0.35)
        + _when(imported, -0.35) + _when(imported & recent, -0.8) + _when(imported & (c("intent") == "this_session"), -1.25)
    )
    score = ranking.base_score(c("lex"), c("importance"), c("confidence")) + _when(c("preferred").isNotNull() & (c("session_id") == c("preferred")), 1.0) + F.when(recent, bonus(0.9)).otherwise(bonus(0.25)) + F.when(c("mode") == "archive", 0.0).otherwise(penalty) + _when((c("intent") == "project") & project, 0.7)
    return rows.select("qid", "ref", text.rounded(score).alias("score"), own_text.alias("said"))


def _keep_if_any(rows: DataFrame, asks: Column) -> DataFrame:
    """Rows of a query that asks for a filter (column _keeps), less those it doesn't keep, unless it would keep none."""
    some = F.bool_or(F.coalesce("_keeps", F.lit(False))).over(Window.partitionBy("qid"))
    return rows.withColumn("_some", some).where(~asks | F.coalesce("_keeps", F.lit(False)) | ~F.col("_some")).drop("_keeps", "_some")


def bundles(queries: DataFrame, m: Stored) -> DataFrame:
    """qid, kind, ref, score and place (within the kind) of what answers each of queries (qid, scope_key, query).

    The archive's mode halves the budgets of what is derived. A question for a claim that has one shows no graph, episodes
    or events unless evidence is asked for. Events of one text are shown once. Scopes never mix; a query of an unknown
    scope has no rows. Ties go by ref. Queries of one qid are one query's wordings and should be told apart.
    """
    c = F.col
    q = settled(asked(queries).join(preferred_sessions(m.sessions), "scope_key", "left").withColumn("preferred", F.when(c("session"), c("preferred"))))
    budget = F.lit(0)
    for kind, k in BUDGET.items():
        budget = F.when((c("kind") == kind) & (c("mode") == "archive"), max(1, k // 2)).when(c("kind") == kind, k).otherwise(budget)
    r = top_by(settled(ranked(q, m)), ["qid", "kind"], [F.desc("score"), "ref"], max(BUDGET.values()), "place").where(c("place") <= budget)
    answered = F.bool_or(c("kind") == "claim").over(Window.partitionBy("qid"))
    r = r.withColumn("quiet", answered & c("claims") & ~c("relations") & (c("mode") == "default") & ~c("proof"))
    hushed = r.where("quiet").select("qid").distinct()
    derived = r.where(~c("quiet") | (c("kind") == "claim")).select("qid", "kind", "ref", "score", "place")
    said = events_for(q.join(hushed, "qid", "left_anti"), m)
    once = said.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "said").orderBy(F.desc("score"), "ref"))).where((c("_n") == 1) | (c("said") == ""))
    events = top_by(once, ["qid"], [F.desc("score"), "ref"], BUDGET["event"], "place").select("qid", F.lit("event").alias("kind"), "ref", "score", "place")
    leases = top_by(m.leases, ["scope_key"], [F.desc("refreshed_at"), "ref"], BUDGET["lease"], "place")
    states = q.select("qid", "scope_key").join(leases, "scope_key").select("qid", F.lit("lease").alias("kind"), "ref", F.lit(None).cast("double").alias("score"), "place")
    return derived.unionByName(events).unionByName(states)
