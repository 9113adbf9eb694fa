"""The review of claims, relations and episodes: evidence in one pass, factors and scores, one cascade of rules, states and stamps.

What supports an artifact is added up event by event, so no artifact's events are ever held together: a text counts as
whether it is a command, a question, holds the title, or is the same as all others; its trading words as a set within a
fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import ranking, rules, text, trading
from annalist.functions.policy import Policy

KINDS = ("claim", "relation", "episode")
#: Fields of a supporting event; those that are missing count as null.
EVENT = {
    "event_id": "string", "ts": "timestamp", "event_kind": "string", "raw_text": "string", "importance": "double", "route_domain": "string", "route_action": "string", "source_app": "string",
    "claim_signal": "string", "payload_claim": "boolean", "relation_hint": "boolean", "fact_eligible": "boolean", "submitted": "long", "failed": "long", "vetoes": "long", "approved": "boolean", "regime_shift": "boolean",
}


def _low(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def evidence(support: DataFrame) -> DataFrame:
    """One row for each artifact (scope_key, kind, ref) of support (with title, an episode's, and EVENT): what its events say together."""
    c = F.col
    have = set(support.columns)
    s = support.select("scope_key", "kind", "ref", F.coalesce(c("title"), F.lit("")).alias("title"), *((c(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in EVENT.items()))
    s = s.dropDuplicates(["scope_key", "kind", "ref", "event_id"])
    one = F.array(F.struct(_low("event_kind").alias("kind"), "route_domain", "route_action", "source_app", c("raw_text").alias("text"), "fact_eligible", "submitted", "failed", "vetoes", "approved", "regime_shift"))
    legacy = (_low("source_app") == "legacy_adapter") | F.endswith(_low("source_app"), F.lit("_legacy"))
    said, words = rules.folded(c("raw_text")), text.token_set(c("raw_text"))
    s = s.withColumns({"_one": one, "_said": F.when(said != "", said), "_words": words, "_legacy": legacy, "_title": F.array_distinct(text.tokens(rules.folded(c("title"))))})
    remembers = rules.explicit_memory(c("route_domain"), c("route_action"), c("claim_signal")) | ((_low("event_kind") == "note") & F.coalesce("payload_claim", F.lit(False)) & c("_legacy"))
    newest = F.struct("ts", "event_id")
    of_texts = lambda test: F.coalesce(F.bool_and(F.when(c("_said").isNotNull(), test)), F.lit(False))
    return s.groupBy("scope_key", "kind", "ref").agg(
        F.count("*").alias("events"), F.max_by(_low("event_kind"), newest).alias("primary"), F.max_by(remembers, newest).alias("primary_remembers"), F.max("ts").alias("newest_at"), F.max("importance").alias("importance"),
        F.bool_or(remembers).alias("remembers"), F.bool_or(F.coalesce("relation_hint", F.lit(False))).alias("hinted"), F.bool_and("_legacy").alias("imported"), F.bool_or(trading.routed(c("_one"))).alias("routed"), F.bool_or(trading.has_fact(c("_one"))).alias("fact"),
        F.array_distinct(F.flatten(F.collect_set(F.array_intersect("_words", F.array(*map(F.lit, trading.WORDS)))))).alias("trading_words"), F.bool_or(F.arrays_overlap("_words", F.array(*map(F.lit, trading.SYMBOLS)))).alias("symbol"),
        F.bool_or(trading.matters(c("title"), c("_one"))).alias("matters"), F.count("_said").alias("texts"), (F.min("_said") == F.max("_said")).alias("same"), of_texts(rules.first_token(c("_said")).isin(*rules.COMMANDS)).alias("commands"),
        of_texts(rules.review_asks(c("_said"))).alias("questions"), of_texts(F.forall("_title", lambda t: F.contains("_said", t))).alias("titled"),
    )


def low_quality(title: Column) -> Column:
    """Whether an episode says too little, by its title and what evidence() knows of its texts."""
    c = F.col
    low = rules.folded(title)
    words = text.tokens(low)
    n = F.size(words)
    signals = (n > 0) & F.forall(words, lambda w: w.isin(*rules.LOW_SIGNAL_TOKENS))
    again = c("texts") >= 2
    imported = c("imported") & ((n == 1) | signals | (again & c("same") & c("commands")) | ((n <= 2) & (c("events") < 3)))
    return (n == 0) | low.isin(*rules.GENERIC_TITLES) | ((n <= 2) & signals) | imported | (again & (n <= 3) & c("commands") & c("titled")) | (again & (n <= 2) & c("questions") & c("titled"))


def factors() -> dict[str, Column]:
    """The factors of a row with kind, name, predicate, canonical, pinned, evidence and what evidence() tells."""
    c = F.col
    pick = lambda claim, episode, relation: F.when(c("kind") == "claim", claim).when(c("kind") == "episode", episode).otherwise(relation)
    claim = c("kind") == "claim"
    explicit = c("pinned") | c("primary").isin(*ranking.EXPLICIT_KINDS) | (c("primary_remembers") & ~c("question"))
    repeated = (c("events") >= 2) | (claim & (c("evidence") >= 2))
    generic, weak = rules.folded(c("name")).isin(*rules.GENERIC_TITLES), c("weak")
    by = lambda a, b, other: F.when(explicit, a).when(repeated, b).otherwise(other)
    return {
        "consequence": F.when(explicit & c("pinned"), 1.0).when(explicit, 0.85).when(repeated, 0.65).otherwise(F.least(F.lit(0.25), c("importance") * 0.35)),
        "recurrence": F.when(c("events") >= 3, 1.0).when(c("events") == 2, 0.7).otherwise(0.0),
        "identity": pick(F.when(explicit, 0.9).when(c("question"), 0.15).when(repeated, 0.75).otherwise(0.2), F.when(generic, 0.1).otherwise(by(0.8, 0.7, 0.1)), F.when(weak, 0.15).otherwise(by(0.75, 0.65, 0.25))),
        "utility": pick(F.when(explicit, 0.95).when(c("question"), 0.1).when(repeated, 0.75).otherwise(0.15), F.when(generic, 0.1).otherwise(by(0.8, 0.7, 0.1)), F.when(weak, 0.1).otherwise(by(0.75, 0.55, 0.2))),
        "user_emphasis": F.when(c("pinned"), 1.0).when(explicit, 0.85).when(repeated, F.least(F.lit(0.75), c("importance"))).otherwise(F.least(F.lit(0.2), c("importance") * 0.2)),
    }


def cascade(policy: Policy) -> Column:
    """struct(action, locked, reason): the first rule that holds decides."""
    c = F.col
    claim, relation, episode = (c("kind") == k for k in KINDS)
    remembered = F.coalesce(c("current") == "remembered", F.lit(False))
    title = rules.folded(c("name"))
    spoken = c("primary").isin("decision", "failure")
    about = c("routed") | (F.size("claim_trading") >= 2) | ((F.size("claim_trading") > 0) & c("claim_symbol"))
    routine, profile, operation = title.isin(*trading.ROUTINES) & ~c("matters"), title.isin(*rules.PROFILE_TITLES), title.isin(*rules.ROUTINE_TITLES)
    loose = F.when(claim, c("question") | (~remembered & ~(c("pinned") | c("primary").isin(*ranking.EXPLICIT_KINDS) | c("remembers")) & (c("evidence") < 2) & (c("events") < 2)))
    loose = loose.when(episode, c("poor") | (~remembered & ~spoken & (c("events") < 2))).otherwise(~remembered & ~(c("hinted") | spoken) & (c("events") < 2))
    gone = lambda reason: (F.when(remembered, "retire").otherwise("leave_candidate"), True, reason)
    said = lambda action, locked, reason: F.struct((F.lit(action) if isinstance(action, str) else action).alias("action"), F.lit(locked).alias("locked"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    ladder = [
        (c("state_pinned"), ("pin", True, "current_pinned")), (claim & c("pinned"), ("pin", True, "artifact_pinned")), (claim & rules.speech_act(c("canonical")), ("retire", True, "speech_act_claim")),
        (claim & about & ~c("fact"), gone(F.when(remembered, "trading_claim_missing_ledger_evidence").otherwise("trading_claim_requires_ledger_evidence"))), (c("question") & remembered, ("retire", True, "remembered_question_claim")),
        (relation & c("weak"), gone("weak_related_to_relation")), (episode & remembered & c("poor"), ("retire", True, "low_quality_remembered_episode")), (episode & routine, gone("trading_routine_episode_requires_consolidation")),
        (episode & profile, gone("personal_profile_episode_requires_consolidation")), (episode & operation, gone("operational_routine_episode_requires_consolidation")), (loose, ("leave_candidate", True, "hold_as_candidate")),
        (remembered & (c("score") >= policy.reinforce), ("reinforce", False, "remembered_reinforce")), (remembered & (c("score") <= policy.retire), ("retire", False, "remembered_retire")), (remembered, ("fade", False, "remembered_fade")),
        (c("score") >= policy.promotion, ("promote", False, "promotion_threshold")),
    ]
    out = said("leave_candidate", False, "below_promotion_threshold")
    for test, row in reversed(ladder):
        out = F.when(F.coalesce(test, F.lit(False)), said(*row)).otherwise(out)
    return out


def decide(artifacts: DataFrame, support: DataFrame, states: DataFrame, policy: Policy | None = None) -> DataFrame:
    """A decision for each artifact that is due: scope_key, kind, ref, action, locked, reason, score, influence, factors, remember, activation, pinned and reviewed_at.

    artifacts: scope_key, kind (see KINDS), ref, name (an episode's title), predicate (a relation's type), canonical,
    pinned, evidence. states: scope_key, kind, ref, remember, state_pinned, of those reviewed before. Artifacts without
    a supporting event are judged by nothing and importance 0; rows of another kind are passed over. Each artifact is one
    row, whatever its events; repeated events count once.
    """
    c = F.col
    policy = policy or Policy()
    keys = ["scope_key", "kind", "ref"]
    titled = artifacts.where(c("kind").isin(*KINDS)).select(*keys, "name", "predicate", "canonical", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
    e = evidence(support.join(titled.select(*keys, c("name").alias("title")), keys))
    none = {"events": 0, "texts": 0, "importance": 0.0, **dict.fromkeys(("primary_remembers", "remembers", "hinted", "imported", "routed", "fact", "symbol", "matters", "same", "commands", "questions", "titled"), False)}
    rows = titled.join(e, keys, "left").join(states.select(*keys, c("remember").alias("current"), "state_pinned"), keys, "left")
    rows = rows.fillna(none).fillna({"state_pinned": False}).withColumn("primary", F.coalesce(F.nullif("primary", F.lit("")), "kind"))
    words = text.token_set(c("canonical"))
    listed = F.array(*map(F.lit, trading.WORDS))
    rows = rows.withColumns({
        "question": (c("kind") == "claim") & F.coalesce(rules.review_asks(c("canonical")), F.lit(False)), "weak": (c("kind") == "relation") & (F.lower(F.trim("predicate")) == "related_to"), "poor": (c("kind") == "episode") & low_quality(c("name")),
        "claim_trading": F.array_union(F.coalesce("trading_words", F.array().cast("array<string>")), F.array_intersect(words, listed)), "claim_symbol": c("symbol") | F.arrays_overlap(words, F.array(*map(F.lit, trading.SYMBOLS))),
    })
    rows = rows.withColumns(factors())
    rows = rows.withColumn("score", policy.score({k: c(k) for k in ranking.WEIGHTS}, c("primary"))).withColumn("d", cascade(policy))
    remember, activation = ranking.states_of(c("d.action"))
    influence = F.least(F.lit(1.0), c("score") + F.when(c("recurrence") > 0.5, 0.1).otherwise(0.0))
    return rows.select(*keys, "d.*", text.rounded(c("score")).alias("score"), text.rounded(influence).alias("influence"), F.struct(*ranking.WEIGHTS).alias("factors"), remember.alias("remember"), activation.alias("activation"), (c("pinned") | c("state_pinned")).alias("pinned"), c("newest_at").alias("reviewed_at"))


def stamps(decisions: DataFrame, at) -> DataFrame:
    """What a review at a time stamps on claims and relations: scope_key, kind, ref, last_reinforced_at, disputed_at, superseded_at and valid_until."""
    when = lambda *actions: F.when(F.col("action").isin(*actions), F.lit(at).cast("timestamp"))
    kept = decisions.where(F.col("kind").isin("claim", "relation"))
    return kept.select("scope_key", "kind", "ref", when("promote", "reinforce", "pin").alias("last_reinforced_at"), when("mark_disputed").alias("disputed_at"), when("mark_superseded").alias("superseded_at"), when("mark_superseded").alias("valid_until"))


def due(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue (scope_key, kind, ref) without what a review has decided."""
    return queue.join(decisions.select("scope_key", "kind", "ref"), ["scope_key", "kind", "ref"], "left_anti")
