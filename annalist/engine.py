"""The memory as a whole: an append-only archive of events, sessions, leases and decisions under a folder, all else derived from it.

Every tool reads the logs and returns a DataFrame; writing tools append. Times are given, never taken from the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions import derivation as dv
from annalist.functions import ranking, rules, text
from annalist.functions.policy import Policy
from annalist.operators import archive as ops
from annalist.operators import derive
from annalist.sources.archive import settled
from annalist.streaming.ingest import stored

EVENTS = "event_id string, scope string, session_id string, ts timestamp, kind string, raw_text string, importance double, confidence double, pinned boolean, idempotency_key string, arrival long"
SESSIONS = "session_id string, scope string, kind string, parent string, at timestamp, closes boolean"
LEASES = "scope string, lease_key string, value string, ttl long, ts timestamp, event_id string"
DECISIONS = "scope string, claim_id string, action string, score double, influence double, manual boolean, decided_at timestamp"


class Memory:
    def __init__(self, spark: SparkSession, path: str, policy: Policy | None = None):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy or Policy()

    def _log(self, name: str, schema: str, scope: str | None = None) -> DataFrame:
        log = stored(self.spark, f"{self.path}/{name}", self.spark.createDataFrame([], schema).schema)
        return log if scope is None else log.where(F.col("scope") == scope)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("scope").parquet(f"{self.path}/{name}")

    # sessions
    def open_session(self, session_id: str, scope: str, at, kind: str = "interaction", parent: str | None = None) -> None:
        self._append("sessions", self.spark.createDataFrame([(session_id, scope, kind, parent, at, False)], SESSIONS))

    def close_session(self, session_id: str, scope: str, at) -> None:
        self._append("sessions", self.spark.createDataFrame([(session_id, scope, None, None, at, True)], SESSIONS))

    def sessions(self, scope: str) -> DataFrame:
        opened, closed = (F.when(F.col("closes") == x, F.col("at")) for x in (False, True))
        return self._log("sessions", SESSIONS, scope).groupBy("session_id").agg(F.max("kind").alias("kind"), F.max("parent").alias("parent"), F.min(opened).alias("opened_at"), F.max(closed).alias("closed_at"))

    def preferred_session(self, scope: str) -> DataFrame:
        """The newest open interaction, else the newest by its closing or opening."""
        s = self.sessions(scope).where("kind = 'interaction'").withColumn("recency", F.coalesce("closed_at", "opened_at"))
        return s.orderBy(F.col("closed_at").isNotNull(), F.desc("recency"), "session_id").limit(1)

    # events and states
    def ingest_events(self, events: DataFrame) -> DataFrame:
        """Appends events whose idempotency key is new in their scope, the first arrival of each; offered, accepted and duplicates.

        An event without a key goes by its event_id; those with neither count as one.
        """
        named = {f.name: f.dataType for f in self.spark.createDataFrame([], EVENTS).schema}
        rows = events.select(*(F.col(c).cast(t) for c, t in named.items())).withColumn("idempotency_key", F.coalesce("idempotency_key", "event_id", F.lit("")))
        first = ops.first_by(rows, ["scope", "idempotency_key"], ["arrival", "event_id"])
        known = self._log("events", EVENTS).join(F.broadcast(rows.select("scope").distinct()), "scope", "left_semi").select("scope", F.coalesce("idempotency_key", "event_id", F.lit("")).alias("idempotency_key"))
        new = settled(first.join(known, ["scope", "idempotency_key"], "left_anti").select(*named))
        self._append("events", new)
        offered, accepted = rows.count(), new.count()
        return self.spark.createDataFrame([(offered, accepted, offered - accepted)], "offered long, accepted long, duplicates long")

    def events(self, scope: str) -> DataFrame:
        return self._log("events", EVENTS, scope)

    def get_events(self, scope: str, ids: DataFrame) -> DataFrame:
        """Events of some ids (event_id), newest first."""
        return self.events(scope).join(ids.select("event_id").distinct(), "event_id", "left_semi").orderBy(F.desc("ts"), "event_id")

    def upsert_state(self, scope: str, key: str, value: str, at, ttl: int = 3600) -> None:
        self._append("leases", self.spark.createDataFrame([(scope, key, value, ttl, at, "")], LEASES))

    def states(self, scope: str, as_of) -> DataFrame:
        """Leases that haven't ended, the newest refreshed first: latest value, first issue."""
        log = self._log("leases", LEASES, scope)
        g = log.groupBy("lease_key").agg(F.min("ts").alias("issued_at"), F.max("ts").alias("refreshed_at"), F.max_by("value", "ts").alias("value"), F.max_by("ttl", "ts").alias("ttl"))
        live = F.unix_micros("refreshed_at") + F.col("ttl") * 1_000_000 > F.unix_micros(F.lit(as_of).cast("timestamp"))
        return g.where(live).orderBy(F.desc("refreshed_at"), "lease_key")

    # derived
    def claims(self, scope: str) -> DataFrame:
        """claim_id, subject, predicate, object, canonical, evidence, confidence, pinned, kind (of the newest event), first and last seen."""
        e = self.events(scope).withColumn("text", F.col("raw_text"))
        facts = e.where("kind = 'fact_assertion'").withColumn("c", rules.memory_fact(dv.without_fillers(F.col("text")))).where("c is not null")
        facts = facts.select("event_id", "ts", "kind", "importance", F.greatest(F.lit(0.7), F.col("confidence")).alias("confidence"), "pinned", "c.subject", "c.predicate", "c.object")
        said = derive.derive_claims(e.where(F.col("kind").isin("message", "decision", "summary", "note"))).select("event_id", "ts", "kind", "importance", "confidence", "pinned", "subject", "predicate", "object")
        every = facts.unionByName(said)
        keys = [rules.folded(F.col(c)).alias(f"k_{c}") for c in ("subject", "predicate", "object")]
        g = every.select("*", *keys).groupBy("k_subject", "k_predicate", "k_object").agg(
            *(F.min_by(c, "ts").alias(c) for c in ("subject", "predicate", "object")), F.count_distinct("event_id").alias("evidence"), F.max("confidence").alias("confidence"), F.max("importance").alias("importance"),
            F.bool_or("pinned").alias("pinned"), F.max_by("kind", "ts").alias("kind"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        )
        ids = F.concat(F.lit("clm_"), F.left(F.sha2(F.concat_ws("|", F.lit(scope), "k_subject", "k_predicate", "k_object"), 256), F.lit(16)))
        return g.select(ids.alias("claim_id"), "*", F.concat_ws(" ", "subject", "predicate", "object").alias("canonical")).drop("k_subject", "k_predicate", "k_object")

    def editorial(self, scope: str) -> DataFrame:
        """The state of each claim that was decided on: its latest decision; a manual pin stays."""
        log = self._log("decisions", DECISIONS, scope)
        latest = lambda c: F.max_by(c, "decided_at").alias(c)
        s = log.groupBy("claim_id").agg(latest("action"), latest("score"), latest("influence"), F.bool_or((F.col("action") == "pin")).alias("state_pinned"), F.max("decided_at").alias("decided_at"))
        remember, activation = ranking.states_of(F.col("action"))
        return s.withColumn("remember", remember).withColumn("activation", activation)

    def review_queue(self, scope: str) -> DataFrame:
        """Claims never decided on or seen anew since, the most important first."""
        c = self.claims(scope).join(self.editorial(scope).select("claim_id", "decided_at"), "claim_id", "left")
        return c.where("decided_at is null or last_seen > decided_at").select("claim_id", "canonical", F.col("importance").alias("priority"), F.col("first_seen").alias("created_at")).orderBy(F.desc("priority"), "created_at", "claim_id")

    def review(self, scope: str, at) -> DataFrame:
        """Decides on the queue by the policy, appends the decisions and returns them."""
        c = self.claims(scope).join(self.review_queue(scope).select("claim_id"), "claim_id", "left_semi").join(self.editorial(scope).select("claim_id", "remember", "state_pinned"), "claim_id", "left")
        pinned = F.col("pinned") | F.coalesce("state_pinned", F.lit(False))
        question = rules.review_asks(F.col("canonical"))
        f = c.withColumns(ranking.claim_factors(pinned, F.col("kind").isin(*ranking.EXPLICIT_KINDS), question, F.col("evidence"), F.col("importance")))
        f = f.withColumn("score", self.policy.score({k: F.col(k) for k in ranking.WEIGHTS}, F.col("kind")))
        action = ranking.claim_action(pinned, F.col("kind"), question, F.col("evidence"), F.coalesce(F.col("remember") == "remembered", F.lit(False)), F.col("score"))
        influence = F.least(F.lit(1.0), F.col("score") + F.when(F.col("recurrence") > 0.5, 0.1).otherwise(0.0))
        made = f.select(F.lit(scope).alias("scope"), "claim_id", action.alias("action"), "score", influence.alias("influence"), F.lit(False).alias("manual"), F.lit(at).cast("timestamp").alias("decided_at"))
        self._append("decisions", made)
        return self.decisions(scope).where(F.col("decided_at") == F.lit(at).cast("timestamp"))

    def apply_decision(self, scope: str, claim_id: str, action: str, at) -> None:
        """A decision by hand: it has no score and stamps nothing."""
        if action not in ranking.ACTION_STATES:
            raise ValueError(f"no such action: {action}")
        self._append("decisions", self.spark.createDataFrame([(scope, claim_id, action, 0.0, 0.0, True, at)], DECISIONS))

    def decisions(self, scope: str, claim_id: str | None = None) -> DataFrame:
        log = self._log("decisions", DECISIONS, scope)
        return (log if claim_id is None else log.where(F.col("claim_id") == claim_id)).orderBy(F.desc("decided_at"), "claim_id")

    # recall
    def recall(self, scope: str, query: str, mode: str = "default", limit: int = 5) -> DataFrame:
        """The claims that answer a query best, with what is known of them and why they are shown."""
        q = self.spark.range(1).select(F.lit(query).alias("query"))
        asked = q.select("query", text.token_set(F.col("query")).alias("qw"), text.content_set(F.col("query")).alias("qc"), rules.intent(F.col("query")).alias("intent"), rules.claim_focus(F.col("query")).alias("claim_focused"))
        mode_ = F.when(F.col("intent").isin("archive", "archaeology"), "archive").otherwise(mode)
        c = self.claims(scope).join(self.editorial(scope).drop("decided_at", "action"), "claim_id", "left").join(F.broadcast(asked)).withColumn("ct", text.token_set(F.col("canonical")))
        share = lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(F.col(w), F.col("ct"))) / F.size(w))
        c = c.withColumn("lex", share("qw")).withColumn("topical", text.topical(share("qc"), share("qw"), F.size("qc") > 0)).withColumn("mode", mode_)
        weight, pinned = F.coalesce(F.col("score"), F.lit(0.0)) + F.coalesce("influence", F.lit(0.0)), F.coalesce("state_pinned", F.lit(False))
        by_mode = lambda f: F.when(F.col("mode") == "archive", f("archive")).when(F.col("mode") == "deep", f("deep")).otherwise(f("default"))
        few = (F.col("evidence") < 2) & ~F.col("pinned")
        penalty = F.when(F.col("mode") == "archive", 0.0).otherwise(F.when(few, -0.35).otherwise(0.0) + F.when(rules.asks(F.col("canonical")), -0.9).otherwise(0.0))
        focus = F.when(~F.col("claim_focused"), 0.0).otherwise(F.when(F.col("remember") == "remembered", 0.75).otherwise(-0.1) + F.when(F.col("activation") == "active", 0.15).otherwise(0.0) + F.least(F.lit(0.35), F.col("topical") * 0.7))
        total = ranking.base_score(F.col("lex"), F.col("evidence") / 3, F.col("confidence")) + by_mode(lambda m: ranking.editorial_modifier(F.col("remember"), F.col("activation"), weight, pinned, m)) + penalty + focus
        off_topic = F.col("claim_focused") & (F.col("mode") == "default") & ~F.col("pinned") & (F.col("topical") < 0.15)
        shown = c.where(~off_topic).where(by_mode(lambda m: ranking.admitted(F.col("remember"), F.col("activation"), m)))
        why = F.concat_ws(", ", F.coalesce("remember", F.lit("unreviewed")), F.concat(F.col("evidence").cast("string"), F.lit(" events")), F.when(pinned, "pinned"))
        return shown.select("claim_id", "canonical", text.rounded(total).alias("score"), "remember", "evidence", why.alias("why")).orderBy(F.desc("score"), "claim_id").limit(max(1, limit))

    def explain(self, scope: str, claim_id: str) -> DataFrame:
        """A claim with its state and its decisions, newest first; no row if there is none."""
        log = self.decisions(scope, claim_id).groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("decided_at", "action", "score", "manual")), asc=False).alias("decisions"))
        c = self.claims(scope).where(F.col("claim_id") == claim_id)
        return c.join(self.editorial(scope).select("claim_id", "remember", "activation"), "claim_id", "left").join(log, "claim_id", "left")

    def timeline(self, scope: str, name: str | None = None, limit: int = 16) -> DataFrame:
        """Events in order of time, those that name an entity if one is given."""
        e = self.events(scope)
        named: Column = F.lit(True) if name is None else F.contains(rules.folded(F.col("raw_text")), rules.folded(F.lit(name)))
        return e.where(named).orderBy("ts", "event_id").limit(max(1, limit))

    def patterns(self, scope: str, limit: int = 12) -> DataFrame:
        """Claims that came on two days or in two sessions at least, with a blended confidence."""
        e = self.events(scope).select("event_id", "session_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), rules.folded(F.col("raw_text")).alias("said"), "importance").where("said != ''")
        g = e.groupBy("said").agg(F.count("*").alias("support"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("day").alias("days"), F.max("importance").alias("source"))
        one = F.lit(1.0)
        spread = F.greatest("sessions", "days")
        blend = F.lit(0.4) * F.least(one, F.col("source")) + F.lit(0.35) * F.least(one, spread / F.col("support")) + F.lit(0.25) * F.least(one, F.col("support") / 5)
        ranked = g.where("sessions >= 2 or days >= 2").withColumn("confidence", text.rounded(blend))
        order = [F.desc("confidence"), F.desc("said")]
        return ranked.orderBy(*order).limit(max(1, limit)).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over as many rows as are asked for


#: The tools by name, for a host that dispatches calls.
TOOLS = ("open_session", "close_session", "ingest_events", "get_events", "upsert_state", "states", "claims", "review_queue", "review", "apply_decision", "decisions", "recall", "explain", "timeline", "patterns")
