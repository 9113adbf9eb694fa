"""All artifacts of an event in one pass, and their upsert into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import derivation as dv
from annalist.functions import rules
from annalist.operators.episodes import DOMINANT
from annalist.sources.archive import settled

#: The fields of an artifact. name: a lease's key, an entity, a relation's or claim's subject, an episode's title, or the kind of what is queued.
ARTIFACT = {
    "artifact": "string", "name": "string", "predicate": "string", "object": "string", "canonical": "string", "confidence": "double", "pinned": "boolean",
    "trigger": "string", "priority": "double", "ttl": "long",
}
CLAIM_KINDS = ("message", "decision", "summary", "note", "fact_assertion", "tool_result")
#: The least confidence of a message and of a tool's result that states a claim, and the priorities of what is queued.
LEAST_CONFIDENCE = {"message": dv.MESSAGE_CONFIDENCE, "tool_result": 0.7}
#: Lists of hints that are sent to all tasks at most, with the names in them.
MOST_LISTS = 100_000
LEAST_FACT_CONFIDENCE, RELATION_PRIORITY, EPISODE_PRIORITY = 0.7, 0.35, 0.3


def _row(artifact: str, **fields: Column) -> Column:
    return F.struct(*((F.lit(artifact) if name == "artifact" else fields.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in ARTIFACT.items()))


def _none() -> Column:
    return F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in ARTIFACT.items()) + ">>")


def staged(events: DataFrame) -> DataFrame:
    """Events (see payloads.events_of) with text, normal (its normalised form), names, relations and claims.

    A null or empty text gives none of them. Hinted entities are names if any is sound; a reaction that only its
    interpretation makes sense of has none. What several rules read is a column of its own, so that it is worked out once.
    """
    c = F.col
    hinted = F.size(F.coalesce("hint_entities", F.array().cast("array<string>"))) > 0
    texts = (c("raw_text"), c("normalized_text"), c("p_raw"), c("p_normalized"))
    spare = {"raw_text": "raw", "normalized_text": "normalized", "p_raw": "p_raw", "p_normalized": "p_normalized", "p_interpreted": "p_interpreted", "observation": "observation"}
    e = events.withColumns({f"_{short}": dv.compact(c(name)) for name, short in spare.items()})
    texts = tuple(c(f"_{n}") for n in ("raw", "normalized", "p_raw", "p_normalized"))
    e = e.withColumn("_reacts", rules.reacts(texts[0], texts[2], c("_p_interpreted"), c("kind"), hinted=hinted))
    e = e.withColumn("text", rules.derivation_text(c("kind"), *texts, c("_p_interpreted"), c("_observation"), reacted=c("_reacts")))
    e = e.withColumn("normal", rules.normalised_text(c("text"), *texts)).withColumn("_bare", dv.without_fillers(c("text")))
    e = e.withColumn("names", dv.phrases(F.when(~c("_reacts"), c("text")), c("hint_entities")))
    e = e.withColumn("_sides", F.when(dv.has_cue(c("normal")), dv.relation_sides(c("names"))))  # of no use without a cue
    e = e.withColumns({"_read": dv.relation(c("normal"), c("_sides")), "_fact": rules.memory_fact(c("_bare")), "_copula": dv.copula_claim(c("_bare")), "_first": F.get("names", F.lit(0)), "_low": F.transform("names", F.lower)})
    e = e.withColumn("_spoken", _spoken())
    e = e.withColumns({"relations": _relations(), "claims": _claims()})
    return e.drop(*(f"_{n}" for n in (*spare.values(), "reacts", "bare", "sides", "read", "fact", "copula", "first", "spoken")))


def _relations() -> Column:
    """Hinted relations of a known type, else the one that the text states; both sides must be names of the event."""
    typed = F.filter("hint_relations", lambda r: r["type"].isin(*dv.RELATION_TYPES))
    hinted = F.transform(typed, lambda r: F.struct(r["src"].alias("src"), r["dst"].alias("dst"), r["type"].alias("type"), F.coalesce(r["confidence"], F.lit(dv.HINT_CONFIDENCE)).alias("confidence")))
    read = F.array_compact(F.array("_read"))
    known = lambda r: F.array_contains("_low", F.lower(r["src"])) & F.array_contains("_low", F.lower(r["dst"]))
    return dv.let(hinted, lambda h: F.filter(F.when(F.coalesce(F.size(h), F.lit(0)) > 0, h).otherwise(read), known))


def _spoken() -> Column:
    """The claim of an event's own text: a fact as it is asserted, else what a sure statement says of its subject."""
    c = F.col

    def said(subject: Column, predicate: Column, what: Column, canonical: Column, confidence: Column, pinned: Column) -> Column:
        return F.struct(subject.alias("subject"), predicate.alias("predicate"), what.alias("object"), canonical.alias("canonical"), confidence.cast("double").alias("confidence"), pinned.alias("pinned"))

    text, fact, copula = c("_bare"), c("_fact"), c("_copula")
    sure, pinned = F.greatest(F.lit(LEAST_FACT_CONFIDENCE), c("confidence")), c("pin") | c("p_pin")
    of = lambda s: F.concat_ws(" ", s["subject"], s["predicate"], s["object"])
    asserted = said(c("_first"), F.lit("asserts"), text, F.regexp_replace(text, r"\.+$", ""), sure, pinned)
    stated = F.when(fact.isNotNull(), said(fact["subject"], fact["predicate"], fact["object"], of(fact), sure, pinned)).otherwise(asserted)
    asked = F.coalesce(rules.or_null(dv.without_fillers(c("_p_interpreted"))), rules.or_null(text), c("_raw"))
    quiet = F.when(c("kind") == "message", dv.asks(c("_raw"), asked) | F.contains(asked, F.lit("?")) | c("unclear")).otherwise(F.lit(False))
    least = reduce(lambda out, k: F.when(c("kind") == k, LEAST_CONFIDENCE[k]).otherwise(out), LEAST_CONFIDENCE, F.lit(0.0))
    one = F.when(c("kind") == "fact_assertion", stated).when(copula.isNotNull() & ~quiet & (c("confidence") >= least), said(copula["subject"], copula["predicate"], copula["object"], of(copula), c("confidence"), c("pin")))
    return F.when(c("kind").isin(*CLAIM_KINDS) & (text != ""), one)


def _claims() -> Column:
    """The payload's claims, the first name standing for a subject that isn't told; else the claim of the text."""
    c = F.col

    def named(x: Column) -> Column:
        told_claim = rules.profile_claim(F.coalesce(x["subject"], c("_first")), x["predicate"], x["object"], F.coalesce(x["canonical"], F.concat_ws(" ", x["predicate"], x["object"])))
        return dv.let(told_claim, lambda t: F.struct(*(t[n].alias(n) for n in ("subject", "predicate", "object", "canonical")), F.coalesce(x["confidence"], c("confidence")).alias("confidence"), (x["pinned"] | c("pin")).alias("pinned")))

    return F.when(F.size("told_claims") > 0, F.transform("told_claims", named)).otherwise(F.array_compact(F.array("_spoken")))


def titled(events: DataFrame) -> DataFrame:
    """staged() with the title of each event's episode; one who reads the titles alone has no relations and claims worked out."""
    c = F.col
    return staged(events).withColumn("title", rules.episode_title(c("episode_hint"), F.get(c("names"), F.lit(0)), c("text"), c("kind")))


def dominant(names: Column) -> Column:
    """The first names of an event, which stand for its episode, in one text."""
    return F.array_join(F.slice(names, 1, DOMINANT), ", ")


def artifacts_of(events: DataFrame, queue: bool = True) -> DataFrame:
    """A row for each artifact of each event, with event_id, scope_key, session_id, ts and arrival: leases, entities, relations, claims, episodes and, unless left out, what is queued for review.

    An event is read once and gives all of its rows by one explode; nothing is shuffled. A claim's subject that is no
    name of the event is an entity too. Only events of a session have an episode. A pinned claim is remembered at once
    and not queued. Repeated events give their rows again, for the upsert to count once by event_id.
    """
    c = F.col
    fresh = F.filter(F.array_distinct(F.transform("claims", lambda x: x["subject"])), lambda s: s.isNotNull() & ~F.array_contains("_low", F.lower(s)))
    queued = lambda kind, what, trigger, priority: _row("queue", name=F.lit(kind), canonical=what, trigger=F.lit(trigger), priority=priority)
    edge = lambda r: F.concat_ws(" ", r["src"], r["type"], r["dst"])
    parts = [
        _lease(), _mentions(),
        F.transform(c("fresh"), lambda n: _row("entity", name=n, canonical=n, predicate=F.lit("subject"))),
        F.transform("relations", lambda r: _row("relation", name=r["src"], predicate=r["type"], object=r["dst"], canonical=edge(r), confidence=r["confidence"])),
        F.transform("claims", lambda x: _row("claim", name=x["subject"], predicate=x["predicate"], object=x["object"], canonical=x["canonical"], confidence=x["confidence"], pinned=x["pinned"])),
        _episode(),
    ]
    if queue:
        parts += [
            F.transform("relations", lambda r: queued("relation", edge(r), "derived_relation", F.lit(RELATION_PRIORITY))),
            F.transform(F.filter("claims", lambda x: ~x["pinned"]), lambda x: queued("claim", x["canonical"], "derived_claim", c("importance"))),
            F.when(c("session_id").isNotNull(), F.array(queued("episode", c("title"), "episode_activity", F.lit(EPISODE_PRIORITY)))),
        ]
    return _each(titled(events).withColumn("fresh", fresh), parts)


def _lease() -> Column:
    lease = _row("lease", name=F.col("lease_key"), object=F.col("lease_value"), canonical=F.col("lease_key"), ttl=F.col("ttl"))
    return F.when((F.col("kind") == "state_update") & F.col("lease_key").isNotNull(), F.array(lease))


def _mentions() -> Column:
    return F.transform("names", lambda n: _row("entity", name=n, canonical=n, predicate=F.lit("mentioned")))


def _episode() -> Column:
    c = F.col
    return F.when(c("session_id").isNotNull(), F.array(_row("episode", name=c("title"), object=dominant(c("names")), canonical=c("title"), confidence=c("confidence"))))


def _each(events: DataFrame, parts: list[Column]) -> DataFrame:
    every = F.concat(*(F.coalesce(p, _none()) for p in parts))  # an explode of one array, so each event is worked on once
    return events.select("event_id", "scope_key", "session_id", "ts", "arrival", F.explode(every).alias("a")).select("event_id", "scope_key", "session_id", "ts", "arrival", "a.*")


def unqueued(events: DataFrame) -> DataFrame:
    """artifacts_of() less what is queued, for settled events: those that say nothing have no rules of texts applied.

    Without a text, a told claim or a hinted relation an event has its lease, its hinted names and its episode alone.
    """
    c = F.col
    texts = ("raw_text", "normalized_text", "p_raw", "p_normalized", "p_interpreted", "observation")
    held = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    says = (F.concat_ws("", *texts) != "") | held("told_claims") | held("hint_relations")
    silent = _with_hinted_names(events.where(~says))
    silent = silent.withColumn("title", rules.episode_title(c("episode_hint"), F.get(c("names"), F.lit(0)), F.lit(""), c("kind")))
    return artifacts_of(events.where(says), queue=False).unionByName(_each(silent, [_lease(), _mentions(), _episode()]))


def key() -> Column:
    """What tells artifacts of a scope and kind apart: a lease's or entity's folded name, an episode's session and title, else name, predicate and object."""
    c = F.col
    folded = lambda *names: F.concat_ws("\x1f", *(F.coalesce(rules.folded(c(n)), F.lit("")) for n in names))
    alone, queued = folded("name"), folded("name", "canonical", "trigger")
    return F.when(c("artifact").isin("lease", "entity"), alone).when(c("artifact") == "episode", folded("session_id", "name")).when(c("artifact") == "queue", queued).otherwise(folded("name", "predicate", "object"))


def upserted(artifacts: DataFrame) -> DataFrame:
    """One row for each artifact of a scope, by its folded name, predicate and object (a lease by its key, an episode by session and title).

    Spelling by first arrival, times by arrival (a late event overwrites last_seen with its own earlier time), the highest
    confidence, pinned if ever, the number of events as evidence, a lease's latest value, and of what is queued the first
    priority. All of it is partial aggregation, so a hot artifact costs its tasks one row each.
    """
    order = F.struct("arrival", "event_id")
    at_first, at_last = ("name", "predicate", "canonical", "trigger", "priority"), ("object", "ttl")
    # what goes by one order is one value, so that the order is held once for all of it
    keyed = artifacts if "key" in artifacts.columns else artifacts.withColumn("key", key())
    g = keyed.groupBy("scope_key", "artifact", "key").agg(
        F.min_by(F.struct(*at_first, "ts"), order).alias("f"), F.max_by(F.struct(*at_last, "ts"), order).alias("l"), F.max("confidence").alias("confidence"), F.bool_or("pinned").alias("pinned"), F.count_distinct("event_id").alias("evidence"),
    )
    of = lambda held, names: (F.col(f"{held}.{n}").alias(n) for n in names)
    return g.select("scope_key", "artifact", "key", *of("f", at_first), *of("l", at_last), "confidence", "pinned", "evidence", F.col("f.ts").alias("first_seen"), F.col("l.ts").alias("last_seen"))


def _with_hinted_names(events: DataFrame) -> DataFrame:
    """names of events without a text, worked out once for each list of hints where lists are few."""
    names = dv.phrases(F.lit(None).cast("string"), F.col("hint_entities"))
    lists = settled(events.select("hint_entities").distinct())
    if lists.count() > MOST_LISTS:
        return events.withColumn("names", names)
    known = settled(lists.where("hint_entities is not null").withColumn("names", names))
    return events.join(F.broadcast(known), "hint_entities", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def latest(rows: DataFrame) -> DataFrame:
    """scope_key, artifact, key, last_seen and ttl of each artifact (rows with key), as upserted() has them."""
    # the hash comes first, so that rows are sorted by a number
    g = rows.groupBy(F.xxhash64("scope_key", "artifact", "key").alias("_h"), "scope_key", "artifact", "key").agg(F.max_by(F.struct("ts", "ttl"), F.struct("arrival", "event_id")).alias("l"))
    return g.select("scope_key", "artifact", "key", F.col("l.ts").alias("last_seen"), F.col("l.ttl").alias("ttl"))


def ends(rows: DataFrame) -> DataFrame:
    """The first and last arrivals of each artifact, all of them where arrivals are alike, by aggregations of numbers alone."""
    by = ["scope_key", "artifact", "key"]
    at = F.coalesce("arrival", F.lit(-(2**63)))  # a null comes first
    span = rows.groupBy(*by).agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    return rows.join(F.broadcast(span), by).where((at == F.col("_from")) | (at == F.col("_to"))).drop("_from", "_to")


def described(rows: DataFrame) -> DataFrame:
    """upserted() for few artifacts of many rows (with key): what goes by order is taken from their ends, evidence is counted by itself."""
    by = ["scope_key", "artifact", "key"]
    tally = rows.select(*by, "event_id").distinct().groupBy(*by).agg(F.count("event_id").alias("evidence"))
    most = rows.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.bool_or("pinned").alias("pinned"))
    return upserted(ends(rows)).drop("confidence", "pinned", "evidence").join(most, by).join(tally, by)
