"""Events from JSON: lines and a host's nested export, each document parsed once into a VARIANT and read by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAIM = "struct<subject_name:string,subject:string,predicate:string,object_text:string,object:string,canonical_claim:string,confidence:double,pinned:boolean>"
_RELATION = "struct<src:string,source:string,dst:string,target:string,type:string,relation_type:string,confidence:double>"
_PAYLOAD = f"""struct<raw_text:string,normalized_text:string,interpreted_text:string,tool_observation_text:string,route_domain:string,route_action:string,needs_clarification:boolean,pin:boolean,
claims:array<{_CLAIM}>,claim:variant,fact:variant,value_json:variant,value:variant,ttl_seconds:bigint,ttl:bigint,lease_key:string,key:string>""".replace("\n", "")
_SCOPE = "struct<tenant:string,namespace:string,workspace:string,project:string>"
#: What is read of an event, all by one walk through its document; a field that isn't there or is of another type is null.
_EVENT = f"""struct<event_id:string,session_id:string,timestamp:string,arrival:bigint,kind:string,raw_text:string,normalized_text:string,idempotency_key:string,scope:{_SCOPE},
structured_payload:{_PAYLOAD},hints:struct<pin:boolean,entities:array<string>,relations:array<{_RELATION}>,episode_hint:string>,scores:struct<importance:double,confidence:double>>""".replace("\n", "")
#: JSON of values that count as absent.
_EMPTY = ("null", '""', "0", "0.0", "false", "{}", "[]")


def at(path: str, kind: str = "string", of: str | Column = "v") -> Column:
    """A value by its path; null where it isn't there or is of another type."""
    return F.try_variant_get(of, f"$.{path}", kind)


def filled(text: Column) -> Column:
    """A trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def truthy(value: Column) -> Column:
    """A variant that holds something, or null."""
    return F.when(~F.to_json(value).isin(*_EMPTY), value)


def parsed(docs: DataFrame, column: str = "doc") -> DataFrame:
    """v, the parsed document, of each row; what is no JSON is null there and gives no event."""
    return docs.select(F.try_parse_json(column).alias("v"))


def host_events(docs: DataFrame, column: str = "doc") -> DataFrame:
    """v of each event of nested documents {session, events}, with session_id and scope of the session as the event's own where it has none."""
    own = parsed(docs, column).select(at("session.session_id").alias("of"), at("session.scope", "variant").alias("within"), F.explode(at("events", "array<variant>")).alias("v"))
    return own


def _claim(x: Column, speaker: bool) -> Column:
    """One claim of a payload (see _CLAIM); speaker: whether `subject` may stand for `subject_name`."""
    subject = F.coalesce(filled(x["subject_name"]), filled(x["subject"])) if speaker else filled(x["subject_name"])
    return F.struct(
        subject.alias("subject"), filled(x["predicate"]).alias("predicate"), F.coalesce(filled(x["object_text"]), filled(x["object"])).alias("object"),
        filled(x["canonical_claim"]).alias("canonical"), F.nullif(x["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(x["pinned"], F.lit(False)).alias("pinned"),
    )


def events_of(variants: DataFrame) -> DataFrame:
    """The typed columns of events (v): texts, payload, hints, claims, lease and scores.

    Missing scores are 0.5. A claim without predicate or object, a relation hint without a side, and items of another
    type are left out. Of a lease, ttl falls back to an hour, and a value that is no object is wrapped into one.
    """
    sound = lambda c: c["predicate"].isNotNull() & c["object"].isNotNull()
    get = lambda x, *names: F.coalesce(*(filled(x[n]) for n in names))
    relation = lambda x: F.struct(get(x, "src", "source").alias("src"), get(x, "dst", "target").alias("dst"), get(x, "type", "relation_type").alias("type"), F.nullif(x["confidence"], F.lit(0.0)).alias("confidence"))
    joined = lambda s: F.lower(F.concat_ws("::", *(F.trim(F.coalesce(s[k], F.lit(""))) for k in ("tenant", "namespace", "workspace", "project"))))
    nested = {"of", "within"} <= set(variants.columns)
    # an explode of one, so that the test of the kind isn't moved below the parsing, which would then be done twice
    v = variants.withColumn("e", F.explode(F.array(F.try_variant_get("v", "$", _EVENT)))).where("e.kind is not null")
    e = lambda name: F.col(f"e.{name}")
    p = lambda name: e(f"structured_payload.{name}")
    session, scope = filled(e("session_id")), joined(e("scope"))
    if nested:
        session = F.coalesce(session, F.col("of"))
        scope = F.when(truthy(at("scope", "variant")).isNull(), joined(F.try_variant_get("within", "$", _SCOPE))).otherwise(scope)
    # each is a column of its own, so that it is worked out once
    v = v.withColumns({"_session": session, "_scope": scope, "_value": F.coalesce(truthy(p("value_json")), truthy(p("value"))), "_one": F.coalesce(truthy(p("claim")), truthy(p("fact"))), "_listed": F.filter(F.transform(p("claims"), lambda x: _claim(x, True)), sound)})
    v = v.withColumns({"_value": F.coalesce("_value", F.parse_json(F.lit("{}"))), "_one": F.try_variant_get("_one", "$", _CLAIM)})
    wrapped = F.when(F.schema_of_variant("_value").startswith("OBJECT"), F.to_json("_value")).otherwise(F.concat(F.lit('{"value":'), F.to_json("_value"), F.lit("}")))
    single = F.filter(F.array(_claim(F.col("_one"), False)), sound)
    ttl = lambda name: F.nullif(p(name), F.lit(0))
    return v.select(
        filled(e("event_id")).alias("event_id"), F.col("_scope").alias("scope_key"), F.col("_session").alias("session_id"), F.try_to_timestamp(e("timestamp")).alias("ts"), e("arrival").alias("arrival"),
        F.lower(F.trim(e("kind"))).alias("kind"), e("raw_text").alias("raw_text"), e("normalized_text").alias("normalized_text"), p("raw_text").alias("p_raw"),
        p("normalized_text").alias("p_normalized"), p("interpreted_text").alias("p_interpreted"), p("tool_observation_text").alias("observation"),
        p("route_domain").alias("route_domain"), p("route_action").alias("route_action"), F.coalesce(p("needs_clarification"), F.lit(False)).alias("unclear"), F.coalesce(e("hints.pin"), F.lit(False)).alias("pin"),
        F.coalesce(p("pin"), F.lit(False)).alias("p_pin"), F.filter(F.transform(e("hints.entities"), filled), lambda x: x.isNotNull()).alias("hint_entities"),
        F.filter(F.transform(e("hints.relations"), relation), lambda r: r["src"].isNotNull() & r["dst"].isNotNull()).alias("hint_relations"),
        e("hints.episode_hint").alias("episode_hint"), F.coalesce(e("scores.importance"), F.lit(0.5)).alias("importance"), F.coalesce(e("scores.confidence"), F.lit(0.5)).alias("confidence"),
        F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(single).alias("told_claims"), F.coalesce(filled(p("lease_key")), filled(p("key"))).alias("lease_key"),
        wrapped.alias("lease_value"), F.coalesce(ttl("ttl_seconds"), ttl("ttl"), F.lit(3600)).alias("ttl"), filled(e("idempotency_key")).alias("idempotency_key"),
    )
