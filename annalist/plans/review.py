"""The review of the derived archive: claims, relations and episodes with what supports them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators import artifacts, review
from annalist.plans.catalogue import ORACLE, QUERIES, query
from annalist.plans.derivation import documents
from annalist.sources import payloads
from annalist.sources.archive import settled

__all__ = ["ORACLE", "QUERIES"]


def pieces(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts, their supporting events and the states of an earlier review: what is sure is remembered."""
    c = F.col
    events = settled(payloads.events_of(payloads.parsed(documents(spark, d))))
    rows = settled(artifacts.artifacts_of(events))
    ref = F.concat_ws(":", "artifact", artifacts.key()).alias("ref")
    up = artifacts.upserted(rows).where(c("artifact").isin(*review.KINDS))
    known = settled(up.select("scope_key", c("artifact").alias("kind"), F.concat_ws(":", "artifact", "key").alias("ref"), "name", "predicate", "canonical", F.coalesce("pinned", F.lit(False)).alias("pinned"), "evidence", "confidence"))
    own = events.select("scope_key", "event_id", c("kind").alias("event_kind"), F.coalesce(F.nullif(F.trim("p_raw"), F.lit("")), "raw_text").alias("raw_text"), "importance", "route_domain", "route_action", (F.size("hint_relations") > 0).alias("relation_hint"))
    support = rows.where(c("artifact").isin(*review.KINDS)).select("scope_key", c("artifact").alias("kind"), ref, "event_id", "ts").join(own, ["scope_key", "event_id"])
    states = known.where((c("confidence") >= 0.7) | c("pinned")).select("scope_key", "kind", "ref", F.when(c("confidence") >= 0.9, "remembered").otherwise("candidate").alias("remember"), F.lit(False).alias("state_pinned"))
    return known.drop("confidence"), support, states


@query("")
def review_decisions(spark, d):
    return review.decide(*pieces(spark, d)).select("scope_key", "kind", "ref", "action", "locked", "reason", "score", "influence", "remember", "activation", "pinned")
