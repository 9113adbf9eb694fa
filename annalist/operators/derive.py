"""From events to artifacts: entities, relations and claims, each a projection of one event and free of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import derivation as dv


def derive_entities(events: DataFrame) -> DataFrame:
    """events with `entities`: hinted names if any is sound, else phrases of the text; null or empty texts give none.

    events: text, and hint_entities (array of strings) if there are hints.
    """
    hints = F.col("hint_entities") if "hint_entities" in events.columns else F.lit(None).cast("array<string>")
    return events.withColumn("entities", dv.phrases(F.col("text"), hints))


def derive_relations(events: DataFrame) -> DataFrame:
    """events (text, entities) that state relations, with src, dst, type and confidence.

    Hinted relations (hint_relations, if there: structs of src, dst, type and confidence) of an allowed type win, a missing
    confidence being 0.8; else one relation at most is read from the text.
    """
    kind = "array<struct<src:string,dst:string,type:string,confidence:double>>"
    hints = F.col("hint_relations").cast(kind) if "hint_relations" in events.columns else F.lit(None).cast(kind)
    sound = F.filter(hints, lambda h: (F.trim(h["src"]) != "") & (F.trim(h["dst"]) != "") & h["type"].isin(*dv.RELATION_TYPES))
    hinted = F.transform(sound, lambda h: F.struct(F.trim(h["src"]).alias("src"), F.trim(h["dst"]).alias("dst"), h["type"].alias("type"), F.coalesce(h["confidence"], F.lit(dv.HINT_CONFIDENCE)).alias("confidence")))
    staged = events.withColumn("_low", F.lower(dv.compact(F.col("text")))).withColumn("_names", dv.relation_sides(F.col("entities")))
    read = F.filter(F.array(dv.relation(F.col("_low"), F.col("_names"))), lambda r: r.isNotNull())
    chosen = F.when(F.size(hinted) > 0, hinted).otherwise(read)
    return staged.withColumn("_r", F.explode(chosen)).select("*", "_r.*").drop("_r", "_low", "_names")


def derive_claims(messages: DataFrame) -> DataFrame:
    """messages (text, confidence) that state a claim, with subject, predicate, object and canonical; unsure ones and questions state none."""
    sure = messages.where(F.col("confidence") >= dv.MESSAGE_CONFIDENCE).withColumn("_text", dv.without_fillers(F.col("text")))
    staged = sure.where(~dv.asks(F.coalesce("text", F.lit("")), F.col("_text"))).withColumn("_c", dv.copula_claim(F.col("_text")))
    claims = staged.where(F.col("_c").isNotNull()).select("*", "_c.*").drop("_c", "_text")
    return claims.withColumn("canonical", F.concat_ws(" ", "subject", "predicate", "object"))
