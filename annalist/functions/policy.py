"""Review policies: weights, biases, thresholds and the band in which a second opinion is asked for, read from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import ranking


@dataclass(frozen=True)
class Policy:
    """A review's parameters; what a file leaves out has the default policy's value."""

    name: str = "default"
    version: int = 1
    weights: dict = field(default_factory=lambda: dict(ranking.WEIGHTS))
    kind_biases: dict = field(default_factory=lambda: dict(ranking.KIND_BIAS))
    promotion: float = ranking.PROMOTION
    reinforce: float = ranking.REINFORCE
    retire: float = ranking.RETIRE
    mode: str = "shadow"
    artifact_types: tuple = ("claim", "episode")
    actions: tuple = ranking.ADJUDICATED
    floor: float = ranking.BAND_FLOOR
    ceiling: float = ranking.BAND_CEILING
    promotion_margin: float = ranking.BAND_BELOW_PROMOTION
    retire_margin: float = ranking.BAND_MARGIN

    def score(self, factors: dict[str, Column], kind: Column) -> Column:
        """Weighted factors and the bias of the kind, within 0 and 1."""
        total = F.lit(0.0)
        for k, bias in self.kind_biases.items():
            total = F.when(kind == k, float(bias)).otherwise(total)
        for k, w in self.weights.items():
            if k in factors:
                total = total + F.lit(float(w)) * factors[k]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))

    def reasons(self, artifact_type: Column, action: Column, locked: Column, score: Column) -> Column:
        """Why no second opinion is asked for; empty where one is."""
        floor = max(self.floor, self.retire + self.retire_margin)
        near = F.when(action == "promote", score >= max(floor, self.promotion - self.promotion_margin)).when(action == "retire", score <= min(self.ceiling, self.retire + self.retire_margin)).otherwise(score.between(floor, self.ceiling))
        every = F.array(
            F.when(F.lit(self.mode == "off"), "mode_off"), F.when(locked, "hard_locked"), F.when(~artifact_type.isin(*self.artifact_types), "artifact_type_ineligible"),
            F.when(~action.isin(*self.actions), "action_ineligible"), F.when(~near, "score_outside_ambiguity_band"),
        )
        return F.filter(every, lambda r: r.isNotNull())


#: Names of factors in policy files.
_FACTORS = {"identity_relevance": "identity", "future_utility": "utility"}


@lru_cache(maxsize=32)
def policy_of(text: str) -> Policy:
    """A policy from its JSON text, parsed once."""
    d = json.loads(text)
    a = d.get("adjudication") or {}
    band = a.get("ambiguity_band") or {}
    base = Policy()
    return Policy(
        d.get("name", base.name), d.get("version", base.version), {_FACTORS.get(k, k): v for k, v in (d.get("factor_weights") or base.weights).items()}, d.get("kind_biases") or base.kind_biases,
        d.get("promotion_threshold", base.promotion), d.get("reinforce_threshold", base.reinforce), d.get("retire_threshold", base.retire), a.get("mode", base.mode) if a.get("enabled", True) else "off",
        tuple(a.get("artifact_types") or base.artifact_types), tuple(a.get("allowed_actions") or base.actions), band.get("candidate_floor", base.floor), band.get("candidate_ceiling", base.ceiling),
        band.get("promotion_margin", base.promotion_margin), band.get("retire_margin", base.retire_margin),
    )


def no_opinion(batch: pd.DataFrame) -> pd.DataFrame:
    """The adjudicator that is never asked anything: every decision stays."""
    return pd.DataFrame({"action": batch["action"], "confidence": 0.0, "rationale": ""})


def second_opinion(decisions: DataFrame, policy: Policy, adjudicator: Callable[[pd.DataFrame], pd.DataFrame] = no_opinion) -> DataFrame:
    """decisions (artifact_id, artifact_type, action, locked, score) with suggested and final action, confidence, rationale and whether it was applied.

    Eligible ones are given to the adjudicator in batches; in mode `assist` its allowed actions are applied, else told only.
    """
    assist, allowed = policy.mode == "assist", frozenset(policy.actions)
    asked = decisions.withColumn("eligible", F.size(policy.reasons(F.col("artifact_type"), F.col("action"), F.col("locked"), F.col("score"))) == 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.assign(suggested=None, confidence=0.0, rationale="")
            some = batch["eligible"].to_numpy(dtype=bool)
            if some.any():
                told = adjudicator(batch[some])
                out.loc[some, ["suggested", "confidence", "rationale"]] = told[["action", "confidence", "rationale"]].to_numpy()
            applied = some & assist & out["suggested"].isin(allowed).to_numpy() & (out["suggested"] != out["action"]).to_numpy()
            out["final"] = out["suggested"].where(applied, out["action"])
            out["applied"] = applied
            out["confidence"] = out["confidence"].astype(float)
            yield out[["artifact_id", "artifact_type", "action", "score", "eligible", "suggested", "confidence", "rationale", "final", "applied"]]

    rows = asked.select("artifact_id", "artifact_type", "action", "locked", "score", "eligible")
    return rows.mapInPandas(run, "artifact_id string, artifact_type string, action string, score double, eligible boolean, suggested string, confidence double, rationale string, final string, applied boolean")
