"""Scoring formulas of retrieval and review as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENCY_BIAS = 0.1
#: Factor weights and thresholds of the default policy.
WEIGHTS = {"consequence": 0.25, "recurrence": 0.20, "identity": 0.20, "utility": 0.20, "user_emphasis": 0.15}
PROMOTION, REINFORCE, RETIRE = 0.70, 0.55, 0.20
#: What the kind of an artifact's newest event adds to its score; other kinds add nothing.
KIND_BIAS = {"decision": 0.25, "failure": 0.25, "fact_assertion": 0.20, "summary": 0.10, "message": 0.0, "state_update": -0.20}
#: Kinds of events that speak for themselves.
EXPLICIT_KINDS = ("decision", "failure", "fact_assertion")


def base_score(lexical: Column, importance: Column, confidence: Column) -> Column:
    return lexical + importance * 0.3 + confidence * 0.2 + F.lit(RECENCY_BIAS)


def editorial_modifier(remember: Column, activation: Column, weight: Column, pinned: Column, mode: str = "default") -> Column:
    deep, archive = mode == "deep", mode == "archive"
    state = F.when(remember == "remembered", 0.6).when(remember == "candidate", 0.15 if deep else -0.05).when(remember.isin("retired", "superseded"), 0.0 if archive else -0.5).otherwise(0.0)
    active = F.when(activation == "active", 0.25).when(activation == "dormant", 0.05 if deep else -0.05).otherwise(-0.1)
    return F.when(remember.isNull(), 0.2 if deep else 0.0).otherwise(weight + state + active + F.when(pinned, 0.5).otherwise(0.0))


def admitted(remember: Column, activation: Column, mode: str = "default") -> Column:
    if mode == "archive":
        return F.lit(True)
    deep = F.lit(mode == "deep")
    return F.when(remember.isNull() | remember.isin("retired", "superseded"), deep).when((remember == "candidate") & (activation == "suppressed"), deep).otherwise(F.lit(True))


def rank_bonus(rank: Column, n: Column, most: float) -> Column:
    """Linear from `most` at rank 0 to nothing at the last rank."""
    return F.when(n <= 1, F.lit(most)).otherwise((F.lit(1.0) - rank / (n - 1)) * F.lit(most))


def claim_factors(pinned: Column, explicit: Column, question: Column, evidence: Column, importance: Column) -> dict[str, Column]:
    """The factors of a claim; evidence is its number of events."""
    repeated = evidence >= 2

    def pick(pin: float, explicit_: float, asked: Column | None, again: Column, once: Column) -> Column:
        out = F.when(pinned, pin).when(explicit, explicit_)
        return (out if asked is None else out.when(question, asked)).when(repeated, again).otherwise(once)

    return {
        "consequence": pick(1.0, 0.85, None, F.lit(0.65), F.least(F.lit(0.25), importance * 0.35)),
        "recurrence": F.when(evidence >= 3, 1.0).when(evidence == 2, 0.7).otherwise(0.0),
        "identity": pick(0.9, 0.9, F.lit(0.15), F.lit(0.75), F.lit(0.2)),
        "utility": pick(0.95, 0.95, F.lit(0.1), F.lit(0.75), F.lit(0.15)),
        "user_emphasis": pick(1.0, 0.85, None, F.least(F.lit(0.75), importance), F.least(F.lit(0.2), importance * 0.2)),
    }


def kind_bias(kind: Column) -> Column:
    out = F.lit(0.0)
    for k, bias in KIND_BIAS.items():
        out = F.when(kind == k, bias).otherwise(out)
    return out


def claim_action(pinned: Column, kind: Column, question: Column, evidence: Column, remembered: Column, score: Column) -> Column:
    """The action of a review on a claim, the first rule that holds deciding."""
    spoken = pinned | kind.isin(*EXPLICIT_KINDS)
    held = question | (~remembered & ~spoken & (evidence < 2))
    return (
        F.when(pinned, "pin").when(question & remembered, "retire").when(held, "leave_candidate")
        .when(remembered & (score >= REINFORCE), "reinforce").when(remembered & (score <= RETIRE), "retire").when(remembered, "fade")
        .when(score >= PROMOTION, "promote").otherwise("leave_candidate")
    )


#: The states that an action leads to.
ACTION_STATES = {
    "promote": ("remembered", "active"), "reinforce": ("remembered", "active"), "pin": ("remembered", "active"), "fade": ("remembered", "dormant"),
    "leave_candidate": ("candidate", "suppressed"), "retire": ("retired", "suppressed"), "mark_disputed": ("disputed", "suppressed"), "mark_superseded": ("superseded", "suppressed"),
}


def states_of(action: Column) -> tuple[Column, Column]:
    """remember and activation after an action."""
    table = F.create_map(*(x for a, (r, s) in ACTION_STATES.items() for x in (F.lit(a), F.struct(F.lit(r).alias("r"), F.lit(s).alias("a")))))
    return table[action]["r"], table[action]["a"]


#: Actions that a second opinion may change, the least and the largest score it is asked for.
ADJUDICATED = ("promote", "leave_candidate", "retire")
BAND_FLOOR, BAND_CEILING, BAND_MARGIN, BAND_BELOW_PROMOTION = 0.35, 0.82, 0.08, 0.10


def in_band(action: Column, locked: Column, score: Column) -> Column:
    """Whether a decision is close enough to a threshold for a second opinion."""
    floor = max(BAND_FLOOR, RETIRE + BAND_MARGIN)
    near = F.when(action == "promote", score >= max(floor, PROMOTION - BAND_BELOW_PROMOTION)).when(action == "retire", score <= min(BAND_CEILING, RETIRE + BAND_MARGIN)).otherwise(score.between(floor, BAND_CEILING))
    return ~locked & action.isin(*ADJUDICATED) & near
