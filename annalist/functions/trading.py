"""Review rules for trading memories: what is about trading, what is evidence of it, and which routine episodes matter.

Events are an array of structs with kind, route_domain, route_action, source_app, text, fact_eligible, submitted, failed,
vetoes, approved and regime_shift.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.rules import folded
from annalist.functions.text import token_set

# Fixed values.
WORDS = """
trade trading order orders position positions entry entries exit exits broker exchange execution executed portfolio capital
equity drawdown pnl profit loss risk thesis theses regime market buy sell long short
""".split()
SYMBOLS = "btc eth sol ada doge bnb aapl nvda tsla msft googl amzn okx alpaca".split()
SUMMARIES = ("trading_scorecard", "trading_cycle_summary", "trading_journal_event", "trading_theses")
ROUTINES = ("crypto-regime-cycle", "risk-envelope", "execution-cycle", "trade-outcome-review", "learner-state-update")


def _low(column: Column) -> Column:
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def routed(events: Column) -> Column:
    """Whether any event comes from trading."""
    return F.exists(
        events,
        lambda e: _low(e["kind"]).startswith("trading_") | (_low(e["route_domain"]) == "trading") | _low(e["route_action"]).startswith("trading_") | (_low(e["source_app"]) == "trading_adapter") | _low(e["source_app"]).endswith("_trading"),
    )


def about_trading(claim: Column, events: Column) -> Column:
    """Whether a claim is about trading, by where its events come from or by its words and theirs."""
    words = token_set(F.concat_ws(" ", claim, F.array_join(F.transform(events, lambda e: e["text"]), " ")))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, WORDS))))
    return routed(events) | (hits >= 2) | ((hits > 0) & F.arrays_overlap(words, F.array(*map(F.lit, SYMBOLS))))


def has_fact(events: Column) -> Column:
    """Whether any trading event is more than a summary, or says that it is a fact."""
    return F.exists(events, lambda e: _low(e["kind"]).startswith("trading_") & (F.coalesce(e["fact_eligible"], F.lit(False)) | ~_low(e["kind"]).isin(*SUMMARIES)))


def matters(title: Column, events: Column) -> Column:
    """Whether an episode holds what its routine is kept for: an outcome, an intervention, a failed order, a veto, a shift."""
    any_ = lambda test: F.exists(events, test)
    outcome, intervention = any_(lambda e: _low(e["kind"]) == "trading_outcome"), any_(lambda e: _low(e["kind"]) == "trading_learner_intervention")
    failure = any_(lambda e: (_low(e["kind"]) == "trading_execution_result") & (F.coalesce(e["failed"], F.lit(0)) > 0))
    veto = any_(lambda e: (_low(e["kind"]) == "trading_risk_envelope") & ((F.coalesce(e["vetoes"], F.lit(0)) > 0) | ~F.coalesce(e["approved"], F.lit(True))))
    shift = any_(lambda e: (_low(e["kind"]) == "trading_market_state") & F.coalesce(e["regime_shift"], F.lit(False)))
    return (
        F.when(folded(title) == "trade-outcome-review", outcome).when(folded(title) == "learner-state-update", intervention).when(folded(title) == "risk-envelope", veto)
        .when(folded(title) == "crypto-regime-cycle", shift).when(folded(title) == "execution-cycle", failure | outcome | intervention).otherwise(outcome | intervention | failure | veto | shift)
    )


def held_back(title: Column, events: Column) -> Column:
    """Whether a routine episode is left to be consolidated."""
    return folded(title).isin(*ROUTINES) & ~matters(title, events)
