"""Mixing documents to target domain weights with soft membership.

A classifier learned from the labelled table (softmax regression over the presence of those hashed words and shapes that
tell domains apart) predicts each document's posterior over domains, in steps of a thousandth. Nonnegative rates of the
documents are then fitted by projected gradient so that the expected tokens of each domain meet their targets in the
least-squares sense, with momentum, starting from the prior rate of 1. A rate after k steps depends on the posterior and
the k residual vectors alone, so only those small vectors travel, and documents of one posterior are one row of the fit:
at most some 500,000 rows, whatever the corpus. At last a rate within SNAP of a whole number is projected onto it, so that
what belongs to one domain is kept or left out as a whole, and the other rates make up for what that moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import ascii_lower_text, drop_settled, fold_arrow, settle, table

#: Domains from the labels: toxic first, whatever the quality; then by quality.
DOMAINS = ("good", "low", "toxic")
#: Target tokens of each domain as a share of the tokens that the domain is expected to hold.
TARGET_SHARES = {"good": 1.0, "low": 0.5, "toxic": 0.0}
FEATURES = 1 << 18
#: Steps at most, and after snapping; ended before when no domain misses its target by more than TOLERANCE of its scale, or five
#: steps together lower the squared misses by less than the share SETTLED.
STEPS, CORRECTIONS, TOLERANCE, SETTLED = 40, 6, 1e-3, 0.01
MAX_RATE, SNAP = 4.0, 0.1
#: A domain's misses are scaled by its tokens, or by this share of all tokens if that is more, so that a target that the
#: bounds on rates rule out (no toxic token at all) doesn't pull large domains from theirs.
LEAST_SCALE = 0.5
#: Posteriors are counted in steps of 1 / GRAIN.
GRAIN = 1000
_MARKS = ".,;:!?\"'()[]{}#*$%&|<>=+-_~^/\\"
_CAPITALS = "\x00capitals"


def _parts(word: bytes) -> tuple[list[str], bool]:
    """Of a word: itself without marks around it, in lower case, and the marks after it; and whether it is in capitals."""
    text = word.decode("utf-8", "surrogatepass")
    low = ascii_lower_text(text)
    return [low.strip(_MARKS), "\x00" + low[len(low.rstrip(_MARKS)) :]], len(text) > 1 and text.isupper()


def _feature(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % FEATURES


#: A worker forgets its words between texts once it knows so many.
REMEMBERED = 600_000


class _Words:
    """What a worker remembers of words: features, only those weighed if some are, of words that have any; which are in capitals."""

    def __init__(self, weighed: np.ndarray | None = None):
        self.weighed = None if weighed is None else frozenset(weighed.tolist())
        self.met: set[bytes] = set()
        self.telling: dict[bytes, tuple[int, ...]] = {}
        self.capitals: set[bytes] = set()

    def meet(self, words: set[bytes]) -> None:
        if len(self.met) > REMEMBERED:
            self.met.clear()
            self.telling.clear()
            self.capitals.clear()
        for word in words - self.met:
            parts, capitals = _parts(word)
            found = {_feature(p) for p in parts + [_CAPITALS] * capitals}
            if self.weighed is not None:
                found &= self.weighed
            if found:
                self.telling[word] = tuple(found)
            if capitals:
                self.capitals.add(word)
        self.met |= words


def _shapes(text: str, n_words: int, n_different: int, n_capitals: int) -> list[str]:
    """What a text looks like, each rate as the number of cuts that it passes."""
    n = max(n_words, 1)
    rates = {
        "symbols": sum(map(text.count, "#*$%&<>")) / n,
        "bars": text.count("|") / n,
        "bangs": text.count("!") / n,
        "capitals": n_capitals / max(n_different, 1),
        "lengths": len(text) / n / 20,
    }
    out = [f"\x01{name} {sum(rate > cut for cut in _CUTS)}" for name, rate in rates.items()]
    # the share of different words falls with the length by itself
    return [*out, f"\x01different {min(n_words.bit_length(), 12)} {int(20 * n_different / n)}", f"\x01words {min(n_words.bit_length(), 12)}"]


_CUTS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 1.0, 2.0)


def features_of(text: str | None, known: _Words) -> tuple[list[int], int]:
    """The different features of a text, words and shapes, and its number of words."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []  # at ASCII white space
    different = set(words)
    known.meet(different)
    found = set(chain.from_iterable(map(known.telling.__getitem__, known.telling.keys() & different)))
    found.update(map(_feature, _shapes(text or "", len(words), len(different), len(known.capitals & different))))
    return sorted(found), len(words)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, domain (number) of labelled documents; a null label counts as 0, ids twice labelled take the worse.

    All labelled ids, or those SAMPLE of the smallest hashes if there are more, are broadcast; only their texts are read.
    """
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)
    chosen = of.select("l_id", domain.cast("int").alias("domain")).orderBy(F.xxhash64("l_id", F.lit("sample")), "l_id").limit(SAMPLE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "domain")


def learn(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Base score of each domain and what a present feature adds [domain, feature], from rows of labelled().

    Those TELLING features that tell domains apart most are weighed. What reaches the driver are counts of FEATURES
    features and the weighed features of about SAMPLE documents.
    """

    def present(parts: Iterator[dict]) -> Iterator[dict]:
        known = _Words()
        for part in parts:
            yield {"domain": part["domain"], "at": [features_of(t, known)[0] for t in part["text"]]}

    found = settle(fold_arrow(rows.select("text", "domain"), present, "domain int, at array<int>"), "features")
    docs = np.zeros(len(DOMAINS))
    for r in found.groupBy("domain").count().collect():
        docs[r["domain"]] = r["count"]
    held = np.zeros((len(DOMAINS), FEATURES))
    counts = found.select("domain", F.explode("at").alias("feature")).groupBy("feature").pivot("domain", list(range(len(DOMAINS)))).count().fillna(0)
    total = sum((F.col(str(d)) for d in range(1, len(DOMAINS))), F.col("0"))
    for batch in counts.where(total >= MIN_DOCS).toArrow().to_batches():
        at = np.asarray(batch.column("feature"))
        for d in range(len(DOMAINS)):
            held[d, at] = np.asarray(batch.column(str(d)))
    power = surprise(held, docs)
    telling = np.argsort(-power, kind="stable")[:TELLING]
    telling = np.sort(telling[power[telling] > np.log(max((power > 0).sum(), 1))])
    weights = np.zeros((len(DOMAINS), FEATURES), dtype=np.float32)
    base = np.log((docs + 1) / (docs.sum() + len(DOMAINS)))
    if not len(telling):
        return base, weights
    del held, power
    place = {int(f): i for i, f in enumerate(telling)}

    def weighed(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            yield {"domain": part["domain"], "at": [[place[f] for f in at if f in place] for at in part["at"]]}

    sample = fold_arrow(found, weighed, "domain int, at array<int>", None).toArrow().combine_chunks()
    x = np.zeros((len(sample), 1 + len(telling)), dtype=np.float32)
    y = np.zeros((len(sample), len(DOMAINS)), dtype=np.float32)
    x[:, 0] = 1.0
    at = sample.column("at").combine_chunks()
    x[np.repeat(np.arange(len(sample)), np.asarray(at.value_lengths())), 1 + np.asarray(at.flatten())] = 1.0
    y[np.arange(len(sample)), np.asarray(sample.column("domain"))] = 1.0
    # rows in an order of their own, so that sums of floats don't depend on tasks
    order = np.lexsort(np.concatenate([np.packbits(x[:, 1:] > 0, axis=1).T, y.T]))
    base, weights[:, telling] = softmax_fit(x[order], y[order], base)
    drop_settled(found)
    return base, weights


def surprise(held: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How unlikely a feature's documents fall so unevenly on a domain by chance: the largest -log of Chernoff's bound; 0 for rare ones.

    held: documents of each domain with each feature; docs: documents of each domain. Few documents count if all are of
    a rare domain, so that the words of a small language tell as well as those of a large one.
    """
    every = held.sum(axis=0)
    prior = np.clip(docs / max(docs.sum(), 1), 1e-9, 1 - 1e-9)[:, None]
    share = held / np.maximum(every, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(share > 0, share * np.log(share / prior), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - prior)), 0)
    return (every * parts).max(axis=0) * (every >= MIN_DOCS)


def softmax_fit(x: np.ndarray, y: np.ndarray, base: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Ridge softmax regression of y (one-hot) on x, whose first column is 1, by gradient steps with momentum, scaled to each weight."""
    w = np.concatenate([base[:, None], np.zeros((y.shape[1], x.shape[1] - 1))], axis=1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = x @ w.T.astype(np.float32)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = ((e / e.sum(axis=1, keepdims=True) - y).T @ x) / len(x)
        g[:, 1:] += RIDGE * w[:, 1:]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.05 * (1 - k / rounds) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w[:, 0], w[:, 1:]


#: Features weighed, labelled ids that the classifier is fitted on at most, and its ridge.
TELLING, SAMPLE, RIDGE = 1000, 20_000, 1e-3
#: A feature in fewer of those documents isn't weighed, nor one spread as unevenly as chance would spread one of all features.
MIN_DOCS = 5


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, n_tokens and p (GRAIN times the probability of each domain, whole numbers that add up to GRAIN) of every whole text."""
    prior, weights = model
    weighed = np.flatnonzero(weights.any(axis=0))
    shared = docs.sparkSession.sparkContext.broadcast((prior.astype(np.float64), weighed, weights[:, weighed].astype(np.float64)))  # TELLING features

    def run(parts: Iterator[dict]) -> Iterator[dict]:
        base, at, of = shared.value
        known, place = _Words(at), {int(f): i for i, f in enumerate(at)}
        for part in parts:
            out: dict[str, list] = {"doc_id": part["doc_id"], "text_hash": part["text_hash"], "n_tokens": [], "p": []}
            for text in part["text"]:
                features, n = features_of(text, known)
                score = base + of[:, [place[f] for f in features if f in place]].sum(axis=1)
                e = np.exp(score - score.max())
                p = np.floor(GRAIN * e / e.sum()).astype(np.int64)
                p[int(e.argmax())] += GRAIN - p.sum()  # what rounding leaves is the likeliest one's
                out["n_tokens"].append(n)
                out["p"].append(p.tolist())
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return fold_arrow(rows, run, "doc_id long, text_hash long, n_tokens long, p array<int>")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


#: The steps of a fit: those with momentum, each a pull on every domain and the momentum after it, and those that make up for snapping.
Fit = tuple[list[list[float]], list[list[float]]]


def _clipped(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(MAX_RATE), rate))


def _pull(g: Column | list[float]) -> Column:
    return sum((F.col(f"p{i}") * g[i] for i in range(1, len(DOMAINS))), F.col("p0") * g[0])


def _moved(steps: list[list[float]], finish) -> Column:
    """finish(struct(rate, ahead)) after all steps as a column of p0, p1, ...: each moves `ahead` against the residuals and back into [0, MAX_RATE]."""

    def step(a: Column, g: Column) -> Column:
        rate = _clipped(a["ahead"] - _pull(g))
        return F.struct(rate.alias("rate"), (rate + g[len(DOMAINS)] * (rate - a["rate"])).alias("ahead"))

    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    return F.aggregate(F.lit(steps), start, step, finish) if steps else finish(start)


def _snaps(rate: Column) -> Column:
    return F.abs(rate - F.round(rate)) < SNAP


def _rate(fit: Fit) -> Column:
    """The rate as a column: near whole numbers snap, and the others move on to make up for what that moves."""
    steps, corrections = fit
    on = lambda rate: F.aggregate(F.lit(corrections), rate, lambda r, g: _clipped(r - _pull(g))) if corrections else rate
    return _moved(steps, lambda a: F.when(_snaps(a["rate"]), F.round(a["rate"])).otherwise(on(a["rate"])))


def fit_rates(cells: DataFrame, targets: dict[str, float] | None = None, steps: int = STEPS) -> tuple[Fit, dict[str, tuple[float, float, float]]]:
    """The steps whose replay gives each rate, and for each domain its expected tokens at rate 1, its target and what is attained.

    cells: n_tokens, p0, p1, ... ; targets: shares of each domain's own expected tokens. Projected gradient in the metric
    of tokens, its step from the largest eigenvalue of the domains' second moments, with momentum that starts anew when
    the misses grow. It ends when no domain misses its target by TOLERANCE of its scale or the misses have settled. Then
    whole numbers are snapped to and CORRECTIONS steps at most move the rates that are left; the best of them are given.
    """
    n = len(DOMAINS)
    shares = np.array([(targets or TARGET_SHARES)[d] for d in DOMAINS])

    def sums(table: DataFrame, *columns: Column) -> np.ndarray:
        return np.array([float(x) for x in table.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns))).first()])

    mass = lambda of: [F.col("n_tokens") * F.col(f"p{i}") * of for i in range(n)]
    second = lambda of: [F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}") * of for i in range(n) for j in range(n)]
    first = sums(cells, *mass(F.lit(1.0)), *second(F.lit(1.0)))
    start, goal = first[:n], shares * first[:n]
    scale = np.maximum(np.maximum(start, LEAST_SCALE * start.sum()), 1.0)
    miss = lambda m: float((((m - goal) / scale) ** 2).sum())

    def pull(m: np.ndarray, moments: np.ndarray) -> list[float]:
        steep = np.linalg.eigvalsh(moments.reshape(n, n) / np.outer(scale, scale)).max()
        return [round(float(x), 12) for x in (m - goal) / scale**2 / max(steep, 1e-300)] if steep > 0 else [0.0] * n

    history: list[list[float]] = []
    seen, best, ahead, t = [miss(start)], (miss(start), 0), start, 1.0
    for k in range(1, steps + 1):
        if np.abs((ahead - goal) / scale).max() < TOLERANCE or (k > 6 and seen[-6] - min(seen[-5:]) < SETTLED * seen[-6]):
            break
        t = 1.0 if len(seen) > 1 and seen[-1] > seen[-2] else t
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        history.append([*pull(ahead, first[n:]), round((t - 1) / later, 12)])
        t = later
        both = sums(cells.withColumn("_a", _moved(history, lambda a: a)), *mass(F.col("_a.rate")), *mass(F.col("_a.ahead")))
        ahead = both[n:]
        seen.append(miss(both[:n]))
        best = min(best, (seen[-1], k))
    history = history[: best[1]]
    loose = cells.withColumn("_a", _moved(history, lambda a: a["rate"]))
    now = sums(cells.withColumn("rate", _rate((history, []))), *mass(F.col("rate")))
    moments = sums(loose.where(~_snaps(F.col("_a"))), *second(F.lit(1.0)))
    corrections: list[list[float]] = []
    least = (miss(now), 0, now)
    for k in range(1, CORRECTIONS + 1):
        if not moments.any() or np.abs((now - goal) / scale).max() < TOLERANCE:
            break
        corrections.append(pull(now, moments))
        now = sums(cells.withColumn("rate", _rate((history, corrections))), *mass(F.col("rate")))
        least = min(least, (miss(now), k, now), key=lambda x: x[:2])
    return (history, corrections[: least[1]]), {d: (float(start[i]), float(goal[i]), float(least[2][i])) for i, d in enumerate(DOMAINS)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_good, p_low, p_toxic, rate and copies for every row of docs (doc_id, text).

    copies is the rate rounded up or down by a hash of the id (of the text, if the id is null), so that its mean is the
    rate and a rerun gives the same.
    Null and empty texts have no tokens and take what a text without words has. Without labels every domain is as likely.
    Repeated rows are fitted each by itself; an empty table gives no rows.
    """
    return _mixed(docs, labels, targets).drop("text_hash")


def members_of(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, text_hash, n_tokens, p0, p1, ...), settled, and cells, their tokens by posterior, settled too."""
    model = learn(labelled(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic")))
    of = [f"p{i}" for i in range(len(DOMAINS))]
    members = settle(posteriors(docs, model).select("doc_id", "text_hash", "n_tokens", *((F.col("p")[i] / F.lit(float(GRAIN))).alias(c) for i, c in enumerate(of))), "members")
    return members, settle(members.groupBy(*of).agg(F.sum("n_tokens").alias("n_tokens")).coalesce(8), "cells")


def _cell() -> Column:
    """A posterior's number, from its first two parts; the last is what they leave of GRAIN."""
    return F.round(F.col("p0") * GRAIN).cast("int") * (GRAIN + 1) + F.round(F.col("p1") * GRAIN).cast("int")


def _mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """mix() with the hash of each row's text."""
    members, cells = members_of(docs, labels)
    history, _ = fit_rates(cells, targets)
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", "text_hash"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a rate for each posterior, some 500,000 at most, worked out once and sent to the rows
    rates = settle(cells.select(_cell().alias("cell"), _rate(history).alias("rate")), "rates")
    rated = members.withColumn("cell", _cell()).join(F.broadcast(rates), "cell")
    return rated.select("doc_id", "text_hash", "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row as often as its own copies say, its own columns alone, whether or not its id is null or given again.

    Rows of one id and text have the same copies. Nulls, empty texts and an empty table are as in mix().
    """
    names = docs.columns
    own = lambda name: name + "_" * max(map(len, names))  # noqa: E731  # clashes with no column
    copies = _mixed(docs, labels, targets).where("copies > 0").groupBy(F.col("doc_id").alias(own("id")), F.col("text_hash").alias(own("hash"))).agg(F.max("copies").alias(own("n")))
    joined = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col(own("id"))) & (F.xxhash64(docs["text"].cast("string")) == F.col(own("hash"))))
    return joined.withColumn(own("nth"), F.explode(F.sequence(F.lit(1), F.col(own("n"))))).select(*names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
