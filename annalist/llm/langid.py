"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three, words padded with a blank) in rank
order. A document's own most frequent n-grams are compared with each profile by out-of-place distance: the sum of rank
differences, with the profile length for an n-gram that the profile lacks. Ties of frequency are broken by the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import crc_remainder, fold_arrow, map_arrow, table

#: N-grams of a profile, of a language and of a document.
PROFILE = 400
#: Different n-grams that a counting task holds.
COUNTED = 2_000_000
UNDETERMINED = "und"
_BITS = 21  # of a code point: three fit in 63 bits
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 (blank) for what is no letter. Built once a worker."""
    global _LETTER
    if _LETTER is None:
        of = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                of[c] = ord(low) if len(low) == 1 else c
        _LETTER = of
    return _LETTER


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three letters in words padded with blanks; empty without a letter."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.concatenate(([0], _letters()[points], [0])).astype(np.int64)
    # runs of blanks become one
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    one = x[x != 0]
    two = (x[:-1] << _BITS) | x[1:]
    middle = x[1:-1] != 0  # a trigram across a word's end says nothing
    three = ((x[:-2] << 2 * _BITS) | (x[1:-1] << _BITS) | x[2:])[middle]
    return np.concatenate((one, two | (1 << 62), three))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, frequent first, ties to the smaller code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


def learn_profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, list[int]]:
    """N-gram codes in rank order for each language of docs (lang, text); null langs and texts teach nothing.

    Each partition adds up its counts before the shuffle, so a hot language costs no more than any other, and sends them
    on when it holds COUNTED of them. What reaches the driver is `most` codes for each language.
    """

    def count(parts: Iterator[dict]) -> Iterator[dict]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[dict]:
            for lang, (codes, counts) in totals.items():
                yield {"lang": [lang] * len(codes), "gram": codes.tolist(), "n": counts.tolist()}
            totals.clear()

        for part in parts:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part["lang"], part["text"], strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, all_codes in by.items():
                codes, counts = np.unique(np.concatenate(all_codes), return_counts=True)
                if lang in totals:
                    old, had = totals[lang]
                    merged, at = np.unique(np.concatenate((old, codes)), return_inverse=True)
                    totals[lang] = merged, np.bincount(at, np.concatenate((had, counts))).astype(np.int64)
                else:
                    totals[lang] = codes, counts
            if sum(len(codes) for codes, _ in totals.values()) > COUNTED:
                yield from rows()
        yield from rows()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = fold_arrow(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most `most` rows of each language, taken by a rank that Spark limits before the shuffle
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], most: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score, margin for docs (doc_id, text).

    score: 1 minus the nearest profile's distance over the largest possible one; margin: how much farther the next
    profile is, in the same unit. Texts that are null, empty or without a letter, and all texts if nothing was learned,
    give `und` with score 0. Ties go to the language first in order. Repeated rows are predicted alike.
    """
    langs = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast((langs, [np.array(profiles[k], dtype=np.int64) for k in langs]))

    def run(part: dict) -> dict:
        names, of = shared.value
        sorters = [np.argsort(p) for p in of]
        out: dict[str, list] = {"doc_id": part["doc_id"], "lang_pred": [], "score": [], "margin": []}
        for text in part["text"]:
            codes = grams(text)
            if not len(codes) or not names:
                pred, score, margin = UNDETERMINED, 0.0, 0.0
            else:
                own = ranked(*np.unique(codes, return_counts=True), most)
                ranks = np.arange(len(own))
                far = []
                for p, sort in zip(of, sorters, strict=True):
                    at = sort[np.minimum(np.searchsorted(p, own, sorter=sort), len(p) - 1)]
                    far.append(int(np.where(p[at] == own, np.abs(at - ranks), most).sum()))
                worst = most * len(own)
                order = sorted(range(len(far)), key=far.__getitem__)
                pred, score = names[order[0]], 1 - far[order[0]] / worst
                margin = (far[order[1]] - far[order[0]]) / worst if len(order) > 1 else score
            out["lang_pred"].append(pred)
            out["score"].append(score)
            out["margin"].append(margin)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, lang_pred string, score double, margin double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    profiles = learn_profiles(docs.where(~held_out))
    return predict(docs, profiles).select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
