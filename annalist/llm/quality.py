"""Quality rules with adaptive thresholds.

Each document's metrics are whole numbers: per-mille rates, and hundredths of a mean word's length. For each language and
source, and merged for the language and for all, a quantile sketch of every metric is kept over the documents that pass
the base rules: counts of fixed bins, which add up exactly in any order of partitions. Fences read off the sketches
(a quartile, and beyond it a multiple of its distance from the median) replace fixed cutoffs; documents are joined with
the fences of their group and judged. Words much shorter or longer than the group's reject a document, and so do lines
or windows that repeat; few letters do so together with symbols beyond the group's fence, as names, numbers and addresses
alone make a text no worse.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import WORD, map_arrow, settle, small_enough_to_broadcast, table

#: Metrics with an upper fence and its guard: no document up to its guard is ever rejected by the metric, so that a group
#: without any symbol doesn't reject the first one.
UPPER_GUARDS = {"symbol_rate": 20, "dup_line_rate": 400, "repeat_rate": 400, "word_length": 0}
#: Metrics with a lower fence.
LOWER = ("letter_rate", "word_length")
METRICS_JUDGED = tuple(dict.fromkeys((*UPPER_GUARDS, *LOWER)))
#: The bins of a sketch: one for each value, the last one open.
BINS = 2000
#: How many times a quartile's distance from the median (1 at least) a fence lies beyond the quartile.
REACH = 12
#: A group with fewer documents takes the fences of its language, and that one, if it too is small, those of all.
LEAST_GROUP = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Most groups whose fences are broadcast; beyond that they are joined by a salted shuffle.
BROADCAST_GROUPS = 100_000
SALTS = 16

METRICS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long"
_WORDS = re.compile(WORD)
_NOT_SPACE = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ASCII = re.compile(r"[\x00-\x7f]+")
_NOT_LETTERS = bytes(c for c in range(256) if not (c < 128 and chr(c).isalpha()))


def letters_in(text: str) -> int:
    """Characters that are letters (Unicode categories L)."""
    raw = text.encode("utf-8", "surrogatepass")
    found = len(raw.translate(None, _NOT_LETTERS))
    return found if len(raw) == len(text) else found + sum(map(str.isalpha, _ASCII.sub("", text)))


def text_metrics(text: str) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_letters."""
    words = _WORDS.findall(text)
    n = len(words)
    symbols = len(_SYMBOLS.findall(text))
    lines = dup = 0
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if _NOT_SPACE.search(line):
                lines += 1
                if line in seen:
                    dup += 1
                seen.add(line)
    else:
        lines = int(n > 0)
    repeated = 0
    if n >= 4:
        first: dict[tuple[str, str, str], int] = {}
        covered = 0  # words before this position are counted
        marks = bytearray(n)
        for i, window in enumerate(zip(words, words[1:], words[2:])):  # noqa: B905
            j = first.setdefault(window, i)
            if j != i:
                marks[i] = marks[j] = 1
        if 1 in marks:
            for i in range(n - 2):
                if marks[i]:
                    repeated += i + 3 - max(covered, i)
                    covered = i + 3
    return n, sum(map(len, words)), symbols, dup, repeated, lines, letters_in(text)


def metrics(docs: DataFrame) -> DataFrame:
    """One row of counts for each document's whole text; null texts have no word. A text_hash is passed on."""
    given = [c for c in ("text_hash",) if c in docs.columns]

    def run(part: dict) -> dict:
        rows = [text_metrics(t or "") for t in part["text"]]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")
        return {c: part[c] for c in ("doc_id", "lang", "source", *given)} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")), *given)
    return map_arrow(rows, run, METRICS + "".join(f", {c} long" for c in given))


def with_rates(counted: DataFrame) -> DataFrame:
    """Metrics and base_failed beside the counts."""

    def rate(part: str, whole: str, times: int = 1000):
        return F.when(F.col(whole) > 0, F.least(F.lit(BINS - 1), F.floor(F.lit(times) * F.col(part) / F.col(whole)))).otherwise(0).cast("int")

    return counted.select(
        "*", rate("n_symbols", "n_words").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("word_chars", "n_words", 100).alias("word_length"), rate("n_letters", "word_chars").alias("letter_rate"),
        ((F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def sketches(rated: DataFrame) -> DataFrame:
    """Bin counts of documents that pass the base rules: lang, source, metric, bin, n. They merge by adding, so a hot group shrinks before the shuffle."""
    long = rated.where("not base_failed").select("lang", "source", F.explode(F.create_map(*(x for m in METRICS_JUDGED for x in (F.lit(m), F.col(m))))).alias("metric", "bin"))
    return long.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and the fences of each metric: from the group's own sketch, or from a merged one if it is small."""

    def quartiles(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "metric")
        ranked = merged.withColumn("total", F.sum("n").over(w)).withColumn("up_to", F.sum("n").over(w.orderBy("bin")))
        at = lambda num: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * num, F.col("bin"))).alias(f"q{num}")
        return ranked.groupBy(*keys, "metric").agg(at(1), at(2), at(3), F.first("total").alias("total"))

    names = ("q1", "q2", "q3")
    own = quartiles(["lang", "source"])
    by_lang = quartiles(["lang"]).select("lang", "metric", F.struct(*names, "total").alias("of_lang"))
    of_all = quartiles([]).select("metric", F.struct(*names).alias("of_all"))
    b = by_lang.withColumnsRenamed({"lang": "l_lang", "metric": "l_metric"})
    # by_lang and of_all have a few rows for each language and metric; Spark chooses how to join them.
    joined = own.join(b, own["lang"].eqNullSafe(b["l_lang"]) & (own["metric"] == b["l_metric"])).join(of_all, "metric")
    use = F.when(F.col("total") >= LEAST_GROUP, F.struct(*names)).when(F.col("of_lang.total") >= LEAST_GROUP, F.struct(*(f"of_lang.{q}" for q in names))).otherwise(F.col("of_all"))
    guard = F.create_map(*(x for m, v in UPPER_GUARDS.items() for x in (F.lit(m), F.lit(v))))
    q1, q2, q3 = (F.col(f"use.{q}") for q in names)
    one = joined.withColumn("use", use).withColumn("upper", F.greatest(q3 + REACH * F.greatest(q3 - q2, F.lit(1)), guard[F.col("metric")])).withColumn("lower", q1 - REACH * F.greatest(q2 - q1, F.lit(1)))
    pick = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}")
    return one.groupBy("lang", "source").agg(*(pick(m, "upper") for m in UPPER_GUARDS), *(pick(m, "lower") for m in LOWER))


#: What a document must be within to be kept.
WITHIN = "word_length between word_length_lower and word_length_upper and dup_line_rate <= dup_line_rate_upper and repeat_rate <= repeat_rate_upper and (letter_rate >= letter_rate_lower or symbol_rate <= symbol_rate_upper)"


def judge(docs: DataFrame) -> DataFrame:
    """Metrics, rates, fences, base_failed, verdict fields and kept for every document.

    docs: doc_id, text, lang, source. Null texts have no words and fail the base; null lang and source form groups of
    their own; a group none of whose documents passes the base has no fences; repeated rows are judged alike; an empty
    table gives no rows.
    """
    rated = settle(with_rates(metrics(docs)), "quality")  # read three times; a row of numbers for each text
    return _join_bounds(rated, fences(sketches(rated))).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.expr(WITHIN), F.lit(False)))


def _join_bounds(rated: DataFrame, bounds: DataFrame) -> DataFrame:
    key = F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
    bounds = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    groups = rated.select("lang", "source")
    spread = F.array(*(F.lit(i) for i in range(SALTS)))
    if _groups_bounded(groups):
        return rated.join(F.broadcast(bounds), key, "left").drop("b_lang", "b_source")
    salted = bounds.withColumn("b_salt", F.explode(spread))
    left = rated.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return left.join(salted, key & (F.col("salt") == F.col("b_salt")), "left").drop("b_lang", "b_source", "salt", "b_salt")


def _groups_bounded(groups: DataFrame) -> bool:
    return small_enough_to_broadcast(groups.distinct(), BROADCAST_GROUPS)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their own columns; each is judged by itself, whether or not its id is null or given again."""
    keyed = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    kept = judge(keyed).where("kept").select(*(F.col(c).alias(f"kept_{c}") for c in ("doc_id", "lang", "source", "text_hash"))).distinct()
    # rows of one id, language, source and text have one verdict
    same = keyed["doc_id"].cast("long").eqNullSafe(kept["kept_doc_id"]) & (keyed["text_hash"] == kept["kept_text_hash"])
    for c in ("lang", "source"):
        same = same & keyed[c].cast("string").eqNullSafe(kept[f"kept_{c}"])
    return keyed.join(kept, same, "left_semi").drop("text_hash")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
