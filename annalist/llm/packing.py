"""Packing documents into fixed-length training sequences by cutting-stock column generation.

Every document's ids are cut into full sequences and one remainder. Remainders are items of a cutting-stock problem
over their length histogram (at most seq_len - 1 classes, whatever the corpus size): a linear program over patterns is
solved by column generation, where a knapsack dynamic program prices new patterns from the dual prices. Rounded-down
patterns and first-fit-decreasing patterns for the few items left over give a plan of (pattern, count), and documents
ranked within their length take its slots.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import map_arrow, settle, table

SEQ_LEN = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: Most words whose ids a worker remembers; beyond that the memory is emptied and filled anew.
CACHE_WORDS = 300_000
#: Pieces of one length are ranked in parts of about so many, so that no length fills a task.
RANKED = 50_000
#: Most parts whose first ranks are broadcast; beyond that they are joined by a shuffle.
BROADCAST_PARTS = 200_000

_ENCODERS: dict[str, object] = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit bytes.

    A space between two characters that are not white space always starts a new BPE piece, so ids of such words can be
    remembered by word; texts where a space touches other white space, or with a special token, are encoded whole.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._hf = Tokenizer.from_file(tokenizer_path)
        self._words: dict[str, bytes] = {}
        self._fast = None
        ranks = tokenizer_path.removesuffix(".json") + ".tiktoken"
        try:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={})
        except (ImportError, OSError):
            pass

    def _encode(self, text: str) -> bytes:
        if self._fast is not None and "<|" not in text:
            return np.array(self._fast.encode_ordinary(text), dtype="<u4").tobytes()
        return np.array(self._hf.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or "  " in text or " \n" in text or "\n " in text or " \t" in text or "\t " in text or not _plain(text):
            return self._encode(text)
        words, known = text.split(" "), self._words
        if len(known) > CACHE_WORDS:
            known.clear()
        out = [self._encode(words[0])]
        for w in words[1:]:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._encode(" " + w)
            out.append(ids)
        return b"".join(out)


def _plain(text: str) -> bool:
    """No white space but space, newline and tab."""
    return not any(c in text for c in "\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　")


def encoder(tokenizer_path: str) -> Encoder:
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.json")


def cut_pieces(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer_path: str | None = None) -> DataFrame:
    """Ids of every whole text with END_ID after them, cut at multiples of seq_len: one row for each piece."""
    path = tokenizer_path or default_tokenizer()

    def cut(part: dict) -> dict:
        encode = encoder(path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        end = int(END_ID).to_bytes(4, "little")
        for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
            raw = encode(text or "") + end
            n = len(raw) // 4
            for start in range(0, n, seq_len):
                piece = raw[4 * start : 4 * (start + seq_len)]
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(len(piece) // 4)
                out["ids_crc32"].append(zlib.crc32(piece))
                out["doc_tokens"].append(n)
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


def solve_plan(histogram: dict[int, int], seq_len: int = SEQ_LEN, most_rounds: int = 30) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, items), ...) with their counts, covering each item of the histogram exactly once.

    Column generation: the restricted master is a covering linear program, solved by revised simplex from the
    one-length patterns on. The knapsack program gives, for each length, the pattern of largest dual value that holds
    it; those that still price above 1 enter in turn. It stops when none does, which solves the program, when its value is
    within GAP of all items' length, or after most_rounds, as the last parts of a per cent take many rounds; the plan is
    complete all the same: what its full patterns leave is packed best fit. Its size depends on seq_len alone.
    """
    lengths = sorted(r for r, n in histogram.items() if n > 0 and 0 < r < seq_len)
    if not lengths:
        return []
    need = np.array([histogram[r] for r in lengths], dtype=float)
    k = len(lengths)
    basis = np.diag([float(seq_len // r) for r in lengths])  # [i, j]: items of length i in pattern j
    place = {r: i for i, r in enumerate(lengths)}
    for i, r in enumerate(lengths):  # complements start out paired: the scarcer length is used up by the pair
        j = place.get(seq_len - r)
        if j is not None and i != j and (need[i], i) < (need[j], j):
            basis[i, i] = basis[j, i] = 1
    inverse = np.linalg.inv(basis)
    level = np.maximum(inverse @ need, 0)
    pivots = 0
    bound = need @ np.array(lengths) / seq_len
    for _ in range(most_rounds):
        entered = 0
        columns = _knapsack(lengths, inverse.sum(axis=0), seq_len)
        if not columns or level.sum() <= bound * (1 + GAP):
            break
        for column in columns:
            if inverse.sum(axis=0) @ column <= 1 + 1e-6:
                continue
            direction = inverse @ column
            positive = direction > 1e-9
            if not positive.any():
                continue
            ratio = np.where(positive, level / np.where(positive, direction, 1), np.inf)
            leave = int(ratio.argmin())
            step = max(ratio[leave], 0)
            pivot = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, pivot)
            inverse[leave] = pivot
            basis[:, leave] = column
            level = np.maximum(level - direction * step, 0)
            level[leave] = step
            entered += 1
            pivots += 1
            if pivots % 200 == 0:
                inverse = np.linalg.inv(basis)
                level = np.maximum(inverse @ need, 0)
            if entered >= ENTER:
                break
        if not entered:
            break
    left = {r: int(histogram[r]) for r in lengths}
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for j in np.argsort(-level):
        pattern = tuple((lengths[i], round(basis[i, j])) for i in range(k) if basis[i, j] > 0.5)
        count = min([int(level[j] + 1e-6), *(left[r] // a for r, a in pattern)])
        if count > 0 and sum(r * a for r, a in pattern) >= seq_len - seq_len // FULL:
            plan.append((pattern, count))
            for r, a in pattern:
                left[r] -= a * count
    return plan + _best_fit(left, seq_len)


#: Rounded patterns with more padding than this part of a sequence are packed anew with what rounding leaves.
FULL = 256
#: Patterns that enter the master between two knapsack programs.
ENTER = 40
#: Padding, as a part of all items' length, that the linear program need not go below.
GAP = 5e-3


def _knapsack(lengths: list[int], prices: np.ndarray, seq_len: int) -> list[np.ndarray]:
    """For each length the pattern of largest total price that holds it, those above 1, dearest first."""
    best = np.zeros(seq_len + 1)
    take = np.full(seq_len + 1, -1)
    sizes = np.array(lengths)
    fits = np.searchsorted(sizes, np.arange(seq_len + 1), side="right")
    for c in range(lengths[0], seq_len + 1):
        options = best[c - sizes[: fits[c]]] + prices[: fits[c]]
        i = int(options.argmax())
        if options[i] > best[c - 1] + 1e-12:
            best[c], take[c] = options[i], i
        else:
            best[c] = best[c - 1]
    value = prices + best[seq_len - sizes]
    columns = []
    for i in np.argsort(-value)[: 4 * ENTER]:
        if value[i] <= 1 + 1e-6:
            break
        column = np.zeros(len(lengths))
        column[i] = 1
        c = seq_len - lengths[i]
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= lengths[take[c]]
        columns.append(column)
    return columns


def _best_fit(left: dict[int, int], seq_len: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over what rounding leaves: work by length classes, so it doesn't grow with the corpus."""
    left = {r: n for r, n in left.items() if n > 0}
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    while left:
        room, pattern = seq_len, {}
        while left and (fit := [r for r in left if left[r] - pattern.get(r, 0) > 0 and r <= room]):
            r = max(fit)
            a = min(room // r, left[r] - pattern.get(r, 0))
            pattern[r] = pattern.get(r, 0) + a
            room -= a * r
        times = min(left[r] // a for r, a in pattern.items())
        plan.append((tuple(sorted(pattern.items(), reverse=True)), times))
        for r, a in pattern.items():
            left[r] -= a * times
        left = {r: n for r, n in left.items() if n > 0}
    return plan


def slots_of(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, items in a pattern, first sequence, offset in the sequence), by length and first rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in plan:
        offset = 0
        for r, a in pattern:
            first = taken.get(r, 0)
            rows.append((r, first, first + a * count, a, sequence, offset))
            taken[r] = first + a * count
            offset += a * r
        sequence += count
    return sorted(rows)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and offset that each is given.

    docs: doc_id, text; other columns are not read. Null texts are empty (their end id alone is packed); repeated and
    null ids stay rows of their own; an empty table gives no rows. Sequence ids are dense from 0 but for no fixed order.
    Full pieces are sequences by themselves. The driver sees the length histogram (under seq_len rows) and the plan.
    """
    spark = docs.sparkSession
    pieces = settle(cut_pieces(docs, seq_len, tokenizer_path), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    parts = spark.createDataFrame([(r, -(-n // RANKED)) for r, n in histogram.items()], "length long, parts long")  # at most seq_len rows
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts"))).drop("parts")
    few = sum(-(-n // RANKED) for n in histogram.values()) <= BROADCAST_PARTS
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    full = histogram.pop(seq_len, 0)
    rows = [(seq_len, 0, full, 1, 0, 0)] if full else []
    rows += [(r, a, b, items, first + full, offset) for r, a, b, items, first, offset in slots_of(solve_plan(histogram, seq_len))]
    slots = spark.createDataFrame(rows, "length long, first_rank long, end_rank long, items long, first_sequence long, first_offset long")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    # slots: a few rows for each length, whatever the corpus
    ranked = (
        dealt.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(before) if few else before, ["length", "part"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    within = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first_sequence") + F.floor(within / F.col("items"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + within % F.col("items") * F.col("length")).cast("long").alias("offset"),
        )
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
