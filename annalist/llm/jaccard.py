"""N-gram Jaccard join as a blocked sparse matrix product with size-derived bounds.

Rows of the incidence matrix are the different shingle sets (equal sets are one row), columns are shingles. Only columns
that can decide are multiplied: of each row, in one global order that puts widespread shingles last, the first
n - ceil(t n) + 1; two rows linked at threshold t share one of them, and their sizes lie within t of each other. In the
shorter row it is among the first n - ceil(2t / (1 + t) n) + 1, its inner columns, as what a longer row shares with it is more.

The product is taken in two grains. In the coarse one a row is the parities of its counts in ranges of hashes; where two
rows' parities differ, one has a hash that the other hasn't, which bounds their overlap, and pairs below what their
sizes demand are discarded. In the fine one the overlaps of the pairs left are accumulated from the whole sets, a row
against a block of rows at a time.

What is wanted are the components of the links, so large groups of near copies need not be multiplied out. Near copies
share most of their columns, so the first round takes a few columns of each row, by a hash of the column; columns whose
rows it brings into one component are done, and of those that have the same rows one is enough. In rounds the rows of a column that lie in different components are dealt into blocks, and each row is tried with its best partner
among those before it in the block, so that a block of near copies becomes one component at once, until a round links
nothing; a column of one block that has few pairs has all of them tried in one round, and is left out after it. At last
every pair left across components is taken, block by block, blocks of one size band meeting only those of the same band and the next,
beyond which sizes differ too much. No link between different sets is lost to the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import BLOCKS, blocks_of, drop_settled, fold_arrow, map_arrow, merged_blocks, settle, small_enough_to_broadcast, table

#: Slots of the table that tells widespread shingles from others. It orders columns only; links don't depend on it.
SLOTS = 1 << 21
_SLOT_BLOCKS = 32
#: Most rows whose ids are broadcast to pick the texts that a product needs; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Bytes that hold the parities of sets of up to so many hashes, a bit for each range of hashes.
RANGES = ((512, 64), (1536, 128), (4096, 256), (8192, 512), (16384, 1024), (float("inf"), 2048))
#: Columns whose slot counts more rows than this are hot: they are counted in parts. All others are no longer than this.
HOT = 1_000_000
#: Rows of a block, about; a column of at most twice so many is one block.
BLOCK = 512
#: Hashes of the sets that one row is multiplied with at once, about.
MULTIPLIED = 1 << 20
#: Columns of each row that the first round takes.
FIRST_COLUMNS = 3
#: Pairs of a block of near copies are tried all at once if there are at most so many for each row.
FEW_PAIRS = 2
#: Pairs whose bounds are taken at once, and bytes of parities, about.
_PAIRS, _PARITIES = 1 << 17, 1 << 24
_CACHE = 400_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_HASHES: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; bytes lower-case and split by ASCII alone."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    known = _HASHES
    if len(known) > _CACHE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of so many words; of a shorter text the whole run; none without words."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    width = min(words, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ w[j : n - width + 1 + j]) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def widespread(docs: DataFrame, words: int) -> np.ndarray:
    """A level for each slot of shingle hashes: how widespread its shingles are, in quarter powers of two."""

    def count(parts: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for part in parts:
            sets = [shingles(t, words) for t in part["text"]]
            at = (np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64) if sets else np.zeros(0, dtype=np.int64)
            total += np.bincount(at, minlength=SLOTS)
        yield blocks_of(total, _SLOT_BLOCKS)

    total = merged_blocks(fold_arrow(_rows(docs), count, BLOCKS), _SLOT_BLOCKS, SLOTS, np.add)
    return np.minimum(255, np.rint(4 * np.log2(total + 1.0))).astype(np.uint8)


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def ranges_of(s: np.ndarray) -> bytes:
    bits = 8 * next(r for most, r in RANGES if len(s) <= most)
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def row_heads(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, n (set size), key (of the whole set), head and hot (the columns that decide) and ranges of each document."""
    hot_level = int(4 * np.log2(HOT + 1.0))  # slots of a smaller level count at most HOT rows
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # SLOTS bytes

    def run(part: dict) -> dict:
        of = shared.value
        out: dict[str, list] = {"doc_id": part["doc_id"], "n": [], "key": [], "head": [], "hot": [], "ranges": []}
        for text in part["text"]:
            s = shingles(text, words)
            n = len(s)
            level = of[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
            first = np.lexsort((s, level))[: n - _least(n, percent) + 1] if n else np.zeros(0, dtype=np.int64)
            hot = level[first] >= hot_level
            out["n"].append(n)
            out["key"].append(_key(s))
            out["head"].append(s[first[~hot]].view(np.int64))
            out["hot"].append(s[first[hot]].view(np.int64))
            out["ranges"].append(ranges_of(s))
        return out

    return map_arrow(_rows(docs), run, "doc_id long, n long, key binary, head array<long>, hot array<long>, ranges binary")


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose accumulated overlap reaches the threshold.

    A row's partners are dealt into blocks by their number and size, so that neither a frequent row nor long sets fill a
    task. The sets are made anew from the texts that need them, each sent to the blocks that it is in.
    """
    sized = pairs.join(classes.select(F.col("node").alias("b"), "n"), "b")
    dealt = sized.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(MULTIPLIED))).cast("int").alias("k"))
    salted = settle(sized.join(dealt, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part")), "dealt")
    rows = salted.select("a", "part").distinct().select(F.col("a").alias("node"), "a", "part")
    wanted = rows.union(salted.select("b", "a", "part")).join(classes.select("node", "first_id", "key"), "node")
    # a row of very many blocks is asked for in parts
    asked = wanted.groupBy("first_id", "key", "node", F.pmod(F.xxhash64("a", "part"), F.lit(64)).alias("share")).agg(F.collect_list(F.struct("a", "part")).alias("blocks"))
    asked = settle(asked.drop("share"), "asked")
    few = small_enough_to_broadcast(asked, BROADCAST_ROWS)
    texts = _rows(docs).join(F.broadcast(asked) if few else asked, F.col("doc_id") == F.col("first_id")).select("text", "key", "node", "blocks")

    def send(part: dict) -> dict:
        out: dict[str, list] = {"a": [], "part": [], "node": [], "s": []}
        for text, key, node, blocks in zip(part["text"], part["key"], part["node"], part["blocks"], strict=True):
            s = shingles(text, words)
            if _key(s) == key:  # else it is another text of the id
                for block in blocks:
                    out["a"].append(block["a"])
                    out["part"].append(block["part"])
                    out["node"].append(node)
                    out["s"].append(s.tobytes())
        return out

    grouped = map_arrow(texts, send, "a long, part int, node long, s binary").groupBy("a", "part").agg(F.collect_list(F.struct("node", "s")).alias("m"))

    def multiply(part: dict) -> dict:
        a, b = [], []
        for row, m in zip(part["a"], part["m"], strict=True):
            of = {r["node"]: np.frombuffer(r["s"], dtype=np.uint64) for r in m}
            x = of.pop(row)
            every = np.concatenate(list(of.values()))
            sizes = np.array([len(s) for s in of.values()])
            at = np.minimum(np.searchsorted(x, every), len(x) - 1)
            overlap = np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            near = 100 * overlap >= percent * (len(x) + sizes - overlap)
            found = np.array(list(of))[near]
            a += [row] * len(found)
            b += found.tolist()
        return {"a": a, "b": b}

    out = settle(map_arrow(grouped.select("a", "m"), multiply, "a long, b long", None), "links")
    for t in (salted, asked):
        drop_settled(t)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of a link (a, b) reaches.

    Labels move along links and then jump to their own labels, so rounds grow with the logarithm of a chain's length.
    """
    edges = settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = settle(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("comp")), "labels")
    while True:
        seen = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("near"))
        moved = settle(labels.join(seen, F.col("node") == F.col("u")).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), "moved")
        to = moved.select(F.col("node").alias("t"), F.col("comp").alias("t_comp"))
        jumped = settle(moved.join(to, F.col("comp") == F.col("t"), "left").select("node", F.least("comp", F.coalesce("t_comp", "comp")).alias("comp"), "old"), "labels")
        for t in (labels, moved):
            drop_settled(t)
        labels = jumped
        if jumped.where("comp != old").isEmpty():
            drop_settled(edges)
            return labels.select("node", "comp")


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, comp) after new links between components, a node without label being its own: only components are joined."""
    if labels is None:
        return components(links)
    label = lambda c: labels.select(F.col("node").alias(f"{c}_node"), F.col("comp").alias(f"{c}_comp"))
    named = links.join(label("a"), F.col("a") == F.col("a_node"), "left").join(label("b"), F.col("b") == F.col("b_node"), "left")
    between = settle(named.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a != b").distinct(), "between")
    upper = components(between).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    drop_settled(between)
    moved = labels.join(upper, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return settle(moved.union(upper.select("old", "new").join(labels, F.col("old") == F.col("node"), "left_anti")), "labels")


def _within(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


class Bounds:
    """The most that rows can overlap, from the parities of their counts in ranges and their sizes.

    A range whose parities differ holds a hash of one row alone. They are compared in the fewest ranges first, and in as
    many as both rows have where that doesn't discard a pair.
    """

    def __init__(self, ranges: list[bytes], n: np.ndarray):
        self.n, size = n, np.array([len(r) for r in ranges])
        self.levels = []
        for _, least in RANGES:
            rows = np.flatnonzero(size >= least)
            if len(rows):
                place = np.full(len(n), -1)
                place[rows] = np.arange(len(rows))
                # a range of a shorter row is several of a longer one's, whose parities add up
                parities = np.stack([np.bitwise_xor.reduce(np.frombuffer(ranges[i], dtype=np.uint64).reshape(-1, least // 8), axis=0) for i in rows])
                self.levels.append((place, parities))

    def most(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        both = self.n[a] + self.n[b]
        out = np.minimum(self.n[a], self.n[b])
        at = np.arange(len(a))
        for place, parities in self.levels:
            at = at[(100 * out[at] >= percent * (both[at] - out[at])) & (place[a[at]] >= 0) & (place[b[at]] >= 0)]
            step = max(1, _PARITIES // (8 * parities.shape[1]))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                apart = np.bitwise_count(parities[place[a[some]]] ^ parities[place[b[some]]]).sum(axis=1, dtype=np.int64)
                out[some] = np.minimum(out[some], (both[some] - apart) // 2)
        return out


def blocked_product(open_: DataFrame, classes: DataFrame, percent: int, round_: int | None) -> DataFrame:
    """h, a < b, rest: pairs of rows that share a column h, lie in different components and aren't discarded by the coarse product.

    open_: h, node, n, c (rows of the column, or more), comp. A column of at most 2 * BLOCK rows is one block. In a round a longer one is dealt into blocks
    by a hash of the round. Of a column that is one block and has few pairs all are given in a round; of others, of each
    row's pairs with rows before it in its block, the one of the largest bound, and rest tells that there may be more.
    Without a round
    every pair is: a longer column is dealt by size band and hash, and a task takes two blocks of one band or of two that
    follow each other. No task holds more than about 2 * BLOCK rows however long the column.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(float(-np.log(percent / 100.0)), 0.01) + 1e-9)).cast("int")
    rows = open_.withColumn("long", F.col("c") > 2 * BLOCK)
    none = F.lit(0)
    if round_ is not None:
        own = F.when(F.col("long"), F.pmod(F.xxhash64("node", F.lit(round_)), F.ceil(F.col("c") / F.lit(BLOCK)))).otherwise(none).cast("int")
        met = rows.select("h", own.alias("i"), none.alias("j"), F.col("long").cast("int").alias("own"), "node", "n", "comp")
    else:
        banded = rows.withColumn("band", F.when(F.col("long"), band).otherwise(none))
        sizes = banded.where("long").groupBy("h", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("k"))
        next_ = sizes.select("h", (F.col("band") - 1).alias("band"), F.col("k").alias("k_next"))
        before = sizes.select("h", (F.col("band") + 1).alias("band"), F.col("k").alias("k_before"))
        dealt = banded.join(sizes, ["h", "band"], "left").join(next_, ["h", "band"], "left").join(before, ["h", "band"], "left")
        own = F.pmod(F.xxhash64("node"), F.coalesce("k", F.lit(1))).cast("int")
        # a block is named by its band and number, joined into one; pairs of blocks by the smaller name and the larger
        name = lambda b, k: b.cast("long") * F.lit(1 << 32) + k.cast("long")
        mine = name(F.col("band"), F.col("own"))
        others = lambda b, k: F.transform(F.sequence(F.lit(0), k - 1), lambda x: name(b, x))
        empty = F.array().cast("array<long>")
        partners = F.when(~F.col("long"), F.array(mine)).otherwise(F.concat(
            others(F.col("band"), F.coalesce("k", F.lit(1))),
            F.when(F.col("k_next").isNotNull(), others(F.col("band") + 1, F.col("k_next"))).otherwise(empty),
            F.when(F.col("k_before").isNotNull(), others(F.col("band") - 1, F.col("k_before"))).otherwise(empty),
        ))
        met = dealt.withColumn("own", own).withColumn("mine", mine).withColumn("other", F.explode(partners)).select("h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("own"), "node", "n", "comp")
        met = met.withColumn("j", F.when(F.col("i") == F.col("j"), F.lit(None).cast("long")).otherwise(F.col("j")))
    grouped = met.join(classes.select("node", "ranges"), "node").groupBy("h", "i", "j").agg(F.collect_list(F.struct("node", "n", "comp", "own", "ranges")).alias("m"))
    best = round_ is not None

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("m"))
            columns = np.repeat(np.asarray(batch.column(batch.schema.get_field_index("h"))), np.asarray(lists.value_lengths()))
            two = ~np.asarray(batch.column(batch.schema.get_field_index("j")).is_null()) if not best else np.zeros(len(lists), dtype=bool)
            m = lists.flatten()
            if not len(m):
                continue
            node, n, comp, own = (np.asarray(m.field(i)) for i in range(4))
            bounds = Bounds(m.field(4).to_pylist(), n)
            sizes = np.asarray(lists.value_lengths())
            ends = np.repeat(np.cumsum(sizes), sizes)
            later = ends - 1 - np.arange(len(node))  # rows of the group after each
            cross = np.repeat(two, sizes)
            found_a, found_b, found_w = [], [], []
            block = np.repeat(np.arange(len(lists)), sizes)
            at = 0
            total = np.cumsum(later)
            while at < len(node):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
                a = np.repeat(np.arange(at, to), later[at:to])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
                may = (comp[a] != comp[b]) & (node[a] != node[b]) & _within(n[a], n[b], percent) & (~cross[a] | (own[a] != own[b]))
                a, b = a[may], b[may]
                most = bounds.most(a, b, percent)
                near = 100 * most >= percent * (n[a] + n[b] - most)
                found_a.append(a[near])
                found_b.append(b[near])
                found_w.append(most[near] / (n[a] + n[b])[near])
                at = to
            a, b, w = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_w)
            rest = np.zeros(len(a), dtype=bool)
            if best and len(a):
                # in a round, own tells the blocks of longer columns
                rest = ((np.bincount(block[a], minlength=len(lists)) > FEW_PAIRS * sizes)[block] | (own == 1))[a]
                order = np.lexsort((-w, b))
                first = np.append(True, b[order][1:] != b[order][:-1])
                kept = np.sort(order[first | ~rest[order]])
                a, b, rest = a[kept], b[kept], rest[kept]
            lo, hi = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (columns[a], lo, hi)), pa.array(rest)], names=["h", "a", "b", "rest"])

    return grouped.select("h", "j", "m").mapInArrow(multiply, "h long, a long, b long, rest boolean")


def unfinished(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of lists whose columns may have pairs beyond those of a round; of columns longer than a block not all were tried."""
    short = lists.where(F.col("c") <= 2 * BLOCK).join(pairs.where("rest").select("h").distinct(), "h", "left_semi")
    return short.unionByName(lists.where(F.col("c") > 2 * BLOCK))


def shared_columns(classes: DataFrame, percent: int) -> DataFrame:
    """h, node, n, c: the rows of the columns that more than one row has (c rows), but for rows that can meet none there.

    Of two linked rows the shorter has a shared column among its inner ones. So a column that is an inner one of no row is
    left out, and a row of which it is no inner one meets only rows as short as itself of which it is. A row whose next
    shorter and next longer one differ too much in size meets none.
    """
    both = 100 + percent
    inner = lambda at: at < F.expr(f"n - (2 * {percent} * n + {both - 1}) div {both} + 1")
    of = lambda name, before: classes.select("node", "n", before.alias("before"), F.posexplode(name).alias("at", "h")).select("h", "node", "n", inner(F.col("at") + F.col("before")).alias("inner"))
    told = {"c": F.count("*"), "shortest": F.min(F.when(F.col("inner"), F.col("n")))}
    meets = F.col("inner") | (F.col("shortest") <= F.col("n"))
    w = Window.partitionBy("h")
    by_size = w.orderBy("n")
    within = lambda short, long: F.coalesce(F.lit(100) * short >= F.lit(percent) * long, F.lit(False))
    cold = of("head", F.lit(0)).withColumns({k: x.over(w) for k, x in told.items()}).where((F.col("c") > 1) & meets)  # at most HOT rows each
    cold = cold.withColumns({"before": F.lag("n").over(by_size), "after": F.lead("n").over(by_size)}).where(within(F.col("before"), F.col("n")) | within(F.col("n"), F.col("after")))
    hot = of("hot", F.size("head"))
    counts = hot.groupBy("h").agg(*(x.alias(k) for k, x in told.items()))
    return cold.select("h", "node", "n", "c").unionByName(hot.join(counts, "h").where((F.col("c") > 1) & meets).select("h", "node", "n", "c"))


def first_columns(lists: DataFrame) -> DataFrame:
    """Of each row of lists FIRST_COLUMNS of its columns, those that come first by a hash, so that rows of the same columns take the same."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("h"), "h")
    return lists.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST_COLUMNS).drop("nth")


def open_columns(placed: DataFrame) -> DataFrame:
    """h of the columns whose rows (h, node, comp) lie in different components yet, one for each set of rows: columns of the same rows give the same pairs."""
    rows = (F.count("*"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))))  # 128 bits tell sets apart, as they do in keys
    found = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.struct(*rows).alias("rows")).where("lo != hi")
    return found.groupBy("rows").agg(F.min("h").alias("h")).select("h")


def link_components(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """node, comp of every row of classes (node, n, head, hot, ranges, first_id, key) that is linked; None if none is."""
    left = settle(shared_columns(classes, percent), "lists")
    first = settle(blocked_product(first_columns(left).withColumn("comp", F.col("node")), classes, percent, 0), "pairs")
    fresh = tried = settle(first.select("a", "b").distinct(), "tried")
    drop_settled(first)
    labels, round_ = None, 0
    while True:
        links = None if fresh.isEmpty() else linked(docs, fresh, classes, words, percent)
        more = links is not None and not links.isEmpty()
        if more:
            labels = joined_components(labels, links)
        if round_ is None:
            return labels
        placed = left.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if labels is not None else left.withColumn("comp", F.col("node"))
        open_ = settle(placed.join(open_columns(placed), "h", "left_semi"), "open")
        drop_settled(left)
        # rounds go on as long as they link anything; then all pairs left
        round_ = round_ + 1 if more else None
        pairs = settle(blocked_product(open_, classes, percent, round_), "pairs")
        left = open_.drop("comp") if round_ is None else settle(unfinished(open_.drop("comp"), pairs), "left")
        drop_settled(open_)
        fresh = settle(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        drop_settled(pairs)
        tried = tried.union(fresh)


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Texts that are null or have no word have an empty set and link with nothing: their component is their own id. Rows
    without an id get none and link nothing by it. Rows that share an id but not the text are linked each by its own
    text. Ties cannot arise: a component is named by its smallest id. Repeated rows stay; an empty table gives no rows.
    """
    return _placed(docs, words, percent).drop("key", "comp")


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """join_components() with the key of each row's set, and a number for its component, null for empty sets."""
    heads = settle(row_heads(docs, widespread(docs, words), words, percent), "heads")
    # equal sets have equal heads and ranges
    distinct = heads.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("hot").alias("hot"), F.first("ranges").alias("ranges"))
    classes = settle(distinct.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = link_components(docs, classes, words, percent)
    named = classes.select("key", "node", "first_id")
    if labels is not None:
        placed = named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        smallest = placed.groupBy("comp").agg(F.min("first_id").alias("least"))
        named = placed.join(smallest, "comp").select("key", "least", "comp")
    else:
        named = named.select("key", F.col("first_id").alias("least"), F.col("node").alias("comp"))
    ids = heads.select("doc_id", "n", "key").join(named, "key", "left")
    return ids.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "key", "comp")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each component, that of the smallest id; rows without an id stay.

    Of rows that repeat an id, one stays for each of their components that the id names, that of the smallest text, and
    one without words.
    """
    found = settle(_placed(docs, words, percent).where("doc_id is not null"), "components")
    # ids that stay, and whether more than one row has them
    ids = settle(found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows")).where("doc_id = least").select("doc_id", "rows"), "kept")

    def of(where: str) -> DataFrame:
        some = ids.where(where)
        return docs.join(some, docs["doc_id"].cast("long") == some["doc_id"], "left_semi")

    out = of("rows = 1").unionByName(docs.where("doc_id is null"))
    if ids.where("rows > 1").isEmpty():
        drop_settled(found)
        return out
    own = lambda name: name + "_" * max(map(len, docs.columns))  # noqa: E731  # clashes with no column

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _key(shingles(t, words)))

    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(own("id")), F.col("key").alias(own("key")), F.col("comp").alias(own("comp"))).distinct()
    keyed = of("rows > 1").withColumn(own("set"), key_of(F.col("text").cast("string")))
    rows = keyed.join(first, (F.col("doc_id").cast("long") == F.col(own("id"))) & (F.col(own("set")) == F.col(own("key"))))
    order = Window.partitionBy("doc_id", own("comp")).orderBy(F.col("text").asc_nulls_last(), *(F.xxhash64(c) for c in docs.columns))
    return out.unionByName(rows.withColumn(own("nth"), F.row_number().over(order)).where(F.col(own("nth")) == 1).select(*docs.columns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), words=3, percent=90)
