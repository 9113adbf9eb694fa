"""Hard negatives by one-dimensional distance keys.

Inner products become distances: a vector x whose norm lies within its grade's M is augmented with sqrt(M^2 - |x|^2), an
anchor q with 0, so that |q' - x'|^2 = |q|^2 + M^2 - 2 qx. Rows are keyed by (grade, nearest pivot, distance to it) and
stored in that order, cut into blocks that a small directory describes by the interval of their keys. By the triangle
inequality all scores of a block have an upper and a lower bound for an anchor; the blocks of the greatest upper bounds
lie in the annuli around the anchor's own keys. A scan reads those first, then ever more, until no block that is left
can hold a row that would change the answer. Scores are exact integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import drop_settled, map_batches, settle, table
from annalist.llm.vectors import LARGEST, finite, magnitude, matrix, products, whole

#: Pivots, the rows of the smallest hashes of their ids.
PIVOTS = 16
#: A block holds this many rows, or more once there would be more than BLOCKS of them, so that the directory stays small.
BLOCK_ROWS, BLOCKS = 512, 1 << 16
#: Grades of the norm in each doubling of its square.
GRADES = 4
#: Anchors handled at once.
PACK = 64
#: Blocks read for an anchor in the first scan, and how many times more in each one after it.
FIRST, GROW = 8, 8
#: Bounds give way by this share of the squares they are made of, far more than doubles lose.
SLACK = 1e-10
POSITIVES, NEGATIVES, LOW = 5, 5, 80
_BLOCK = "block long, grade int, pivot int, low double, high double, ids binary, labels binary, width int, x binary"


def _grade(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grade of each row and the square of its M."""
    squares = (x.astype(np.float64) ** 2).sum(axis=1)
    grade = np.ceil(GRADES * np.log2(np.maximum(squares, 1.0)) + 1e-9).astype(np.int32)
    return grade, squares


def _reach(grade: np.ndarray) -> np.ndarray:
    return np.exp2(np.asarray(grade, dtype=np.float64) / GRADES)


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Of augmented rows to augmented pivots. lift: the rows' last component; reach: M^2 for each row."""
    own = (pivots**2).sum(axis=1)
    out = np.empty((len(x), len(pivots)))
    for p, pivot in enumerate(pivots):
        out[:, p] = np.sqrt(((x - pivot) ** 2).sum(axis=1) + (lift - np.sqrt(np.maximum(reach - own[p], 0))) ** 2)
    return out


def _index(rows: DataFrame, width: int, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """Blocks of rows (vec_id, label, x), sorted by grade, pivot, distance and id."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = matrix(batch.column(2), width)
            grade, squares = _grade(x)
            reach = _reach(grade)
            d = _distances(x.astype(np.float64), np.sqrt(np.maximum(reach - squares, 0)), pivots, reach)
            pivot = d.argmin(axis=1)
            yield {"grade": grade, "pivot": pivot.astype(np.int32), "distance": d[np.arange(len(d)), pivot], "vec_id": batch.column(0), "label": batch.column(1), "x": batch.column(2)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        names, begun = count_up(TaskContext.get().partitionId() << 32), []

        def block(parts: list[pa.RecordBatch]) -> dict:
            t = pa.Table.from_batches(parts).combine_chunks()
            x = matrix(t.column("x").combine_chunks(), width)
            small = next(d for d in (np.int16, np.int32, np.int64) if d is np.int64 or magnitude(x) <= np.iinfo(d).max)
            keys = np.asarray(t.column("distance"))
            own = {"block": next(names), "grade": t.column("grade")[0].as_py(), "pivot": t.column("pivot")[0].as_py(), "low": keys[0], "high": keys[-1], "width": np.dtype(small).itemsize}
            packed = {"ids": np.asarray(t.column("vec_id")).tobytes(), "labels": np.asarray(t.column("label")).tobytes(), "x": x.astype(small).tobytes()}
            return {k: [v] for k, v in (own | packed).items()}

        last = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            start = 0
            for at in range(batch.num_rows):
                here = tuple(keys[at])
                held = sum(b.num_rows for b in begun) + at - start
                if held and (held >= block_rows or here != last):
                    if at > start:
                        begun.append(batch.slice(start, at - start))
                    yield block(begun)
                    begun, start = [], at
                last = here
            if start < batch.num_rows:
                begun.append(batch.slice(start))
        if begun:
            yield block(begun)

    order = ("grade", "pivot", "distance", "vec_id")
    ordered = map_batches(rows, keyed, "grade int, pivot int, distance double, vec_id long, label long, x array<long>").repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(map_batches(ordered, cut, _BLOCK), "blocks")


class _Directory:
    """What is known of all blocks: at most BLOCKS and the cuts between pivots, grades and partitions."""

    def __init__(self, blocks: DataFrame, pivots: np.ndarray):
        t = blocks.select("block", "grade", "pivot", "low", "high").orderBy("block").toArrow()
        self.block, self.grade, self.pivot, self.low, self.high = (np.asarray(c.combine_chunks()) for c in t.columns)
        self.pivots = pivots
        self.grades, self.at = np.unique(self.grade, return_inverse=True)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and block: numbers that no score of the block is above, or below."""
        x = q.astype(np.float64)
        squares = (x**2).sum(axis=1)[:, None]
        reach = _reach(self.grades)
        d = np.stack([_distances(x, np.zeros(len(x)), self.pivots, np.full(len(x), r)) for r in reach], axis=1)[:, self.at, self.pivot]
        near, far = np.maximum(np.maximum(self.low - d, d - self.high), 0), d + self.high
        both = squares + reach[self.at]
        loose = SLACK * (both + far**2) + 1
        return (both - near**2) / 2 + loose, (both - far**2) / 2 - loose


def _requests(queries: DataFrame, directory, scan: int) -> DataFrame:
    """A row for each block that anchors still need in a scan, with the anchors that need it.

    queries: q, vec_id, label, x, floors and caps (a score lies within them), found (for each pair of them the k-th
    score so far, or null).
    """
    begin, end = (FIRST * GROW ** (scan - 1) if scan else 0), FIRST * GROW**scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = directory.value
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                part = batch.slice(start, PACK)
                floors, caps, found = (part.column(i).to_pylist() for i in (4, 5, 6))
                needs = [[max(f, n) if n is not None else f for f, n in zip(a, b, strict=True)] for a, b in zip(floors, found, strict=True)]
                x = matrix(part.column(3), known.pivots.shape[1])
                upper, lower = known.bounds(x)
                asked: dict[int, list[int]] = {}
                for i, need in enumerate(needs):
                    some = np.flatnonzero(lower[i] <= float(max(caps[i])))  # the same in every scan
                    order = some[np.argsort(-upper[i][some], kind="stable")][begin:end]
                    order = order[upper[i][order] >= float(min(need))]
                    for b in order.tolist():
                        asked.setdefault(b, []).append(i)
                out: dict[str, list] = {c: [] for c in ("block", "q", "own", "label", "x", "floors", "caps")}
                q, own, label = (np.asarray(part.column(i)) for i in range(3))
                for b, rows in asked.items():
                    out["block"].append(int(known.block[b]))
                    for name, values in (("q", q[rows]), ("own", own[rows]), ("label", label[rows]), ("x", x[rows].ravel())):
                        out[name].append(values)
                    out["floors"].append([needs[i] for i in rows])
                    out["caps"].append([caps[i] for i in rows])
                yield out

    return map_batches(queries, run, "block long, q array<long>, own array<long>, label array<long>, x array<long>, floors array<array<long>>, caps array<array<long>>")


def _scan(requests: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """q, no, score and vec_id: for each anchor and pair of floor and cap the k best rows of each block, ties by smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() if name not in ("x", "qx") else batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                ids, labels = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64)
                x = np.frombuffer(row["x"].as_py(), dtype=f"i{row['width']}").reshape(len(ids), -1).astype(np.int64)
                scores = products(np.asarray(row["qx"].values).reshape(len(row["q"]), -1), x)
                out: list[tuple[np.ndarray, ...]] = []
                for i, q in enumerate(row["q"]):
                    allowed = ((labels == row["label"][i]) == same) & (ids != row["own"][i])
                    for no, (floor, cap) in enumerate(zip(row["floors"][i], row["caps"][i], strict=True)):
                        at = np.flatnonzero(allowed & (scores[i] >= floor) & (scores[i] <= cap))
                        at = at[np.lexsort((ids[at], -scores[i][at]))][:k]
                        if len(at):
                            out.append((np.full(len(at), q), np.full(len(at), no), scores[i][at], ids[at]))
                if out:
                    q, no, score, vec_id = map(np.concatenate, zip(*out, strict=True))
                    yield {"q": q, "no": no.astype(np.int32), "score": score, "vec_id": vec_id}

    asked = requests.select("block", "q", "own", "label", F.col("x").alias("qx"), "floors", "caps").join(blocks.select("block", "ids", "labels", "width", "x"), "block").drop("block")
    return map_batches(asked, run, "q long, no int, score long, vec_id long")


def _best(queries: DataFrame, blocks: DataFrame, directory, same: bool, k: int) -> DataFrame:
    """q, no, score, vec_id and rank of the k best rows for each anchor and pair of floor and cap; queries as in _requests, without found."""
    found = None
    ranked = Window.partitionBy("q", "no").orderBy(F.desc("score"), "vec_id")
    for scan in count_up():
        known = queries.withColumn("found", F.transform("floors", lambda _: F.lit(None).cast("long")))
        if found is not None:
            kth = found.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("kth"))
            known = queries.join(kth, "q", "left").select(*queries.columns, F.transform("floors", lambda _, no: F.try_element_at("kth", no.cast("int"))).alias("found"))
        requests = settle(_requests(known, directory, scan), "requests")
        if requests.isEmpty():
            drop_settled(requests)
            return found
        new = _scan(requests, blocks, same, k)
        every = new if found is None else new.unionByName(found.drop("rank"))
        now = settle(every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "found")
        for old in (requests, found):
            if old is not None:
                drop_settled(old)
        found = now


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, label, vector).

    Anchors are rows whose id is divisible by `every`. Components are floor(256 * x), within 2^62 either way; a score is
    an integer inner product, told within a long. A positive of a score below 0 has no negatives, as none lies between
    low hundredths of that score and it. Rows with a null id, label or vector, or a null or non-finite component, take no
    part. A shorter vector counts as continued by zeros. Rows of an anchor's own id are no candidates of it; a repeated
    row of another id counts each time, and a repeated anchor is mined each time. An empty table, or one without
    anchors, gives no rows. Other columns are passed over.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    rows = settle(usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("vector")).alias("x")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    width = max(size["width"] or 1, 1)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PIVOTS).collect()
    pivots = np.zeros((max(len(chosen), 1), width))
    for p, r in zip(pivots, chosen, strict=False):
        p[: len(r["x"])] = r["x"]
    blocks = _index(rows, width, pivots, max(BLOCK_ROWS, -(-size["n"] // BLOCKS)))
    directory = spark.sparkContext.broadcast(_Directory(blocks, pivots))
    anchors = settle(rows.where(F.col("vec_id") % every == 0).withColumn("q", F.monotonically_increasing_id()).select("q", "vec_id", "label", "x"), "anchors")
    drop_settled(rows)
    free = F.array(F.lit(-LARGEST - 1).cast("long")), F.array(F.lit(LARGEST).cast("long"))
    found = _best(anchors.withColumns({"floors": free[0], "caps": free[1]}), blocks, directory, True, positives)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if found is None:
        return spark.createDataFrame([], schema)
    # the lowest score allowed: low hundredths of the positive's, rounded up
    less = F.expr(f"positive_score div 100 * {100 - low} + (positive_score % 100) * {100 - low} div 100")
    of = found.where("score >= 0").select("q", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    asked = settle(of.withColumn("floor", F.col("positive_score") - less), "positives")
    wanted = asked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("p", "floor", "positive_score"))).alias("w")).select("q", F.col("w.floor").alias("floors"), F.col("w.positive_score").alias("caps"))
    queries = settle(anchors.join(wanted, "q").select("q", "vec_id", "label", "x", "floors", "caps"), "wanted")
    hard = _best(queries, blocks, directory, False, negatives)
    drop_settled(queries)
    drop_settled(blocks)
    if hard is None:
        return spark.createDataFrame([], schema)
    # positives are numbered from 1 without gaps, so a pair's number is its rank less 1
    named = hard.withColumn("p", F.col("no") + 1).join(asked, ["q", "p"]).join(anchors.select("q", F.col("vec_id").alias("anchor_id")), "q")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector")))
