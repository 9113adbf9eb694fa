"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors form one node. A neighbour graph starts from random-hyperplane buckets and is improved by joins: around
every node its neighbours and reverse neighbours meet, and each keeps the partners that are nearer than its worst one.
Queries walk the graph greedily with a beam: the nearest nodes not yet expanded are joined with their links until none
is left. While the graph grows vectors travel as 8-bit integers, each with its own step; search and results use the original ones in double
precision.
"""

from __future__ import annotations

from itertools import count as count_up

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import map_arrow, settle, table

#: Links of a node; reverse links taken beside them; rounds of descent; random-hyperplane tables of the start.
LINKS, REVERSE, ROUNDS, TABLES = 20, 12, 4, 4
#: A start bucket is about so large; a larger one is dealt into parts of this size at random.
BUCKET = 256
#: Partners offered to a node around one common neighbour.
OFFERS = 8
#: Nodes that a query keeps, and nodes that it expands in one join.
BEAM, EXPAND = 320, 32
#: Start nodes of a query beside its own links.
ENTRIES = 32
NEAREST = 10
SEED = 7
_SALTS = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, without null, zero, null-holding or non-finite ones and those of a rarer length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    good = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0))
    sizes = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("x") == (sizes["n"] if sizes else 0))


def nodes_of(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x): one for each different vector, named by its smallest id; members (node, vec_id), each id once."""
    named = settle(good.groupBy("x").agg(F.min("vec_id").alias("node")), "nodes")
    members = good.join(named, "x").select("node", "vec_id").distinct()
    return named.select("node", "x"), members


def _quantised(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with q, the vector in 8-bit steps of its own largest component, and the number of components."""
    top = nodes.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("m"), F.max(F.size("x")).alias("n")).first()
    unit = top["m"] or 1.0  # squares of the table's largest components stay finite

    def run(part: dict) -> dict:
        out = []
        for x in part["x"]:
            x = np.array(x) / unit
            step = max(np.abs(x).max() / 127.0, np.finfo(float).tiny)
            out.append(np.float64(step).tobytes() + np.rint(x / step).astype(np.int8).tobytes())
        return {"node": part["node"], "q": out}

    return map_arrow(nodes.select("node", "x"), run, "node long, q binary", None), top["n"] or 0


def _decoded(coded: list[bytes], width: int) -> np.ndarray:
    """The vectors of their codes, in units of the table's largest component."""
    rows = np.frombuffer(b"".join(coded), dtype=[("step", "f8"), ("codes", "i1", (width,))])
    return rows["codes"] * rows["step"][:, None]


def _pairs(ids: np.ndarray, x: np.ndarray, most: int, radius: np.ndarray | None = None, fresh: np.ndarray | None = None):
    """For each row its nearest others (at most `most`), nearer than its radius, not both old: from, to, distance."""
    norms = (x * x).sum(axis=1)
    d = np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0.0)
    # 30 bits, so that a pair has the same distance wherever it meets
    digits, power = np.frexp(d)
    d = np.ldexp(np.rint(digits * (1 << 30)) / (1 << 30), power)
    np.fill_diagonal(d, np.inf)
    if fresh is not None:
        d[~(fresh[:, None] | fresh[None, :])] = np.inf
    if radius is not None:
        d[d >= radius[:, None]] = np.inf
    k = min(most, len(ids) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(d, axis=1)[:, :k]
    dist = np.take_along_axis(d, near, 1)
    a, b = np.nonzero(np.isfinite(dist))
    return ids[a], ids[near[a, b]], dist[a, b]


EDGE = "u long, v long, d double"


def start_graph(coded: DataFrame, width: int, count: int) -> DataFrame:
    """Edges between nodes that fall into one bucket of a table of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / BUCKET))))
    planes = np.random.default_rng(SEED).standard_normal((TABLES, bits, width)).astype(np.float32)

    def bucket(part: dict) -> dict:
        x = _decoded(part["q"], width)
        out: dict[str, list] = {"t": [], "b": [], "node": [], "q": []}
        for t in range(TABLES):
            codes = ((x @ planes[t].T > 0) @ (1 << np.arange(bits))) if bits else np.zeros(len(x), dtype=np.int64)
            out["t"] += [t] * len(x)
            out["b"] += codes.tolist()
            out["node"] += part["node"]
            out["q"] += part["q"]
        return out

    dealt = map_arrow(coded, bucket, "t int, b long, node long, q binary", None)
    sizes = dealt.groupBy("t", "b").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node", "t"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(2 * BUCKET)))).alias("s")
    # sizes has under 2 * count / BUCKET + 1 rows a table; Spark chooses how to join
    grouped = dealt.join(sizes, ["t", "b"]).select("t", "b", part, "node", "q").groupBy("t", "b", "s").agg(F.collect_list(F.struct("node", "q")).alias("m"))

    def near(part: dict) -> dict:
        u, v, d = [], [], []
        for m in part["m"]:
            if len(m) > 1:
                ids = np.array([r["node"] for r in m])
                x = _decoded([r["q"] for r in m], width)
                a, b, dist = _pairs(ids, x, LINKS)
                u += a.tolist()
                v += b.tolist()
                d += dist.tolist()
        return {"u": u, "v": v, "d": d}

    return map_arrow(grouped.select("m"), near, EDGE, None)


def _nearest_links(edges: DataFrame) -> DataFrame:
    """The LINKS nearest different links of each node; a link seen before isn't fresh."""
    rank = F.dense_rank().over(Window.partitionBy("u").orderBy("d", "v"))
    top = edges.withColumn("r", rank).where(F.col("r") <= LINKS)
    return top.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))


def build_graph(coded: DataFrame, width: int, count: int) -> DataFrame:
    """Edges u, v, d (in coded units) of the neighbour graph."""
    coded = settle(coded, "coded")
    graph = settle(_nearest_links(start_graph(coded, width, count).withColumn("fresh", F.lit(True))), "graph")
    for _ in range(ROUNDS):
        back = graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "fresh").withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("x")))).where(F.col("r") <= REVERSE).drop("r")
        around = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "fresh").unionByName(back)
        radius = graph.groupBy("u").agg(F.when(F.count("*") >= LINKS, F.max("d")).otherwise(F.lit(float("inf"))).alias("radius"))
        points = coded.join(radius, coded["node"] == radius["u"], "left").select("node", "q", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        # at most LINKS + REVERSE members each
        met = around.join(points, around["x"] == points["node"]).groupBy("w").agg(F.collect_list(F.struct("x", "fresh", "q", "radius")).alias("m"))

        def offer(part: dict) -> dict:
            u, v, d = [], [], []
            for m in part["m"]:
                rows = list({r["x"]: r for r in sorted(m, key=lambda r: r["fresh"])}.values())
                if len(rows) < 2 or not any(r["fresh"] for r in rows):
                    continue
                x = _decoded([r["q"] for r in rows], width)
                a, b, dist = _pairs(np.array([r["x"] for r in rows]), x, OFFERS, np.array([r["radius"] for r in rows]), np.array([r["fresh"] for r in rows]))
                u += a.tolist()
                v += b.tolist()
                d += dist.tolist()
            return {"u": u, "v": v, "d": d}

        offers = map_arrow(met.select("m"), offer, EDGE, None).withColumn("fresh", F.lit(True))
        graph = settle(_nearest_links(graph.withColumn("fresh", F.lit(False)).unionByName(offers)), "graph")
        if graph.where("fresh").count() < 0.01 * LINKS * max(count, 1):
            break
    return graph


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """q, node, dist: for each query (q, qx, own node `home`) the nodes of its final beam.

    A walk ends when all nodes of its beam are expanded; each is once at most, so that every walk ends.
    """
    # links both ways, so that every node can be left and reached; reverse ones are limited as in the descent
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("r") <= 2 * LINKS).drop("r")
    links = settle(graph.select("u", "v").union(back.select("u", "v")).distinct().groupBy("u").agg(F.collect_list("v").alias("to")), "links")
    vectors = nodes.select(F.col("node").alias("n"), "x")
    far = F.aggregate(F.zip_with("x", "qx", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    entries = nodes.select("node").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(ENTRIES)
    first = queries.select("q", "home").join(F.broadcast(entries)).select("q", "node").union(queries.select("q", F.col("home").alias("node")))
    beam = None
    seen = first.distinct()
    frontier = seen
    for hop in count_up():
        scored = frontier.join(vectors, frontier["node"] == vectors["n"]).join(queries.select("q", "qx"), "q").select("q", "node", far.alias("dist"), F.lit(False).alias("done"))
        pool = scored if beam is None else beam.unionByName(scored)
        ranked = pool.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "node"))).where(F.col("r") <= BEAM)
        turn = F.row_number().over(Window.partitionBy("q", "done").orderBy("dist", "node"))
        state = settle(ranked.drop("r").withColumn("turn", F.when(F.col("done"), F.lit(0)).otherwise(turn)), "beam")
        chosen = state.where((F.col("turn") > 0) & (F.col("turn") <= EXPAND)).select("q", "node")
        beam = state.select("q", "node", "dist", (F.col("done") | (F.col("turn") <= EXPAND)).alias("done"))
        if chosen.isEmpty():
            break
        reached = chosen.join(links, chosen["node"] == links["u"]).select("q", F.explode("to").alias("node")).distinct()
        frontier = settle(reached.join(seen, ["q", "node"], "left_anti"), "frontier")
        seen = settle(seen.union(frontier), "seen") if hop % 4 == 3 else seen.union(frontier)
    return beam.select("q", "node", F.sqrt("dist").alias("dist"))


def nearest(vectors: DataFrame, every: int = 100, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by `every`.

    Vectors that are null, zero, hold null or non-finite components or have a rarer length take no part; equal vectors
    are found at their distances, smaller ids first; an id given twice with the same vector counts once; without usable
    vectors there are no rows.
    """
    good = settle(usable(vectors), "vectors")
    nodes, members = nodes_of(good)
    members = settle(members, "members")
    count = nodes.count()
    coded, width = _quantised(nodes)
    graph = build_graph(coded, width, count)
    asked = members.where(F.col("vec_id") % every == 0).join(nodes, "node")
    # queries that share a vector share the walk
    queries = settle(asked.groupBy(F.col("node").alias("q")).agg(F.first("x").alias("qx")).withColumn("home", F.col("q")), "queries")
    found = search(graph, nodes, queries)
    # the k + 1 smallest ids of a vector are all that any query can need of it
    salted = members.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("node", "s").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("node", "vec_id")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "node"))).where(F.col("r") <= k + 1).drop("r")
    ids = settle(top.join(few, "node"), "found")
    per = members.where(F.col("vec_id") % every == 0).select(F.col("node").alias("q"), F.col("vec_id").alias("query_id"))
    answers = per.join(ids, "q").where("vec_id != query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("dist").alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
