"""Clusters, hard negatives and toxicity against plain Python, on small tables and awkward rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from annalist.llm import clusters, negatives, toxicity
from annalist.llm.queries import QUERIES
from annalist.llm.vectors import LARGEST, products, squared_distances

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, vector array<float>, cluster string, rank string, x string, q string"


def floored(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def rows_of(n, dim, seed, copies=0, bad=True):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), rng.normal(size=dim).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(copies)]
    rows += [(rows[5][0], 1, rows[6][2]), (rows[7][0], rows[7][1], rows[7][2])]  # ids given again, with other and equal vectors
    if bad:
        rows += [(9001, 1, None), (9002, 1, [None] * dim), (9003, 1, [float("nan")] * dim), (9004, 1, [float("inf")] * dim), (9005, 1, []), (9006, 1, [1.0] * (dim - 1)), (None, 2, rows[1][2]), (9007, None, rows[2][2])]
    return [(*r, "a", "b", "c", "d") for r in rows]


def usable(v, dim=None):
    return v is not None and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, dim, seed):
    kept = [(i, floored(v)) for i, _, v, *_ in rows if usable(v, dim)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [assign(v)[1] for _, v in kept]
        for j in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *assign(v)) for i, v in kept]
    total = lambda j: min(sum(d for _, d, o in found if j in (None, o)), LARGEST)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, j, min(d, LARGEST), total(j), total(None), sha(cents[j])) for i, d, j in found), key=repr)


@pytest.mark.parametrize(("n", "copies", "dim", "wide"), [(120, 60, 12, 0), (30, 0, 8, 1e6), (30, 0, 8, 3e38), (3, 0, 8, 0), (40, 0, 5, 0)])
def test_clusters(spark, n, copies, dim, wide):
    rows = rows_of(max(n, 8), dim, n, copies) if n > 3 else [(i, 0, [float(i)] * dim, "a", "b", "c", "d") for i in range(n)]
    if wide:
        rows.append((777, 0, [wide] * dim, "a", "b", "c", "d"))
        rows.append((778, 0, [-wide] * dim, "a", "b", "c", "d"))
    expected = plain_clusters(rows, 10, 3, dim, 2) if wide < 1e30 else None
    out = clusters.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), 10, 3, dim)
    got = out.drop("measured").collect()
    if expected:
        assert sorted(map(tuple, got), key=repr) == expected
    else:  # components beyond 2^62 count as that, distances are told as the largest long
        far = {r["vec_id"]: r for r in got}
        assert far[777]["distance"] == 0 or far[777]["distance"] == LARGEST or far[777]["cluster"] != far[778]["cluster"]
    assert out.where("measured < 1 or measured > 10").count() == 0


def test_clusters_of_an_empty_table(spark):
    out = clusters.cluster_vectors(spark.createDataFrame([], VECTORS))
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "cluster", "distance"]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 1 << 40):
        x = (rng.normal(size=(300, 20)) * scale).astype(np.int64)
        c = (rng.normal(size=(9, 20)) * scale / 3).astype(np.int64)
        codes, step, rests = clusters.compress(x)
        norms = clusters.segment_norms(x)
        bounds = clusters.lower_bounds(codes, step, norms, rests, c)
        exact = np.array([squared_distances(x, np.broadcast_to(k, x.shape)) for k in c], dtype=object).T
        assert (bounds <= exact.astype(float)).all()
        at, d, measured = clusters.nearest(x, codes, step, norms, rests, c)
        assert (exact[np.arange(300), at] == d).all() and all(int(r.argmin()) == a for r, a in zip(exact, at, strict=True))
        if scale > 3:
            assert measured.mean() < 6


def test_products_are_exact():
    a = np.array([[1 << 61, -(1 << 61)], [3, 4]])
    assert products(a, a).tolist() == [[LARGEST, -(1 << 61)], [-(1 << 61), 25]]
    b = np.array([[1 << 27, 3], [1, 1]])
    assert products(b, b).tolist() == [[(1 << 54) + 9, (1 << 27) + 3], [(1 << 27) + 3, 2]]


def plain_negatives(rows, every, k, low):
    kept = [(i, lab, floored(v)) for i, lab, v, *_ in rows if i is not None and lab is not None and usable(v)]
    out = []
    for a, lab, v in kept:
        if a % every:
            continue
        score = lambda w: sum(p * q for p, q in zip(v, w, strict=False))  # noqa: B023, E731  # shorter ones end in zeros
        others = sorted((-score(w), i, m == lab) for i, m, w in kept if i != a)
        for s, p, _ in [o for o in others if o[2]][:k]:
            fit = [(-t, i) for t, i, same in others if not same and low * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(fit[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "copies", "dim"), [(200, 0, 6), (150, 90, 3), (60, 10, 16)])
def test_negatives(spark, monkeypatch, n, copies, dim):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "FIRST", 2)
    monkeypatch.setattr(negatives, "GROW", 2)
    rows = [*rows_of(n, dim, n, copies), (5000, 2, [1e6] * dim, "a", "b", "c", "d"), (5001, 3, [0.0] * dim, "a", "b", "c", "d")]
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), every=10).collect()
    expected = plain_negatives(rows, 10, 5, 80)
    assert len(expected) > 50 and sorted(map(tuple, got)) == expected


def test_negatives_without_anchors_or_rows(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame(rows_of(20, 4, 1)[1:9], VECTORS), every=1000).count() == 0
    one = [(100, 1, [1.0, 2.0], "a", "b", "c", "d"), (101, 1, [-1.0, -2.0], "a", "b", "c", "d"), (102, 2, [1.0, 0.0], "a", "b", "c", "d")]
    assert negatives.mine(spark.createDataFrame(one, VECTORS)).count() == 0  # its only positive scores below 0


def test_bounds_of_blocks_hold(spark):
    rows = spark.createDataFrame(rows_of(300, 5, 9, 0, False), VECTORS).selectExpr("vec_id", "cast(label as long) as label", "transform(vector, v -> cast(floor(256D * v) as long)) as x")
    pivots = np.array([r["x"] for r in rows.limit(4).collect()], dtype=float)
    blocks = negatives._index(rows, 5, pivots, 16)
    known = negatives._Directory(blocks, pivots)
    q = np.array([[300, -20, 5, 7, 90], [0, 0, 0, 0, 0], [90_000, 1, 1, 1, 1]])
    upper, lower = known.bounds(q)
    held = {r["block"]: np.frombuffer(r["x"], dtype=f"i{r['width']}").reshape(-1, 5).astype(np.int64) for r in blocks.collect()}
    assert sum(map(len, held.values())) == rows.count() and max(map(len, held.values())) <= 16
    for i, b in enumerate(known.block):
        s = products(q, held[int(b)])
        assert (s.max(axis=1) <= upper[:, i]).all() and (s.min(axis=1) >= lower[:, i]).all()


def test_buckets_are_words_stems_pairs_and_skips():
    known = toxicity._Words()
    at = lambda t: set(toxicity.buckets(t, known).tolist())
    assert at(None) == at("") == at(" \n") == set()
    assert at("Idiot,") == at("idiot") and len(at("idiot")) == 2  # itself and its first four letters
    assert len(at("one two")) == 3 and len(at("one two six")) == 3 + 2 + 1 and len(at("one two six ten")) == 4 + 3 + 2 + 1
    assert at("one two") != at("two one") and at("one x six") & at("one y six") > at("one") | at("six")
    weighed = toxicity._Words(np.array(sorted(at("worthless"))))
    assert set(toxicity.buckets("worthless", weighed).tolist()) == at("worthless") and len(toxicity.buckets("innocent", weighed)) == 1


def test_ftrl_follows_its_formula():
    model = toxicity.Ftrl(2)
    z, n = [0.0] * 3, [0.0] * 3
    for at, y in [((0, 2), 1), ((1, 2), 0), ((0, 1, 2), 1)] * 9:
        w = [0.0 if abs(z[i]) <= (toxicity.L1 if i < 2 else 0) else -(z[i] - math.copysign(toxicity.L1 if i < 2 else 0, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) for i in range(3)]
        p = 1 / (1 + math.exp(-sum(w[i] for i in at)))
        assert model.learn(np.array(at), y) == pytest.approx(p)
        for i in at:
            g = p - y
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += g * g
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)


DOCS = "doc_id long, text string, lang string, toxic string, score string, at string"


def test_toxicity_learns_and_leaves_clean_texts_alone(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    text = lambda bad: " ".join([*rng.choice(words, 40), *(["scoundrel"] if bad == 1 else ["really", "vile"] if bad == 2 else ["really"] if rng.random() < 0.3 else ["vile"] if rng.random() < 0.3 else []), *rng.choice(words, 40)])
    kind = [i % 3 if i % 2 else 0 for i in range(900)]
    docs = [(i, text(k), "en", "x", "y", "z") for i, k in enumerate(kind)]
    docs += [(None, "scoundrel", None, None, None, None), (2000, None, None, None, None, None), (2001, "", "en", None, None, None), (2001, "", "en", None, None, None), (2002, "w1 " * 200_000 + "scoundrel", "en", None, None, None)]
    table = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, 1, int(k > 0)) for i, k in enumerate(kind)] + [(3, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(toxicity.labelled(table.where("doc_id % 5 <> 0"), labels))
    assert len(model[0]) < 400
    out = toxicity.score(table, model).collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 5 == 0]
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert sum(r["predicted"] == (kind[r["doc_id"]] > 0) for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert by[2002]["predicted"] == 1 and by[2000]["predicted"] == 0 and by[2000]["score"] == by[2001]["score"]
    assert toxicity.score(table.limit(0), model).count() == 0
    again = toxicity.learn(toxicity.labelled(table.where("doc_id % 5 <> 0").repartition(7), labels))
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all()
    nothing = toxicity.score(table, toxicity.learn(toxicity.labelled(table, labels.limit(0)))).collect()
    assert {r["score"] for r in nothing} == {0.0} and len(nothing) == len(docs)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op11_toxicity"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [rows[i]["predicted"] for i, t in truth.items() if rows[i]["held_out"] and not t]
    assert sum(clean) <= 0.02 * len(clean)
