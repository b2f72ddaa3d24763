"""Classifiers on held-out labels; vector operators against plain versions."""
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bitslice, covertree, quality, toxicity
from tidemark.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int, id string, rep string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    hubs = rng.normal(size=(12, 16))
    out = []
    for k in range(420):
        x = hubs[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.2, 1.0])
        out.append((k * 5, [float(v) for v in np.float32(x / np.linalg.norm(x))], int(rng.integers(3)) if k % 3 else 0))
    out += [(3000 + k, out[4][1], out[4][2]) for k in range(30)]  # copies
    out += [(4000, [0.0] * 16, 0), (4001, None, 0), (4002, [float("nan")] + [0.1] * 15, 0), (4003, [None] + [0.1] * 15, 0),
            (4004, [float("inf")] + [0.1] * 15, 1), (4005, out[4][1], None), (None, out[4][1], out[4][2]), (4006, [1.0, 2.0], 0), (4007, [], 0),
            (40, out[8][1], out[8][2])]
    return out


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_large_cells_are_parted_again(spark, rows, monkeypatch):
    """Every vector is in one cell, and cells that one round of few centres leaves too large are parted until they fit."""
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "CENTRES", 3)
    use = [(i, [float(x) for x in r[1]], "a") for i, r in enumerate(rows[:420])]
    classes = spark.createDataFrame(use, "rep long, embedding array<double>, label string").selectExpr(
        "named_struct('label', label, 'length', size(embedding)) AS group", "rep", "1L AS weight", "embedding")
    once = covertree.around_centres(classes.selectExpr("group", "'' AS cell", "rep", "weight", "embedding"))
    assert max(r["count"] for r in once.groupBy("cell").count().collect()) > 40
    got = covertree.parted(classes).select("cell", "rep").collect()
    assert sorted(r["rep"] for r in got) == [r[0] for r in use]
    assert max(Counter(r["cell"] for r in got).values()) <= 40


@pytest.mark.parametrize("block, centres", [(32, 64), (1024, 64), (64, 3)])
def test_near_vectors_plain(spark, rows, monkeypatch, block, centres):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "CENTRES", centres)
    got = sorted(map(tuple, covertree.near_vectors(vectors(spark, rows)).collect()), key=str)
    use = [r for r in rows if r[0] is not None and r[2] is not None and sound(r[1]) and any(r[1])]
    parent, links = {r[0]: r[0] for r in rows if r[0] is not None}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x, la) in enumerate(use):
        links[i] = 0
        for j, (b, y, lb) in enumerate(use):
            if i != j and la == lb and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.93:
                links[i] += 1
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    want, k = [], 0
    for r in rows:
        if r in use and r[0] is not None:
            want.append((r[0], links[use.index(r)], find(r[0]), find(r[0]) == r[0]))
        else:
            want.append((r[0], 0, r[0], True))
    assert got == sorted(want, key=str)
    assert max(links.values()) > 25


def test_cover_levels_nest_and_halve():
    points = covertree.unit(np.random.default_rng(0).normal(size=(200, 8)))
    levels = covertree.cover_levels(points, 0.1)
    top = levels[0][2][0]
    for depth, (centre, parent, radius) in enumerate(levels):
        assert len(set(centre.tolist())) == len(centre)
        if depth < len(levels) - 1:
            assert (radius <= top / 2 ** depth + 1e-12).all()
        if depth:
            assert set(levels[depth - 1][0].tolist()) <= set(centre.tolist())
            away = np.linalg.norm(points[centre] - points[levels[depth - 1][0][parent]], axis=1)
            assert (away <= levels[depth - 1][2][parent] + 1e-7).all()


@pytest.mark.parametrize("block", [64, 32768])
def test_top_k_plain(spark, rows, block):
    from pyspark.sql import functions as F
    got = sorted(map(tuple, bitslice.top_k(vectors(spark, rows), F.col("id") % 100 == 0, k=10, block_rows=block, query_rows=3).collect()))
    use = [(r[0], np.floor(1024 * np.float32(r[1]).astype(float)).astype(int)) for r in rows if sound(r[1]) and r[0] is not None]
    want = []
    for a, x in {a: x for a, x in use if a % 100 == 0}.items():
        best = sorted((-int(x @ y), b) for b, y in use if b != a and len(x) == len(y))[:10]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert got == sorted(want)


def test_slices_add_up():
    rng = np.random.default_rng(1)
    values, weights = rng.integers(0, 200, (150, 7)), rng.integers(0, 50, 7)
    total = bitslice.score_slices(bitslice.bitmaps(values, 8), weights, 20)
    bits = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")[:, :150].astype(np.int64)
    assert ((bits * (1 << np.arange(20))[:, None]).sum(0) == values @ weights).all()


def test_empty_vectors(spark):
    from pyspark.sql import functions as F
    empty = vectors(spark, [])
    assert covertree.near_vectors(empty).count() == 0 and bitslice.top_k(empty, F.col("id") % 100 == 0).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- classifiers

def held_out(frame, labels, label):
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    return [(r["predicted"], truth[r["doc_id"]], r["score"]) for r in frame.where("held_out").collect() if r["doc_id"] in truth]


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    return read("documents"), read("labels")


def test_toxicity_held_out(tables):
    docs, labels = tables
    out = toxicity.toxicity(docs, labels).cache()
    assert out.count() == docs.count()
    rows = held_out(out, labels, "toxic")
    caught = [p for p, y, _ in rows if y == 1]
    wrong = [p for p, y, _ in rows if y == 0]
    assert np.mean(caught) > 0.75 and np.mean(wrong) < 0.02
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.limit(500).collect())


def test_quality_held_out(tables):
    docs, labels = tables
    rows = held_out(quality.quality(docs, labels), labels, "quality")
    assert np.mean([p == y for p, y, _ in rows]) > 0.97


def test_classifier_edges(spark, make_docs):
    rows = [(k, "you idiot moron " + "word " * k if k % 2 else "a kind calm text " + "word " * k) for k in range(60)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1, rows[1][1]), (2000, "long " * 50000)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(k, k % 2, k % 2, "x") for k in range(60)] + [(None, 1, 1, "x"), (3, None, None, "x"), (9999, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    none = labels.limit(0)
    for operator in (toxicity.toxicity, quality.quality):
        for given in (labels, none, labels.where("toxic = 1")):
            out = operator(docs, given).collect()
            assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
        assert operator(docs.limit(0), labels).count() == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert not {r["doc_id"] for r in kept.collect()} & {k for k in range(1, 60, 2)}


def test_factorisation_identity():
    rng = np.random.default_rng(4)
    x, w, v = rng.random((3, 9)), rng.random(9), rng.random((9, 4))
    plain = [0.5 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert np.allclose(quality.margin(x, w, v, 0.5)[0], plain)


def test_features_do_not_depend_on_the_batch():
    texts = ["One two\nthree, 4!", "", "Zwei Wörter", "a a a b\n\n\na"]
    assert np.array_equal(quality.features(pa.array(texts)), np.concatenate([quality.features(pa.array([t])) for t in texts]))
