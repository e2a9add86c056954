import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushscan.llm import gridjoin, neighbours
from hushscan.llm.common import Scratch, components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, score int"


def fixture(n=260, dim=12, seed=4):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(9, dim))
    rows = []
    for i in range(n):
        v = centres[i % 9] + random.normal(size=dim) * random.choice([0.05, 0.2, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, "c", 1))
    rows += [(1000 + i, rows[i % 4][1], 0, "c", 1) for i in range(40)]  # copies
    rows += [(2000 + i, [float(np.float32(x * 3)) for x in rows[i][1]], 0, "c", 1) for i in range(5)]
    rows += [(3000, None, 0, "c", 1), (3050, [0.0] * dim, 0, "c", 1), (3100, [float("nan")] + [1.0] * (dim - 1), 0, "c", 1),
             (3150, [None] + [1.0] * (dim - 1), 0, "c", 1), (3200, [], 0, "c", 1), (3250, [float("inf")] * dim, 0, "c", 1),
             (3300, [1.0, 2.0], 0, "c", 1), (3350, [1.0, float(np.float32(2.1))], 0, "c", 1), (None, rows[0][1], 0, "c", 1), (7, rows[7][1], 0, "c", 1)]
    return rows


def sound(row):
    v = row[1]
    return row[0] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 32)


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_links_against_brute_force(spark, small_blocks, threshold):
    rows = fixture()
    got = gridjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold).collect()
    assert len(got) == len(rows)
    good = [r for r in rows if sound(r)]
    links, parent = {}, {r[0]: r[0] for r in good}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= threshold:
                links[i] = links.get(i, 0) + 1
                j = good.index(b) if good.count(b) == 1 else next(k for k in range(i + 1, len(good)) if good[k] is b)
                links[j] = links.get(j, 0) + 1
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    want = sorted((r[0], links.get(i, 0), root(r[0]), r[0] == root(r[0])) for i, r in enumerate(good))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id in parent) == want
    for r in got:
        if r.vec_id is None or r.vec_id not in parent:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_blocks_that_are_surely_near_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", 8)
    random = np.random.default_rng(1)
    base = random.normal(size=6)
    rows = [(i, [float(x) for x in base + random.normal(size=6) * 1e-3], 0, "", 0) for i in range(40)]
    got = gridjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.9).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}


def test_neighbours_against_brute_force(spark, small_blocks):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {r[0]: r[1] for r in rows if sound(r)}
    for query in [i for i in good if i % 50 == 0]:
        scored = [(-round(cosine(good[query], v), 12), i) for i, v in good.items() if i != query and len(v) == len(good[query])]
        want = [i for _, i in sorted(scored)[:5]]
        mine = sorted(got.pop(query))
        assert [m[0] for m in mine] == list(range(1, len(want) + 1)) and [m[1] for m in mine] == want
        assert all(abs(m[2] - cosine(good[query], good[m[1]])) < 1e-12 for m in mine)
    assert not got


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert gridjoin.near_duplicates(df).collect() == []
    assert neighbours.nearest(df, F.lit(True)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 200 + i) for i in range(50)] + [(3, 3), (9, 8), (8, 9)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{200 + i: 5 for i in range(50)}, 8: 8, 9: 8}
