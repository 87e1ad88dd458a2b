"""Top rows, percentiles, nearest vectors and clusters against brute force, with dirty and empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnmark.llm import clusters, percentiles, topn, vectors


def test_top_n_of_hot_null_and_tied_groups(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"g{rng.integers(40)}", float(rng.integers(5)), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, score double, id long, place string").repartition(9)
    got = topn.top_n(df, ["grp"], [F.desc("score"), F.asc("id")], 4, "place").toPandas()
    assert got.columns.tolist() == ["grp", "score", "id", "place"]
    p = pd.DataFrame(rows, columns=["grp", "score", "id", "_"]).sort_values(["score", "id"], ascending=[False, True])
    want = p.groupby("grp", dropna=False).head(4)
    key = lambda d: set(zip(d.grp.fillna("-"), d.id))
    assert key(got) == key(want)
    for _, g in got.groupby("grp", dropna=False):
        assert g.sort_values(["score", "id"], ascending=[False, True]).place.tolist() == list(range(1, len(g) + 1))
    assert topn.top_n(df.limit(0), ["grp"], [F.asc("id")], 4, "r").count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=40), n=st.integers(1, 5))
def test_top_n_property(spark, rows, n):
    df = spark.createDataFrame([(g, s, i) for i, (g, s) in enumerate(rows)], "g int, s int, i int")
    got = sorted(map(tuple, topn.top_n(df, ["g"], [F.desc("s"), F.asc("i")], n).collect()))
    want = sorted((g, s, i) for i, (g, s) in enumerate(rows) if sum(1 for j, (h, t) in enumerate(rows) if h == g and (-t, j) < (-s, i)) < n)
    assert got == want


def test_best_of_phylum_leaves_out_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, 7.0, 0.5), (2, 7.0, nan), (3, 7.0, None), (4, 7.0, inf), (5, nan, 0.9), (6, None, 0.9), (7, -1.0, 0.1), (8, 0.0, -0.0), (9, 0.0, 0.0), (10, inf, 1.0), (11, 3e30, 1.0)]
    got = sorted((r["phylum"], r["sig_id"], r["place"]) for r in topn.best_of_phylum(spark.createDataFrame(rows, "sig_id long, slot_28 float, slot_31 float")).collect())
    assert got == [(-1, 7, 1), (0, 8, 1), (0, 9, 2), (7, 1, 1), (2**63 - 1, 11, 1)]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("hot", 2500), ("b", 300), ("one", 1), (None, 7)):
        rows += [(g, float(x)) for x in np.where(rng.random(n) < 0.3, 1.25, rng.lognormal(0, 5, n))]
    rows += [("b", None), ("b", math.nan), ("b", -math.inf), ("gone", None)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "g string, v double, id long, p string")
    at = [0.0, 0.013, 0.5, 0.95, 1.0]
    got = {(r["g"], r["p"]): (r["n"], r["x"]) for r in percentiles.order_statistics(df.repartition(5), ["g"], "v", "id", at).collect()}
    assert len(got) == 4 * len(at)
    for g in ("hot", "b", "one", None):
        xs = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        for p in at:
            assert got[g, p] == (len(xs), pytest.approx(np.quantile(xs, p), rel=1e-9))
    assert percentiles.order_statistics(df.limit(0), ["g"], "v", "id", at).count() == 0


def test_months_combine_within_the_stated_error(spark):
    rng = np.random.default_rng(2)
    rows = [("s", m, float(x)) for m, n in ((1, 900), (2, 40), (3, 1), (4, 2000)) for x in rng.lognormal(m, 2, n)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s string, m int, v double, id long")
    parts = percentiles.rank_summary(df, ["s", "m"], "v", "id", 50)
    assert parts.count() == 4 * 51
    xs = np.sort([r[2] for r in rows])
    for r in percentiles.combine(parts, ["s"], 50, [0.01, 0.1, 0.5, 0.9, 0.99]).collect():
        lo, hi = np.searchsorted(xs, r["x"], "left"), np.searchsorted(xs, r["x"], "right")
        assert r["n"] == len(xs)
        off = max(0, lo - r["p"] * len(xs), r["p"] * len(xs) - hi)
        assert off <= len(xs) / 50 + 4
    assert percentiles.combine(parts.limit(0), ["s"], 50, [0.5]).count() == 0


def embeddings(spark, x, extra=()):
    rows = [(int(i), *map(float, v), "clash") for i, v in enumerate(x)] + list(extra)
    cols = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} float" for c in cols) + ", part string"), cols


@pytest.mark.parametrize(("per_part", "max_parts", "part_max", "probes"), [(100, 2048, 20_000, 12), (40, 8, 20_000, 30), (100, 2048, 30, 12), (25, 16, 20, 40)])
def test_nearest_vectors_have_high_recall(spark, monkeypatch, per_part, max_parts, part_max, probes):
    """One level of parts and two, parts held whole and in pieces."""
    for name, value in (("PER_PART", per_part), ("MAX_PARTS", max_parts), ("PART_MAX", part_max)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 6)) * 0.3).astype(np.float32)
    df, cols = embeddings(spark, x)
    got = vectors.neighbours(df, "id", cols, 10, probes, queries=F.col("id") % 50 == 0).toPandas()
    assert set(got.id_a) == set(range(0, 3000, 50)) and (got.groupby("id_a").size() == 10).all()
    hit = 0
    for i, g in got.groupby("id_a"):
        d = np.sqrt(((x.astype(float) - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hit += (g.distance <= np.sort(d)[9] + 1e-6).sum()
        np.testing.assert_allclose(np.sort(g.distance), np.sort(d[g.id_b]), atol=1e-6)
    assert hit / len(got) >= 0.9


def test_copies_zero_and_broken_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x[10:40] = x[10]  # a third and more are copies
    x[50] = 0
    nan = math.nan
    df, cols = embeddings(spark, x, [(100, 1.0, None, 1.0, 1.0, None), (101, nan, 1.0, 1.0, 1.0, ""), (102, math.inf, 1.0, 1.0, 1.0, "")])
    got = vectors.neighbours(df, "id", cols, 3, 2).toPandas()
    assert set(got.id_a) == set(range(60)) - {50} and not set(got.id_b) & {50, 100, 101, 102}
    for i in range(10, 40):
        near = got[got.id_a == i].sort_values("id_b")
        assert near.id_b.tolist() == [j for j in (10, 11, 12, 13) if j != i][:3] and (near.distance == 0).all()
    assert (got.groupby("id_a").size() == 3).all()
    pairs = vectors.neighbours(df, "id", cols, 3, 2, within=1e-6)
    assert pairs.filter("id_a = 39").count() == 3 and pairs.filter("id_a = 5").count() == 0
    assert vectors.neighbours(df.limit(0), "id", cols, 3, 2).count() == 0
    assert vectors.neighbours(df.filter("id = 1"), "id", cols, 3, 2).count() == 0


def test_balanced_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1600, 5)).astype(np.float32)
    near = vectors.nearest_in(x, 8)
    part = vectors.balanced_parts(x, near, 4)
    size = np.bincount(part)
    assert len(size) == 16 and size.min() >= 90 and size.max() <= 110
    assert (part[near] == part[:, None]).mean() > 3 * (1 / 16)
    w = vectors.train_router(x, part, 16)
    assert (vectors.Router(w).routes(x, 1)[:, 0] == part).mean() > 0.7


def brute_clusters(x, ids, radius, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= radius
    left, out = set(range(len(x))), set()
    while left:
        todo = [left.pop()]
        seen = set(todo)
        while todo:
            for j in np.flatnonzero(d[todo.pop()]):
                if j in left:
                    left.discard(j)
                    seen.add(j)
                    todo.append(j)
        if len(seen) >= least:
            out |= {(int(ids[list(seen)].min()), int(ids[j])) for j in seen}
    return out


@pytest.mark.parametrize("crowd", [20_000, 60])
def test_clusters_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(clusters, "CROWD", crowd)
    rng = np.random.default_rng(6)
    chain = np.cumsum(np.full((40, 5), 0.03), 0) + 2  # longer than any ball: flow alone may part it
    x = np.concatenate([rng.normal(0, 0.01, (150, 5)), np.repeat(rng.normal(size=(1, 5)), 30, 0), chain, rng.normal(5, 0.03, (60, 5)), rng.uniform(-3, 3, (200, 5)), [[9.0] * 5] * 2]).astype(np.float32)
    ids = rng.permutation(len(x)) + 100
    cols = [f"v{i}" for i in range(5)]
    rows = [(int(i), *map(float, v), "clash") for i, v in zip(ids, x, strict=True)] + [(1, None, 0.0, 0.0, 0.0, 0.0, ""), (2, math.nan, 0.0, 0.0, 0.0, 0.0, ""), (3, math.inf, 0.0, 0.0, 0.0, 0.0, "")]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} float" for c in cols) + ", cell string")
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(clusters, "markov", lambda links, f=clusters.markov: f(links, rounds=3))
        clusters.clusters(df, "id", cols, 0.1, 5, exact=False)
    full, sizes = clusters.clusters(df, "id", cols, 0.1, 5)
    got = {(r["cluster_id"], r["id"]) for r in full.collect()}
    want = brute_clusters(x.astype(float), ids, 0.1, 5)
    assert got == want and len({c for c, _ in got}) >= 3
    assert {r["cluster_id"]: r["size"] for r in sizes.collect()} == pd.Series([c for c, _ in want]).value_counts().to_dict()


def test_no_rows_no_clusters(spark):
    df = spark.createDataFrame([], "id long, a float, b float")
    full, sizes = clusters.clusters(df, "id", ["a", "b"], 0.1, 2)
    assert full.count() == sizes.count() == 0
    one = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id long, a float, b float")
    assert clusters.clusters(one, "id", ["a", "b"], 0.1, 2)[0].count() == 0


def test_markov_parts_two_cliques_joined_by_a_weak_link(spark):
    clique = lambda a: [(a + i, a + j, 1.0) for i in range(5) for j in range(i + 1, 5)]
    links = spark.createDataFrame([*clique(0), *clique(10), (4, 10, 0.05)], "a long, b long, w double")
    m, settled = clusters.markov(links, inflation=2.0)
    assert settled and not clusters.markov(links, rounds=0)[1]
    hub = {r["node"]: r["hub"] for r in clusters.attractors(m).collect()}
    assert len({hub[i] for i in range(5)}) == 1 and len({hub[i] for i in range(10, 15)}) == 1 and hub[0] != hub[10]


def test_crowded_cells_are_split(spark, monkeypatch):
    """Copies by the hundred, minus zeros, and rows that only the further dimensions set apart."""
    monkeypatch.setattr(clusters, "CROWD", 60)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat([[1.0] * 9], 300, 0), np.repeat([[0.0] * 9], 80, 0), np.repeat([[-0.0] * 9], 40, 0), rng.normal(0, 0.02, (200, 9)) + np.repeat(np.array([[0, 0, 0, 0, 0, 0, 0, 1, 3.0]]) * rng.integers(0, 3, (200, 1)), 1, 0), [[40.0] * 9] * 2, rng.uniform(-9, 9, (30, 9))]).astype(np.float32)
    x[:, :4] *= 0.5
    ids = rng.permutation(len(x)) + 1
    cols = [f"v{i}" for i in range(9)]
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)], "id long, " + ", ".join(f"{c} float" for c in cols))
    got = {(r["cluster_id"], r["id"]) for r in clusters.clusters(df, "id", cols, 0.1, 2)[0].collect()}
    assert got == brute_clusters(x.astype(float), ids, 0.1, 2)


def test_flow_alone_finds_most_clusters(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.015, (rng.integers(10, 60), 5)) + c for c in rng.uniform(-4, 4, (25, 5))]).astype(np.float32)
    ids = np.arange(len(x))
    cols = [f"v{i}" for i in range(5)]
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)], "id long, " + ", ".join(f"{c} float" for c in cols))
    got = {(r["cluster_id"], r["id"]) for r in clusters.clusters(df, "id", cols, 0.1, 5, exact=False)[0].collect()}
    want = brute_clusters(x.astype(float), ids, 0.1, 5)
    assert len(got & want) >= 0.9 * len(want)
