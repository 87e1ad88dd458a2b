"""Problem 2: the k most similar vectors of every vector, by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into balanced parts by recursive bisection; a small neural
classifier learns which part a vector belongs to. Where parts would grow beyond what one classifier can tell apart,
each is cut further in the same way, from a sample of its own, by a task of its own. Every row is indexed in its most
probable part, every query visits its most probable parts and reranks what it meets there by exact distance. A part
that grew too large is held in several pieces, which its queries all visit. Equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .topn import finite, top_n

SAMPLE = 20_000  # vectors from which partitions and classifier are learned
PER_PART = 1_000  # rows a part should hold
MAX_PARTS = 2_048  # parts of the first level; the sample must hold a few vectors of each
MAX_FINE = 256  # parts into which each of these may be cut again: in all, half a billion vectors before parts grow
FINE_SAMPLE = 48  # vectors per part of the second level from which it is learned
COARSE = 8  # parts of the first level among which a query's parts of the second level are sought
PART_MAX = 20_000  # vectors that a task holds at once
HIDDEN = 48  # units of the classifier's hidden layer
SEED = 11


def nearest_in(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Indices of the k nearest other rows of every row of x."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    sq = (x * x).sum(1)
    for a in range(0, len(x), block):
        d = sq[None] - 2 * (x[a : a + block] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, depth: int, rounds: int = 12) -> np.ndarray:
    """Part of every row: the neighbour graph halved `depth` times, each time with few cut edges and equal halves.

    A half starts as a cut across the direction of greatest spread; then every node takes the mean side of its
    neighbours, a little of its own, and the upper half of these scores becomes the new side."""
    part = np.zeros(len(x), np.int64)
    for _ in range(depth):
        order = np.argsort(part, kind="stable")
        bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=part.max() + 1))
        side = np.zeros(len(x), np.float32)
        place = np.zeros(len(x), np.float32)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]
            c = x[own] - x[own].mean(0)
            v = np.linalg.eigh(c.T @ c)[1][:, -1]
            s = c @ v
            r = np.empty(len(own), np.float32)
            r[np.argsort(s, kind="stable")] = np.arange(len(own))
            place[own] = (r - (len(own) - 1) / 2) / max(1, len(own))
            side[own] = np.where(r >= len(own) / 2, 1.0, -1.0)
        same = part[near] == part[:, None]
        degree = np.maximum(same.sum(1), 1)
        for _ in range(rounds):
            score = (side[near] * same).sum(1) / degree + 0.25 * side + 0.05 * place
            new = np.empty_like(side)
            rank = np.lexsort((place, score, part))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                new[rank[a:b]] = np.where(np.arange(b - a) >= (b - a) / 2, 1.0, -1.0)
            if (new == side).all():
                break
            side = new
        part = part * 2 + (side > 0)
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 40, batch: int = 256, rate: float = 4e-3) -> list[np.ndarray]:
    """Weights of a classifier with one hidden layer: Adam on cross-entropy, learning rate falling to 0."""
    rng = np.random.default_rng(SEED)
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / std).astype(np.float32)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    steps, t = epochs * -(-len(z) // batch), 0
    for _ in range(epochs):
        mix = rng.permutation(len(z))
        for a in range(0, len(z), batch):
            i = mix[a : a + batch]
            h = np.maximum(z[i] @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            o[np.arange(len(i)), part[i]] -= 1
            o /= len(i)
            dh = (o @ w[2].T) * (h > 0)
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for j, g in enumerate([z[i].T @ dh, dh.sum(0), h.T @ o, o.sum(0)]):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.01 * (g * g - v[j])
                w[j] -= lr * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    w[0], w[1] = w[0] / std[:, None], w[1] - (mean / std) @ w[0]
    return [a.astype(np.float32) for a in w]


def _logits(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def _chances(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    o = _logits(w, x)
    o = o - o.max(1, keepdims=True)
    return o - np.log(np.exp(o).sum(1, keepdims=True))


def _best(o: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of every row, the largest first."""
    n = min(n, o.shape[1])
    top = np.argpartition(-o, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(o, top, 1), axis=1, kind="stable"), 1)


class Router:
    """The parts of a vector, most probable first: of the first level alone, or of the second within the first's."""

    def __init__(self, coarse: list[np.ndarray], fine: dict[int, list[np.ndarray]] | None = None):
        self.coarse, self.fine = coarse, fine

    def routes(self, x: np.ndarray, probes: int) -> np.ndarray:
        if self.fine is None:
            return _best(_logits(self.coarse, x), probes).astype(np.int32)
        first = _chances(self.coarse, x)
        near = _best(first, COARSE)
        wide = max([len(w[3]) for w in self.fine.values()], default=1)
        joint = np.full((*near.shape, wide), -np.inf, np.float32)
        joint[..., 0] = np.take_along_axis(first, near, 1)  # a part that isn't cut further
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        for a, z in zip(c := np.flatnonzero(np.diff(flat[order], prepend=-1)), np.append(c[1:], len(flat)), strict=True):
            w = self.fine.get(int(flat[order[a]]))
            if w is not None:
                i, j = np.divmod(order[a:z], near.shape[1])
                joint[i, j, : len(w[3])] = first[i, flat[order[a]]][:, None] + _chances(w, x[i])
        joint = joint.reshape(len(x), -1)
        at = _best(joint, probes)
        part = np.take_along_axis(near, at // wide, 1) * MAX_FINE + at % wide
        # Places that no part fills are the first part again, which a query visits once.
        return np.where(np.isfinite(np.take_along_axis(joint, at, 1)), part, part[:, :1]).astype(np.int32)


def learn(sample: np.ndarray, rows: int) -> list[np.ndarray]:
    """The router for a collection of `rows` vectors from a sample of them."""
    depth = int(np.clip(np.round(np.log2(max(rows, 1) / PER_PART)), 0, np.log2(min(MAX_PARTS, max(1, len(sample) // 8)))))
    if depth == 0:
        d = sample.shape[1] if sample.ndim == 2 else 1
        return [np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)]
    near = nearest_in(sample, 10)
    return train_router(sample, balanced_parts(sample, near, depth), 2**depth)


def learn_fine(kinds: DataFrame, vs: list[str], coarse: list[np.ndarray], rows: int) -> dict[int, list[np.ndarray]] | None:
    """Routers of the second level by part of the first; None where one level is enough.

    Every part's sample is learned from by one task; what comes back are weights, at most MAX_PARTS times some
    (columns + MAX_FINE) * HIDDEN numbers, whatever the number of rows."""
    parts = len(coarse[3])
    fine = 2 ** int(np.ceil(np.log2(max(rows / (parts * PER_PART), 1))))
    if parts < MAX_PARTS or fine < 2:
        return None
    fine = min(fine, MAX_FINE)
    drawn = kinds.select(*vs).filter(F.pmod(F.xxhash64(*vs, F.lit(SEED)), F.lit(rows)) < FINE_SAMPLE * fine * parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b, vs)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(_logits(coarse, x).argmax(1).astype(np.int32)), *b.columns], names=["part", *vs])

    def train(t: pa.Table) -> pa.Table:
        x = np.unique(np.stack([t[v].to_numpy() for v in vs], 1).astype(np.float32), axis=0)
        if len(x) > 4 * FINE_SAMPLE * fine:  # a part far larger than its share
            x = x[np.random.default_rng(SEED).choice(len(x), 4 * FINE_SAMPLE * fine, replace=False)]
        depth = int(min(np.log2(fine), np.log2(max(1, len(x) // 8))))
        if not depth:
            return pa.table({"part": pa.array([], pa.int32()), "weights": pa.array([], pa.list_(pa.float32()))})
        w = train_router(x, balanced_parts(x, nearest_in(x, 10), depth), 2**depth)
        return pa.table({"part": t["part"][:1], "weights": pa.array([np.concatenate([a.ravel() for a in w])], pa.list_(pa.float32()))})

    schema = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(v, T.FloatType()) for v in vs]])
    got = drawn.mapInArrow(place, schema).groupBy("part").applyInArrow(train, "part int, weights array<float>")
    out = {}
    for r in got.toArrow().to_pylist():
        w = np.array(r["weights"], np.float32)
        d = len(vs)
        p = (len(w) - d * HIDDEN - HIDDEN) // (HIDDEN + 1)
        cuts = np.cumsum([d * HIDDEN, HIDDEN, HIDDEN * p])
        a, b, c, e = np.split(w, cuts)
        out[r["part"]] = [a.reshape(d, HIDDEN), b, c.reshape(HIDDEN, p), e]
    return out


def _stack(b: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cols], 1).astype(np.float32)


def _search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, within: float | None, block: int = 256):
    """Of every query its k nearest among x, or those within a distance: query id, id, distance."""
    mid = x.mean(0)
    xc = x - mid
    sq = (xc * xc).sum(1)
    got = []
    for a in range(0, len(q), block):
        qs = q[a : a + block]
        qc = qs - mid
        own = (qc * qc).sum(1)
        d = sq[None] - 2 * (qc @ xc.T)
        d += own[:, None]
        if within is not None:  # single precision finds candidates, with room for its error; double decides
            i, j = np.nonzero(d <= within * within + 1e-4 + 2e-6 * (own[:, None] + sq[None]))
        else:
            d[qids[a : a + block, None] == ids[None]] = np.inf
            kk = min(k + 8, len(x))
            j = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            i, j = np.repeat(np.arange(len(qs)), kk), j.ravel()
        i, j = i[qids[a + i] != ids[j]], j[qids[a + i] != ids[j]]
        exact = np.sqrt(((qs[i].astype(np.float64) - x[j].astype(np.float64)) ** 2).sum(1))
        if within is not None:
            i, j, exact = i[exact <= within], j[exact <= within], exact[exact <= within]
        got.append((qids[a + i], ids[j], exact))
    return [np.concatenate(z) for z in zip(*got, strict=True)]


def neighbours(df: DataFrame, id: str, cols: list[str], k: int, probes: int, queries=None, within: float | None = None) -> DataFrame:
    """For every row (or those where the Column `queries` holds) its k nearest other rows: id_a, id_b, distance.

    Rows with a null, NaN or infinite component, or with all components zero, take no part. Ties go to the smaller
    id_b. `within` leaves out everything farther away. `probes`: parts that a query visits. With equal vectors, each
    row's nearest are the k smallest ids that share its vector. Any other columns of df are ignored; an empty df
    gives an empty result. Needs id to be unique."""
    spark = df.sparkSession
    ok = F.lit(False)
    good = F.lit(True)
    for c in cols:
        good, ok = good & finite(c), ok | (F.col(c) != 0)
    is_query = F.lit(True) if queries is None else queries
    rows = df.filter(good & ok).select(F.col(id).cast("long").alias("_id"), *[(F.col(c).cast("float") + F.lit(0.0).cast("float")).alias(f"_v{i}") for i, c in enumerate(cols)], is_query.alias("_q"))
    vs = [f"_v{i}" for i in range(len(cols))]
    kinds = cut(rows.groupBy(*vs).agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.max("_q").alias("_q")))
    n = kinds.count()
    # About SAMPLE vectors reach the driver whatever n is: those with the smallest hashes.
    drawn = kinds.select(*vs).filter(F.pmod(F.xxhash64(*vs), F.lit(max(n, 1))) < SAMPLE)
    sample = drawn.toPandas().sort_values(vs).to_numpy(np.float32)
    if not n:
        return spark.createDataFrame([], "id_a long, id_b long, distance double")
    coarse = learn(sample, n)
    router = Router(coarse, learn_fine(kinds, vs, coarse, n))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b, vs)
            if not len(x):
                continue
            asks = b.column(b.schema.get_field_index("_q")).to_numpy(zero_copy_only=False)
            to = router.routes(x, probes)
            n_to = np.where(asks, to.shape[1], 1)
            keep = np.arange(to.shape[1])[None] < n_to[:, None]
            parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_to)).astype(np.int32)), pa.array(to[keep]))
            yield pa.RecordBatch.from_arrays([parts, *b.select(["rep", "_q", *vs]).columns], names=["parts", "rep", "_q", *vs])

    spots = T.StructType([T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("rep", T.LongType()), T.StructField("_q", T.BooleanType()), *[T.StructField(v, T.FloatType()) for v in vs]])
    placed = cut(kinds.select("rep", "_q", *vs).mapInArrow(route, spots))
    own = F.col("parts")[0]
    large = cut(placed.groupBy(own.alias("part")).count().filter(F.col("count") > PART_MAX).select("part", F.ceil(F.col("count") / PART_MAX).cast("int").alias("pieces")))
    # A part's pieces, at most one per PART_MAX rows of it: rows go to one by their id, queries to all.
    held = placed.select(own.alias("part"), F.lit(0).alias("role"), "rep", *vs)
    asked = placed.filter("_q").select(F.explode(F.array_distinct("parts")).alias("part"), F.lit(1).alias("role"), "rep", *vs)
    if large.isEmpty():
        routed = held.unionAll(asked).withColumn("piece", F.lit(0))
    else:
        few, n_of = F.broadcast(large), F.coalesce("pieces", F.lit(1))
        held = held.join(few, "part", "left").withColumn("piece", F.pmod(F.xxhash64("rep"), n_of).cast("int"))
        asked = asked.join(few, "part", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), n_of - 1)))
        routed = held.drop("pieces").unionByName(asked.drop("pieces"))
    routed = routed.select("part", "role", "rep", *vs, "piece").repartition("part", "piece").sortWithinPartitions("part", "piece", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, those to be found first: one part's rows are held, its queries stream by."""
        part, ids, x = -1, [], []
        for b in batches:
            if not b.num_rows:
                continue
            ps = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(len(vs) + 3).to_numpy()
            roles, reps, v = b.column(1).to_numpy(), b.column(2).to_numpy(), _stack(b, vs)
            for a, z in zip(c := np.flatnonzero(np.diff(ps, prepend=-1)), np.append(c[1:], len(ps)), strict=True):
                if ps[a] != part:
                    part, ids, x = ps[a], [], []
                own = slice(a, a + int((roles[a:z] == 0).sum()))
                if own.stop > a:
                    ids.append(reps[own])
                    x.append(v[own])
                if own.stop < z and ids:
                    if len(ids) > 1:
                        ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    i, j, d = _search(ids[0], x[0], reps[own.stop : z], v[own.stop : z], k, within)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d)], names=["ra", "rb", "distance"])

    found = routed.mapInArrow(search, "ra long, rb long, distance double")
    if within is None:
        found = top_n(found, ["ra"], [F.col("distance").asc(), F.col("rb").asc()], k)
    # From distinct vectors back to rows: of a vector's copies, the k + 1 smallest ids can be anyone's neighbours.
    many = kinds.filter("copies > 1").select(*vs, "rep")
    both = rows.join(many, vs).select("rep", "_id", "_q")
    heads = cut(top_n(both.select("rep", "_id"), ["rep"], [F.col("_id").asc()], k + 1))
    found = found.filter("ra <> rb")
    b_side = heads.select(F.col("rep").alias("rb"), F.col("_id").alias("b2"))
    a_side = both.filter("_q").select(F.col("rep").alias("ra"), F.col("_id").alias("a2"))
    full = found.join(b_side, "rb", "left").join(a_side, "ra", "left")
    full = full.select(F.coalesce("a2", "ra").alias("id_a"), F.coalesce("b2", "rb").alias("id_b"), "distance")
    single = rows.filter("_q").select(F.col("_id").alias("id_a"))
    if queries is not None:
        full = full.join(single, "id_a", "left_semi")
    own = a_side.join(b_side, F.col("ra") == F.col("rb")).filter("a2 <> b2").select(F.col("a2").alias("id_a"), F.col("b2").alias("id_b"), F.lit(0.0).alias("distance"))
    return top_n(full.unionByName(own), ["id_a"], [F.col("distance").asc(), F.col("id_b").asc()], k)


EMBEDDING = [f"slot_{i}" for i in range(16, 24)]


def close_pairs(signatures: DataFrame, distance: float = 0.008, k: int = 10, probes: int = 6) -> DataFrame:
    """Pairs of rows within `distance` among each other's k nearest: sig_id_a < sig_id_b."""
    near = neighbours(signatures, "sig_id", EMBEDDING, k, probes, within=distance)
    return near.select(F.least("id_a", "id_b").alias("sig_id_a"), F.greatest("id_a", "id_b").alias("sig_id_b")).distinct()
