"""DBSCAN over tables: dense rows and what is near them, without comparing all rows with all.

Rows go to cells over their widest dimensions and, near a border, to the neighbouring cells too. A row's neighbours are
counted in its own cell; dense (core) rows are joined cell by cell into sparse links, whose connected components are
the clusters; other rows near a core row belong to the nearest one's cluster. Crowded cells are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .graphs import components

CROWD = 20_000  # rows of a cell beyond which it is dealt out in blocks
DIMENSIONS, WIDTH = 3, 4  # widest dimensions of a cell, its side in radii
_CHUNK = 1_024


def _near(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T) <= radius * radius + 1e-12


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (cell, i, j), from batches sorted by these."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        rest = rest.combine_chunks()
        key = np.stack([rest[c].to_numpy() for c in ("cell", "i", "j")], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for a, z in zip(np.append(0, cuts[:-1]), cuts, strict=True) if len(cuts) else ():
            yield rest.slice(int(a), int(z - a))
        rest = rest.slice(int(cuts[-1])) if len(cuts) else rest
    if rest is not None:
        yield rest


def _matrix(t: pa.Table, vs: list[str]) -> np.ndarray:
    return np.stack([t[v].to_numpy().astype(float) for v in vs], 1)


def placed(rows: DataFrame, vs: list[str], radius: float) -> DataFrame:
    """Rows per cell and block that needs them: cell, home, lot, i, j, _id, vs."""
    spread = rows.agg(*[F.stddev_pop(v).alias(v) for v in vs]).first()
    wide = sorted(range(len(vs)), key=lambda i: -(spread[vs[i]] or 0))[: min(DIMENSIONS, len(vs))]
    side, reach = WIDTH * radius, radius * 1.000001

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(1 + i).to_numpy().astype(float) for i in wide], 1)
            c = np.floor(x / side).astype(np.int64)
            ok = {0: np.ones_like(c, bool), -1: x - c * side <= reach, 1: (c + 1) * side - x <= reach}
            at, cell, home = [], [], []
            for s in product((0, -1, 1), repeat=len(wide)):
                i = np.flatnonzero(np.all([ok[k][:, d] for d, k in enumerate(s)], axis=0))
                h = np.zeros(len(i), np.uint64)
                with np.errstate(over="ignore"):
                    for d, k in enumerate(s):
                        h = (h ^ (c[i, d] + k).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(31)
                at.append(i)
                cell.append(h.view(np.int64))
                home.append(np.full(len(i), not any(s)))
            out = b.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.concatenate(home)), *out.columns], names=["cell", "home", *b.schema.names])

    df = rows.mapInArrow(place, T.StructType([T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType()), *rows.schema.fields]))
    crowds = cut(df.groupBy("cell").count().filter(F.col("count") > CROWD).select("cell", F.ceil(F.col("count") / CROWD).cast("int").alias("k")))
    if crowds.isEmpty():
        return df.withColumns({"lot": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    df = df.join(crowds, "cell", "left").withColumn("lot", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("k")).cast("int"), F.lit(0)))
    others = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    df = df.withColumn("o", F.explode(others))
    return df.withColumns({"i": F.least("lot", "o"), "j": F.greatest("lot", "o")}).drop("o", "k")


def dbscan(df: DataFrame, id: str, cols: list[str], radius: float, least: int) -> DataFrame:
    """id, cluster, core: cluster is the smallest core id of its cluster, -1 for noise.

    A row is core if at least `least` rows, itself included, lie within `radius` (Euclidean). Null and non-finite
    components count as 0; a null id is left out; an empty df gives an empty result. A row near core rows of several
    clusters goes with the nearest, the smaller id on ties."""
    vs = [f"_v{i}" for i in range(len(cols))]
    clean = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double")).otherwise(0.0)
    rows = cut(df.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("_id"), *[clean(c).alias(v) for c, v in zip(cols, vs, strict=True)]))
    by = ["cell", "i", "j"]
    spots = placed(rows, vs, radius)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            x, lot, home, ids = _matrix(t, vs), t["lot"].to_numpy(), t["home"].to_numpy(), t["_id"].to_numpy()
            own = np.flatnonzero(home)
            if not len(own):
                continue
            mixed = t["i"][0].as_py() != t["j"][0].as_py()
            n = np.zeros(len(own), np.int64)
            for a in range(0, len(own), _CHUNK):
                near = _near(x[own[a : a + _CHUNK]], x, radius)
                if mixed:
                    near &= lot[own[a : a + _CHUNK]][:, None] != lot[None]
                n[a : a + _CHUNK] = near.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(n)], names=["_id", "n"])

    counts = spots.repartition(*by).sortWithinPartitions(*by).mapInArrow(count, "_id long, n long")
    core = cut(counts.groupBy("_id").agg(F.sum("n").alias("n")).select("_id", (F.col("n") >= least).alias("core")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            is_core = t["core"].to_numpy()
            if not is_core.any():
                continue
            x, home, ids = _matrix(t, vs), t["home"].to_numpy(), t["_id"].to_numpy()
            a, b, d = [], [], []
            free = np.flatnonzero(is_core)
            while len(free):
                root, front, free = free[0], free[:1], free[1:]
                while len(front) and len(free):
                    hit = _near(x[front[:_CHUNK]], x[free], radius).any(0)
                    front = np.append(front[_CHUNK:], free[hit])
                    a += ids[free[hit]].tolist()
                    b += [int(ids[root])] * int(hit.sum())
                    d += [None] * int(hit.sum())
                    free = free[~hit]
            hub, edge = np.flatnonzero(is_core), np.flatnonzero(home & ~is_core)
            for s in range(0, len(edge), _CHUNK):
                own = edge[s : s + _CHUNK]
                far = np.sqrt(np.maximum((x[own] ** 2).sum(1)[:, None] + (x[hub] ** 2).sum(1)[None] - 2 * (x[own] @ x[hub].T), 0))
                k = far.argmin(1)
                ok = far[np.arange(len(own)), k] <= radius
                a += ids[own[ok]].tolist()
                b += ids[hub[k[ok]]].tolist()
                d += far[np.arange(len(own)), k][ok].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names=["a", "b", "d"])

    both = spots.join(core, "_id").select("cell", "home", "_id", *vs, "lot", "i", "j", "core")
    links = cut(both.repartition(*by).sortWithinPartitions(*by).mapInArrow(link, "a long, b long, d double"))
    root = components(links.filter("d is null and a <> b").select("a", "b")).select(F.col("node").alias("hub"), "root")
    near = links.filter("d is not null").groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("hub")).select(F.col("a").alias("_id"), "hub")
    out = core.join(near, "_id", "left").withColumn("hub", F.when(F.col("core"), F.col("_id")).otherwise(F.col("hub")))
    out = out.join(root, "hub", "left")
    return out.select(F.col("_id").alias(id), F.coalesce("root", "hub", F.lit(-1).cast("long")).alias("cluster"), "core")
