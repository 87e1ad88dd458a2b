"""Problem 7: clusters of mutually similar rows, by Markov clustering of a sparse similarity graph.

Rows are placed in cells over the few widest dimensions; a row near a border is also shown to the cell below, so that
every alike pair meets in some cell. A crowded cell is split by further dimensions, equal vectors counting once; only
rows that lie together in all dimensions are dealt out in blocks of bounded size. A cell gathers its rows in balls of
half the likeness radius, which become the nodes of the graph, and links balls that hold an alike pair: dense spots
thus give few nodes, never all pairs. Markov clustering (squaring, inflation, pruning of small entries) runs on the
graph as a table of matrix entries, and its attractor rows are the clusters. An exact step then looks for links between
different clusters, as flow may part a long chain, and joins those it finds.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graphs import components
from ..operators.spread import spread_join
from ..session import cut, removed, stored_at
from .topn import finite, top_n

DIMENSIONS = 4  # widest dimensions that make up a cell
WIDTH = 5  # side of a cell in likeness radii
INFLATION = 1.3  # power of the flow's contrast: higher parts the graph more finely
SPREAD, SETTLE = 4, 2.0  # rounds with that power, after which flow has gone round its part of the graph; power of the rest
SURE = 0.05  # share of a column's flow that counts in the limit
CROWD = 20_000  # rows of a cell beyond which it is split
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the cell hash


def _hash(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            h = (h ^ p.astype(np.int64).view(np.uint64)) * MIX
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _alike(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether a pair of rows is within the radius; pairs near the limit are measured again by differences."""
    d, r = _square(a, b), radius * radius
    yes = d <= r
    i, j = np.nonzero(np.abs(d - r) < 1e-9 * (1 + (a * a).sum(1).max(initial=0)))
    if len(i):
        yes[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(1)) <= radius
    return yes


def cell_graph(ids: np.ndarray, tags: np.ndarray, home: np.ndarray, x: np.ndarray, radius: float):
    """Of one cell: kept rows (id, ball leader or -1 for guests) and links between balls (id, id, weight)."""
    x = x - x.mean(0)
    lonely = np.ones(len(x), bool)
    for a in range(0, len(x), 1024):
        near = _square(x[a : a + 1024], x) <= radius * radius * 1.000001 + 1e-9
        lonely[a : a + 1024] = near.sum(1) < 2
    if lonely.all():
        return None
    ids, tags, home, x = (z[~lonely] for z in (ids, tags, home, x))
    ball = np.full(len(x), -1)
    leaders = []
    free = np.arange(len(x))
    while len(free):
        f = free[0]
        near = (((x[free] - x[f]) ** 2).sum(1) <= radius * radius / 4) & (tags[free] == tags[f])
        near[0] = True
        ball[free[near]] = len(leaders)
        leaders.append(f)
        free = free[~near]
    lead = np.array(leaders)
    far = np.zeros(len(lead))  # how far a ball's members lie from its leader: 0 for a single row
    np.maximum.at(far, ball, np.sqrt(((x - x[lead[ball]]) ** 2).sum(1)))
    order = np.argsort(ball, kind="stable")
    bounds = np.append(np.searchsorted(ball[order], np.arange(len(lead))), len(order))
    links = []
    for a in range(0, len(lead), 512):
        own = np.arange(a, min(a + 512, len(lead)))
        d = _square(x[lead[own]], x[lead])
        reach = radius + far[own][:, None] + far[None]
        i, j = np.nonzero((d <= reach * reach * 1.000001 + 1e-9) & (own[:, None] < np.arange(len(lead))[None]))
        # Two guests of one home cell are linked there.
        out = home[lead[own[i]]] | home[lead[j]] | (tags[lead[own[i]]] != tags[lead[j]])
        i, j = i[out], j[out]
        yes = _alike(x[lead[own]], x[lead], radius)[i, j]
        for k in np.flatnonzero(~yes & (far[own[i]] + far[j] > 0)):
            p, q = own[i[k]], j[k]
            some, other = order[bounds[p] : bounds[p + 1]], order[bounds[q] : bounds[q + 1]]
            yes[k] = any(_alike(x[some[s : s + 1024]], x[other], radius).any() for s in range(0, len(some), 1024))
        i, j = i[yes], j[yes]
        links.append((ids[lead[own[i]]], ids[lead[j]], np.exp(-d[i, j] / (radius * radius))))
    return ids, np.where(home, ids[lead[ball]], -1), [np.concatenate(z) for z in zip(*links, strict=True)]


def _cells(x: np.ndarray, side: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and cell of every place that a row is shown to, its own and those below near borders; each row's own cell."""
    c = np.floor(x / side).astype(np.int64)
    low = x - c * side <= reach
    tag = _hash(*c.T)
    at, cell = [], []
    for shift in product((0, 1), repeat=x.shape[1]):
        s = np.array(shift)
        i = np.flatnonzero((low | (s == 0)).all(1))
        at.append(i)
        cell.append(_hash(*(c[i] - s).T) if any(shift) else tag)
    return np.concatenate(at), np.concatenate(cell), tag


def _crowds(placed: DataFrame) -> DataFrame | None:
    """Cells of more than CROWD rows, at most one per CROWD rows, 16 bytes each; None if there are none."""
    crowds = cut(placed.groupBy("cell").count().filter(F.col("count") > CROWD).select("cell", F.ceil(F.col("count") / CROWD).cast("int").alias("k")))
    return None if crowds.isEmpty() else crowds


def _copies(rows: DataFrame, kinds: DataFrame, vs: list[str]) -> DataFrame:
    """id, rep of all rows whose vector a row with a smaller id has as well."""
    h = F.xxhash64(*[F.col(v) + F.lit(0.0) for v in vs]).alias("_h")  # no minus zero
    named = rows.select("_id", h, *vs)
    reps = kinds.select(F.col("_id").alias("rep"), h, *[F.col(v).alias(v + "r") for v in vs])
    both = spread_join(named, reps, "_h").filter(" and ".join(f"{v} = {v}r" for v in vs))
    return cut(both.filter("_id <> rep").select(F.col("_id").alias("id"), "rep"))


def _split(placed: DataFrame, crowds: DataFrame, dims: list[str], side: float, reach: float) -> DataFrame:
    """placed with the crowded cells split by further dimensions, in the same manner; others stay as they are."""
    names = placed.columns
    hit = placed.join(F.broadcast(crowds.select("cell", F.lit(True).alias("_c"))), "cell", "left").join(F.broadcast(crowds.select(F.col("cell").alias("tag"), F.lit(True).alias("_t"))), "tag", "left")
    stay = hit.filter("_c is null and _t is null").select(*names)
    at = [names.index(d) for d in dims]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at], 1)
            old, own = b.column(0).to_numpy(), b.column(1).to_numpy()
            in_c, in_t = (b.column(len(names) + i).is_valid().to_numpy(zero_copy_only=False) for i in (0, 1))
            row, cell, tag = _cells(x, side, reach)
            own = np.where(in_t, _hash(own, tag), own)
            # A cell that isn't crowded stays whole: of its rows only the first, unshifted place counts.
            keep = in_c[row] | (np.arange(len(row)) < len(x))
            row, cell = row[keep], cell[keep]
            cell = np.where(in_c[row], _hash(old[row], cell), old[row])
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own[row]), *out.columns[2 : len(names)]], names=names)

    return stay.unionAll(hit.filter("_c is not null or _t is not null").select(*names, "_c", "_t").mapInArrow(again, placed.schema))


def _dealt_out(placed: DataFrame, crowds: DataFrame | None, vs: list[str]) -> DataFrame:
    """placed with each crowded cell's rows in k lots; each pair of lots is a block, at home where both are its own."""
    if crowds is None:
        return placed
    placed = placed.join(F.broadcast(crowds), "cell", "left").withColumn("lot", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("_id"), F.col("k")).cast("int")))
    homes = crowds.select(F.col("cell").alias("tag"), F.col("k").alias("hk"))
    placed = placed.join(F.broadcast(homes), "tag", "left").withColumn("htag", F.when(F.col("hk").isNotNull(), F.xxhash64("tag", F.pmod(F.xxhash64("_id"), F.col("hk")).cast("int"))).otherwise(F.col("tag")))
    pair = lambda o: F.when(o == F.col("lot"), F.xxhash64("cell", "lot")).otherwise(F.xxhash64("cell", F.least(o, F.col("lot")), F.greatest(o, F.col("lot"))))
    blocks = F.when(F.col("k").isNull(), F.array(F.col("cell"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), pair))
    return placed.withColumn("cell", F.explode(blocks)).select("cell", F.col("htag").alias("tag"), "_id", *vs)


def similarity_graph(df: DataFrame, id: str, cols: list[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) of all rows that are alike to another one, and links (a, b, w) between nodes.

    Two rows are alike at a Euclidean distance of at most `radius`. Rows with a null, NaN or infinite component take
    no part. The links join two nodes if and only if some of their rows are alike."""
    good = F.lit(True)
    for c in cols:
        good = good & finite(c)
    vs = [f"_v{i}" for i in range(len(cols))]
    rows = df.filter(good).select(F.col(id).cast("long").alias("_id"), *[F.col(c).alias(v) for c, v in zip(cols, vs, strict=True)])
    spread = rows.agg(*[F.stddev_pop(F.col(v).cast("double")).alias(v) for v in vs]).first()
    wide = sorted(range(len(vs)), key=lambda i: -(spread[vs[i]] or 0))
    first = wide[:DIMENSIONS]
    side, reach = WIDTH * radius, radius * 1.000001
    dealt = T.StructType([T.StructField("cell", T.LongType()), T.StructField("tag", T.LongType()), *rows.schema.fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in first], 1)
            at, cell, tag = _cells(x, side, reach)
            out = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(tag[at]), *out.columns], names=dealt.names)

    placed = rows.mapInArrow(place, dealt)
    copies = None
    crowds = _crowds(placed)
    if crowds is not None:
        kinds = cut(rows.groupBy(*vs).agg(F.min("_id").alias("_id"), F.count("*").alias("_n")))
        copies = _copies(rows, kinds.filter("_n > 1").drop("_n"), vs)
        placed = kinds.select("_id", *vs).mapInArrow(place, dealt)
        for more in range(DIMENSIONS, len(wide), DIMENSIONS):
            crowds = _crowds(placed)
            if crowds is None:
                break
            placed = _split(placed, crowds, [vs[i] for i in wide[more : more + DIMENSIONS]], side, reach)
        else:
            placed = _dealt_out(placed, _crowds(placed), vs)

    found = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("w", T.DoubleType())])

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        out: list[tuple[list, list, list]] = []

        def work(b: pa.RecordBatch) -> None:
            cell = b.column(0).to_numpy()
            first = np.flatnonzero(np.diff(cell, prepend=cell[0] + 1))
            last = np.append(first[1:], len(cell))
            several = last - first > 1
            if not several.any():
                return
            tag, ids = b.column(1).to_numpy(), b.column(2).to_numpy()
            x = np.stack([b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(vs))], 1)
            for i, j in zip(first[several], last[several], strict=True):
                home = tag[i:j] == cell[i]
                order = np.lexsort((ids[i:j], ~home))
                got = cell_graph(ids[i:j][order], tag[i:j][order], home[order], x[i:j][order], radius)
                if got:
                    k, node, links = got
                    out.append((k.tolist(), node.tolist(), [None] * len(k)))
                    if len(links[0]):
                        out.append(tuple(z.tolist() for z in links))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                a, b, w = ([y for o in out for y in o[z]] for z in range(3))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], names=found.names)

        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            cell = b.column(0).to_numpy()
            tail = int(np.searchsorted(cell, cell[-1]))
            if tail:
                work(b.slice(0, tail))
                yield from flush()
            rest = b.slice(tail)
        if rest is not None:
            work(rest)
            yield from flush()

    got = cut(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(graph, found))
    members = got.filter("w is null").groupBy(F.col("a").alias("id")).agg(F.max("b").alias("b")).select("id", F.when(F.col("b") < 0, F.col("id")).otherwise(F.col("b")).alias("node"))
    members = cut(members)
    links, size = got.filter("w is not null"), got.count()
    for side_ in ("a", "b"):
        links = spread_join(links, members.select(F.col("id").alias(side_), F.col("node").alias("_n")), side_, rows=size).drop(side_).withColumnRenamed("_n", side_)
    links = cut(links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w")))
    if copies is not None:
        # A copy goes with its representative, which may have no other row near it.
        named = members.select(F.col("id").alias("rep"), "node")
        reps = copies.select("rep").distinct().join(named, "rep", "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("node"))
        also = spread_join(copies, named, "rep", "left").select("id", F.coalesce("node", "rep").alias("node"))
        members = cut(members.unionAll(reps).unionAll(also))
    return members, links


def markov(links: DataFrame, inflation: float = INFLATION, least: float = 1e-3, rounds: int = 24) -> tuple[DataFrame, bool]:
    """Markov clustering of an undirected graph: entries (j, i, p) of the limit matrix, column j flowing to row i, and
    whether the process settled within `rounds`.

    Each round squares the matrix by a join on the middle index, whose crowded values are dealt out, raises entries to
    the power `inflation` (at least SETTLE once SPREAD rounds are over), drops those below `least` of their column and scales columns to 1, until columns stop
    changing. A column holds at most 1 / least entries. An empty graph gives an empty matrix."""
    both = links.select(F.col("a").alias("j"), F.col("b").alias("i"), "w").unionAll(links.select(F.col("b").alias("j"), F.col("a").alias("i"), "w"))
    nodes = both.select("j").distinct()
    loops = nodes.select("j", F.col("j").alias("i"), F.lit(1.0).alias("w"))
    col = Window.partitionBy("j")
    m = both.unionAll(loops).repartition("j").withColumn("p", F.col("w") / F.sum("w").over(col))
    # Tables, not checkpoints: see graphs.components.
    m, at = stored_at(m.filter(F.col("p") >= least / 10).select("j", "i", "p"), "flow")
    size = None
    for r in range(rounds):
        # Many columns may flow to one row, but every column is short: that side is repeated for the crowded ones.
        left = m.select("j", F.col("i").alias("k"), F.col("p").alias("p1"))
        right = m.select(F.col("j").alias("k"), "i", F.col("p").alias("p2"))
        sq = spread_join(left, right, "k", rows=size).select("j", "i", (F.col("p1") * F.col("p2")).alias("p")).groupBy("j", "i").agg(F.sum("p").alias("p"))
        sq = sq.repartition("j").withColumn("p", F.pow("p", F.lit(inflation if r < SPREAD else max(inflation, SETTLE))))
        sq = sq.withColumn("p", F.col("p") / F.sum("p").over(col)).filter(F.col("p") >= least)
        old = at
        m, at = stored_at(sq.withColumn("p", F.col("p") / F.sum("p").over(col)), "flow")
        removed(links.sparkSession, old)
        chaos, size = m.groupBy("j").agg((F.max("p") - F.sum(F.col("p") * F.col("p"))).alias("c"), F.count("*").alias("n")).agg(F.max("c"), F.sum("n")).first()
        if chaos is None or chaos < 1e-2:
            return m, True
    return m, False


def attractors(m: DataFrame) -> DataFrame:
    """node, hub of all nodes that share a cluster with others: hub is the cluster's smallest node.

    Columns that flow to the same rows belong together, as do attractors that flow to each other."""
    flows = m.filter((F.col("i") != F.col("j")) & (F.col("p") >= SURE)).select(F.col("j").alias("a"), F.col("i").alias("b"))
    return components(flows).select("node", F.col("root").alias("hub"))


def clusters(df: DataFrame, id: str, cols: list[str], radius: float, least_rows: int, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members (cluster_id, id, flow) of all clusters with at least `least_rows` rows, and clusters (cluster_id, size).

    cluster_id is the smallest id of the cluster. flow: what the limit of the Markov process sends to the row's ball.
    exact: clusters between which a link of likeness is left are joined, so that a cluster is exactly a set of rows
    joined by likeness, directly or through others; without it a process that doesn't settle is an error. Rows with a
    null or non-finite component are in no cluster; equal rows are alike; extra columns are ignored; an empty df gives
    empty results."""
    members, links = similarity_graph(df, id, cols, radius)
    m, settled = markov(links)
    if not settled:
        if not exact:
            raise RuntimeError("the Markov process did not settle")
        logging.getLogger(__name__).warning("the Markov process did not settle; its clusters are joined along the links left between them")
    node = cut(members.select("node").distinct().join(attractors(m), "node", "left").select("node", F.coalesce("hub", "node").alias("hub")))
    if exact:
        hub = lambda c: node.select(F.col("node").alias(c), F.col("hub").alias(c + "h"))
        apart = cut(links.join(hub("a"), "a").join(hub("b"), "b").filter("ah <> bh").select(F.least("ah", "bh").alias("a"), F.greatest("ah", "bh").alias("b")).distinct())
        if not apart.isEmpty():
            root = components(apart).withColumnRenamed("node", "hub")
            node = spread_join(node, root, "hub", "left", rows=node.count()).select("node", F.coalesce("root", "hub").alias("hub"))
    flow = m.groupBy(F.col("i").alias("node")).agg(F.sum("p").alias("flow"))
    placed = node.join(flow, "node", "left").select("node", "hub", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    size = members.count()
    placed = cut(spread_join(members, placed, "node", rows=size).select("hub", "id", "flow", (F.col("id") == F.col("node")).alias("leads")))
    sizes = placed.groupBy("hub").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size")).filter(F.col("size") >= least_rows)
    full = spread_join(placed, sizes, "hub", rows=size).select("cluster_id", "id", "flow", "leads")
    return full, sizes.select("cluster_id", "size")


LIKENESS = [*[f"slot_{i:02d}" for i in range(16)], "slot_31"]


def signature_clusters(signatures: DataFrame, radius: float = 0.1, least_rows: int = 15) -> DataFrame:
    """cluster_id, sig_id of every signature in a cluster of at least `least_rows`."""
    return clusters(signatures, "sig_id", LIKENESS, radius, least_rows)[0].select("cluster_id", F.col("id").alias("sig_id"))


def typical_members(signatures: DataFrame, n: int = 3, radius: float = 0.1, least_rows: int = 15) -> DataFrame:
    """cluster_id, size, place, sig_id: the n members of each cluster that the most flow reaches, ball leaders first."""
    full, sizes = clusters(signatures, "sig_id", LIKENESS, radius, least_rows)
    top = top_n(full, ["cluster_id"], [F.col("flow").desc(), F.col("leads").desc(), F.col("id").asc()], n, "place")
    return top.join(sizes, "cluster_id").select("cluster_id", "size", "place", F.col("id").alias("sig_id"))
