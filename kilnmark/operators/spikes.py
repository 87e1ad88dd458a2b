"""Problem 5: implausible readings, judged by each source's own normal behaviour.

Every reading gets an isolation forest score within its source, on its level, its difference to the reading before, its
deviation from the hour's usual level and the length of the run of equal readings it is in. Nothing is sampled: the space
that trees cut comes from exact quantiles, their leaves count all readings of the source, and readings whose score is
above an exact quantile of all its scores are marked odd. Those that score at least what any reading of a suspicious level
or run must score are candidates, from which exact checks take the spikes (a multiple of the source's exact median) and
stuck readings: no case is lost, as that floor follows from the forest's own longest paths. Explicit rules mark what breaks
physical limits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import BROADCAST_ROWS, exact_quantiles
from ..session import cut, sized_partitions, stored
from .ordered import Ordered

TREES, DEPTH = 64, 8  # trees of a forest, cuts on the way to each of their leaves
LEAVES = 2**DEPTH
MIDST = (0.1, 0.9)  # quantiles of a feature between which lies the midst of the space that trees cut
WIDER = 1.5  # how far that space goes beyond the midst, in widths of the midst
LOT = 16_384  # readings that go down the trees at once, so that they stay in the processor's cache
HELD = 500_000  # readings that a task holds at once, some 100 bytes each
ODD = 0.05  # share of a source's readings that counts as odd
FEATURES = ("level", "volume_level", "difference", "seasonal", "run")


def usable(c: str) -> Column:
    """Finite and above 0; false, never null, for null."""
    return F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) != float("inf")), F.lit(False))


def quantities() -> dict[str, Column]:
    """The three quantities that have a normal size: wick up, wick down, volume; null where not measurable."""
    body = usable("open") & usable("close")
    vol = F.col("volume")
    return {
        "up": F.when(body & usable("high"), F.col("high") / F.greatest("open", "close") - 1),
        "down": F.when(body & usable("low"), 1 - F.col("low") / F.least("open", "close")),
        "vol": F.when(vol.isNotNull() & ~F.isnan(vol) & (F.abs(vol) != float("inf")) & (vol >= 0), vol),
    }


def impossible() -> Column:
    """Physical limits: no reading may be non-finite, prices must be above 0, volume not below, high and low in order
    and around open and close."""
    odd = lambda c: F.col(c).isNotNull() & ~usable(c)
    vol = F.col("volume")
    bad_vol = vol.isNotNull() & (F.isnan(vol) | (F.abs(vol) == float("inf")) | (vol < 0))
    crossed = usable("high") & usable("low") & (F.col("high") < F.col("low"))
    for c in ("open", "close"):
        crossed = crossed | (usable("high") & usable(c) & (F.col("high") < F.col(c))) | (usable("low") & usable(c) & (F.col("low") > F.col(c)))
    return F.coalesce(odd("high") | odd("low") | bad_vol | crossed, F.lit(False))


def run_lengths(same: np.ndarray) -> np.ndarray:
    """Length of the run each row is in, where same[i] says that row i continues row i - 1."""
    run = np.cumsum(~same)
    return np.bincount(run)[run]


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n leaves, the norm of isolation forests."""
    m = np.maximum(np.asarray(n, float), 3)
    return np.where(np.asarray(n) <= 1, 0.0, np.where(np.asarray(n) == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


def plant(low: np.ndarray, high: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The cuts of a forest over a space: per tree feature and threshold of its inner nodes, children of i at 2i + 1 and
    2i + 2. Cuts fall anywhere in the space of a node and so need no readings; outer nodes have no end."""
    can = np.flatnonzero(high > low)
    if not len(can):
        return []
    rng = np.random.default_rng(seed)
    feature, cut_at = np.empty((TREES, LEAVES - 1), np.intp), np.empty((TREES, LEAVES - 1))
    low, high = (np.broadcast_to(x, (TREES, 1, len(x))).astype(float) for x in (low, high))
    for depth in range(DEPTH):
        n = 2**depth
        f = can[rng.integers(len(can), size=(TREES, n))]
        a, b = (np.take_along_axis(x, f[..., None], 2)[..., 0] for x in (low, high))
        c = a + (b - a) * rng.random((TREES, n))
        feature[:, n - 1 : 2 * n - 1], cut_at[:, n - 1 : 2 * n - 1] = f, c
        low, high = np.repeat(low, 2, 1), np.repeat(high, 2, 1)
        np.put_along_axis(high[:, 0::2], f[..., None], c[..., None], 2)
        np.put_along_axis(low[:, 1::2], f[..., None], c[..., None], 2)
    return list(zip(feature, cut_at))


def leaves(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf that each row of x falls into, from 0."""
    feature, cut_at = tree[:2]
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), np.intp)
    for _ in range(DEPTH):
        right = flat.take(feature.take(node) + first) > cut_at.take(node)
        node *= 2
        node += 1
        node += right
    return node - (LEAVES - 1)


def counted(planted: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Rows of x by tree and leaf."""
    counts = np.zeros((len(planted), LEAVES), np.int64)
    for i in range(0, len(x), LOT):
        for t, tree in enumerate(planted):
            counts[t] += np.bincount(leaves(tree, x[i : i + LOT]), minlength=LEAVES)
    return counts


def grown(planted: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The forest over all counted readings: planted trees with the path length of each leaf. A path ends at the first
    node that holds at most one reading; where several are left at the last cut, the usual depth among them is added."""
    if not planted:
        return []
    path = DEPTH + _path(counts)
    for depth in reversed(range(DEPTH)):
        alone = counts.reshape(len(counts), 2**depth, -1).sum(2) <= 1
        path = np.where(np.repeat(alone, LEAVES >> depth, 1), depth, path)
    return [(*tree, p) for tree, p in zip(planted, path)]


def grow(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, ...]]:
    """A forest over all rows of x, where they are at hand: per tree feature and threshold of inner nodes, path lengths."""
    low, high = np.quantile(x, MIDST, axis=0)
    planted = plant(low - WIDER * (high - low), high + WIDER * (high - low), seed)
    return grown(planted, counted(planted, x))


def score(forest: list[tuple[np.ndarray, ...]], x: np.ndarray, n: int) -> np.ndarray:
    """2 ** -(mean path / usual path among all n readings): near 1 for readings that few cuts set apart, below 0.5 for
    ordinary ones."""
    if not forest:
        return np.full(len(x), 0.5)
    total = np.zeros(len(x))
    for i in range(0, len(x), LOT):
        for tree in forest:
            total[i : i + LOT] += tree[2].take(leaves(tree, x[i : i + LOT]))
    return 2.0 ** (-total / len(forest) / max(_path(n), 1e-9))


def least_score(forest: list[tuple[np.ndarray, ...]], feature: int, above: float, n: int) -> float:
    """What every reading scores at least whose feature exceeds a value: in each tree it may take the longest path that
    is open to it."""
    total = 0.0
    for split, cut_at, path in forest:
        left = (split != feature) | (cut_at > above)
        ways = np.ones(1, bool)
        for depth in range(DEPTH):
            ways = np.stack([ways & left[2**depth - 1 : 2 ** (depth + 1) - 1], ways], 1).ravel()
        total += path[ways].max()
    return 2.0 ** (-total / max(len(forest), 1) / max(_path(n), 1e-9)) * (1 - 1e-9)


JUDGED_SCHEMA = "bar_id long, source string, impossible boolean, spike boolean, stuck boolean, score double, candidate boolean"
FLAGS = ("bar_id", "source", "impossible", "spike", "stuck", "score", "odd", "candidate")


def judged_readings(bars: DataFrame, factor: float = 20.0, run: int = 6) -> DataFrame:
    """One row per bar: bar_id, source, impossible, spike, stuck, score, candidate.

    impossible: a reading breaks a physical limit. spike: wick up, wick down or volume is more than `factor` times the
    exact median of that quantity over all bars of the source. stuck: the bar is in a run of at least `run` bars of the
    source, by datetime and bar_id, with the same volume or the same high and low, all with finite non-zero volume.
    score: isolation forest score within the source, the forest counting all its readings. candidate: it reaches what any
    spike or stuck reading of the source must score; others aren't checked.

    Nulls are never a case by themselves; bars with a null datetime are in no run; a null source is a source like any
    other; bars given twice are judged twice; an empty table gives an empty result; extra columns don't matter. Needs
    bar_id to be unique."""
    cols = ["open", "high", "low", "close", "volume"]
    base = bars.select("bar_id", F.col("symbol").alias("source"), F.col("datetime").cast("timestamp").alias("at"), *[F.col(c).cast("double").alias(c) for c in cols])
    q = quantities()
    hours = base.select("source", F.hour("at").alias("hour"), F.log1p(q["vol"]).alias("v")).groupBy("source", "hour").agg(F.avg("v").alias("mean"))
    hours = hours.filter("hour is not null and mean is not null").groupBy("source").agg(F.collect_list(F.struct("hour", "mean")).alias("hours"))

    lean = base.select("bar_id", "source", F.unix_micros("at").alias("at"), F.hour("at").alias("hour"), F.col("high"), F.col("low"), F.when(usable("close"), F.col("close")).alias("close"), F.col("volume"), *[c.alias(k) for k, c in q.items()], impossible().alias("impossible"))
    ordered = Ordered(lean, ["source", "at", "bar_id"], sized_partitions(bars, HELD))
    halo = run - 1

    def kernel(t: pa.Table, start: int, stop: int) -> pa.Table:
        def num(c: str) -> np.ndarray:
            return t[c].to_numpy().astype(float) if not t[c].null_count else t[c].cast(pa.float64()).to_pandas().to_numpy(dtype=float, na_value=np.nan)

        source = t["source"].combine_chunks().dictionary_encode()
        code = np.asarray(source.indices.fill_null(-1))
        at, vol, high, low, close = (num(c) for c in ("at", "volume", "high", "low", "close"))
        n = len(at)
        follows = np.zeros(n, bool)
        follows[1:] = (code[1:] == code[:-1]) & ~np.isnan(at[1:]) & ~np.isnan(at[:-1])
        moves = np.isfinite(vol) & (vol != 0)
        follows[1:] &= moves[1:] & moves[:-1]
        same_v, same_p = follows.copy(), follows.copy()
        with np.errstate(invalid="ignore"):
            same_v[1:] &= vol[1:] == vol[:-1]
            same_p[1:] &= (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        length = np.minimum(np.maximum(run_lengths(same_v), run_lengths(same_p)), run)
        diff = np.zeros(n)
        with np.errstate(invalid="ignore", divide="ignore"):
            diff[1:] = np.where(code[1:] == code[:-1], np.abs(np.log(close[1:]) - np.log(close[:-1])), 0.0)
        own = t.slice(start, stop - start).select(["bar_id", "source", "hour", "up", "down", "vol", "impossible"])
        cut_ = slice(start, stop)
        own = own.append_column("diff", pa.array(np.nan_to_num(diff[cut_]))).append_column("run", pa.array(length[cut_].astype(np.int32)))
        return own.append_column("block", pa.array(np.full(stop - start, TaskContext.get().partitionId(), np.int32)))

    features = ordered.with_neighbours(kernel, "bar_id long, source string, hour int, up double, down double, vol double, impossible boolean, diff double, run int, block int", halo, halo)
    levels = exact_quantiles(base, "source", q, [MIDST[0], 0.5, MIDST[1]])
    levels = levels.unionByName(exact_quantiles(features, "source", {"diff": F.col("diff")}, [MIDST[1], 1.0]))
    levels = levels.groupBy(F.col("grp").alias("source")).agg(F.collect_list(F.struct("q", "p", "x")).alias("levels"))

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for b in batches:
            u = b.column(b.schema.get_field_index("source")).unique()
            yield pa.RecordBatch.from_arrays([u, pa.array([pid] * len(u), pa.int32())], names=["source", "block"])

    blocks = ordered.map(sources, "source string, block int").distinct()
    known = blocks.select(F.col("source").alias("s"), "block")
    same_source = F.col("s").eqNullSafe(F.col("_s"))
    for part in (levels, hours):
        known = known.join(part.withColumnRenamed("source", "_s"), same_source, "left").drop("_s")
    # Kept, so that counting and judging see the same last digits of the means.
    known = cut(known.withColumnRenamed("s", "source"))

    def planted(key: tuple, left: pa.Table, right: pa.Table) -> tuple[list, np.ndarray, dict[str, np.ndarray], dict[str, float | None]]:
        """The cuts of a source's forest, its readings' features and quantities, and the medians of these."""
        ref = right.select(["hours", "levels"]).to_pylist()[0]
        source = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        hour_mean = {h["hour"]: h["mean"] for h in ref["hours"] or []}
        at = {(r["q"], r["p"]): r["x"] for r in ref["levels"] or []}
        medians = {k: at.get((k, 0.5)) for k in ("up", "down", "vol")}
        c = {k: left[k].cast(pa.float64()).to_pandas().to_numpy(dtype=float, na_value=np.nan) for k in ("hour", "up", "down", "vol", "diff", "run")}
        over = {k: c[k] / medians[k] if medians[k] else c[k] * 0 for k in medians}
        level = np.log1p(np.maximum(np.nan_to_num(np.fmax(over["up"], over["down"])), 0))
        volume = np.log1p(np.maximum(np.nan_to_num(over["vol"]), 0))
        means = np.array([hour_mean.get(h, 0.0) for h in range(25)])
        seasonal = np.nan_to_num(np.log1p(c["vol"]) - means[np.where(np.isnan(c["hour"]), 24, c["hour"]).astype(int)])
        x = np.stack([level, volume, c["diff"], seasonal, c["run"]], 1)

        # A feature's space: upwards from 0 for what can't fall below, around the hours' means for the seasonal deviation.
        top = {k: at[k, MIDST[1]] / m if m else 0.0 for k, m in medians.items()}
        high = np.array([np.log1p(max(top["up"], top["down"], 0.0)), np.log1p(max(top["vol"], 0.0)), at.get(("diff", MIDST[1])) or at.get(("diff", 1.0)) or 0.0, 0.0, 1.0])
        low = np.zeros(len(FEATURES))
        low[3], high[3] = (np.log1p(at["vol", p]) - m for p, m in zip(MIDST, (max(hour_mean.values()), min(hour_mean.values())))) if hour_mean else (0.0, 0.0)
        wide = WIDER * (high - low)
        low[3], high[:4] = low[3] - wide[3], high[:4] + wide[:4]
        low[4], high[4] = 1.0, run
        return plant(low, high, zlib.crc32((source or "").encode())), x, c, medians

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trees, x, _, _ = planted(key, left, right)
        n = counted(trees, x).ravel()
        leaf = np.flatnonzero(n)
        return pa.table({"source": left["source"].combine_chunks().take(pa.array(np.zeros(len(leaf), np.int64))), "leaf": pa.array(leaf.astype(np.int32)), "n": pa.array(n[leaf])})

    grouped = features.groupBy("source", "block")
    counts = grouped.cogroup(known.groupBy("source", "block")).applyInArrow(count, "source string, leaf int, n long")
    counts = counts.groupBy("source", "leaf").agg(F.sum("n").alias("n")).groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("leaf", "n")).alias("counts"))
    known = known.withColumnRenamed("source", "s").join(counts, same_source, "left").drop("_s").withColumnRenamed("s", "source")

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trees, own, c, medians = planted(key, left, right)
        counts = np.zeros(len(trees) * LEAVES, np.int64)
        full = right["counts"].combine_chunks().flatten()
        counts[full.field("leaf").to_numpy()] = full.field("n").to_numpy()
        counts = counts.reshape(-1, LEAVES)
        forest, n = grown(trees, counts), int(counts[:1].sum())
        s = score(forest, own, n)
        # A median of 0 tells the forest nothing of the multiple, so every reading is checked.
        blind = not forest or any(m == 0 for m in medians.values())
        above = np.log1p(factor) * (1 - 1e-9)
        floor = 0.0 if blind else min(least_score(forest, FEATURES.index(f), above, n) for f in ("level", "volume_level"))
        hot, long_ = np.flatnonzero(s >= floor), np.flatnonzero(s >= (least_score(forest, FEATURES.index("run"), run - 0.5, n) if forest else 0.0))
        spike, stuck, candidate = (np.zeros(left.num_rows, bool) for _ in range(3))
        candidate[hot] = candidate[long_] = True
        for k, m in medians.items():
            if m is not None:
                spike[hot] |= np.nan_to_num(c[k][hot], nan=-np.inf) > factor * m
        stuck[long_] = own[long_, FEATURES.index("run")] >= run
        out = left.select(["bar_id", "source", "impossible"])
        for name, x in (("spike", spike), ("stuck", stuck), ("score", s), ("candidate", candidate)):
            out = out.append_column(name, pa.array(x))
        return out

    return grouped.cogroup(known.groupBy("source", "block")).applyInArrow(judge, JUDGED_SCHEMA)


def flag_readings(bars: DataFrame, factor: float = 20.0, run: int = 6, share: float = ODD) -> DataFrame:
    """`judged_readings` with odd: the score is above the exact quantile that all but `share` of all the source's scores
    don't exceed."""
    judged = stored(judged_readings(bars, factor, run), "judged")
    usual = cut(exact_quantiles(judged, "source", {"score": F.col("score")}, [1 - share]).select("grp", "x"))
    # A row a source: sent to all tasks if these are few. Interpolation may miss equal scores by a last digit.
    usual = F.broadcast(usual) if usual.count() <= BROADCAST_ROWS else usual
    odd = F.coalesce(F.col("score") > F.col("x") * (1 + 1e-12), F.lit(False)).alias("odd")
    return judged.join(usual, F.col("source").eqNullSafe(F.col("grp")), "left").select(*[odd if c == "odd" else c for c in FLAGS])


def implausible(bars: DataFrame) -> DataFrame:
    """bar_id of every bar that breaks a limit, or that the forest lets through as a candidate and that spikes or is stuck."""
    return judged_readings(bars).filter("impossible or spike or stuck").select("bar_id")
