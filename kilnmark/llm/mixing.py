"""Problem 9: mixing sources to target weights, by temperature.

The token share of every source is raised to an exponent. A common one, bisected to the entropy of the target shares,
is where each source's own bisection starts: it ends at the smallest exponent whose weight is neither above the
source's target nor above what its repetition limit allows. What limited sources leave open raises the targets of the
others, until no further source meets its limit. The normalised weights become token budgets, which are met by whole
passes over a source and a last part of a pass, taken as a prefix of a random permutation of its blocks. A source is
short if the mix as realised has used it up and still holds less of it than its target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored
from .worker import kept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text before this public vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_DOCS = 1_000  # documents in a block of the permutation
NEAR = 1e-9  # relative distance at which a bisected budget counts as at its limit


def load_tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(c: str = "source") -> Column:
    """Sources are the same after trimming and lower-casing."""
    return F.lower(F.trim(F.col(c)))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, small letters, may be null), tokens: 0 for null or empty text. Whole texts count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept(("tokenizer", vocabulary), lambda: load_tokenizer(vocabulary))
        for b in batches:
            n = [len(t.encode_ordinary(x.as_py())) if x.is_valid else 0 for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source"), "text").mapInArrow(count, "doc_id long, source string, tokens long")


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bent(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """shares ** exponent, scaled to sum to 1; sources without a share keep none."""
    w = {k: p**exponent if p > 0 else 0.0 for k, p in shares.items()}
    total = sum(w.values()) or 1.0
    return {k: x / total for k, x in w.items()}


def exponent_for_entropy(shares: dict[str, float], wanted: float) -> float:
    """The exponent in [0, 1] at which the bent shares have the wanted entropy, which falls as the exponent rises."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(bent(shares, mid)) > wanted else (low, mid)
    return (low + high) / 2


def bounded_exponent(share: float, bound: float, start: float = 1.0) -> float:
    """The smallest exponent at which share ** exponent is at most bound; share lies between 0 and 1, bound above 0."""
    low, high = 0.0, max(start, 1e-9)
    if 1.0 <= bound:
        return 0.0
    while share**high > bound:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if share**mid > bound else (low, mid)
    return high


def plan(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int) -> list[dict]:
    """Token budgets of the sources: one dict a target source, with its exponent and the common one.

    The mix is as large as the targets' share of `total`, or as the repetition limits allow. Sources without tokens or
    target get budget 0 and no exponent. Exact to one part in 1e9, a budget that near to its limit being the limit."""
    limit = {s: sizes.get(s, 0) * repeats[s] for s in targets}
    live = [s for s in targets if limit[s] > 0 and targets[s] > 0]
    shares = {s: sizes[s] / (total + 1) for s in live}
    scale = sum(targets.values()) or 1.0
    wanted = entropy({s: t / scale for s, t in targets.items() if t > 0})
    common = exponent_for_entropy(bent(shares, 1.0), wanted)
    full: set[str] = set()
    weights, exponents = {}, {}
    while True:
        free = [s for s in live if s not in full]
        open_ = sum(targets[s] for s in targets) - sum(limit[s] / total for s in full)
        level = open_ / (sum(targets[s] for s in free) or 1.0)
        exponents = {s: bounded_exponent(shares[s], min(limit[s] / total, level * targets[s] if s in free else math.inf), common) for s in live}
        weights = {s: shares[s] ** exponents[s] for s in live}
        met = {s for s in free if weights[s] * total > limit[s] * (1 - NEAR)}
        if not met:
            break
        full |= met
    norm = sum(weights.values()) or 1.0
    size = norm * total

    def budget(s: str) -> int:
        x = size * weights.get(s, 0.0) / norm
        return limit[s] if x > limit[s] * (1 - NEAR) else int(x)

    return [{"source": s, "target_share": targets[s], "max_repeats": repeats[s], "tokens": sizes.get(s, 0), "budget": budget(s), "exponent": exponents.get(s), "common": common} for s in targets]


PLAN = "source string, target_share double, max_repeats int, tokens long, budget long, exponent double, common double"


def mix_plan(counts: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """The plan of every target source, from token counts (see token_counts), and the tokens of all documents.

    Only sums per target source reach the driver: as many rows as `targets` has. Target rows without a source or a
    finite target above 0 are left out, a null max_repeats is 1, one below 0 is 0; of rows that name the same source
    the one spelled smallest counts, then the smallest target and limit."""
    t = F.col("target_share")
    want = targets.select("source", source_key().alias("k"), t.cast("double").alias("t"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("int").alias("r"))
    want = want.filter(F.col("k").isNotNull() & (F.col("t") > 0) & ~F.isnan("t") & (F.col("t") != float("inf")))
    want = want.groupBy(F.col("k").alias("source")).agg(F.min(F.struct("source", "t", "r")).alias("w")).select("source", "w.t", "w.r")
    by = cut(counts.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = by.agg(F.sum("tokens")).first()[0] or 0
    rows = want.join(by, "source", "left").select("source", "t", "r", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
    made = plan({r["source"]: r["tokens"] for r in rows}, {r["source"]: r["t"] for r in rows}, {r["source"]: r["r"] for r in rows}, total)
    names = [c.split()[0] for c in PLAN.split(", ")]
    return counts.sparkSession.createDataFrame([tuple(x[k] for k in names) for x in sorted(made, key=lambda x: x["source"])], PLAN), total


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, times) and its report.

    times: how often a document is used, at most max_repeats of its source; documents that aren't used don't come out.
    The report has, per target source, plan and outcome: used tokens, reached share of the mix, and whether it is short:
    every document with tokens is used as often as allowed, and yet less than the target share of the corpus came
    together. Documents of a null or untargeted source are not used but count in the total size that target shares
    refer to. Null and empty texts have size 0 and ride along with their block. Needs doc_id unique; an empty corpus
    gives an empty mix, of which nothing is short."""
    counts = stored(token_counts(documents, vocabulary), "tokens")
    todo, total = mix_plan(counts, targets)
    sizes = counts.groupBy("source").agg(F.count("*").alias("docs"))
    p = todo.join(sizes, "source").filter("tokens > 0").select("source", F.expr("budget div tokens").alias("passes"), F.expr("budget % tokens").alias("rest"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"))
    placed = counts.join(F.broadcast(p), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    blocks = placed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("left", F.col("rest") - before).select("source", "block", "size", "left")
    placed = placed.join(blocks, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = (F.col("left") > 0) & (F.col("size") > F.col("left"))
    split = placed.filter(edge).withColumn("more", F.sum("tokens").over(inside) <= F.col("left"))
    whole = placed.filter(~edge).withColumn("more", F.col("left") >= F.col("size"))
    mix = whole.unionByName(split).withColumn("times", (F.col("passes") + F.col("more").cast("int")).cast("int")).filter("times > 0").select("doc_id", "source", "tokens", "times")
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"))
    report = todo.join(F.broadcast(used), "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    used_up = F.col("used") >= F.col("tokens") * F.col("max_repeats")
    report = report.withColumn("short", used_up & (F.col("used") < F.col("target_share") * F.lit(total)))
    report = report.withColumn("reached_share", F.col("used") / F.sum("used").over(Window.partitionBy(F.lit(1))))
    return mix, report


def short_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, as targets spell it, of those that the realised mix (see mixed) leaves short of their target."""
    report = mixed(documents, targets, vocabulary=vocabulary)[1]
    names = targets.select("source", source_key().alias("k"))
    return names.join(F.broadcast(report.filter("short").select(F.col("source").alias("k"))), "k").select("source")
