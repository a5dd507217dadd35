"""Problem 7: mixing sources to target weights, sizes in tokens of a public vocabulary.

Method: Poisson replication. The mean number of copies of a source's documents is its share
of the total over its size. Each document gets a number of copies by inverting a Poisson
distribution at a uniform value hashed from seed, id and text; the distribution is cut at the
source's cap and its parameter is set so that the mean *after* the cut is the wanted one.
Copies are exploded and shuffled globally: sorted by a hash over all partitions, whose ranges are known
beforehand, so there is no sampling pass.

The total is by default the largest at which every source that has documents can have its
weight (weights are shared out over those sources) within its cap. With a larger ``total``
sources at their cap fall short and the others share the rest by weight (water filling).

Cases: sources are compared as written, outer blanks aside; documents with a source that is
null or has no target, and targets without documents, null, negative or NaN weights get no
rows in the mixture and a line in the report; a null cap is 1; repeated target rows add their
weights and keep the smallest cap; null and empty texts have size 0 and are mixed like any
other; repeated documents draw alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import trimmed
from attestry.llm.encoding import count_tokens
from attestry.runtime import materialize, table

#: Most sources a target table may name: their rates are literals of the plan.
MAX_TARGETS = 10_000


#: Tokens wanted in a partition of the mixture: some 50 MB of text.
PARTITION_TOKENS = 16_000_000


@dataclass(frozen=True)
class Rate:
    source: str
    weight: float
    cap: int
    size: int
    mean: float
    #: steps[k] is the probability of at most k copies, k < cap
    steps: tuple[float, ...]


def capped_mean(lam: float, cap: int) -> float:
    """E[min(X, cap)] of a Poisson variable: the sum over k < cap of P(X > k)."""
    p = cum = math.exp(-lam)
    total = 1 - cum
    for k in range(1, cap):
        p *= lam / k
        cum += p
        total += 1 - cum
    return total


def poisson_steps(mean: float, cap: int) -> tuple[float, ...]:
    """The cumulative probabilities of 0 .. cap - 1 copies such that the mean with the cap is ``mean``."""
    if mean >= cap * (1 - 1e-9):
        return (0.0,) * cap
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    p = cum = math.exp(-lo)
    steps = [cum]
    for k in range(1, cap):
        p *= lo / k
        cum += p
        steps.append(cum)
    return tuple(steps)


def plan_rates(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> list[Rate]:
    """Mean copies per source; see the module's text for the total."""
    live = [(s, w, c) for s, w, c in targets if sizes.get(s, 0) > 0 and w > 0 and c > 0]
    weight = sum(w for _, w, _ in live)
    if total is None:
        total = min((c * sizes[s] * weight / w for s, w, c in live), default=0.0)
    full: set[str] = set()
    while True:
        rest = total - sum(c * sizes[s] for s, _, c in live if s in full)
        open_weight = sum(w for s, w, _ in live if s not in full)
        over = {s for s, w, c in live if s not in full and w / open_weight * rest > c * sizes[s] * (1 + 1e-12)}
        if not over:
            break
        full |= over
    means = {s: float(c) if s in full else min(float(c), w / open_weight * rest / sizes[s]) for s, w, c in live}
    return [Rate(s, w, c, sizes.get(s, 0), means.get(s, 0.0), poisson_steps(means[s], c) if s in means else ()) for s, w, c in targets]


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = (
        targets.select(trimmed(F.col("source")).alias("source"), F.col("target_weight").alias("w"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("c"))
        .filter("source is not null and w > 0 and not isnan(w)")
        .groupBy("source").agg(F.sum("w").alias("w"), F.min("c").alias("c")).orderBy("source").limit(MAX_TARGETS + 1).collect()
    )
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources have targets")
    return [(r.source, r.w, int(r.c)) for r in rows]


def _uniform(seed: int, *cols: str):
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _copies(spark: SparkSession, df: DataFrame, rates: list[Rate], draw: str = "_u") -> DataFrame:
    """df with n_copies; rates has at most MAX_TARGETS rows, so it is broadcast."""
    known = spark.createDataFrame([(r.source, list(r.steps)) for r in rates if r.steps], "source string, _steps array<double>")
    joined = df.join(F.broadcast(known), "source")
    return joined.withColumn("n_copies", F.size(F.filter("_steps", lambda p: F.col(draw) >= p))).drop("_steps", draw)


def sized(documents: DataFrame, seed: int, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, _u, n_tokens): one pass over the texts, written to the shared folder."""
    docs = documents.select("doc_id", trimmed(F.col("source")).alias("source"), _uniform(seed, "doc_id", "text").alias("_u"), "text")
    return materialize(count_tokens(docs, vocabulary=vocabulary), "sizes")


def source_sizes(sizes: DataFrame, targets: list[tuple[str, float, int]]) -> dict[str, int]:
    """Tokens of each targeted source; at most MAX_TARGETS rows reach the driver."""
    names = sizes.sparkSession.createDataFrame([(s,) for s, _, _ in targets], "source string")
    return {r.source: r.n or 0 for r in sizes.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20240607, vocabulary: str | None = None) -> DataFrame:
    """(position, doc_id, source, copy, text) in shuffled order: sorted by position over all partitions."""
    spark = documents.sparkSession
    wanted = _targets(targets)
    docs = documents.select("doc_id", trimmed(F.col("source")).alias("source"), "text")
    names = spark.createDataFrame([(s,) for s, _, _ in wanted], "source string")
    sizes = {
        r.source: r.n
        for r in count_tokens(docs.join(F.broadcast(names), "source", "left_semi").select("source", "text"), vocabulary=vocabulary).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    }
    rates = plan_rates(wanted, sizes, total)
    drawn = _copies(spark, docs.withColumn("_u", _uniform(seed, "doc_id", "text")), rates).filter("n_copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.select(F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("position"), "doc_id", "source", "copy", "text")
    # positions are hashes, evenly spread over all bigints, so the ranges need no sample: partition i holds the i-th part of them
    tokens = sum(r.size * r.mean for r in rates)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(tokens / PARTITION_TOKENS))
    part = F.least(F.floor((F.col("position").cast("double") / float(1 << 64) + 0.5) * parts).cast("int"), F.lit(parts - 1))
    return out.repartitionById(parts, part).sortWithinPartitions("position", "doc_id", "copy")


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20240607, vocabulary: str | None = None) -> DataFrame:
    """One row per source of either table: sizes, wanted and actual shares, wanted and actual repetition."""
    spark = documents.sparkSession
    wanted = _targets(targets)
    sizes = sized(documents, seed, vocabulary)
    rates = plan_rates(wanted, source_sizes(sizes, wanted), total)
    known = spark.createDataFrame(
        [(r.source, r.weight, r.cap, r.mean) for r in rates], "source string, target_weight double, max_repeats int, target_repeats double"
    )
    drawn = _copies(spark, sizes, rates).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n_copies")).alias("mixed_tokens"), F.sum("n_copies").alias("n_rows"), F.max("n_copies").alias("most_repeats")
    )
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    out = have.join(F.broadcast(known), "source", "full").join(drawn, "source", "left")
    whole = drawn.agg(F.sum("mixed_tokens").alias("_all"))  # one row
    return out.join(F.broadcast(whole)).select(
        "source", "target_weight", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        "target_repeats", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.try_divide("mixed_tokens", "_all"), F.lit(0.0)).alias("actual_share"),
    )


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
