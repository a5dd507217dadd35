"""Problem 5: per source, the score cutoff that keeps a target fraction of its records.

Method: distributed quickselect. A source's cutoff is its k-th highest score, k the target
rank. A pass over the open scores prepares HALVINGS halvings at once: in every Arrow batch, of
each source, the median, the medians of both halves, of the quarters and so on; per place in
this order the median of a task's batches weighted by their counts, and of these the median
weighted over all tasks, are the source's pivots (2^HALVINGS - 1 at most, one row per source and
task is moved). Scores are then counted between and at the pivots, all counts but those of the
interval with the target rank are discarded, and the interval's scores are written anew for the
next pass. A pass leaves about 2^-HALVINGS of a source's scores, so a source of n takes about
log2(n) / HALVINGS passes; it ends when a pivot has the target rank. All sources go through the
same passes; there is no other way to a cutoff, whatever a source's size.

Cases: the current version of an id is its row of the latest recorded_at (a null time is the
earliest, tying rows are equal); rows without an id are left out. A target above 100 percent
keeps nothing, one of 0 or less keeps the highest score with its ties; sources without a
target have a null cutoff and keep nothing; repeated target rows of one key use the largest;
a target counts with four decimals.
Ties at the cutoff are all kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import folded, repository_key
from attestry.runtime import discard, join_hot, materialize, measured, table

#: Halvings prepared by one pass: up to 2^HALVINGS - 1 pivots per source.
HALVINGS = 4
KEYS = ["repository", "language"]


def current_versions(records: DataFrame, *fields: str) -> DataFrame:
    """One row per id: the fields of its latest row. Partial maxima are made before the shuffle."""
    return (
        records.filter("id is not null").groupBy("id")
        .agg(F.max(F.struct("recorded_at", *fields)).alias("_v"))
        .select("id", *[F.col(f"_v.{f}").alias(f) for f in fields])
    )


def counted(records: DataFrame) -> DataFrame:
    """(id, repository, language, confidence) of the records that count for a cutoff."""
    current = current_versions(records, "repository", "language", "confidence", "pending_human_review")
    return current.filter("not coalesce(pending_human_review, false) and confidence between 0 and 1").select(
        "id", repository_key(F.col("repository")).alias("repository"), folded(F.col("language")).alias("language"), "confidence"
    ).filter("repository is not null and language in ('go', 'kotlin')")


def target_ranks(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """counts (repository, language, n) with target_percent and the rank k of the cutoff; k > n: none."""
    t = targets.select(repository_key(F.col("repository")).alias("repository"), folded(F.col("language")).alias("language"), F.col("target_percent").cast("decimal(12,4)").alias("t"))
    own = t.filter("repository is not null").groupBy(*KEYS).agg(F.max("t").alias("own"))
    default = t.filter("repository is null").groupBy("language").agg(F.max("t").alias("default"))
    return (
        counts.join(own, KEYS, "left").join(default, "language", "left")
        .withColumn("target_percent", F.coalesce("own", "default"))
        # in exact decimals: the smallest k with 100 k >= target n
        .withColumn("k", F.expr("if(target_percent is null, null, greatest(1, cast(ceil(target_percent * n / 100) as bigint)))"))
        .select(*KEYS, "n", "target_percent", "k")
    )


def _batch_medians(group: np.ndarray, v: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, their sizes, and of each group's values the median, then those of the lower and the upper half, and so on.

    2^depth - 1 places a group; NaN where a part of a group is empty.
    """
    at = np.lexsort((v, group))
    group, v = group[at], v[at]
    low = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    high = np.r_[low[1:], len(group)]
    known, sizes, spans, out = group[low], high - low, [(low, high)], []
    for _ in range(depth):
        halves = []
        for lo, hi in spans:
            mid = (lo + hi - 1) // 2
            out.append(np.where(hi > lo, v[np.minimum(np.maximum(mid, 0), len(v) - 1)], np.nan))
            halves += [(lo, np.where(hi > lo, mid, lo)), (np.where(hi > lo, mid + 1, lo), hi)]
        spans = halves
    return known, sizes, np.stack(out, 1)


def _weighted_medians(group: np.ndarray, n: np.ndarray, m: np.ndarray, groups: int) -> np.ndarray:
    """Per group (0 .. groups - 1) and place the median of m weighted by n; NaNs count for nothing."""
    out = np.full((groups, m.shape[1]), np.nan)
    for place in range(m.shape[1]):
        known = np.flatnonzero(~np.isnan(m[:, place]))
        known = known[np.lexsort((m[known, place], group[known]))]
        g, upto = group[known], np.cumsum(n[known])
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
        before = np.repeat(upto[first] - n[known][first], np.diff(np.r_[first, len(g)]))
        whole = np.bincount(g, n[known], groups)
        over = np.flatnonzero(2 * (upto - before) >= whole[g])
        g_over, where = np.unique(g[over], return_index=True)
        out[g_over, place] = m[known[over[where]], place]
    return out


def _task_medians(depth: int):
    """Per source and place of the halvings the median of the task's batches, weighted by their counts.

    A task keeps 2^depth numbers per source and batch, not the scores.
    """

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        seen = []
        for batch in it:
            if not batch.num_rows:
                continue
            repo, lang = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = np.asarray(repo.indices).astype(np.int64) * len(lang.dictionary) + np.asarray(lang.indices)
            known, n, m = _batch_medians(group, np.asarray(batch.column(2)), depth)
            repos, langs = repo.dictionary.to_pylist(), lang.dictionary.to_pylist()
            seen.append((np.array([codes.setdefault((repos[g // len(langs)], langs[g % len(langs)]), len(codes)) for g in known]), n, m))
        g, n, m = (np.concatenate(x) for x in zip(*seen)) if seen else (np.zeros(0, int), np.zeros(0, int), np.zeros((0, 2**depth - 1)))
        medians, weight = _weighted_medians(g, n, m, len(codes)), np.bincount(g, n, len(codes)).astype(np.int64)
        keys = [pa.array([k[i] for k in codes], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(weight), *(pa.array(c) for c in medians.T)], names=[*KEYS, "weight", *[f"m{i}" for i in range(2**depth - 1)]])

    return over


def select_ranks(scores: DataFrame, ranks: DataFrame, halvings: int = HALVINGS, passes: list[int] | None = None) -> DataFrame:
    """(repository, language, cutoff): of each source the k-th highest of its scores.

    scores: (repository, language, confidence); ranks: (repository, language, n, k), 1 <= k <= n,
    a written step. passes, if given, gets the number of open sources of each pass.
    """
    width = 2**halvings - 1
    # a known median is no NaN; places without one are null and count for nothing
    medians = F.expr("array(" + ", ".join(f"percentile(nanvl(m{i}, null), 0.5D, weight)" for i in range(width)) + ")")
    counted_slots = F.expr("array(" + ", ".join(f"count_if(slot = {i})" for i in range(2 * width + 1)) + ")")
    schema = "repository string, language string, weight bigint, " + ", ".join(f"m{i} double" for i in range(width))
    state = ranks.select(*KEYS, "k", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    keys_size = measured(ranks.select(*KEYS))
    open_scores, found, spent = scores.select(*KEYS, "confidence"), [], []
    inside = "(low is null or confidence > low) and (high is null or confidence < high)"
    while n_open := state.count():
        if passes is not None:
            passes.append(n_open)
        size = keys_size + n_open * 8 * (width + 8)  # of what is joined to the scores: keys, k and at most width numbers
        open_scores = join_hot(open_scores, state.select(*KEYS, "low", "high"), KEYS, small_bytes=size).filter(inside).select(*KEYS, "confidence")
        if found:  # the first pass reads the scores as they stand
            open_scores = materialize(open_scores, "open")
            spent.append(open_scores)
        pivots = open_scores.mapInArrow(_task_medians(halvings), schema).groupBy(*KEYS).agg(F.sort_array(F.array_distinct(F.array_compact(medians)), asc=False).alias("pivots"))
        pivots = materialize(join_hot(pivots, state.select(*KEYS, "k"), KEYS, small_bytes=size), "pivots")
        # slot 2 i: between pivots i - 1 and i (from the top); slot 2 i + 1: at pivot i
        above = F.size(F.filter("pivots", lambda p: p > F.col("confidence")))
        slot = 2 * above + F.coalesce(F.get("pivots", above) == F.col("confidence"), F.lit(False)).cast("int")
        slots = join_hot(open_scores, pivots.select(*KEYS, "pivots"), KEYS, small_bytes=size).select(*KEYS, slot.alias("slot"))
        counts = slots.groupBy(*KEYS).agg(counted_slots.alias("counts"))
        upto = F.aggregate(
            "counts", F.struct(F.lit(-1).alias("slot"), F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("upto")),
            lambda a, c: F.when(a["upto"] >= F.col("k"), a).otherwise(F.struct((a["slot"] + 1).alias("slot"), a["upto"].alias("before"), (a["upto"] + c).alias("upto"))),
        )
        # explode of one keeps the result a column, so the counts are walked once
        at = join_hot(counts, pivots, KEYS, small_bytes=size).select(*KEYS, "k", "pivots", F.explode(F.array(upto)).alias("at"))
        i = F.expr("at.slot div 2").cast("int")
        step = materialize(at.select(
            *KEYS, (F.col("k") - F.col("at.before")).alias("k"), F.when(F.col("at.slot") % 2 == 1, F.get("pivots", i)).alias("cutoff"),
            F.get("pivots", i).alias("low"), F.get("pivots", i - 1).alias("high"),
        ), "step")
        found.append(step.filter("cutoff is not null").select(*KEYS, "cutoff"))
        state = step.filter("cutoff is null").select(*KEYS, "k", "low", "high")
    for s in spent:
        discard(s)
    out = state.select(*KEYS, F.col("low").alias("cutoff"))  # no row
    for f in found:
        out = out.unionByName(f)
    return out


def cutoffs(records: DataFrame, targets: DataFrame, passes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The counted records, and (repository, language, n, target_percent, k, cutoff) of each source."""
    base = materialize(counted(records), "counted")
    ranks = materialize(target_ranks(base.groupBy(*KEYS).agg(F.count("*").alias("n")), targets), "targets")
    chosen = select_ranks(base, ranks.filter("k <= n"), passes=passes)
    return base, ranks.join(chosen, KEYS, "left")


def kept(records: DataFrame, targets: DataFrame, passes: list[int] | None = None) -> DataFrame:
    base, found = cutoffs(records, targets, passes)
    return join_hot(base, found.select(*KEYS, "cutoff"), KEYS).filter("confidence >= cutoff").select("id", *KEYS, "confidence", "cutoff")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(table(spark, sf_dir, "evaluation_records"), table(spark, sf_dir, "cutoff_targets")).select("id")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its cutoff, the counted records and the records kept."""
    base, found = cutoffs(table(spark, sf_dir, "evaluation_records"), table(spark, sf_dir, "cutoff_targets"))
    sizes = join_hot(base, found.select(*KEYS, "cutoff"), KEYS).filter("confidence >= cutoff").groupBy(*KEYS).agg(F.count("*").alias("n_kept"))
    return found.join(sizes, KEYS, "left").select(*KEYS, F.col("target_percent").cast("double").alias("target_percent"), F.col("n").alias("n_records"), "cutoff", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


QUERIES = {"p5_found": p5_found, "p5_cutoffs": p5_cutoffs}

_KEY = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^([a-z][a-z0-9+.-]*://)?([^@/\s]+@)?forge\.example\.test[:/]+', ''), '^/+|/+$', '', 'g'), '(\.git)?/*$', ''), '')"
_SQL = f"""
with latest as (
  select id, max({{'at': recorded_at, 'r': repository, 'l': language, 'c': confidence, 'p': pending_human_review}}) v
  from evaluation_records where id is not null group by id),
base as (
  select id, {_KEY.format('v.r')} as repository, lower(regexp_replace(v.l, '^\\s+|\\s+$', '', 'g')) as language, v.c as confidence
  from latest where not coalesce(v.p, false) and v.c between 0 and 1 and not isnan(v.c)),
counted as (select *, count(*) over (partition by repository, language) n,
    rank() over (partition by repository, language order by confidence desc) below
  from base where repository is not null and language in ('go', 'kotlin')),
t as (select lower(language) l, {_KEY.format('repository')} r, target_percent p from cutoff_targets),
ranked as (select c.*, coalesce(own.p, d.p) target_percent,
    count(*) over (partition by repository, language order by confidence desc range between unbounded preceding and current row) upto
  from counted c left join t own on own.r = c.repository and own.l = c.language left join t d on d.r is null and d.l = c.language),
cut as (select repository, language, max(confidence) cutoff from ranked where 100 * upto >= target_percent * n group by 1, 2)
"""
SQL = {
    "p5_found": _SQL + "select id from ranked join cut using (repository, language) where confidence >= cutoff",
    "p5_cutoffs": _SQL + """select repository, language, cast(max(target_percent) as double) target_percent, max(n) n_records, max(cutoff) cutoff,
  count(*) filter (where confidence >= cutoff) n_kept from ranked left join cut using (repository, language) group by 1, 2""",
}
