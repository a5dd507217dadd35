"""Problem 1: a consensus label per item, agreement, and a reliability per annotator.

Method: latent ability-difficulty estimation by gradient expectation-maximisation. Annotator j
names the true label z of item i with probability sigmoid(a[j, z] * exp(b[i])): ability times
the item's ease. A wrong label is drawn from the annotator's own distribution of errors
given z, which also puts to use annotators who confuse two labels or always err. The E step
gives the posterior of each item's label, the M step takes Newton-scaled gradient steps on the
abilities (with a normal prior around the annotator's mean) and on every item's ease (normal
prior), and sets priors and error distributions from the expected counts.

Items with the same labels by the same annotators are one pattern with a count. An iteration is
one pass over the patterns: ease and posterior follow from the parameters alone, so no state is
kept between passes, and a pass returns one row per annotator and label. Parameters are sent to
the workers: MAX_ANNOTATORS * 72 numbers at most. Passes end when no chance of being right
changes by TOLERANCE, after at most ITERATIONS; annotators() reports how many there were and
whether they converged.

Evidence: of each annotator and item the latest value that names a label of the vocabulary in
whatever written form; the record's reviewer_a / reviewer_b where that slot has none; and,
where the two reviewers differ, the adjudication (human_primary, else a label the note names)
as one more annotator whose ability is learned like the others'. Where they agree the
adjudication repeats them and is no evidence.

Cases: null ids are left out; a value that names no label is skipped; equal times are ordered
by label_id; an item with no label has no row; ties of the posterior go to the label that
stands first in the vocabulary; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.cutoffs import current_versions
from attestry.runtime import materialize, table

# The closed vocabulary, in display order, and other written forms of its labels.
LABELS = ("unit", "integration", "contract", "end_to_end", "performance", "smoke", "other", "unknown")
ALIASES = {"e2e": "end_to_end", "endtoend": "end_to_end", "perf": "performance"}

MAX_ANNOTATORS = 2000
ITERATIONS, TOLERANCE, EASE_SD = 60, 0.004, 0.5
K = len(LABELS)
ADJUDICATOR = "adjudication"


def label_of(c: Column) -> Column:
    """The label of the vocabulary that c names in any letter case, spacing or camel case, with or without 'test'; else null.

    A value that is a label as it stands, as most are, is not normalised.
    """
    snake = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "(?<=[a-z])(?=[A-Z])", "_"))
    plain = F.regexp_replace(F.regexp_replace(snake, r"(?U)[\s_\-]+", "_"), "_tests?$", "")
    forms = {x: x for x in LABELS} | ALIASES
    return F.when(c.isin(*LABELS), c).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in forms.items() for x in pair]), plain))


def code_of(c: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, LABELS)), c) - 1).cast("int")


def latest_labels(labels: DataFrame) -> DataFrame:
    """(id, annotator, slot, label): the latest value of each annotator and item that names a label."""
    named = labels.select("id", F.col("reviewer_id").alias("annotator"), "slot", "labelled_at", "label_id", label_of(F.col("primary_label")).alias("label"))
    named = named.filter("id is not null and annotator is not null and label is not null")
    return named.groupBy("id", "annotator").agg(F.max(F.struct("labelled_at", "label_id", "slot", "label")).alias("v")).select("id", "annotator", "v.slot", "v.label")


def annotator_names(labels: DataFrame) -> list[str]:
    """All annotators, those that stand for a record's own columns included; at most MAX_ANNOTATORS reach the driver."""
    names = {r[0] for r in labels.select("reviewer_id").filter("reviewer_id is not null").distinct().limit(MAX_ANNOTATORS + 1).collect()}
    if len(names) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    return sorted(names | {"record:a", "record:b", ADJUDICATOR})


def evidence(labels: DataFrame, records: DataFrame, names: list[str]) -> DataFrame:
    """(id, cells array<int>, n_reviewers, n_labels) per item with a label; a cell is K times the annotator's place in names plus the label's."""
    codes = labels.sparkSession.createDataFrame([(a, i * K) for i, a in enumerate(names)], "annotator string, base int")
    latest = latest_labels(labels).join(F.broadcast(codes), "annotator")  # at most MAX_ANNOTATORS + 3 rows
    given = latest.groupBy("id").agg(
        F.collect_list(F.col("base") + code_of(F.col("label"))).alias("given"), F.bool_or(F.lower("slot") == "a").alias("has_a"), F.bool_or(F.lower("slot") == "b").alias("has_b")
    )
    rec = current_versions(records, "reviewer_a_primary", "reviewer_b_primary", "human_primary", "adjudication_note")
    noted = F.regexp_extract(F.lower("adjudication_note"), rf"\b({'|'.join(LABELS)})\b", 1)
    rec = rec.select(
        "id", label_of(F.col("reviewer_a_primary")).alias("a"), label_of(F.col("reviewer_b_primary")).alias("b"),
        F.coalesce(label_of(F.col("human_primary")), label_of(noted)).alias("h"),
    )
    both = given.join(rec, "id", "full")
    one = lambda who, label, when: F.when(when, F.lit(names.index(who) * K) + code_of(F.col(label)))
    more = F.array_compact(F.array(
        one("record:a", "a", F.col("a").isNotNull() & ~F.coalesce("has_a", F.lit(False))), one("record:b", "b", F.col("b").isNotNull() & ~F.coalesce("has_b", F.lit(False))),
        one(ADJUDICATOR, "h", F.col("h").isNotNull() & F.coalesce(F.col("a") != F.col("b"), F.lit(False))),
    ))
    own = F.coalesce("given", F.expr("cast(array() as array<int>)"))
    distinct = F.size(F.array_distinct(F.transform(own, lambda c: c % K)))
    out = both.select("id", F.array_sort(F.concat(own, more)).alias("cells"), F.size(own).cast("bigint").alias("n_reviewers"), distinct.cast("bigint").alias("n_labels"))
    return out.filter(F.size("cells") > 0)


class Parameters:
    def __init__(self, n: int):
        self.ability = np.full((n, K), 1.0)
        self.error = np.tile((1 - np.eye(K)) / (K - 1), (n, 1, 1))
        self.prior = np.full(K, 1 / K)

    def posterior(self, item: np.ndarray, who: np.ndarray, label: np.ndarray, n: int):
        """Of n items with labels (item, who, label): posterior, ease, and per label the chance of being right."""
        right = label[:, None] == np.arange(K)
        ability, error = self.ability[who], np.log(self.error[who, :, label] + 1e-9)
        ease = np.zeros(n)
        for step in range(4):
            scale = np.exp(ease)[item]
            s = np.clip(1 / (1 + np.exp(-ability * scale[:, None])), 1e-6, 1 - 1e-6)
            score = np.where(right, np.log(s), np.log1p(-s) + error)
            logp = np.log(self.prior + 1e-12) + np.stack([np.bincount(item, score[:, z], n) for z in range(K)], 1)
            q = np.exp(logp - logp.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            if step < 3:
                w = q[item]
                grad = np.bincount(item, (w * (right - s) * ability).sum(1) * scale, n) - ease / EASE_SD**2
                curve = np.bincount(item, (w * s * (1 - s) * (ability * scale[:, None]) ** 2).sum(1), n) + 1 / EASE_SD**2
                ease = np.clip(ease + np.clip(grad / curve, -1, 1), -3, 3)
        return q, ease, s, right

    def step(self, count: np.ndarray, grad: np.ndarray, curve: np.ndarray, seen: np.ndarray) -> float:
        """M step from expected counts [who, z, label], gradient and curvature [who, z]; returns the largest change."""
        was = 1 / (1 + np.exp(-self.ability))
        mean = self.ability.mean(1, keepdims=True)
        self.ability = np.clip(self.ability + np.clip((grad - (self.ability - mean)) / (curve + 1), -1, 1), -8, 8)
        errors = count * (1 - np.eye(K))
        base = errors.sum(1, keepdims=True)
        base = base / np.maximum(base.sum(2, keepdims=True), 1e-9)
        errors = (errors + 4 * base + 0.5) * (1 - np.eye(K))
        self.error = errors / errors.sum(2, keepdims=True)
        self.prior = (seen + 1) / (seen.sum() + K)
        return float(np.abs(1 / (1 + np.exp(-self.ability)) - was).max())


def _arrays(cells: pa.ListArray):
    """item, who, label of lists of cells."""
    n = np.diff(np.asarray(cells.offsets))
    who, label = np.divmod(np.asarray(cells.flatten()), K)
    return np.repeat(np.arange(len(n)), n), who, label


_STATS = "who int, z int, grad double, curve double, " + ", ".join(f"c{i} double" for i in range(K))


def _statistics(p: Parameters):
    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(p.ability)
        count, grad, curve, seen = np.zeros((n, K, K)), np.zeros((n, K)), np.zeros((n, K)), np.zeros(K)
        for batch in it:
            if not batch.num_rows:
                continue
            item, who, label = _arrays(batch.column(0))
            q, ease, s, right = p.posterior(item, who, label, batch.num_rows)
            q = q * np.asarray(batch.column(1))[:, None]
            w, scale = q[item], np.exp(ease)[item][:, None]
            g, h = w * (right - s) * scale, w * s * (1 - s) * scale**2
            cell = who.astype(np.int64) * K + label
            for z in range(K):
                count[:, z, :] += np.bincount(cell, w[:, z], n * K).reshape(n, K)
                grad[:, z] += np.bincount(who, g[:, z], n)
                curve[:, z] += np.bincount(who, h[:, z], n)
            seen += q.sum(0)
        who, z = np.divmod(np.arange(n * K), K)
        rows = [np.r_[who, [-1] * K], np.r_[z, np.arange(K)], np.r_[grad.ravel(), seen], np.r_[curve.ravel(), [0.0] * K]]
        rows += [np.r_[count[:, :, i].ravel(), [0.0] * K] for i in range(K)]
        arrays = [pa.array(r, pa.int32() if i < 2 else pa.float64()) for i, r in enumerate(rows)]
        yield pa.RecordBatch.from_arrays(arrays, names=["who", "z", "grad", "curve", *[f"c{i}" for i in range(K)]])

    return over


def fit(items: DataFrame, n: int, iterations: int = ITERATIONS) -> Parameters:
    """items: (cells array<int>), of annotators below n. Each pass returns n * K rows to the driver."""
    p = Parameters(n)
    p.count, p.passes, p.converged = np.zeros((n, K, K)), 0, False
    patterns = materialize(items.groupBy("cells").agg(F.count("*").alias("weight")), "patterns")
    sums = [F.sum(c).alias(c) for c in ("grad", "curve", *[f"c{i}" for i in range(K)])]
    while p.passes < iterations and not p.converged:
        rows = patterns.mapInArrow(_statistics(p), _STATS).groupBy("who", "z").agg(*sums).collect()
        count, grad, curve, seen = np.zeros((n, K, K)), np.zeros((n, K)), np.zeros((n, K)), np.zeros(K)
        for r in rows:
            if r.who < 0:
                seen[r.z] = r.grad
            else:
                grad[r.who, r.z], curve[r.who, r.z], count[r.who, r.z] = r.grad, r.curve, r[4:]
        p.count = count
        p.passes += 1
        p.converged = p.step(count, grad, curve, seen) < TOLERANCE
    return p


def _coded(labels: DataFrame, records: DataFrame) -> tuple[DataFrame, list[str]]:
    names = annotator_names(labels)
    return materialize(evidence(labels, records, names), "items"), names


def _judged(p: Parameters):
    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            item, who, label = _arrays(batch.column(1))
            q, ease, _, right = p.posterior(item, who, label, batch.num_rows)
            best = q.argmax(1)
            agree = np.bincount(item, label == best[item], batch.num_rows) / np.maximum(np.bincount(item, minlength=batch.num_rows), 1)
            out = [pa.array(np.array(LABELS, object)[best], pa.string()), pa.array(q.max(1)), pa.array(np.exp(-ease)), pa.array(agree)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out, batch.column(2), batch.column(3)], names=["id", "consensus_primary", "posterior", "difficulty", "agreement", "n_reviewers", "n_labels"])

    return over


def consensus(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Per item: consensus label, its posterior, difficulty, share of labels that agree with it, reviewers and distinct labels in the label table."""
    items, names = _coded(labels, records)
    p = fit(items, len(names))
    return items.mapInArrow(_judged(p), "id string, consensus_primary string, posterior double, difficulty double, agreement double, n_reviewers bigint, n_labels bigint")


def annotators(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Per annotator with labels: labels given, expected share right, mean ability, the share right of each true
    label's items, and of the fit its passes and whether it converged."""
    items, names = _coded(labels, records)
    p = fit(items, len(names))
    total, right = p.count.sum((1, 2)), np.trace(p.count, axis1=1, axis2=2)
    recall = np.diagonal(p.count, axis1=1, axis2=2) / np.maximum(p.count.sum(2), 1e-9)
    rows = [(a, round(float(total[j])), float(right[j] / total[j]), float(p.ability[j].mean()), recall[j].tolist(), p.passes, p.converged) for j, a in enumerate(names) if total[j] > 0.5]
    return labels.sparkSession.createDataFrame(rows, "annotator string, n_labels bigint, reliability double, ability double, recall_by_label array<double>, passes int, converged boolean")


def agreement(labels: DataFrame) -> DataFrame:
    """One row: items with two or more labels, observed and expected agreement, and Krippendorff's alpha (nominal)."""
    per_item = latest_labels(labels).groupBy("id", "label").agg(F.count("*").alias("c"))
    sizes = per_item.groupBy("id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("m"))
    sizes = sizes.filter("n > 1")
    counts = [F.sum(F.coalesce(F.col("m")[label], F.lit(0))).alias(label) for label in LABELS]
    one = sizes.agg(F.count("*").alias("n_items"), F.sum("n").alias("n"), F.sum(F.col("same") / (F.col("n") - 1)).alias("same"), *counts)
    chance = sum((F.col(x) * (F.col(x) - 1) for x in LABELS), F.lit(0)) / (F.col("n") * (F.col("n") - 1))
    return one.select("n_items", F.col("n").alias("n_labels"), (F.col("same") / F.col("n")).alias("observed"), chance.alias("expected")).withColumn(
        "alpha", F.when(F.col("expected") < 1, 1 - (1 - F.col("observed")) / (1 - F.col("expected"))).otherwise(1.0)
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "reviewer_labels"), table(spark, sf_dir, "evaluation_records")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(*_tables(spark, sf_dir)).filter("n_reviewers >= 3 and n_labels > 1").select("id", "consensus_primary")


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(*_tables(spark, sf_dir))


def p1_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators(*_tables(spark, sf_dir))


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement(table(spark, sf_dir, "reviewer_labels"))


QUERIES = {"p1_found": p1_found, "p1_consensus": p1_consensus, "p1_annotators": p1_annotators, "p1_agreement": p1_agreement}
SQL = {
    "p1_agreement": r"""
with named as (select id, reviewer_id, labelled_at, label_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(primary_label, '^\s+|\s+$', '', 'g'),
    '([a-z])([A-Z])', '\1_\2', 'g')), '[\s_\-]+', '_', 'g'), '_tests?$', '') l from reviewer_labels where id is not null and reviewer_id is not null),
lab as (select id, reviewer_id, labelled_at, label_id, case l when 'e2e' then 'end_to_end' when 'endtoend' then 'end_to_end' when 'perf' then 'performance' else l end l from named),
last as (select id, reviewer_id, arg_max(l, (labelled_at, label_id)) l from lab
  where l in ('unit', 'integration', 'contract', 'end_to_end', 'performance', 'smoke', 'other', 'unknown') group by 1, 2),
cell as (select id, l, count(*) c from last group by 1, 2),
item as (select id, sum(c) n, sum(c * (c - 1)) same from cell group by 1 having sum(c) > 1),
lab_total as (select l, sum(c) t from cell semi join item using (id) group by 1),
tot as (select cast(count(*) as bigint) n_items, cast(sum(n) as bigint) n_labels, sum(same / (n - 1)) / sum(n) observed from item),
ch as (select (select sum(cast(t as double) * (t - 1)) from lab_total) / (cast(n_labels as double) * (n_labels - 1)) expected from tot)
select n_items, n_labels, observed, expected, 1 - (1 - observed) / (1 - expected) alpha from tot, ch"""
}
