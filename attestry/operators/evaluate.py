"""Quality of a classifier over reviewed records: validation, confusion, per-class and per-trait
metrics, slices, acceptance, agreement of two reviewers.

Every aggregate has partial sums before its shuffle; keys are labels, traits and slices, so what
is shuffled is small whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import taxonomy as X
from attestry.functions.evidence import literal_array, margin, ratio
from attestry.functions.text import trimmed

REQUIRED = ("repository", "split", "language", "model", "question_set_version", "extractor_version", "reviewer_a_primary", "reviewer_b_primary")


def validation_error() -> Column:
    """The first fault of a reviewed row, in a fixed order; null for a valid one."""
    label = lambda c: F.coalesce(F.col(c).isin(*X.PRIMARY), F.lit(False))
    out = F.when(~label("human_primary"), "human_primary").when(~label("predicted_primary"), "predicted_primary")
    for c in REQUIRED:
        out = out.when(F.coalesce(trimmed(F.col(c)), F.lit("")) == "", f"blank {c}")
    out = out.when(~F.col("split").isin(*X.SPLITS), "split").when(~F.col("language").isin(*X.LANGUAGES), "language")
    for c in ("reviewer_a_primary", "reviewer_b_primary"):
        out = out.when(~label(c), c)
    for c in ("human_traits", "predicted_traits"):
        out = out.when(F.size(F.array_except(F.coalesce(c, literal_array(())), literal_array(X.TRAITS))) > 0, c)
    return out


def reviewed(records: DataFrame) -> DataFrame:
    """Rows that are not pending, with validation_error."""
    return records.filter(~F.coalesce("pending_human_review", F.lit(False))).withColumn("validation_error", validation_error())


def valid(records: DataFrame, strict: bool = False) -> DataFrame:
    """The valid reviewed rows. strict: the first row with a fault stops the query instead."""
    rows = reviewed(records)
    if strict:
        return rows.filter(F.when(F.col("validation_error").isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), "validation_error"))).otherwise(F.lit(True)).cast("boolean"))
    return rows.filter("validation_error is null")


def crossing_repositories(rows: DataFrame) -> DataFrame:
    """(repository, n_splits) of the repositories in more than one split."""
    return rows.groupBy("repository").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("human_primary", "predicted_primary").agg(F.count("*").alias("n"))


def _scores(counts: DataFrame, key: str) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(key, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label that occurs, from the confusion matrix (64 cells at most)."""
    cells = confusion(rows)
    sides = cells.select(F.explode(F.array_distinct(F.array("human_primary", "predicted_primary"))).alias("label"), "*")
    human, predicted = F.col("human_primary") == F.col("label"), F.col("predicted_primary") == F.col("label")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return _scores(sides.groupBy("label").agg(count(human & predicted).alias("tp"), count(~human & predicted).alias("fp"), count(human & ~predicted).alias("fn")), "label")


def macro_f1(rows: DataFrame) -> DataFrame:
    return class_metrics(rows).agg(F.avg("f1").alias("macro_f1"))


def trait_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of each trait that occurs; a trait given twice in a row counts once."""
    none = literal_array(())
    h, p = F.coalesce("human_traits", none), F.coalesce("predicted_traits", none)
    each = rows.select(h.alias("h"), p.alias("p")).select(F.explode(F.array_union("h", "p")).alias("trait"), "h", "p")
    inh, inp = F.array_contains("h", F.col("trait")), F.array_contains("p", F.col("trait"))
    return _scores(each.groupBy("trait").agg(F.count_if(inh & inp).alias("tp"), F.count_if(~inh & inp).alias("fp"), F.count_if(inh & ~inp).alias("fn")), "trait")


def slices(rows: DataFrame) -> DataFrame:
    """Accuracy by language, repository and split, in one pass over grouping sets."""
    right = F.count_if(F.col("human_primary") == F.col("predicted_primary"))
    cells = rows.groupingSets([["language"], ["repository"], ["split"]], "language", "repository", "split").agg(
        F.expr("case when grouping(language) = 0 then 'language' when grouping(repository) = 0 then 'repository' else 'split' end").alias("slice"),
        right.alias("n_correct"), F.count("*").alias("n"),
    )
    return cells.select("slice", F.coalesce("language", "repository", "split").alias("value"), "n_correct", "n", ratio(F.col("n_correct"), F.col("n")).alias("accuracy"))


def acceptance(rows: DataFrame, min_confidence: float, min_margin: float) -> DataFrame:
    """Records, accepted, accepted and right, coverage and accepted accuracy; thresholds of 0 or less accept nothing."""
    on = F.lit(min_confidence > 0 and min_margin > 0)
    ok = on & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence) & ~F.isnan(F.coalesce("confidence", F.lit(0.0))) & (margin(F.col("primary_probabilities"), floor=False) >= min_margin)
    right = F.col("human_primary") == F.col("predicted_primary")
    counts = rows.agg(F.count("*").alias("records"), F.count_if(ok).alias("accepted"), F.count_if(ok & right).alias("accepted_correct"))
    return counts.select("*", ratio(F.col("accepted"), F.col("records")).alias("coverage"), ratio(F.col("accepted_correct"), F.col("accepted")).alias("accepted_accuracy"))


def kappa(rows: DataFrame, a: str = "reviewer_a_primary", b: str = "reviewer_b_primary") -> DataFrame:
    """Cohen's kappa of two columns; 1 where chance agreement is complete, 0 without rows."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    marginal = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    both = marginal("a").join(marginal("b"), "label", "left").agg(F.sum(F.col("n_a") * F.coalesce("n_b", F.lit(0))).alias("cross"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    chance = F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    seen = F.col("same") / F.col("n")
    value = F.when(F.col("n") == 0, 0.0).when(chance == 1, 1.0).otherwise((seen - chance) / (1 - chance))
    return total.join(F.broadcast(both)).select(F.col("n").alias("records"), value.alias("kappa"))  # one row each


def cells(rows: DataFrame, min_confidence: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """(section, key1, key2, n, hit, extra): all counts of the report in one pass over the rows.

    Every row is expanded to one line per section and key; partial sums are made before the shuffle, so
    what moves is labels, traits, repositories and splits, whatever the number of rows.
    """
    none = literal_array(())
    h, p = F.coalesce("human_traits", none), F.coalesce("predicted_traits", none)
    right = F.col("human_primary") == F.col("predicted_primary")
    on = F.lit(min_confidence > 0 and min_margin > 0)
    sure = F.coalesce("confidence", F.lit(0.0))
    ok = on & (sure >= min_confidence) & ~F.isnan(sure) & (margin(F.col("primary_probabilities"), floor=False) >= min_margin)
    cell = lambda section, k1, k2, hit, extra=F.lit(False): F.struct(F.lit(section).alias("section"), k1.alias("key1"), k2.alias("key2"), hit.alias("hit"), extra.alias("extra"))
    blank = F.lit("")
    fixed = F.array(
        cell("summary", blank, blank, ok, ok & right), cell("confusion", F.col("human_primary"), F.col("predicted_primary"), right),
        cell("kappa", F.col("reviewer_a_primary"), F.col("reviewer_b_primary"), F.col("reviewer_a_primary") == F.col("reviewer_b_primary")),
        cell("by_language", F.col("language"), blank, right), cell("by_repository", F.col("repository"), blank, right), cell("by_split", F.col("split"), blank, right),
    )
    traits = F.transform(F.array_union(h, p), lambda t: cell("trait", t, F.when(~F.array_contains(h, t), "predicted").when(~F.array_contains(p, t), "human").otherwise("both"), F.lit(True)))
    each = rows.select(F.explode(F.concat(fixed, traits)).alias("c")).select("c.*")
    return each.groupBy("section", "key1", "key2").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit"), F.count_if("extra").alias("extra"))


def summary(rows: DataFrame, min_confidence: float = 0.0, min_margin: float = 0.0) -> dict:
    """The report's figures, from the counts of one pass: labels, traits, repositories and splits reach the driver."""
    found = [r.asDict() for r in cells(rows, min_confidence, min_margin).toLocalIterator()]
    of = lambda s: [r for r in found if r["section"] == s]
    div = lambda a, b: a / b if b else 0.0

    def scores(tp: int, fp: int, fn: int) -> tuple[float, float, float]:
        return div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn)

    top = next(iter(of("summary")), {"n": 0, "hit": 0, "extra": 0})
    table = {(r["key1"], r["key2"]): r["n"] for r in of("confusion")}
    primary = {}
    for label in sorted({x for pair in table for x in pair}):
        tp = table.get((label, label), 0)
        primary[label] = scores(tp, sum(n for (a, b), n in table.items() if b == label != a), sum(n for (a, b), n in table.items() if a == label != b))
    traits = {}
    for t in sorted({r["key1"] for r in of("trait")}):
        n = {r["key2"]: r["n"] for r in of("trait") if r["key1"] == t}
        traits[t] = scores(n.get("both", 0), n.get("predicted", 0), n.get("human", 0))
    pairs = of("kappa")
    a, b = ({}, {})
    for r in pairs:
        a[r["key1"]] = a.get(r["key1"], 0) + r["n"]
        b[r["key2"]] = b.get(r["key2"], 0) + r["n"]
    n = top["n"]
    seen, chance = div(sum(r["hit"] for r in pairs), n), div(sum(a[x] * b.get(x, 0) for x in a), n * n)
    return {
        "records": n, "kappa": 0.0 if not n else 1.0 if chance == 1 else (seen - chance) / (1 - chance), "macro_f1": div(sum(f for _, _, f in primary.values()), len(primary)), "primary": primary, "traits": traits,
        "confusion": sorted((*k, v) for k, v in table.items()), "coverage": div(top["hit"], n), "accuracy": div(top["extra"], top["hit"]),
        **{s: sorted((r["key1"], div(r["hit"], r["n"]), r["n"]) for r in of(s)) for s in ("by_language", "by_repository", "by_split")},
    }


def report_text(rows: DataFrame, min_confidence: float = 0.0, min_margin: float = 0.0) -> str:
    """The report as text, sections in a fixed order, names sorted."""
    s = summary(rows, min_confidence, min_margin)
    out = [f"records: {s['records']}", f"reviewer_cohens_kappa: {s['kappa']:.3f}", f"macro_f1: {s['macro_f1']:.3f}"]
    for head in ("primary", "traits"):
        out += [f"{head}:", *(f"  {k} precision={p:.3f} recall={r:.3f} f1={f:.3f}" for k, (p, r, f) in s[head].items())]
    out += ["confusion_matrix:", *(f"  {a} -> {b}: {n}" for a, b, n in s["confusion"])]
    out += [f"accepted_coverage: {s['coverage']:.3f}", f"accepted_accuracy: {s['accuracy']:.3f}"]
    for head in ("by_language", "by_repository", "by_split"):
        out += [f"{head}:", *(f"  {k} accuracy={a:.3f} n={n}" for k, a, n in s[head])]
    return "\n".join(out) + "\n"
