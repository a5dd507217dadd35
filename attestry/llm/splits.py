"""Problem 4: train / validation / test splits that keep related records together.

Method: iterative minimum-label propagation over the bipartite graph of records and entities,
then stratified assignment of whole groups to splits.

Entities are repositories. Records are what names them: links (two entities each) and
evaluation records (one; if versions of one id name several, all of these). A record with one
entity can pass no label on, so only the others are carried through the rounds; the rest take
their entity's label at the end. Entities are numbered once in the order of their names, so a
label is a number and the least label is that of the least name. In a round each record takes
the least label of its entities and each entity the least of its records, then every label is
replaced by its own label (pointer jumping), so a chain of n links needs about log n rounds. A
round's labels are written to the shared folder.

Assignment: groups (never parts of them) are packed. The at most HEAD largest groups, those
with at least 1/HEAD of the records, stand alone; all others fall by hash into BINS bins.
Per head group or bin the records per label are counted (at most HEAD + BINS rows reach the
driver, whatever the input), and in descending size each goes to the split where it leaves
the least squared deviation from the wanted number of records per label.

Cases: null and blank repositories name nothing: such records form a group of their own each
(by id); null relations, self links and links to null join nothing; rows without an id are
left out; an empty table gives an empty result; repeated rows change nothing; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions.text import folded, repository_key
from attestry.llm.consensus import label_of
from attestry.llm.cutoffs import current_versions
from attestry.runtime import BROADCAST_BYTES, hot_keys, join_hot, materialize, measured, numbered, table

# The relations that do not make two repositories one.
UNRELATED = ("depends_on", "cites")
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
HEAD, BINS, ROUNDS = 1000, 2048, 60


def link_edges(links: DataFrame) -> DataFrame:
    """(record bigint, entity) of the links that count, two rows each; repeats collapse."""
    pairs = links.select(
        repository_key(F.col("repository")).alias("a"), repository_key(F.col("related_to")).alias("b"), folded(F.col("relation")).alias("kind")
    ).filter("a is not null and b is not null and a <> b and kind is not null").filter(~F.col("kind").isin(*UNRELATED))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs.withColumn("record", F.monotonically_increasing_id()), "pairs")  # written, so the numbers stay
    return pairs.select("record", F.explode(F.array("a", "b")).alias("entity"))


def record_edges(entities: DataFrame) -> DataFrame:
    """(record bigint, entity) of ids that name several entities; entities: (id, repository), distinct."""
    several = entities.groupBy("id").agg(F.min("repository").alias("lo"), F.max("repository").alias("hi")).filter("lo < hi")
    several = materialize(several.select("id", (-1 - F.monotonically_increasing_id()).alias("record")), "several")  # below 0: no link's number
    return join_hot(entities, several, ["id"]).select("record", F.col("repository").alias("entity"))


def groups(edges: DataFrame) -> DataFrame:
    """(entity, label) of every entity in edges (record, entity), a written step without repeats: the least entity it is joined to."""
    names = materialize(numbered(edges.select("entity").distinct().repartitionByRange("entity").sortWithinPartitions("entity"), "e"), "entities")
    edges = materialize(join_hot(edges, names, ["entity"]).select("record", "e"), "numbered_edges")
    labels = names.select("e", F.col("e").alias("label"))
    size, hot = measured(labels), None
    if size > BROADCAST_BYTES:
        hot = materialize(hot_keys(edges, ["e"]), "hot")  # the edges stay, so do their hot entities
    for _ in range(ROUNDS):
        by_record = join_hot(edges, labels, ["e"], small_bytes=size, hot=hot).groupBy("record").agg(F.min("label").alias("label"))
        # a record is in two edges, or in as many as an id has names: no hot key, a plain join
        by_entity = edges.join(by_record, "record").groupBy("e").agg(F.min("label").alias("label"))
        if size > BROADCAST_BYTES:
            by_entity = materialize(by_entity, "by_entity")
        jump = by_entity.select(F.col("e").alias("label"), F.col("label").alias("next"))
        # the least label of an entity's label, never above it; it changes if it is not the entity's label of the round before
        after = join_hot(by_entity, jump, ["label"], small_bytes=size).select("e", F.least("label", "next").alias("label"))
        after = materialize(after.join(labels.select("e", F.col("label").alias("was")), "e"), "labels")
        changed = after.filter("label <> was").limit(1).count()
        labels = after.select("e", "label")
        if not changed:
            least = names.select(F.col("e").alias("label"), F.col("entity").alias("name"))
            named = join_hot(labels, least, ["label"]).select("e", F.col("name").alias("label"))
            return names.join(named, "e").select("entity", "label")
    raise RuntimeError(f"labels still changed after {ROUNDS} rounds")


def repository_groups(records: DataFrame, links: DataFrame, with_records: bool = False) -> DataFrame:
    """(repository, grp) of every repository in a counting link (and, if asked, in ids that name several)."""
    edges = link_edges(links)
    if with_records:
        named = records.filter("id is not null").select("id", repository_key(F.col("repository")).alias("repository")).filter("repository is not null")
        edges = edges.unionByName(record_edges(materialize(named.distinct(), "named")))
    return groups(edges).select(F.col("entity").alias("repository"), F.col("label").alias("grp"))


def violations(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, grp) of the records whose group has records of both splits."""
    used = records.filter("id is not null and repository is not null and split is not null")
    # per written form of repository and split, of which there are few a repository: which splits it has
    forms = used.select(F.col("repository").alias("form"), F.col("split").alias("side")).distinct()
    forms = forms.select("form", "side", repository_key(F.col("form")).alias("repository"), folded(F.col("side")).alias("split"))
    forms = materialize(forms.filter("repository is not null and split in ('development', 'holdout')"), "forms")
    grp = repository_groups(records, links)
    placed = materialize(join_hot(forms, grp, ["repository"], "left").select("form", "side", F.coalesce("grp", "repository").alias("grp"), (F.col("split") == "holdout").alias("held")), "placed")
    mixed = placed.groupBy("grp").agg(F.bool_or("held").alias("any"), F.bool_and("held").alias("all")).filter("any and not all").select("grp")
    bad = join_hot(placed, materialize(mixed, "mixed"), ["grp"]).select(F.col("form").alias("repository"), F.col("side").alias("split"), "grp")
    return join_hot(used.select("id", "repository", "split"), materialize(bad, "bad"), ["repository", "split"]).select("id", "grp").distinct()


def _pack(rows: list, labels: list[str], share: dict[str, float]) -> dict[tuple[bool, str], str]:
    """Unit -> split: largest first, each where the squared deviation per label ends least."""
    total = {x: sum(r.n[i] for r in rows) for i, x in enumerate(labels)}
    have = {s: [0] * len(labels) for s in share}
    want = {s: [share[s] * total[x] for x in labels] for s in share}
    out = {}
    for r in sorted(rows, key=lambda r: (-sum(r.n), r.head, r.unit)):
        gain = {s: sum((have[s][i] + r.n[i] - want[s][i]) ** 2 - (have[s][i] - want[s][i]) ** 2 for i in range(len(labels))) for s in share}
        best = min(share, key=lambda s: (gain[s], s))
        out[r.head, r.unit] = best
        have[best] = [a + b for a, b in zip(have[best], r.n)]
    return out


def assign(records: DataFrame, links: DataFrame, proportions: dict[str, float] | None = None, label: str = "human_primary", strata: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """(id, grp, label, split): every current record in a split, groups whole, labels in proportion.

    A written form of a label of the vocabulary counts as that label; any other value is only folded.
    strata: the label values balanced one by one (a bounded list); all others count as one more.
    """
    spark = records.sparkSession
    share = proportions or PROPORTIONS
    share = {s: p / sum(share.values()) for s, p in share.items()}
    current = current_versions(records, "repository", label).select("id", repository_key(F.col("repository")).alias("repository"), F.coalesce(label_of(F.col(label)), folded(F.col(label))).alias("label"))
    grp = repository_groups(records, links, with_records=True)
    placed = join_hot(current, materialize(grp, "groups"), ["repository"], "left").select("id", F.coalesce("grp", "repository", F.concat(F.lit("\tid "), "id")).alias("grp"), "label")
    placed = materialize(placed, "placed")
    values = list(strata)
    counts = [F.count_if(F.col("label") == v).alias(f"c{i}") for i, v in enumerate(values)]
    other = F.count_if(~F.coalesce(F.col("label").isin(*values), F.lit(False))) if values else F.count("*")
    sizes = materialize(placed.groupBy("grp").agg(*counts, other.alias(f"c{len(values)}"), F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    unit = sizes.withColumn("head", F.col("size") * HEAD >= F.lit(total)).withColumn(
        "unit", F.when(F.col("head"), F.col("grp")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "grp"), F.lit(BINS)).cast("string"))
    )
    packed = unit.groupBy("head", "unit").agg(F.array(*[F.sum(f"c{i}") for i in range(len(values) + 1)]).alias("n")).collect()  # at most HEAD + BINS rows
    chosen = _pack(packed, [*values, ""], share)
    plan = spark.createDataFrame([(h, u, s) for (h, u), s in chosen.items()] or [(False, "", "")], "head boolean, unit string, split string")
    where = unit.join(F.broadcast(plan), ["head", "unit"]).select("grp", "split")
    return join_hot(placed, where, ["grp"]).select("id", "grp", "label", "split")


# The closed vocabulary of primary labels.
PRIMARY = ("unit", "integration", "contract", "end_to_end", "performance", "smoke", "other", "unknown")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(table(spark, sf_dir, "evaluation_records"), table(spark, sf_dir, "repository_links")).select("id").distinct()


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "evaluation_records"), table(spark, sf_dir, "repository_links"), strata=PRIMARY)


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and groups per split and label, with the split's share of the label."""
    placed = p4_splits(spark, sf_dir)
    cells = placed.groupBy("label", "split").agg(F.count("*").alias("n_records"))  # one row per label and split
    return cells.select("label", "split", "n_records", (F.col("n_records") / F.sum("n_records").over(Window.partitionBy("label"))).alias("share"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_balance": p4_balance}

_KEY = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^([a-z][a-z0-9+.-]*://)?([^@/\s]+@)?forge\.example\.test[:/]+', ''), '^/+|/+$', '', 'g'), '(\.git)?/*$', ''), '')"
SQL = {
    "p4_found": f"""
with recursive e as (select {_KEY.format('repository')} a, {_KEY.format('related_to')} b from repository_links
    where lower(trim(relation)) not in ('depends_on', 'cites')),
edge as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(r, s) as (select a, a from edge union select reach.r, edge.b from reach join edge on reach.s = edge.a),
grp as (select r, min(s) g from reach group by r),
rec as (select id, {_KEY.format('repository')} r, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) s from evaluation_records where id is not null),
used as (select id, coalesce(g, rec.r) g, s from rec left join grp on grp.r = rec.r where rec.r is not null and s in ('development', 'holdout'))
select distinct id from used where g in (select g from used group by g having count(distinct s) > 1)"""
}
