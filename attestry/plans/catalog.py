"""The core's queries by operator, each over its whole table, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import taxonomy as X
from attestry.functions import evidence as E
from attestry.operators import discovery as D
from attestry.operators import evaluate as V
from attestry.operators import report as R
from attestry.operators import responses as A
from attestry.plans import cases as C
from attestry.runtime import Query, numbered, table

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def query(name: str, source: str, sql: str | None = None):
    """Registers a function of one table (or several, comma-separated) under a name."""

    def register(f):
        _QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in source.split(",")])
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- evaluator ---------------------------------------------------------------------------------
_P, _T = _sql_list(X.PRIMARY), "[" + _sql_list(X.TRAITS) + "]"
_BLANK = "\n".join(f"when coalesce(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '') = '' then 'blank {c}'" for c in V.REQUIRED)
_ERROR = f"""case when not coalesce(human_primary in ({_P}), false) then 'human_primary' when not coalesce(predicted_primary in ({_P}), false) then 'predicted_primary'
{_BLANK} when split not in ('development', 'holdout') then 'split' when language not in ('go', 'kotlin') then 'language'
when not coalesce(reviewer_a_primary in ({_P}), false) then 'reviewer_a_primary' when not coalesce(reviewer_b_primary in ({_P}), false) then 'reviewer_b_primary'
when not list_has_all({_T}, coalesce(human_traits, [])) then 'human_traits' when not list_has_all({_T}, coalesce(predicted_traits, [])) then 'predicted_traits' end"""
_EV = f"with rev as (select *, {_ERROR} err from evaluation_records where not coalesce(pending_human_review, false)), ev as (select * from rev where err is null)"
_SCORES = "coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1"
_CLASS = f"""lab as (select human_primary l from ev union select predicted_primary from ev),
cls as (select l as label, count(*) filter (where human_primary = l and predicted_primary = l) tp, count(*) filter (where human_primary <> l and predicted_primary = l) fp,
  count(*) filter (where human_primary = l and predicted_primary <> l) fn from lab, ev group by l), met as (select label, tp, fp, fn, {_SCORES} from cls)"""
_MARGIN = "case when coalesce(cardinality(primary_probabilities), 0) < 2 then 0 else list_reverse_sort(map_values(primary_probabilities))[1] - list_reverse_sort(map_values(primary_probabilities))[2] end"
_REC = "evaluation_records"


@query("flt_6_not_pending", _REC, "select id, recorded_at, coalesce(isnan(confidence), false) as no_number, case when not isnan(confidence) then confidence end as confidence from evaluation_records where not coalesce(pending_human_review, false)")
def _(r):
    """A confidence that is no number is told by a flag: NaN equals nothing, itself included."""
    kept = r.filter(~F.coalesce("pending_human_review", F.lit(False)))
    return kept.select("id", "recorded_at", F.isnan("confidence").alias("no_number"), F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"))


@query("flt_7_vocabulary", _REC, f"select human_primary, coalesce(human_primary in ({_P}), false) as known, count(*) n from evaluation_records group by 1, 2")
def _(r):
    return r.groupBy("human_primary", F.coalesce(F.col("human_primary").isin(*X.PRIMARY), F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


@query("flt_8_validation", _REC, _EV + " select id, recorded_at, err as validation_error from rev where err is not null")
def _(r):
    return V.reviewed(r).filter("validation_error is not null").select("id", "recorded_at", "validation_error")


@query("flt_9_crossing_repositories", _REC, _EV + " select repository, count(distinct split) n_splits from ev group by 1 having count(distinct split) > 1")
def _(r):
    return V.crossing_repositories(V.valid(r))


@query("agg_1_records", _REC, _EV + " select count(*) n from ev")
def _(r):
    return V.valid(r).agg(F.count("*").alias("n"))


@query("agg_2_class_metrics", _REC, f"{_EV}, {_CLASS} select * from met")
def _(r):
    return V.class_metrics(V.valid(r))


@query("agg_3_confusion", _REC, _EV + " select human_primary, predicted_primary, count(*) n from ev group by 1, 2")
def _(r):
    return V.confusion(V.valid(r))


_TRAIT = f"""tr as (select distinct human_traits h, predicted_traits p, id, recorded_at, row_number() over () k from ev),
each as (select k, coalesce(h, []) h, coalesce(p, []) p, unnest(list_distinct(list_concat(coalesce(h, []), coalesce(p, [])))) trait from tr),
cnt as (select trait, count(*) filter (where list_contains(h, trait) and list_contains(p, trait)) tp, count(*) filter (where not list_contains(h, trait) and list_contains(p, trait)) fp,
  count(*) filter (where list_contains(h, trait) and not list_contains(p, trait)) fn from each group by 1)"""


@query("agg_4_trait_metrics", _REC, f"{_EV}, {_TRAIT} select trait, tp, fp, fn, {_SCORES} from cnt")
def _(r):
    return V.trait_metrics(V.valid(r))


@query(
    "agg_5_slices", _REC,
    _EV + """ select 'language' as slice, language as value, count(*) filter (where human_primary = predicted_primary) n_correct, count(*) n, count(*) filter (where human_primary = predicted_primary) / count(*) accuracy from ev group by language
union all select 'repository', repository, count(*) filter (where human_primary = predicted_primary), count(*), count(*) filter (where human_primary = predicted_primary) / count(*) from ev group by repository
union all select 'split', split, count(*) filter (where human_primary = predicted_primary), count(*), count(*) filter (where human_primary = predicted_primary) / count(*) from ev group by split""",
)
def _(r):
    return V.slices(V.valid(r))


@query(
    "agg_6_7_acceptance", _REC,
    f"""{_EV}, a as (select *, coalesce(confidence, 0) >= 0.5 and not isnan(coalesce(confidence, 0)) and {_MARGIN} >= 0.2 ok from ev)
select count(*) records, count(*) filter (where ok) accepted, count(*) filter (where ok and human_primary = predicted_primary) accepted_correct,
coalesce(count(*) filter (where ok) / nullif(count(*), 0), 0) coverage, coalesce(count(*) filter (where ok and human_primary = predicted_primary) / nullif(count(*) filter (where ok), 0), 0) accepted_accuracy from a""",
)
def _(r):
    return V.acceptance(V.valid(r), 0.5, 0.2)


@query(
    "agg_8_kappa", _REC,
    f"""{_EV}, t as (select cast(count(*) as bigint) n, count(*) filter (where reviewer_a_primary = reviewer_b_primary) s from ev),
a as (select reviewer_a_primary l, count(*) c from ev group by 1), b as (select reviewer_b_primary l, count(*) c from ev group by 1),
e as (select sum(cast(a.c as double) * b.c) x from a join b using (l))
select n as records, case when n = 0 then 0 when x / (n * n) = 1 then 1 else (s / n - x / (cast(n as double) * n)) / (1 - x / (cast(n as double) * n)) end as kappa from t, e""",
)
def _(r):
    return V.kappa(V.valid(r))


@query("agg_9_macro_f1", _REC, f"{_EV}, {_CLASS} select avg(f1) macro_f1 from met")
def _(r):
    return V.macro_f1(V.valid(r))


_RIGHT = "human_primary = predicted_primary"
_CELLS = " union all ".join(
    f"select '{section}' as section, {k1} as key1, {k2} as key2, count(*) n, count(*) filter (where {hit}) hit, count(*) filter (where {extra}) extra from ac group by 1, 2, 3"
    for section, k1, k2, hit, extra in (
        ("summary", "''", "''", "ok", f"ok and {_RIGHT}"), ("confusion", "human_primary", "predicted_primary", _RIGHT, "false"), ("kappa", "reviewer_a_primary", "reviewer_b_primary", "reviewer_a_primary = reviewer_b_primary", "false"),
        ("by_language", "language", "''", _RIGHT, "false"), ("by_repository", "repository", "''", _RIGHT, "false"), ("by_split", "split", "''", _RIGHT, "false"),
    )
)


@query(
    "snk_3_report", _REC,
    f"""{_EV}, ac as (select *, coalesce(confidence, 0) >= 0.5 and not isnan(coalesce(confidence, 0)) and {_MARGIN} >= 0.2 ok from ev),
one as (select coalesce(human_traits, []) h, coalesce(predicted_traits, []) p, unnest(list_distinct(list_concat(coalesce(human_traits, []), coalesce(predicted_traits, [])))) t from ev)
{_CELLS} union all select 'trait', t, case when not list_contains(h, t) then 'predicted' when not list_contains(p, t) then 'human' else 'both' end, count(*), count(*), 0 from one group by 1, 2, 3""",
)
def _(r):
    """All counts that the report's text is made of, in one pass."""
    return V.cells(V.valid(r), 0.5, 0.2)


@query(
    "agg_10_probability_sum", _REC,
    "select id, recorded_at, round(list_sum(map_values(primary_probabilities)), 6) as total, round(abs(list_sum(map_values(primary_probabilities)) - 1), 9) <= 0.02 as sums_to_one from evaluation_records where primary_probabilities is not null and cardinality(primary_probabilities) > 0",
)
def _(r):
    s = A.probability_sum(F.col("primary_probabilities"))
    return r.filter(F.size("primary_probabilities") > 0).select("id", "recorded_at", F.round(s, 6).alias("total"), (F.round(F.abs(s - 1), 9) <= X.SUM_TOLERANCE).alias("sums_to_one"))


_TOP = "coalesce(list_max(map_values(primary_probabilities)), 0)"


@query("prj_15_16_17_margins", _REC, f"select id, recorded_at, round(greatest({_TOP}, 0), 6) top, round({_MARGIN}, 6) margin from evaluation_records where primary_probabilities is not null")
def _(r):
    p = F.col("primary_probabilities")
    return r.filter(p.isNotNull()).select("id", "recorded_at", F.round(E.top_probability(p), 6).alias("top"), F.round(E.margin(p), 6).alias("margin"))


@query(
    "pol_2_threshold_policy", _REC,
    f"select id, recorded_at, case when coalesce(predicted_primary <> '' and confidence >= 0.8 and round({_MARGIN}, 9) >= 0.5, false) then 'accept' else 'review' end as decision from evaluation_records",
)
def _(r):
    return r.select("id", "recorded_at", E.decision(F.col("predicted_primary"), F.col("confidence"), F.round(E.margin(F.col("primary_probabilities")), 9), 0.8, 0.5).alias("decision"))


@query(
    "pol_1_default_policy", _REC,
    f"select id, recorded_at, language, case when language = 'go' and coalesce(predicted_primary <> '' and confidence >= 0.3 and round({_MARGIN}, 9) >= 0.1, false) then 'accept' else 'review' end as decision from evaluation_records",
)
def _(r):
    """Thresholds are set for Go only: everything else goes the way of the default policy, which reviews whatever the answer."""
    answer = (F.col("predicted_primary"), F.col("confidence"), F.round(E.margin(F.col("primary_probabilities")), 9))
    return r.select("id", "recorded_at", "language", F.when(F.col("language") == "go", E.decision(*answer, 0.3, 0.1)).otherwise(E.decision(*answer)).alias("decision"))


@query(
    "set_2_trait_sets", _REC,
    "select id, recorded_at, array_to_string(list_sort(list_distinct(list_filter(coalesce(human_traits, []), lambda x: list_contains(coalesce(predicted_traits, []), x)))), ',') as hits, array_to_string(list_sort(list_distinct(list_filter(coalesce(human_traits, []), lambda x: not list_contains(coalesce(predicted_traits, []), x)))), ',') as missed from evaluation_records",
)
def _(r):
    none = E.literal_array(())
    h, p = F.coalesce("human_traits", none), F.coalesce("predicted_traits", none)
    return r.select("id", "recorded_at", F.array_join(F.array_sort(F.array_intersect(h, p)), ",").alias("hits"), F.array_join(F.array_sort(F.array_except(h, p)), ",").alias("missed"))


@query(
    "cls_2_primary_checks", _REC,
    f"""with v as (select *, map_values(primary_probabilities) p, map_keys(primary_probabilities) k from evaluation_records)
select id, recorded_at, case when not coalesce(predicted_primary in ({_P}), false) then 'unknown primary type' when p is null or len(p) = 0 then 'no probabilities'
when confidence is null then 'no confidence' when isnan(confidence) or confidence < 0 or confidence > 1 then 'confidence out of range'
when len(list_filter(k, lambda x: x not in ({_P}))) > 0 then 'unknown probability label' when len(list_filter(p, lambda x: x is null or isnan(x) or x < 0 or x > 1)) > 0 then 'probability out of range'
when round(abs(list_sum(p) - 1), 9) > 0.02 then 'probability sum' when not list_contains(k, predicted_primary) then 'choice not in probabilities' end as error from v""",
)
def _(r):
    a = F.struct(F.lit("choice").alias("type"), F.col("predicted_primary").alias("choice"), F.col("primary_probabilities").alias("probabilities"), "confidence", F.lit(None).cast("double").alias("noul"))
    return r.select("id", "recorded_at", A.primary_error(a).alias("error"))


@query("prj_18_confidence_text", _REC, "select id, recorded_at, printf('%.2f', confidence) as conf from evaluation_records where confidence between 0 and 1 and not isnan(confidence)")
def _(r):
    return r.filter("confidence between 0 and 1").select("id", "recorded_at", F.format_number("confidence", 2).alias("conf"))


@query("jon_6_marginals", _REC, f"{_EV}, a as (select reviewer_a_primary l, count(*) n_a from ev group by 1), b as (select reviewer_b_primary l, count(*) n_b from ev group by 1) select a.l as label, n_a, coalesce(n_b, 0) n_b from a left join b using (l)")
def _(r):
    v = V.valid(r)
    a, b = (v.groupBy(F.col(f"reviewer_{s}_primary").alias("label")).agg(F.count("*").alias(f"n_{s}")) for s in "ab")
    return a.join(b, "label", "left").select("label", "n_a", F.coalesce("n_b", F.lit(0)).alias("n_b"))


# -- evidence ----------------------------------------------------------------------------------
_EVD = "test_evidence"
_SIGNAL = "case " + " ".join(f"when x = '{m}' then '{s}'" for m, s in X.EXACT_IMPORTS) + " " + " ".join(f"when x = '{m}' or starts_with(x, '{m}.') then '{s}'" for m, s in X.PREFIX_IMPORTS) + " end"
_FEATURES = f"list_transform(list_filter(list_transform(coalesce(imports, []), lambda x: {_SIGNAL}), lambda s: s is not null), lambda s: 'imports ' || s)"
_FIRST = "list_filter({0}, lambda s, i: list_position({0}, s) = i)"
_NAMES = "list_transform(coalesce(features, []), lambda f: f.name)"


@query("prj_1_test_id", _EVD, "select seq, recorded_at, path || '::' || qualified as test_id from test_evidence")
def _(e):
    return e.select("seq", "recorded_at", E.test_id(F.col("path"), F.col("qualified")).alias("test_id"))


def _cut_sql(limit: int) -> str:
    keep = limit - len(X.TRUNCATED)
    ok = lambda n: f"substr(hex(encode(source)), {2 * n + 1}, 2) not between '80' and 'BF'"
    n = f"case when {ok(keep)} then {keep} when {ok(keep - 1)} then {keep - 1} when {ok(keep - 2)} then {keep - 2} else {keep - 3} end"
    return f"case when octet_length(encode(source)) <= {limit} then source else decode(unhex(substr(hex(encode(source)), 1, 2 * ({n})))) || chr(10) || '// ... evidence truncated ...' end"


@query("prj_2_3_truncate", _EVD, f"select seq, recorded_at, {_cut_sql(512)} as source from test_evidence where source is not null")
def _(e):
    return e.filter("source is not null").select("seq", "recorded_at", E.truncated(F.col("source"), 512).alias("source"))


@query("prj_4_5_limits", _EVD, f"select seq, recorded_at, len(imports[1:64]) n_imports, len(annotations[1:64]) n_annotations, len(features[1:64]) n_features, octet_length(encode({_cut_sql(8192)})) n_bytes from test_evidence where source is not null and imports is not null and annotations is not null and features is not null")
def _(e):
    e = e.filter("source is not null and imports is not null and annotations is not null and features is not null")
    n = lambda c: F.size(E.capped(F.col(c))).cast("bigint")
    return e.select("seq", "recorded_at", n("imports").alias("n_imports"), n("annotations").alias("n_annotations"), n("features").alias("n_features"), F.octet_length(E.truncated(F.col("source"))).cast("bigint").alias("n_bytes"))


@query("prj_6_import_signal", _EVD, f"with i as (select unnest(imports) x from test_evidence) select x as import, {_SIGNAL} as signal, count(*) n from i group by 1, 2")
def _(e):
    i = e.select(F.explode("imports").alias("import"))
    return i.groupBy("import", E.import_signal(F.col("import")).alias("signal")).agg(F.count("*").alias("n"))


@query("prj_7_import_features", _EVD, f"with f as (select seq, recorded_at, {_FEATURES} f from test_evidence) select seq, recorded_at, array_to_string({_FIRST.format('f')}, '|') as features from f")
def _(e):
    return e.select("seq", "recorded_at", F.array_join(E.import_features(F.col("imports")), "|").alias("features"))


@query(
    "prj_8_merged_features", _EVD,
    f"with f as (select seq, recorded_at, {_NAMES} b, {_FEATURES} f from test_evidence) select seq, recorded_at, array_to_string(list_concat(b, list_filter({_FIRST.format('f')}, lambda x: not list_contains(b, x))), '|') as features from f",
)
def _(e):
    base = F.coalesce(F.transform("features", lambda f: f["name"]), E.literal_array(()))
    return e.select("seq", "recorded_at", F.array_join(E.merged_features(base, E.import_features(F.col("imports"))), "|").alias("features"))


_TRAITS_SQL = "list_concat(" + ", ".join(f"case when list_has_any({_NAMES}, [{_sql_list(X.TRAIT_FEATURES[t])}]) then ['{t}'] else [] end" for t in X.DETERMINISTIC) + ")"


@query("jon_2_parser_traits", _EVD, f"select seq, recorded_at, array_to_string({_TRAITS_SQL}, ',') as traits from test_evidence")
def _(e):
    names = F.coalesce(F.transform("features", lambda f: f["name"]), E.literal_array(()))
    return e.select("seq", "recorded_at", F.array_join(E.parser_traits(names), ",").alias("traits"))


@query("jon_5_rule_counts", _EVD, f"with i as (select unnest(imports) x from test_evidence), s as (select {_SIGNAL} label from i) select label, count(*) n from s where label is not null group by 1")
def _(e):
    """The rule lookup as a join: distinct imports against the 21 rules, first rule wins."""
    spark = e.sparkSession
    rules = spark.createDataFrame([(i, m, i >= len(X.EXACT_IMPORTS), s) for i, (m, s) in enumerate(X.EXACT_IMPORTS + X.PREFIX_IMPORTS)], "ord int, rule string, below boolean, label string")
    paths = e.select(F.explode("imports").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    hit = (F.col("x") == F.col("rule")) | (F.col("below") & F.col("x").startswith(F.concat("rule", F.lit("."))))
    return paths.join(F.broadcast(rules), hit).groupBy("x", "n").agg(F.min_by("label", "ord").alias("label")).groupBy("label").agg(F.sum("n").alias("n"))


# Sources of the evidence table, read again by the readers: Kotlin functions as they stand, Go functions after a package clause.
_WHOLE = f"source is not null and source not like '%{X.TRUNCATED.strip()}' and qualified not like '%/%'"
_READ_AGAIN = f"select distinct seq, source from test_evidence where language = '{{0}}' and {_WHOLE}"


def _read_again(e: DataFrame, language: str) -> DataFrame:
    from attestry.extract import stage

    rows = e.filter(F.col("language") == language).filter(_WHOLE).select("seq", "source").distinct()
    text = F.concat(F.lit("package p\n\n"), "source") if language == "go" else F.col("source")
    return stage.extracted(rows.select(F.col("seq").cast("string").alias("path"), F.lit(language).alias("language"), F.encode(text, "UTF-8").alias("content")))


@query("flt_11_kotlin_tests", _EVD, f"select seq, count(*) n from ({_READ_AGAIN.format('kotlin')}) where regexp_matches(source, '@(?:[a-z]+:)?(?:[A-Za-z_0-9]+\\.)*({'|'.join(X.TEST_ANNOTATIONS)})\\b') group by 1")
def _(e):
    """The Kotlin reader over every whole Kotlin source: which are tests by their annotations."""
    return _read_again(e, "kotlin").filter("error is null").groupBy(F.col("path").cast("bigint").alias("seq")).agg(F.count("*").alias("n"))


# Kotlin text without its strings, comments (of which the innermost go first) and the names of functions where they are declared.
_BARE = r'''regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])+''|//[^\n]*', ' ', 'g'), '/\*(?:[^*/]|\*[^/]|/[^*])*\*/', ' ', 'g'), '/\*[\s\S]*?\*/', ' ', 'g'), '\bfun\s+(?:`[^`]*`|\w+)\s*\(', ' ', 'g')'''

# A brace on the line after the signature is not taken for its body.
_BODIED = "not regexp_matches(source, 'fun [^\\n]*\\)[^\\n{=]*\\n\\s*\\{')"


@query("flt_12_golden_calls", _EVD, f"select seq, {_BODIED} and regexp_matches({_BARE}, '(?i)[A-Za-z_0-9]*golden[A-Za-z_0-9]*`?\\s*\\(') golden, {_BODIED} and regexp_matches({_BARE}, '(?i)[A-Za-z_0-9]*snapshot[A-Za-z_0-9]*`?\\s*\\(') snapshot from (" + _READ_AGAIN.format("kotlin") + f") where regexp_matches(source, '@(?:[a-z]+:)?(?:[A-Za-z_0-9]+\\.)*({'|'.join(X.TEST_ANNOTATIONS)})\\b')")
def _(e):
    """The Kotlin reader over every whole Kotlin test: which call something golden or a snapshot."""
    has = lambda f: F.array_contains("names", f)
    return _read_again(e, "kotlin").filter("error is null").select(F.col("path").cast("bigint").alias("seq"), has("golden comparison call").alias("golden"), has("snapshot assertion call").alias("snapshot"))


@query("gen_6_interval", _EVD, f"select seq, regexp_matches(source, 'for [^\\n]*range [^\\n]*\\{{\\n(?:[^\\n]*\\n)?\\s*t\\.Run\\(') table_driven from ({_READ_AGAIN.format('go')}) where regexp_matches(source, '^func Test\\w*\\(t \\*testing\\.T\\)')")
def _(e):
    """The Go reader over every whole Go test: whether a call of t.Run lies inside the span of a range loop."""
    found = _read_again(e, "go").filter("error is null and qualified not like '%/%'").filter(F.col("source").rlike(r"^func Test\w*\(t \*testing\.T\)"))
    return found.select(F.col("path").cast("bigint").alias("seq"), F.array_contains("names", "go table-driven subtest loop").alias("table_driven")).distinct()


@query("flt_13_run_size", _EVD, f"select count(*) n, count(*) > {X.RUN_TESTS} as too_many from test_evidence")
def _(e):
    return e.agg(F.count("*").alias("n")).withColumn("too_many", F.col("n") > X.RUN_TESTS)


@query(
    "prj_12_requests", _EVD,
    f"select seq, '{X.MODEL}' as model, coalesce(language, '') as language, coalesce(nullif(name, ''), qualified) as test_name, len(coalesce(annotations, [])[1:64]) n_annotations, len(coalesce(imports, [])[1:64]) n_imports, array_to_string({_NAMES}[1:64], '|') as features, coalesce({_cut_sql(8192)}, '') as source, {1 + len(X.ASKED)} as n_questions, 'noul' as kind, false as too_long from test_evidence",
)
def _(e):
    """Requests, read back: model, state and questions of every one."""
    state = "struct<language: string, test_name: string, annotations: array<string>, imports: array<string>, features: array<string>, source: string>"
    r = A.requests(e, X.MODEL).withColumn("r", F.from_json("request", f"model string, state {state}, questions map<string, struct<type: string>>"))
    n = lambda c: F.size(c).cast("bigint")
    return r.select(
        "seq", "r.model", "r.state.language", "r.state.test_name", n("r.state.annotations").alias("n_annotations"), n("r.state.imports").alias("n_imports"), F.array_join("r.state.features", "|").alias("features"), "r.state.source",
        F.size("r.questions").alias("n_questions"), F.col("r.questions")["trait_database"]["type"].alias("kind"), "too_long",
    )


@query("prj_13_questions", _EVD, f"select 'trait_' || unnest([{_sql_list(X.ASKED)}]) as question, (select count(*) from test_evidence) n_tests")
def _(e):
    n = e.agg(F.count("*").alias("n_tests"))
    return n.select(F.explode(F.transform(E.literal_array(X.ASKED), A.trait_question)).alias("question"), "n_tests")


@query("srt_2_report_order", _EVD, "select path || '::' || qualified as test, seq, row_number() over (order by path || '::' || qualified, seq, recorded_at) as position from test_evidence where path is not null and qualified is not null")
def _(e):
    rows = e.filter("path is not null and qualified is not null").select(E.test_id(F.col("path"), F.col("qualified")).alias("test"), "seq", "recorded_at")
    ordered = rows.repartitionByRange("test", "seq", "recorded_at").sortWithinPartitions("test", "seq", "recorded_at")
    return numbered(ordered, "position").select("test", "seq", "position")


@query(
    "snk_1_report_rows", _REC,
    f"""select coalesce(predicted_primary, '') as type, array_to_string(list_sort(list_distinct(coalesce(predicted_traits, []))), ',') as traits, printf('%.2f', confidence) as conf,
case when coalesce(predicted_primary <> '' and confidence >= 0.8 and round({_MARGIN}, 9) >= 0.5, false) then 'accept' else 'review' end as status, repository || '::' || id as test from evaluation_records where confidence between 0 and 1 and not isnan(confidence)""",
)
def _(r):
    """Reviewed records as report rows: type, present traits, confidence, decision and id of every one."""
    present = F.transform(F.array_distinct(F.coalesce("predicted_traits", E.literal_array(()))), lambda t: F.struct(t.alias("k"), F.struct(F.lit(True).alias("present")).alias("v")))
    shown = r.filter("confidence between 0 and 1").select(
        F.col("recorded_at").alias("seq"), F.col("repository").alias("path"), F.col("id").alias("qualified"), F.map_from_entries(present).alias("traits"), F.coalesce("predicted_primary", F.lit("")).alias("primary"), "confidence",
        E.decision(F.col("predicted_primary"), F.col("confidence"), F.round(E.margin(F.col("primary_probabilities")), 9), 0.8, 0.5).alias("decision"),
    )
    return R.rows(shown)


# -- model answers -------------------------------------------------------------------------------
def _case_list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("cls_3_4_stored_cases", _EVD, f"select seq, cast({_case_list(e for _, e in C.RESPONSES)}[seq % {len(C.RESPONSES)} + 1] as varchar) as response_error from (select distinct seq from test_evidence)")
def _(e):
    """The stored answers, one to every test: each must have the error written beside it."""
    texts = E.literal_array([r for r, _ in C.RESPONSES])
    one = e.select("seq").distinct().select("seq", F.get(texts, F.pmod("seq", F.lit(len(C.RESPONSES))).cast("int")).alias("response"))
    return A.decoded(one).withColumn("response_error", A.response_error()).select("seq", "response_error")


def _answered(r: DataFrame, asked) -> DataFrame:
    """Answers with what the records say, dirt included: a record's model, label, probabilities and confidence, and a value for each
    of the traits in ``asked`` (an array column), which is high for a predicted one."""
    noul = lambda t: F.struct(F.lit("noul").alias("type"), F.lit(None).cast("string").alias("choice"), F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("double").alias("confidence"), F.when(F.array_contains(F.coalesce("predicted_traits", E.literal_array(())), t), 0.9).otherwise(0.1).alias("noul"))
    primary = F.struct(F.lit("choice").alias("type"), F.col("predicted_primary").alias("choice"), F.col("primary_probabilities").alias("probabilities"), F.col("confidence").alias("confidence"), F.lit(None).cast("double").alias("noul"))
    answers = F.map_concat(F.create_map(F.lit("primary_type"), primary), F.map_from_entries(F.transform(asked, lambda t: F.struct(A.trait_question(t).alias("k"), noul(t).alias("v")))))
    return r.select("id", "recorded_at", "predicted_traits", "human_traits", F.to_json(F.struct("model", answers.alias("answers"))).alias("response"))


_ANSWER_ERROR = f"""case when isnan(confidence) or len(list_filter(map_values(primary_probabilities), lambda x: isnan(x))) > 0 then 'invalid JSON' when coalesce(model, '') = '' then 'missing model'
when not coalesce(predicted_primary in ({_P}), false) then 'unknown primary type' when coalesce(cardinality(primary_probabilities), 0) = 0 then 'no probabilities'
when confidence is null then 'no confidence' when confidence < 0 or confidence > 1 then 'confidence out of range'
when len(list_filter(map_keys(primary_probabilities), lambda x: x not in ({_P}))) > 0 then 'unknown probability label' when len(list_filter(map_values(primary_probabilities), lambda x: x is null or x < 0 or x > 1)) > 0 then 'probability out of range'
when round(abs(list_sum(map_values(primary_probabilities)) - 1), 9) > 0.02 then 'probability sum' when not list_contains(map_keys(primary_probabilities), predicted_primary) then 'choice not in probabilities' end"""


@query("cls_1_4_response_errors", _REC, f"select id, recorded_at, {_ANSWER_ERROR} as response_error from evaluation_records")
def _(r):
    """Every record's answer as JSON, decoded and checked: the first fault of each. A confidence of NaN is not a JSON number."""
    return A.decoded(_answered(r, E.literal_array(X.ASKED))).withColumn("response_error", A.response_error()).select("id", "recorded_at", "response_error")


_NAMED = "list_concat(coalesce(human_traits, []), coalesce(predicted_traits, []))"


@query("jon_4_missing_answers", _REC, f"select id, recorded_at, array_to_string(list_filter([{_sql_list(X.ASKED)}], lambda t: not list_contains({_NAMED}, t)), ',') as missing from evaluation_records where not coalesce(isnan(confidence), false) and len(list_filter(coalesce(map_values(primary_probabilities), []), lambda x: isnan(x))) = 0")
def _(r):
    """Answers to the traits that a record names, against those that are asked: which are missing."""
    none = E.literal_array(())
    d = A.decoded(_answered(r, F.array_union(F.coalesce("human_traits", none), F.coalesce("predicted_traits", none)))).filter("valid_json")
    return d.select("id", "recorded_at", F.array_join(A.missing_answers(F.col("answers")), ",").alias("missing"))


@query("agg_11_errors", _REC, f"select row_number() over (order by id, recorded_at, f) as position, id || ': ' || f as error from (select id, recorded_at, {_ANSWER_ERROR} f from evaluation_records) where f is not null and id is not null")
def _(r):
    """All errors in order, as numbered rows: their number is not bounded, so they are not joined into one text."""
    d = A.decoded(_answered(r, E.literal_array(X.ASKED))).withColumn("err", A.response_error()).filter("err is not null and id is not null").select("id", "recorded_at", "err")
    ordered = numbered(d.repartitionByRange("id", "recorded_at", "err").sortWithinPartitions("id", "recorded_at", "err"), "position")
    return ordered.select("position", F.concat("id", F.lit(": "), "err").alias("error"))


_JEV = " union all ".join(f"select seq, '{t}' as trait, ((seq + 17 * {i}) % 101) / 100.0 as m from (select distinct seq from test_evidence)" for i, t in enumerate(X.ASKED))


def _recorded(seqs: DataFrame) -> DataFrame:
    """Recorded answers (seq, response) with trait values by seq, to be merged with what the parser found."""
    value = lambda i: F.format_number(F.pmod(F.col("seq") + 17 * i, F.lit(101)) / 100, 2)
    answers = ",".join(f'"trait_{t}":{{"type":"noul","noul":%s}}' for t in X.ASKED)
    shape = '{"model":"m-1","answers":{"primary_type":{"type":"choice","choice":"unit","probabilities":{"unit":0.6,"other":0.4},"confidence":0.5},' + answers + "}}"
    return seqs.select("seq", F.format_string(shape, *map(value, range(len(X.ASKED)))).alias("response"))


@query(
    "jon_1_3_merged_traits", _EVD,
    f"""with m as ({_JEV}), one as (select seq, arg_max(features, recorded_at) as features from (select * replace (coalesce(features, []) as features) from test_evidence) group by seq),
p as (select seq, unnest({_TRAITS_SQL}) trait from one)
select coalesce(m.seq, p.seq) seq, coalesce(m.trait, p.trait) trait, p.trait is not null or m.m >= 0.5 as present, round(coalesce(m.m, 1), 6) as probability,
case when m.m is null then 'parser' when p.trait is null then 'jev' else 'combined' end as source from m full join p on m.seq = p.seq and m.trait = p.trait""",
)
def _(e):
    """The latest delivery of every test, merged with its answer."""
    none = F.expr("cast(array() as array<struct<name: string, source: string>>)")
    one = e.groupBy("seq").agg(F.max_by(F.coalesce("features", none), "recorded_at").alias("features"))
    p = A.predictions(one, _recorded(e.select("seq").distinct())).filter("response_error is null")
    return p.select("seq", F.explode("traits").alias("trait", "v")).select("seq", "trait", "v.present", F.round("v.probability", 6).alias("probability"), "v.source")


# -- discovery ---------------------------------------------------------------------------------
_SRC = "source_files"
_LANG = r"case lower(regexp_extract(path, '(\.[^./]*)$', 1)) when '.go' then 'go' when '.kt' then 'kotlin' end"
_CONV = rf"case {_LANG} when 'go' then ends_with(path, '_test.go') when 'kotlin' then regexp_matches(path, '({'|'.join(X.KOTLIN_STEMS)})\.[^./]*$') or " + " or ".join(f"contains('/' || lower(path), '{m}')" for m in X.KOTLIN_PATHS) + " else false end"
_GLOBS = ("*_test.go", "pkg/**", "**/*Spec.kt", "cmd/*/[a-m]*_test.go", "internal/*.go")


@query("src_3_pruned", _SRC, f"select file_id, recorded_at, list_has_any(string_split(path, '/')[1:-2], [{_sql_list(X.PRUNED)}]) as pruned from source_files where path is not null")
def _(s):
    return s.filter("path is not null").select("file_id", "recorded_at", D.pruned(F.col("path")).alias("pruned"))


@query("src_5_language", _SRC, f"select file_id, recorded_at, {_LANG} as lang from source_files")
def _(s):
    return s.select("file_id", "recorded_at", D.language(F.col("path")).alias("lang"))


@query("src_6_convention", _SRC, f"select file_id, recorded_at, {_CONV} as conventional from source_files where path is not null")
def _(s):
    return s.filter("path is not null").select("file_id", "recorded_at", D.conventional(F.col("path")).alias("conventional"))


@query(
    "src_4_set_1_candidates", _SRC,
    f"""with c as (select file_id, path, source_path, {_LANG} as language, {_CONV} as conv, row_number() over (partition by source_path order by file_id, path, recorded_at) n from source_files
where {_LANG} is not null and {_CONV} and not list_has_any(string_split(path, '/')[1:-2], [{_sql_list(X.PRUNED)}]) and not regexp_matches('/' || path, '^(?:/[^/]*)*/cmd(?:/.*)?$'))
select file_id, path, source_path, language from c where n = 1""",
)
def _(s):
    files = s.select("file_id", "path", "source_path", F.col("file_id").alias("root_ord"))
    return D.candidates(files, exclude=["cmd/**"]).select("file_id", "path", "source_path", "language")


@query("src_8_bounded_read", _SRC, "select file_id, recorded_at, case when octet_length(content) > 1500 then 'file exceeds 1500 byte limit' end as reason, octet_length(content) n_bytes from source_files where content is not null")
def _(s):
    """The bound on a file's bytes, set so low that it divides the files."""
    n = F.octet_length("content")
    return s.filter("content is not null").select("file_id", "recorded_at", D.over_long(n, 1500).alias("reason"), n.cast("bigint").alias("n_bytes"))


@query("srt_1_files_in_order", _SRC, f"select row_number() over (order by encode(path), encode(source_path)) as position, path, source_path from (select distinct path, source_path from source_files where path is not null and source_path is not null and {_LANG} is not null)")
def _(s):
    """Files as a run takes them, numbered in their order."""
    files = s.filter("path is not null and source_path is not null").filter(D.language(F.col("path")).isNotNull()).select("path", "source_path").distinct()
    return numbered(D.in_order(files), "position").select("position", "path", "source_path")


_GLOB_SQL = {"*_test.go": "regexp_matches(path, '^(.*/)?[^/]*_test\\.go$')", "pkg/**": "regexp_matches(path, '^(.*/)?pkg(/.*)?$')", "**/*Spec.kt": "regexp_matches(path, '^(.*/)?[^/]*Spec\\.kt$')", "cmd/*/[a-m]*_test.go": "regexp_matches(path, '^(.*/)?cmd/[^/]*/[a-m][^/]*_test\\.go$')", "internal/*.go": "regexp_matches(path, '^(.*/)?internal/[^/]*\\.go$')"}


@query("flt_1_2_globs", _SRC, "select file_id, recorded_at, " + ", ".join(f"{_GLOB_SQL[g]} as g{i}" for i, g in enumerate(_GLOBS)) + " from source_files where path is not null")
def _(s):
    return s.filter("path is not null").select("file_id", "recorded_at", *[D.matches_any(F.col("path"), [g]).alias(f"g{i}") for i, g in enumerate(_GLOBS)])


@query("flt_4_5_include_exclude", _SRC, f"select file_id, recorded_at, {_GLOB_SQL['**/*Spec.kt']} or {_GLOB_SQL['internal/*.go']} as included, regexp_matches('/' || path, '^(?:/[^/]*)*/(?:pkg|shard)(?:/.*)?$') as excluded from source_files where path is not null")
def _(s):
    return s.filter("path is not null").select("file_id", "recorded_at", D.matches_any(F.col("path"), ["**/*Spec.kt", "internal/*.go"]).alias("included"), D.excluded(F.col("path"), ["pkg", "shard"]).alias("excluded"))


@query("snk_2_skipped", "skipped_files", "select path, reason from skipped_files")
def _(s):
    return R.skipped_rows(s)


# -- extraction --------------------------------------------------------------------------------
@query("gen_extracted_tests", _SRC)
def _(s):
    from attestry.extract import stage

    files = s.select(F.concat_ws("/", "repository", "path").alias("path"), D.language(F.col("path")).alias("language"), "content")
    t = stage.tests(stage.extracted(files))
    return t.select("path", "ord", "qualified", "language", "annotations", "imports", "source", F.transform("features", lambda f: f["name"]).alias("features"))


@query("gen_15_skipped", _SRC)
def _(s):
    from attestry.extract import stage

    return stage.skipped(stage.extracted(s.select("path", D.language(F.col("path")).alias("language"), "content")))


@query(
    "gen_1_12_known_tests", "source_files,test_evidence",
    """select distinct repository, path, qualified from test_evidence where repository is not null and qualified not like '%/%'
and (repository, path) in (select repository, path from source_files where content is not null)""",
)
def _(s, e):
    """The tests of the evidence table that the extractors find in the files: all whose file is there."""
    from attestry.extract import stage

    files = s.select(F.concat_ws("\n", "repository", "path").alias("path"), D.language(F.col("path")).alias("language"), "content")
    found = stage.extracted(files).filter("error is null").select(F.col("path").alias("at"), "qualified").distinct()
    known = e.filter("repository is not null and qualified not like '%/%'").select("repository", "path", "qualified", F.concat_ws("\n", "repository", "path").alias("at")).distinct()
    return known.join(found, ["at", "qualified"], "left_semi").select("repository", "path", "qualified")


_MARKED = r"length(regexp_replace(regexp_extract({0}, '^([\s\S]*?)(?:^|{1})(?:<<<<<<< )', 1), '[^`]', '', 'g')) % 2 = 0 and regexp_matches({0}, '(?:^|{1})<<<<<<< ')"


@query("gen_15_conflicts", _SRC, "select distinct file_id from source_files where content is not null and ends_with(lower(path), '.go') and " + _MARKED.format("cast(content as varchar)", r"\\x0A"))
def _(s):
    """Go files with a merge conflict's marker at the start of a line, outside a raw string: every one is skipped for its syntax."""
    from attestry.extract import stage

    text = F.decode("content", "ISO-8859-1")
    before = F.regexp_extract(text, r"^([\s\S]*?)(?:^|\n)(?:<<<<<<< )", 1)
    marked = text.rlike(r"(?:^|\n)<<<<<<< ") & (F.char_length(F.regexp_replace(before, "[^`]", "")) % 2 == 0)
    files = s.filter("content is not null").filter(marked).select(F.col("file_id").cast("string").alias("path"), D.language(F.col("path")).alias("language"), "content")
    return stage.skipped(stage.extracted(files.filter("language = 'go'"))).select(F.col("path").cast("bigint").alias("file_id")).distinct()
