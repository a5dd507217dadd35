"""Column expressions over evidence: ids, truncation, caps, import signals, features, traits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import taxonomy as X


def literal_array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def test_id(path: Column, qualified: Column) -> Column:
    return F.concat(path, F.lit("::"), qualified)


def truncated(source: Column, limit: int = X.SOURCE_BYTES) -> Column:
    """source in at most ``limit`` UTF-8 bytes: whole characters and a marker, or a bare cut where no marker fits."""
    mark = X.TRUNCATED if limit > len(X.TRUNCATED) else ""
    raw = F.encode(source, "UTF-8")
    keep = limit - len(mark)
    # a byte in 80..bf continues a character: of keep, keep - 1, .. the first size that no such byte follows
    whole = [F.when(~F.hex(F.substring(raw, n + 1, 1)).between("80", "BF"), n) for n in range(keep, max(keep - 4, -1), -1)]
    size = F.coalesce(*whole, F.lit(max(keep, 0)))
    cut = F.concat(F.decode(F.substring(raw, F.lit(1), size), "UTF-8"), F.lit(mark))
    return F.when(F.octet_length(source) <= limit, source).otherwise(cut)


def capped(values: Column, most: int = X.LIST_ENTRIES) -> Column:
    return F.slice(values, 1, most)


def import_signal(path: Column) -> Column:
    """The signal of an import path by the first rule that matches, else null."""
    out = F.lit(None).cast("string")
    for prefix, label in reversed(X.PREFIX_IMPORTS):
        out = F.when((path == prefix) | path.startswith(prefix + "."), label).otherwise(out)
    exact = F.create_map(*[F.lit(x) for pair in X.EXACT_IMPORTS for x in pair])
    return F.coalesce(F.try_element_at(exact, path), out)


def import_features(imports: Column) -> Column:
    """'imports <signal>' of the recognised imports, each once, in first order."""
    found = F.array_distinct(F.filter(F.transform(F.coalesce(imports, literal_array(())), import_signal), lambda x: x.isNotNull()))
    return F.transform(found, lambda x: F.concat(F.lit("imports "), x))


def merged_features(base: Column, extras: Column) -> Column:
    """Feature names of base, then those of extras that are not yet named."""
    return F.concat(base, F.filter(extras, lambda x: ~F.array_contains(base, x)))


def parser_traits(features: Column) -> Column:
    """The traits that feature names establish, in display order."""
    hits = [F.when(F.arrays_overlap(features, literal_array(X.TRAIT_FEATURES[t])), F.lit(t)) for t in X.DETERMINISTIC]
    return F.array_compact(F.array(*hits))


def merged_traits(parser: Column, nouls: Column) -> Column:
    """map trait -> (present, probability, source) of parser traits and a model's map trait -> probability."""
    known = F.map_from_arrays(parser, F.transform(parser, lambda _: F.lit(1.0)))
    return F.map_zip_with(
        known, nouls,
        lambda _, p, m: F.struct(
            (p.isNotNull() | (m >= X.PRESENT_FROM)).alias("present"), F.coalesce(m, p).alias("probability"),
            F.when(m.isNull(), "parser").when(p.isNull(), "jev").otherwise("combined").alias("source"),
        ),
    )


def margin(probabilities: Column, floor: bool = True) -> Column:
    """Difference of the two largest probabilities; 0 for fewer than two. The evaluator's has no floor."""
    v = F.sort_array(F.map_values(probabilities), asc=False)
    top = [F.get(v, i) for i in (0, 1)]
    if floor:
        top = [F.greatest(x, F.lit(0.0)) for x in top]
    return F.when(F.coalesce(F.size(v), F.lit(0)) < 2, 0.0).otherwise(top[0] - top[1])


def top_probability(probabilities: Column) -> Column:
    return F.greatest(F.coalesce(F.array_max(F.map_values(probabilities)), F.lit(0.0)), F.lit(0.0))


def decision(primary: Column, confidence: Column, margin_: Column, min_confidence: float | None = None, min_margin: float | None = None) -> Column:
    """accept or review. Without thresholds everything is reviewed; bounds are inclusive."""
    if min_confidence is None or min_margin is None:
        return F.lit("review")
    good = (primary != "") & (confidence >= min_confidence) & (margin_ >= min_margin)
    return F.when(F.coalesce(good, F.lit(False)), "accept").otherwise("review")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
