"""Report rows and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.evidence import test_id

HEADER = ("TYPE", "TRAITS", "CONF", "STATUS", "TEST")


def trait_text(traits):
    """The present traits of map trait -> struct(present, ...), sorted, joined by commas."""
    return F.array_join(F.array_sort(F.map_keys(F.map_filter(traits, lambda _, v: v["present"]))), ",")


def rows(classified: DataFrame) -> DataFrame:
    """(type, traits, conf, status, test), ordered by test id and seq."""
    out = classified.withColumn("test", test_id(F.col("path"), F.col("qualified"))).orderBy("test", "seq")
    return out.select(F.col("primary").alias("type"), trait_text(F.col("traits")).alias("traits"), F.format_number("confidence", 2).alias("conf"), F.col("decision").alias("status"), "test")


def render(table: DataFrame) -> str:
    """The aligned text table: columns two spaces apart, the last unpadded. Rows stream to the driver twice."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    sizes = table.agg(*[F.coalesce(F.max(F.char_length(c)), F.lit(0)) for c in cells]).first()
    widths = [max(n, len(h)) + 2 for n, h in zip(sizes, HEADER, strict=True)]
    line = lambda values: "".join(v.ljust(w) for v, w in zip(values[:-1], widths, strict=False)) + values[-1]
    body = [line([x or "" for x in r]) for r in table.toLocalIterator()]
    return "\n".join([line(list(HEADER)), *body]) + "\n"


def render_header() -> str:
    """The table of no rows."""
    return "".join(h.ljust(len(h) + 2) for h in HEADER[:-1]) + HEADER[-1] + "\n"


def skipped_rows(skipped: DataFrame) -> DataFrame:
    return skipped.select("path", "reason").orderBy("path", "reason")


def render_skipped(skipped: DataFrame) -> str:
    body = [f"  {r.path}: {r.reason}\n" for r in skipped_rows(skipped).toLocalIterator()]
    return "SKIPPED FILES\n" + "".join(body) if body else ""
