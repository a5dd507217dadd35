"""Extraction as one Arrow stage: files in, tests and skipped files out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import taxonomy as X
from attestry.extract import go, kotlin
from attestry.extract.common import SyntaxFault
from attestry.functions.evidence import capped, import_features, literal_array, merged_features, truncated
from attestry.runtime import spread

READERS = {"go": go.tests, "kotlin": kotlin.tests}
_SCHEMA = "path string, ord int, qualified string, language string, name string, annotations array<string>, imports array<string>, source string, names array<string>, error string"


def _extract(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for path, language, content, reason in zip(pdf.path, pdf.language, pdf.content, pdf.reason, strict=True):
            if reason is not None:
                rows.append((path, -1, None, language, None, None, None, None, None, reason))
                continue
            try:
                found = READERS[language](bytes(content))
                rows += [(path, i, t["qualified"], language, t["name"], t["annotations"], t["imports"], t["source"], t["features"], None) for i, t in enumerate(found)]
            except (SyntaxFault, RecursionError) as e:
                rows.append((path, -1, None, language, None, None, None, None, None, f"parse {path}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "ord", "qualified", "language", "name", "annotations", "imports", "source", "names", "error"])


def extracted(files: DataFrame) -> DataFrame:
    """(path, language, content[, reason]) to tests and error rows in one schema; write it once before splitting it.

    A file with a reason (why it was not read) is an error row; one of neither content nor reason gives nothing.
    """
    reason = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", "language", "content", reason.alias("reason")).filter("content is not null or reason is not null").filter(F.col("language").isin(*READERS))
    return spread(rows).mapInPandas(_extract, _SCHEMA)


def tests(rows: DataFrame, source_bytes: int = X.SOURCE_BYTES, entries: int = X.LIST_ENTRIES) -> DataFrame:
    """The tests, bounded, with import features merged after their own."""
    names = merged_features(F.coalesce("names", literal_array(())), import_features(F.col("imports")))
    return rows.filter("error is null").select(
        "path", "ord", "qualified", "language", "name", capped(F.col("annotations"), entries).alias("annotations"), capped(F.col("imports"), entries).alias("imports"),
        truncated(F.col("source"), source_bytes).alias("source"), F.transform(capped(names, entries), lambda n: F.struct(n.alias("name"), F.lit("parser").alias("source"))).alias("features"),
    )


def skipped(rows: DataFrame) -> DataFrame:
    return rows.filter("error is not null").select("path", F.col("error").alias("reason"))
