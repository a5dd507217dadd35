"""Reviewed records as JSON Lines, and recorded model responses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import taxonomy as X
from attestry.operators import evaluate as V
from attestry.runtime import ensure_workers, numbered

TEXTS = (
    "id", "repository", "split", "language", "human_primary", "predicted_primary", "model", "question_set_version", "extractor_version", "reviewer_a_primary", "reviewer_b_primary", "adjudication_note",
)
SCHEMA = ", ".join([*(f"{c} string" for c in TEXTS), "human_traits array<string>", "predicted_traits array<string>", "primary_probabilities map<string, double>", "confidence double", "pending_human_review boolean"])
_KINDS = {c: str for c in TEXTS} | {"human_traits": list, "predicted_traits": list, "primary_probabilities": dict, "confidence": (int, float), "pending_human_review": bool}


def _checked(lines: pd.Series) -> pd.DataFrame:
    """Per line its JSON with the known fields in lower case, or why it is none."""

    def no(name):
        raise ValueError(f"invalid number {name}")

    def one(line):
        try:
            doc = json.loads(line, parse_constant=no)
            if not isinstance(doc, dict):
                raise ValueError("not an object")
            out = {k.lower(): v for k, v in doc.items() if k.lower() in _KINDS and v is not None}
            bad = next((k for k, v in out.items() if not isinstance(v, _KINDS[k]) or _KINDS[k] != bool and isinstance(v, bool)), None)
            return (json.dumps(out), None) if bad is None else (None, f"wrong type of {bad}")
        except (ValueError, RecursionError) as e:
            return None, str(e)

    return pd.DataFrame([one(x) for x in lines], columns=["clean", "error"])


_checked_udf = F.pandas_udf(_checked, T.StructType([T.StructField("clean", T.StringType()), T.StructField("error", T.StringType())]))


def read_records(spark: SparkSession, path: str, most: int = X.LINE_BYTES) -> DataFrame:
    """Records of a JSON Lines file with line numbers from 1; missing texts are empty, missing lists too.

    line_error names what makes a line no record (blank, too long, not JSON, of wrong types).
    """
    ensure_workers(spark)
    lines = numbered(spark.read.text(path), "line")
    long = F.octet_length("value") > most
    c = lines.withColumn("_c", _checked_udf(F.when(long, "{}").otherwise(F.col("value")))).withColumn("_r", F.from_json("_c.clean", SCHEMA))
    fields = [F.coalesce(f"_r.{x}", F.lit("")).alias(x) for x in TEXTS]
    none = F.expr("cast(array() as array<string>)")
    return c.select(
        "line", F.when(long, f"line exceeds {most} bytes").otherwise(F.col("_c.error")).alias("line_error"), *fields, F.coalesce("_r.human_traits", none).alias("human_traits"),
        F.coalesce("_r.predicted_traits", none).alias("predicted_traits"), F.col("_r.primary_probabilities").alias("primary_probabilities"),
        F.coalesce("_r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_r.pending_human_review", F.lit(False)).alias("pending_human_review"),
    )


def strict_records(records: DataFrame) -> DataFrame:
    """The valid reviewed records; ValueError with the first faulty line, if there is one, or without records."""
    rows = V.reviewed(records).withColumn("_fault", F.coalesce("line_error", "validation_error"))
    bad = rows.filter("_fault is not null").agg(F.min_by(F.struct("line", "_fault"), "line")).first()[0]
    if bad:
        raise ValueError(f"line {bad[0]}: {bad[1]}")
    if not rows.limit(1).count():
        raise ValueError("no reviewed records")
    if (r := V.crossing_repositories(rows).orderBy("repository").first()) is not None:
        raise ValueError(f"repository {r.repository} is in more than one split")
    return rows.drop("_fault")
