"""Problem 3: source files that are not valid in the language of their path.

Method: memoised parsing with derivatives (see derivatives.py) over the token streams of the
languages' grammars (syntax_go.py, syntax_kotlin.py). The token at which the derivative is
empty is the failing one; a last derivative that is not nullable marks a truncated file. A
character that starts no token, a literal or comment without an end, and contents that are
not UTF-8 (or hold a NUL) fail before the grammar does.

The language is the path's: .go or .kt in any letter case; the written language and the
reports in skipped_files are joined in the per-file report but decide nothing, as some are
missing and some are stale. Types, names and unused code don't matter.

Cases: an empty Kotlin file is valid, an empty Go file truncated; a byte order mark at the
start is allowed; null contents and paths of other languages have no verdict (status null);
several rows of one file_id are one file, invalid if any of its rows is; very deep nesting is
bounded only by memory; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import repository_key
from attestry.llm import syntax_go, syntax_kotlin
from attestry.runtime import join_hot, spread, table

LANGUAGES = {"go": syntax_go, "kt": syntax_kotlin}
_grammars: dict[str, object] = {}


def language_of(path):
    """go or kt by the path's ending, else null."""
    return F.nullif(F.regexp_extract(F.lower(path), r"\.(go|kt)$", 1), F.lit(""))


def verdict(content: bytes, language: str) -> tuple[str, int | None, str | None]:
    """(status, line from 1, failing token): valid, error, lexical, truncated or encoding."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return "encoding", content.count(b"\n", 0, e.start) + 1, None
    if "\x00" in text:
        return "encoding", text.count("\n", 0, text.index("\x00")) + 1, None
    if language not in _grammars:
        _grammars[language] = LANGUAGES[language].grammar()
    kinds, at, broken = LANGUAGES[language].tokens(text)
    status, n = _grammars[language].run(kinds)
    if status == "error":
        return "error", text.count("\n", 0, at[n]) + 1, text[at[n] :][:40].split("\n")[0]
    if broken is not None:
        return "lexical", text.count("\n", 0, broken) + 1, text[broken:][:40].split("\n")[0]
    return ("valid", None, None) if status == "ok" else ("truncated", text.count("\n") + 1, None)


def _judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = [verdict(c, x) if c is not None and x is not None else (None, None, None) for c, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        status, line, token = zip(*out, strict=True) if out else ((), (), ())
        arrays = [pa.array(status, pa.string()), pa.array(line, pa.int32()), pa.array(token, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(3), batch.column(4)], names=["file_id", "status", "line", "token", "repository", "path"])


def judged(files: DataFrame) -> DataFrame:
    """(file_id, status, line, token, repository, path) per row; no shuffle."""
    rows = files.select("file_id", "content", language_of(F.col("path")).alias("x"), "repository", "path").filter("x is not null")
    return spread(rows).mapInArrow(_judge, "file_id bigint, status string, line int, token string, repository string, path string")


def per_file(files: DataFrame) -> DataFrame:
    """One row per file_id: its worst verdict (any that is not valid before valid)."""
    worst = F.max(F.struct((F.col("status") != "valid").alias("bad"), "status", "line", "token", "repository", "path")).alias("v")
    return judged(files).groupBy("file_id").agg(worst).select("file_id", *[F.col(f"v.{c}").alias(c) for c in ("status", "line", "token", "repository", "path")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "source_files")).filter("status <> 'valid'").select("file_id").distinct()


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file its verdict, and whether a run reported it as unparsable."""
    reports = table(spark, sf_dir, "skipped_files").filter("path is not null and reason like 'parse %'")
    reports = reports.select(repository_key(F.col("repository")).alias("_r"), "path").filter("_r is not null").distinct().withColumn("reported", F.lit(True))
    verdicts = per_file(table(spark, sf_dir, "source_files")).withColumn("_r", repository_key(F.col("repository")))
    return join_hot(verdicts, reports, ["_r", "path"], "left").select("file_id", "status", "line", "token", F.coalesce("reported", F.lit(False)).alias("reported"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files and their share per repository and language of the path."""
    v = per_file(table(spark, sf_dir, "source_files"))
    cells = v.groupBy(repository_key(F.col("repository")).alias("repository"), language_of(F.col("path")).alias("language")).agg(
        F.count("*").alias("n_files"), F.count_if(F.col("status") != "valid").alias("n_invalid"), F.count_if(F.col("status") == "truncated").alias("n_truncated")
    )
    return cells.withColumn("rate", F.col("n_invalid") / F.col("n_files"))


QUERIES = {"p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
