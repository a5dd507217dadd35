"""Choosing test files: globs, pruning, language and name conventions, duplicates.

Everything works on path columns, so a listing of any size is filtered before a file is opened.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import taxonomy as X
from attestry.functions.evidence import literal_array


def _segment(pattern: str) -> str | None:
    """A regular expression for one path segment of a glob; None if the glob is malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i + 1 == len(pattern):
                return None
            i += 1
            out += re.escape(pattern[i])
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", pattern[i:])
            if not m:
                return None
            out += f"(?!/)[{m[1]}{m[2].replace('[', chr(92) + '[').replace('&&', '&' + chr(92) + '&')}]"
            i += m.end() - 1
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str | None:
    """A regular expression over '/' + name for a glob; None if it can match nothing.

    Without a slash the glob is for the base name; with one it is for the whole path or any
    trailing part of it. A segment ** stands for any number of segments, none included.
    """
    pattern = pattern.strip().replace(os.sep, "/").removeprefix("./")
    if not pattern:
        return None
    parts = []
    for segment in pattern.split("/"):
        if segment == "**" and "/" in pattern:
            parts.append("(?:/[^/]*)*")
        elif (r := _segment(segment)) is None:
            return None
        else:
            parts.append("/" + r)
    return "^(?:/[^/]*)*" + "".join(parts) + "$"


def matches_any(name: Column, patterns: Iterable[str]) -> Column:
    found = [F.concat(F.lit("/"), name).rlike(r) for r in map(glob_regex, patterns) if r]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def excluded(name: Column, patterns: Iterable[str]) -> Column:
    """Whether a pattern matches the path or a directory above it."""
    out = F.lit(False)
    for p in patterns:
        if r := glob_regex(p):
            # below a matched directory everything is pruned
            out = out | F.concat(F.lit("/"), name).rlike(r[:-1] + "(?:/.*)?$")
    return out


def language(path: Column) -> Column:
    """go or kotlin by the ending in any letter case; else null."""
    ending = F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)
    return F.when(ending == ".go", "go").when(ending == ".kt", "kotlin")


def conventional(path: Column) -> Column:
    """Whether the name (case-sensitive) or, for Kotlin, the place says that a file holds tests."""
    stem = "|".join(X.KOTLIN_STEMS)
    lowered = F.concat(F.lit("/"), F.lower(path))
    place = F.lit(False)
    for m in X.KOTLIN_PATHS:
        place = place | lowered.contains(m)
    return F.when(language(path) == "go", path.endswith("_test.go")).when(language(path) == "kotlin", path.rlike(rf"(?:{stem})\.[^./]*$") | place).otherwise(F.lit(False))


def pruned(path: Column) -> Column:
    """Whether a directory above the file, below its root, is never walked."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), literal_array(X.PRUNED))


def candidates(files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Of (path, source_path, root_ord, ...) the test files: excluded ones never, included ones beside those
    of conventional names; of one source_path the row of the first root. Their order is that of in_order."""
    include, exclude = list(include), list(exclude)
    p = F.col("path")
    kept = files.withColumn("language", language(p)).filter(F.col("language").isNotNull() & ~pruned(p) & ~excluded(p, exclude))
    kept = kept.filter(conventional(p) | matches_any(p, include))
    first = Window.partitionBy("source_path").orderBy("root_ord", "path")
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def in_order(files: DataFrame) -> DataFrame:
    """Files by path, with equal paths by source path, as reports and runs take them."""
    return files.orderBy("path", "source_path")


#: Directories the driver looks into before it hands subtrees to tasks.
FRONTIER = 256
_LISTED = "path string, source_path string, root_ord int, length bigint"


def _entries(at: str) -> list[os.DirEntry]:
    with os.scandir(at) as it:
        return sorted(it, key=lambda e: e.name)


def _walk(root: str, at: str, deep: bool, hidden) -> Iterator[tuple[str, str, int]]:
    """(path below root, absolute path, length) of the files in a directory and, if deep, below it."""
    for e in _entries(at):
        rel = os.path.relpath(e.path, root).replace(os.sep, "/")
        if e.is_dir(follow_symlinks=False):
            if deep and e.name not in X.PRUNED and not hidden(rel):
                yield from _walk(root, e.path, True, hidden)
        elif e.is_file():
            yield rel, e.path, e.stat().st_size


def list_files(spark: SparkSession, roots: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """(path, source_path, root_ord, length) of the files under roots; pruned and excluded directories are not entered.

    Roots are folders or files of a file system that the executors share (a mount, or this machine). The
    driver looks into at most about FRONTIER directories, for names of directories only; files are listed by
    tasks, a directory or a whole subtree each, by their exact names. An explicit root of a pruned name is walked
    all the same; a missing root is an error.
    """
    patterns = [r for r in map(glob_regex, exclude) if r]
    globs = [re.compile(r) for r in patterns]
    hidden = lambda path: any(g.match("/" + path) for g in globs)
    work: list[tuple[int, str, str, bool]] = []  # root's place, root, directory, with all below it
    singles = []
    for order, root in enumerate(list(roots) or ["."]):
        root = os.path.normpath(root)
        if os.path.isfile(root):
            singles.append((posixpath.normpath(root), os.path.abspath(root), order, os.path.getsize(root)))
        elif not os.path.isdir(root):
            raise FileNotFoundError(root)
        elif not hidden(root):
            top = os.path.abspath(root)
            queue, seen = [top], 0
            while queue and seen < FRONTIER:
                at, seen = queue.pop(0), seen + 1
                work.append((order, top, at, False))
                queue += [e.path for e in _entries(at) if e.is_dir(follow_symlinks=False) and e.name not in X.PRUNED and not hidden(os.path.relpath(e.path, top))]
            work += [(order, top, at, True) for at in queue]

    def over(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [re.compile(r) for r in patterns]
        for pdf in it:
            for order, top, at, deep in pdf.itertuples(index=False):
                files = _walk(top, at, bool(deep), lambda path: any(g.match("/" + path) for g in known))
                while rows := [(p, s, order, n) for p, s, n in islice(files, 10_000)]:
                    yield pd.DataFrame(rows, columns=["path", "source_path", "root_ord", "length"])

    out = spark.createDataFrame(singles, _LISTED)
    if work:
        tasks = spark.createDataFrame(work, "root_ord int, top string, at string, deep boolean")
        out = out.unionByName(tasks.repartition(min(len(work), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(over, _LISTED))
    return out


def over_long(length: Column, most: int = X.FILE_BYTES) -> Column:
    """Why a file of that length is not read, or null."""
    return F.when(length > most, f"file exceeds {most} byte limit")


def read_files(files: DataFrame, most: int = X.FILE_BYTES) -> DataFrame:
    """files with content and reason: over-long files are never opened, unreadable ones have the reason of the failure."""
    names = [*files.columns]
    marked = files.withColumn("reason", over_long(F.col("length"), most))
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("reason", T.StringType())])

    def over(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for start in range(0, len(pdf), 64):  # contents of some files at a time
                part = pdf.iloc[start : start + 64]
                content, reason = [], []
                for path, why in zip(part.source_path, part.reason, strict=True):
                    data = None
                    if why is None:
                        try:
                            with open(path, "rb") as f:
                                data = f.read(most + 1)
                            if len(data) > most:
                                data, why = None, f"file exceeds {most} byte limit"
                        except OSError as e:
                            why = f"read: {e.strerror or e}"
                    content.append(data), reason.append(why)
                yield part.assign(content=content, reason=reason)[[*names, "content", "reason"]]

    return marked.mapInPandas(over, schema)
