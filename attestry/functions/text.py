"""Column expressions for values written in several forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """c without Unicode white space at its ends; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    """Lower case without outer white space; blank becomes null."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def repository_key(c: Column, host: str = "forge.example.test") -> Column:
    """owner/name in lower case, of any of the forms a repository is written in.

    Scheme, user, host, trailing slashes and .git are dropped. Blank becomes null; a value
    that is not owner/name is kept, folded, as it stands.
    """
    plain = F.regexp_replace(folded(c), rf"^(?:[a-z][a-z0-9+.-]*://)?(?:[^@/\s]+@)?(?:www\.)?{host.replace('.', chr(92) + '.')}(?::\d+)?[:/]+", "")
    key = F.nullif(F.regexp_replace(F.regexp_replace(plain, r"^/+|/+$", ""), r"(?:\.git)?/*$", ""), F.lit(""))
    return F.when(c.rlike(r"^[a-z0-9_\-]+/[a-z0-9_\-]+\z"), c).otherwise(key)
