"""What both extractors share."""

from __future__ import annotations

import re

GOLDEN, SNAPSHOT = re.compile("golden", re.I), re.compile("snapshot", re.I)


class SyntaxFault(ValueError):
    """A file that cannot be read as its language; it is skipped with this reason."""


def unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))
