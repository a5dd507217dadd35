"""Memoised parsing with derivatives: recognition of token sequences by a context-free grammar.

A language is a node. Its derivative by a token is the language of what may follow the token;
it is empty if the token cannot stand there, and a sequence is complete if the last derivative
is nullable. Nodes are interned, concatenations lean to the right and union members are sets,
so equal languages are one node and every (node, token) pair is derived once per worker: the
second file that is in the same situation costs one lookup per token.

Grammars must not be left-recursive (no rule may reach itself before it consumes a token).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

EMPTY, EPS = 0, 1


class Grammar:
    """Interned languages over small integers as tokens. Beyond ``most`` nodes the tables start anew."""

    def __init__(self, rules: dict[str, object], start: str, most: int = 400_000):
        self.source, self.start_rule, self.most = rules, start, most
        self.kinds: dict[str, int] = {}
        self.reset()

    # -- nodes ---------------------------------------------------------------------------
    def reset(self) -> None:
        self.node: list[tuple] = [("empty",), ("eps",)]
        self.intern: dict[tuple, int] = {("empty",): EMPTY, ("eps",): EPS}
        self.rule: dict[str, int] = {}
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.memo: dict[tuple[int, int], int] = {}
        self.start = self.ref(self.start_rule)
        for name in self.source:  # all tokens get their numbers
            self.body(name)

    def make(self, *key) -> int:
        n = self.intern.get(key)
        if n is None:
            n = self.intern[key] = len(self.node)
            self.node.append(key)
        return n

    def token(self, name: str) -> int:
        return self.kinds.setdefault(name, len(self.kinds))

    def tok(self, name: str) -> int:
        return self.make("tok", self.token(name))

    def ref(self, name: str) -> int:
        return self.make("ref", name)

    def alt(self, members: Iterable[int]) -> int:
        flat: set[int] = set()
        for m in members:
            if m == EMPTY:
                continue
            if self.node[m][0] == "alt":
                flat |= self.node[m][1]
            else:
                flat.add(m)
        if len(flat) <= 1:
            return next(iter(flat), EMPTY)
        return self.make("alt", frozenset(flat))

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        if self.node[a][0] == "cat":
            parts = []
            while self.node[a][0] == "cat":
                parts.append(self.node[a][1])
                a = self.node[a][2]
            parts.append(a)
            for p in reversed(parts):
                b = self.make("cat", p, b)
            return b
        return self.make("cat", a, b)

    def build(self, x) -> int:
        """A node from a rule: a string of words, a tuple (sequence), a list (choice) or ('*'|'?'|'+', x).

        In strings, words that name rules (capital first letter) are references, others are tokens.
        """
        if isinstance(x, str):
            x = tuple(x.split()) if " " in x else x
        if isinstance(x, str):
            return self.ref(x) if x[:1].isupper() else self.tok(x)
        if isinstance(x, list):
            return self.alt(self.build(y) for y in x)
        if x and x[0] in ("*", "?", "+") and len(x) == 2 and not (isinstance(x[1], str) and x[1] == ""):
            inner = self.build(x[1])
            if x[0] == "?":
                return self.alt((inner, EPS))
            star = self.make("star", inner)
            return star if x[0] == "*" else self.cat(inner, star)
        out = EPS
        for y in reversed(x):
            out = self.cat(self.build(y), out)
        return out

    def body(self, name: str) -> int:
        n = self.rule.get(name)
        if n is None:
            n = self.rule[name] = self.build(self.source[name])
        return n

    # -- nullability and derivatives -------------------------------------------------------
    def nullable(self, n: int) -> bool:
        known = self.null.get(n)
        if known is not None:
            return known
        kind, *rest = self.node[n]
        if kind == "tok":
            v = False
        elif kind == "star":
            v = True
        elif kind == "alt":
            v = any(self.nullable(m) for m in rest[0])
        elif kind == "cat":
            v = self.nullable(rest[0]) and self.nullable(rest[1])
        else:
            self.null[n] = False  # a rule that is nullable only through itself is not
            v = self.nullable(self.body(rest[0]))
        self.null[n] = v
        return v

    def derive(self, n: int, t: int) -> int:
        key = (n, t)
        known = self.memo.get(key)
        if known is not None:
            return known
        kind, *rest = self.node[n]
        if kind == "tok":
            v = EPS if rest[0] == t else EMPTY
        elif kind == "alt":
            v = self.alt([self.derive(m, t) for m in rest[0]])
        elif kind == "cat":
            v = self.cat(self.derive(rest[0], t), rest[1])
            if self.nullable(rest[0]):
                v = self.alt((v, self.derive(rest[1], t)))
        elif kind == "star":
            v = self.cat(self.derive(rest[0], t), n)
        elif kind == "ref":
            v = self.derive(self.body(rest[0]), t)
        else:
            v = EMPTY
        self.memo[key] = v
        return v

    def run(self, tokens: Iterable[str]) -> tuple[str, int]:
        """('ok' | 'truncated' | 'error', index of the failing token or the number of tokens)."""
        if len(self.node) > self.most:
            self.reset()
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
        state, memo, kinds, i = self.start, self.memo, self.kinds, 0
        for i, name in enumerate(tokens):
            t = kinds.get(name, -1)
            following = memo.get((state, t))
            if following is None:
                following = self.derive(state, t)
            if following == EMPTY:
                return "error", i
            state = following
        n = i + 1 if state != self.start else 0
        return ("ok", n) if self.nullable(state) else ("truncated", n)
