"""Tests and subtests of Go files, from a flat token list with matched brackets.

Offsets are byte offsets: the text is read as Latin-1, and slices are decoded on output.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from attestry.extract import go_syntax
from attestry.extract.common import GOLDEN, SNAPSHOT, SyntaxFault, unique

TOKENS = re.compile(
    r"""(?P<skip>[ \t\r\n]+|//[^\n]*|/\*[\s\S]*?\*/)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|`[^`]*`)
    |(?P<rune>'(?:[^'\\\n]|\\.)+')
    |(?P<name>[A-Za-z_\x80-\xff][\w\x80-\xff]*)
    |(?P<number>0[xX](?:[\w.]|(?<=[pP])[+\-])*|\.?\d(?:[\w.]|(?<=[eE])[+\-])*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|<<|>>|&\^|[-+*/%&|^<>=!:~{}()\[\];,.])""",
    re.X,
)
PAIRS = {"(": ")", "[": "]", "{": "}"}
# Name prefix -> type of the parameter and feature.
KINDS = {"Test": ("T", "go test function"), "Fuzz": ("F", "go fuzz function"), "Benchmark": ("B", "go benchmark function")}


@dataclass
class GoFile:
    text: str
    kind: list[str] = field(default_factory=list)
    word: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    match: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        pos, open_ = 0, []
        for mark, name in (("\x00", "NUL"), ("\xef\xbb\xbf", "byte order mark")):
            if mark in self.text:
                raise SyntaxFault(f"illegal {name} at byte {self.text.index(mark)}")
        while pos < len(self.text):
            m = TOKENS.match(self.text, pos)
            if m is None:
                raise SyntaxFault(f"unexpected character at byte {pos}")
            if m.lastgroup != "skip":
                i = len(self.kind)
                self.kind.append(m.lastgroup), self.word.append(m.group()), self.at.append(pos), self.end.append(m.end())
                if m.group() in PAIRS:
                    open_.append(i)
                elif m.group() in PAIRS.values():
                    if not open_ or PAIRS[self.word[open_[-1]]] != m.group():
                        raise SyntaxFault(f"unmatched {m.group()} at byte {pos}")
                    self.match[open_[-1]] = i
                    self.match[i] = open_.pop()
            pos = m.end()
        if open_:
            raise SyntaxFault(f"missing {PAIRS[self.word[open_[-1]]]}")
        go_syntax.check(self.text, self.kind, self.word, self.at, self.end)

    def get(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) else ""

    def body(self, i: int) -> int | None:
        """The brace that opens the body after a signature that goes on at i."""
        while i < len(self.word):
            w = self.word[i]
            if w == "{":
                if self.get(i - 1) not in ("interface", "struct"):
                    return i
                i = self.match[i]
            elif w in "([":
                i = self.match[i]
            elif w in (")", "]", "}", ";", ",", ":=", "=") or self.kind[i] == "name" and w in ("func", "type", "var", "const") and self.text.rfind("\n", self.end[i - 1], self.at[i]) >= 0:
                return None
            i += 1
        return None

    def loops(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Byte spans of the range loops between tokens lo and hi."""
        out = []
        for i in range(lo, hi):
            if self.word[i] != "for" or self.kind[i] != "name":
                continue
            j, ranged = i + 1, False
            while j < hi:
                w = self.word[j]
                if w == "range":
                    ranged = True
                if w == "{":
                    # a literal in the header is followed by the body's brace
                    if self.get(self.match[j] + 1) != "{" and self.get(j - 1) not in ("struct", "interface"):
                        break
                    j = self.match[j]
                elif w in "([":
                    j = self.match[j]
                j += 1
            if ranged and j < hi:
                out.append((self.at[i], self.end[self.match[j]]))
        return out

    def closures(self, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(func, body, end) tokens of the function literals between lo and hi."""
        out = []
        for i in range(lo, hi):
            if self.word[i] == "func" and self.kind[i] == "name" and self.get(i + 1) == "(":
                b = self.body(self.match[i + 1] + 1)
                if b is not None and b < hi:
                    out.append((i, b, self.match[b]))
        return out

    def first_name(self, paren: int) -> str:
        """The first parameter's name, if it has one besides its type."""
        i = paren + 1
        if i < self.match[paren] and self.kind[i] == "name" and self.get(i + 1) not in (".", ",", ")", ""):
            return self.word[i]
        if self.kind[i] == "name" and self.get(i + 1) == ",":
            j = i
            while self.get(j + 1) == "," and self.kind[j] == "name":
                j += 2
            return self.word[i] if self.kind[j] == "name" and self.get(j + 1) not in (")", ".") else ""
        return ""

    def split(self, paren: int) -> list[tuple[int, int]]:
        """Token ranges of the arguments in a parenthesis."""
        out, start, i = [], paren + 1, paren + 1
        while i < self.match[paren]:
            if self.word[i] == ",":
                out.append((start, i))
                start = i + 1
            elif self.word[i] in PAIRS:
                i = self.match[i]
            i += 1
        if start < i:
            out.append((start, i))
        return out

    def slice(self, lo: int, hi: int) -> str:
        return decode(self.text[self.at[lo] : self.end[hi]])


def decode(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


def unquoted(word: str) -> str:
    if word.startswith("`"):
        return decode(word[1:-1]).replace("\r", "")
    try:
        return ast.literal_eval(decode(word))
    except (SyntaxError, ValueError):
        return decode(word).strip('"')


def features(f: GoFile, lo: int, hi: int, param: str, kind: str | None) -> list[str]:
    """Features of the body between braces lo and hi; closures inside are looked into as well."""
    out = [kind] if kind else []
    if not param:
        return out
    loops = f.loops(lo + 1, hi)
    for i in range(lo + 1, hi):
        if f.kind[i] != "name" or f.get(i + 1) != "(" or f.get(i - 1) == "func":
            continue
        name = f.word[i]
        if f.get(i - 1) == "." and f.get(i - 2) == param and f.get(i - 3) != ".":
            if name == "Run":
                out.append("calls t.Run")
                if any(a <= f.at[i - 2] <= b for a, b in loops):
                    out.append("go table-driven subtest loop")
            elif name == "Parallel":
                out.append("calls t.Parallel")
        if GOLDEN.search(name):
            out.append("golden comparison call")
        if SNAPSHOT.search(name):
            out.append("snapshot assertion call")
    return unique(out)


def subtests(f: GoFile, lo: int, hi: int, param: str, prefix: str) -> list[dict]:
    """Subtests run directly in the body between braces lo and hi, each followed by its own."""
    if not param:
        return []
    inside = f.closures(lo + 1, hi)
    loops, out, i = f.loops(lo + 1, hi), [], lo + 1
    while i < hi:
        if (f.word[i], f.get(i + 1), f.get(i + 2), f.get(i + 3)) == (param, ".", "Run", "(") and f.get(i - 1) != "." and not any(b < i < e for _, b, e in inside):
            paren = i + 3
            args = f.split(paren)
            if len(args) >= 2 and f.word[args[1][0]] == "func" and f.get(args[1][0] + 1) == "(":
                start = args[1][0]
                body = f.body(f.match[start + 1] + 1)
                if body is not None and body < f.match[paren]:
                    a, b = args[0]
                    name = unquoted(f.word[a]) if b - a == 1 and f.kind[a] == "string" else f.slice(a, b - 1)
                    qualified = f"{prefix}/{name}"
                    own = f.first_name(start + 1)
                    found = features(f, body, f.match[body], own, None)
                    if any(x <= f.at[i] <= y for x, y in loops):
                        found = unique([*found, "go table-driven subtest loop"])
                    out.append({"qualified": qualified, "name": qualified, "source": f.slice(start, f.match[body]), "features": found, "annotations": []})
                    out += subtests(f, body, f.match[body], own, qualified)
            i = f.match[paren]
        i += 1
    return out


def imports(f: GoFile) -> list[str]:
    out, i = [], 0
    while i < len(f.word):
        if f.word[i] == "import" and f.kind[i] == "name":
            stop = f.match[i + 1] if f.get(i + 1) == "(" else i + 3
            out += [unquoted(f.word[j]) for j in range(i + 1, min(stop, len(f.word))) if f.kind[j] == "string"]
            i = stop
        elif f.word[i] in PAIRS:
            i = f.match[i]
        i += 1
    return out


def tests(content: bytes) -> list[dict]:
    """The tests of a Go file in order; SyntaxFault if the file has no sound structure."""
    try:
        content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SyntaxFault("illegal UTF-8 encoding") from e
    f = GoFile(content.removeprefix(b"\xef\xbb\xbf").decode("latin-1"))
    found, out, i = imports(f), [], 0
    while i < len(f.word):
        if f.word[i] == "func" and f.kind[i] == "name":
            n = f.match[i + 1] + 1 if f.get(i + 1) == "(" else i + 1
            paren = f.match[n + 1] + 1 if f.get(n + 1) == "[" else n + 1
            if f.get(paren) == "(":
                body = f.body(f.match[paren] + 1)
                if body is not None:
                    name = f.word[n]
                    kind = next((k for p, k in KINDS.items() if name.startswith(p)), None)
                    if kind:
                        for a, b in f.split(paren):
                            if f.word[a + 1 : b] == ["*", "testing", ".", kind[0]]:
                                own = f.word[a]
                                out.append({"qualified": decode(name), "name": decode(name), "source": f.slice(i, f.match[body]), "features": features(f, body, f.match[body], own, kind[1]), "annotations": []})
                                out += subtests(f, body, f.match[body], own, decode(name))
                                break
                    i = f.match[body]
        elif f.word[i] in PAIRS:
            i = f.match[i]
        i += 1
    return [t | {"imports": found} for t in out]
