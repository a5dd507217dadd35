"""Whether a token list is a Go source file, by recursive descent; what fails is named with its byte.

Only syntax counts, as for a parser that resolves no names. Two choices are made by trying: type
parameters or an array length after a type's name, and a field's name or an embedded type.
"""

from __future__ import annotations

import re
import sys

from attestry.extract.common import SyntaxFault

# The language's keywords and operators.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
UNARY = frozenset("+ - ! ^ * & <- ~".split())
ENDING = frozenset("name lit str break continue fallthrough return ++ -- ) ] }".split())

_DIGITS = r"[0-9](?:_?[0-9])*"
_ESCAPE = r"""\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}"""
NUMBER = re.compile(
    rf"(?:0[xX](?:_?[0-9A-Fa-f])+(?:\.[0-9A-Fa-f_]*)?(?:[pP][+\-]?{_DIGITS})?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?[0-7])*|(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?(?:[eE][+\-]?{_DIGITS})?|\.{_DIGITS}(?:[eE][+\-]?{_DIGITS})?)i?"
)
OCTAL = re.compile(r"0[0-9_]*[89][0-9_]*")  # looks like a decimal number
STRING = re.compile(rf"""(?:"(?:[^"\\\n]|{_ESCAPE}|"))*"|`[^`]*`)""")
RUNE = re.compile(rf"""'(?:[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]+|{_ESCAPE}|'))'""")
OPEN = {"(": ")", "[": "]", "{": "}"}


class Syntax:
    """kinds and their offsets, with semicolons where the language puts them at line ends."""

    def __init__(self, text: str, kind: list[str], word: list[str], at: list[int], end: list[int]):
        self.k: list[str] = []
        self.at: list[int] = []
        self.i = 0
        self.header = False  # in the header of a statement, where a brace opens its body
        last = 0
        for kind_, w, a, e in zip(kind, word, at, end, strict=True):
            if self.k and self.k[-1] in ENDING and "\n" in text[last:a]:
                self.k.append(";"), self.at.append(last)
            if kind_ == "name":
                if not w.isascii() and not all(c == "_" or c.isalpha() or c.isdecimal() for c in w.encode("latin-1").decode("utf-8")):
                    raise SyntaxFault(f"illegal character in a name at byte {a}")
                w = w if w in KEYWORDS else "name"
            elif kind_ == "string":
                w = self._sound(STRING, w, a, "str", "string literal")
            elif kind_ in ("rune", "number"):
                w = self._sound(RUNE if kind_ == "rune" else NUMBER, w, a, "lit", f"{kind_} literal")
            self.k.append(w), self.at.append(a)
            last = e
        if self.k and self.k[-1] in ENDING:
            self.k.append(";"), self.at.append(last)
        self.k.append("end of file"), self.at.append(len(text))

    @staticmethod
    def _sound(pattern: re.Pattern, word: str, at: int, name: str, what: str) -> str:
        if not pattern.fullmatch(word) or OCTAL.fullmatch(word):
            raise SyntaxFault(f"malformed {what} at byte {at}")
        return name

    # -- tokens ----------------------------------------------------------------------------------
    def fault(self, want: str) -> SyntaxFault:
        return SyntaxFault(f"expected {want}, found {self.k[self.i]} at byte {self.at[self.i]}")

    def need(self, *kinds: str) -> None:
        for k in kinds:
            if self.k[self.i] != k:
                raise self.fault(k)
            self.i += 1

    def take(self, k: str) -> bool:
        if self.k[self.i] == k:
            self.i += 1
            return True
        return False

    def trying(self, first, second) -> None:
        """first, or second from the same place if first fails."""
        start, header = self.i, self.header
        try:
            first()
        except SyntaxFault:
            self.i, self.header = start, header
            second()

    def inside(self, f) -> None:
        """f outside any header, as between brackets."""
        header, self.header = self.header, False
        f()
        self.header = header

    def listed(self, item, close: str, sep: str = ",") -> None:
        """Items up to close, a separator after the last one allowed."""
        while self.k[self.i] != close:
            item()
            if not self.take(sep):
                break
        self.need(close)

    def names(self) -> None:
        self.need("name")
        while self.take(","):
            self.need("name")

    # -- declarations ----------------------------------------------------------------------------
    def file(self) -> None:
        self.need("package", "name", ";")
        while self.take("import"):
            self.group(self.import_spec)
            self.need(";")
        while self.k[self.i] != "end of file":
            if self.k[self.i] == "func":
                self.function()
            elif self.k[self.i] in ("const", "var", "type"):
                self.declaration()
            else:
                raise self.fault("declaration")
            self.need(";")

    def group(self, spec) -> None:
        if self.take("("):
            self.listed(spec, ")", ";")
        else:
            spec()

    def import_spec(self) -> None:
        if self.k[self.i] in ("name", "."):
            self.i += 1
        self.need("str")

    def declaration(self) -> None:
        word = self.k[self.i]
        self.i += 1
        if word == "type":
            self.group(self.type_spec)
            return
        first = True

        def value() -> None:
            nonlocal first
            self.names()
            typed = self.k[self.i] not in ("=", ";", ")")
            if typed:
                self.type()
            if self.take("="):
                self.expressions()
            elif word == "var" and not typed or word == "const" and (first or typed):
                raise self.fault("=")
            first = False

        self.group(value)

    def type_spec(self) -> None:
        self.need("name")

        def generic() -> None:
            self.type_parameters()
            self.take("=")
            self.type()

        if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
            self.trying(generic, self.type)
        else:
            self.take("=")
            self.type()

    def type_parameters(self) -> None:
        self.need("[")
        if self.k[self.i] == "]":
            raise self.fault("type parameter")

        def one() -> None:
            self.names()
            self.union()

        self.inside(lambda: self.listed(one, "]"))

    def union(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def function(self) -> None:
        self.need("func")
        if self.k[self.i] == "(":
            self.parameters()
        self.need("name")
        if self.k[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.k[self.i] == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.k[self.i] in ("name", "*", "[", "func", "struct", "interface", "map", "chan", "<-"):
            self.type()

    def parameters(self) -> None:
        """Types only, or names of which the last has a type."""
        self.need("(")
        shapes = []  # of each: a name with a type, a name (or type) alone, a type that is no name

        def one() -> None:
            start = self.i
            if self.take("..."):
                self.type()
                shapes.append("type")
                return
            if self.k[start] == "name" and self.k[start + 1] not in (",", ")", ".", "["):
                self.i += 1
                self.take("...")
                self.type()
                shapes.append("both")
                return
            if self.k[start : start + 2] == ["name", "["]:

                def named() -> None:
                    self.need("name")
                    self.type()
                    shapes.append("both")

                def plain() -> None:
                    self.type()
                    shapes.append("type")

                self.trying(named, plain)
                return
            self.type()
            shapes.append("name" if self.i == start + 1 else "type")

        self.inside(lambda: self.listed(one, ")"))
        if "both" in shapes and ("type" in shapes or shapes[-1] != "both"):
            raise self.fault("parameters that all have names")

    # -- types -----------------------------------------------------------------------------------
    def type(self) -> None:
        while True:
            k = self.k[self.i]
            if k == "*":
                self.i += 1
            elif k == "<-":
                self.need("<-", "chan")
            elif k == "chan":
                self.i += 1
                self.take("<-")
            elif k == "map":
                self.need("map", "[")
                self.inside(self.type)
                self.need("]")
            elif k == "[":
                self.i += 1
                if not self.take("]"):
                    if not self.take("..."):
                        self.inside(self.expression)
                    self.need("]")
            else:
                break
        if k == "name":
            self.i += 1
            if self.take("."):
                self.need("name")
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
                self.i += 1
                self.inside(lambda: self.listed(self.type, "]"))
        elif k == "(":
            self.i += 1
            self.inside(self.type)
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
        elif k in ("struct", "interface"):
            self.i += 1
            self.need("{")
            self.inside(lambda: self.listed(self.field if k == "struct" else self.element, "}", ";"))
        else:
            raise self.fault("type")

    def field(self) -> None:
        def named() -> None:
            self.names()
            self.type()

        def embedded() -> None:
            self.take("*")
            if self.k[self.i] != "name":
                raise self.fault("field")
            self.type()

        if self.k[self.i] == "name" and self.k[self.i + 1] not in (".", ";", "}", "str"):
            self.trying(named, embedded)
        else:
            embedded()
        self.take("str")

    def element(self) -> None:
        if self.k[self.i] == "name" and self.k[self.i + 1] == "(":
            self.i += 1
            self.signature()
        else:
            self.union()

    # -- expressions -----------------------------------------------------------------------------
    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.k[self.i] in BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.k[self.i] in UNARY and not (self.k[self.i] == "<-" and self.k[self.i + 1] == "chan"):
            self.i += 1
        self.primary()

    def primary(self) -> bool:
        """Whether the expression ends in a call."""
        k, literal, call = self.k[self.i], False, False
        bare = k == "name"
        if k in ("lit", "str", "name"):
            self.i += 1
            literal = bare
        elif k == "(":
            self.i += 1
            self.inside(self.argument)
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
            if self.k[self.i] == "{":
                self.inside(self.block)
        elif k in ("[", "struct", "map", "chan", "interface", "<-"):
            self.type()
            literal = k in ("[", "struct", "map")
        else:
            raise self.fault("operand")
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.inside(self.type)
                    self.need(")")
                    literal = False
                else:
                    self.need("name")
                call = False
            elif k == "[":
                self.i += 1
                self.inside(self.index)
                call = False
            elif k == "(":
                self.i += 1
                self.inside(self.arguments)
                literal, call = False, True
            elif k == "{" and literal and not (self.header and bare):
                self.literal_value()
                literal, bare, call = False, False, False
            else:
                return call

    def argument(self) -> None:
        """An expression, or a type where one may stand in its place; every type but a few is an expression already."""
        self.expression()

    def arguments(self) -> None:
        while self.k[self.i] != ")":
            self.argument()
            self.take("...")
            if not self.take(","):
                break
        self.need(")")

    def index(self) -> None:
        colons = 0
        if self.k[self.i] != ":":
            self.argument()
        while colons < 2 and self.take(":"):
            colons += 1
            if self.k[self.i] not in (":", "]"):
                self.expression()
        if not colons:
            while self.take(",") and self.k[self.i] != "]":
                self.type()
        self.need("]")

    def literal_value(self) -> None:
        def item() -> None:
            self.literal_value() if self.k[self.i] == "{" else self.expression()

        def pair() -> None:
            item()
            if self.take(":"):
                item()

        self.need("{")
        self.inside(lambda: self.listed(pair, "}"))

    # -- statements ------------------------------------------------------------------------------
    def block(self) -> None:
        self.need("{")
        header, self.header = self.header, False
        self.statements()
        self.header = header
        self.need("}")

    def statements(self) -> None:
        while self.k[self.i] not in ("}", "case", "default"):
            if not self.take(";"):
                self.statement()
                if self.k[self.i] not in ("}", "case", "default"):
                    self.need(";")

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("const", "var", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.conditional()
        elif k == "for":
            self.loop()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.need("{")
            self.cases(lambda: self.simple())
        elif k in ("go", "defer"):
            self.i += 1
            while self.k[self.i] in UNARY and self.k[self.i] != "<-":
                raise self.fault("call")
            start = self.i
            if not self.primary() or self.k[self.i] in BINARY:
                self.i = start
                raise self.fault("call")
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue"):
            self.i += 1
            self.take("name")
        elif k == "goto":
            self.need("goto", "name")
        elif k == "fallthrough":
            self.i += 1
        elif k == "name" and self.k[self.i + 1] == ":":
            self.i += 2
            if self.k[self.i] not in ("}", ";"):
                self.statement()
        else:
            self.simple()

    def simple(self) -> bool:
        """Whether it is a single expression."""
        start = self.i
        self.expression()
        single = self.k[self.i] != ","
        while self.take(","):
            self.expression()
        k = self.k[self.i]
        if k in ASSIGN:
            self.i += 1
            self.expressions()
            # v := x.(type)
            return self.k[start + 1] == ":=" and self.k[self.i - 4 : self.i] == [".", "(", "type", ")"]
        if k in ("++", "--"):
            self.i += 1
            return False
        if k == "<-":
            self.i += 1
            self.expression()
            return False
        return single

    def conditional(self) -> None:
        while True:
            self.need("if")
            self.header = True
            if self.k[self.i] == "{":
                raise self.fault("condition")
            single = self.k[self.i] != ";" and self.simple()
            if self.take(";"):
                if self.k[self.i] == "{":
                    raise self.fault("condition")
                self.expression()
            elif not single:
                raise self.fault("condition")
            self.header = False
            self.block()
            if not self.take("else"):
                return
            if self.k[self.i] != "if":
                self.block()
                return

    def loop(self) -> None:
        self.need("for")
        self.header = True
        if self.k[self.i] == "range":
            self.i += 1
            self.expression()
        elif self.k[self.i] != "{":
            ranged, single = False, True
            if self.k[self.i] != ";":
                start = self.i
                self.expressions()
                if self.k[self.i] in ("=", ":=") and self.k[self.i + 1] == "range":
                    self.i += 2
                    self.expression()
                    ranged = True
                else:
                    self.i = start
                    single = self.simple()
            if not ranged and not single and self.k[self.i] != ";":
                raise self.fault("for loop condition")
            if not ranged and self.take(";"):
                if self.k[self.i] != ";":
                    if self.k[self.i] == "{":
                        raise self.fault("for loop condition")
                    self.expression()
                self.need(";")
                if self.k[self.i] != "{":
                    self.simple()
        self.header = False
        self.block()

    def switch(self) -> None:
        self.need("switch")
        self.header = True
        if self.k[self.i] != "{":
            single = self.k[self.i] != ";" and self.simple()
            if self.take(";"):
                single = self.k[self.i] == "{" or self.simple()
            if not single:
                raise self.fault("switch expression")
        self.header = False
        self.need("{")
        self.cases(self.case)

    def case(self) -> None:
        self.argument()
        while self.take(","):
            self.argument()

    def cases(self, guard) -> None:
        while self.k[self.i] != "}":
            if self.take("case"):
                guard()
            else:
                self.need("default")
            self.need(":")
            self.statements()
        self.need("}")


def check(text: str, kind: list[str], word: list[str], at: list[int], end: list[int]) -> None:
    """SyntaxFault if the tokens are no Go source file."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
    Syntax(text, kind, word, at, end).file()
