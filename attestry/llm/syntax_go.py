"""Tokens and grammar of Go source files, for recognition. Written from the published language specification."""

from __future__ import annotations

import re

from attestry.llm.derivatives import Grammar

# The language's keywords and operators.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
BINARY = frozenset("|| && == != < <= > >= / % << >> &^".split())
ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>= &^=".split())
ENDING = frozenset("break continue fallthrough return ident lit str incdec ) ] }".split())

_ESCAPE = r"""\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"""
_DIGITS = r"[0-9](?:_?[0-9])*"
TOKEN = re.compile(
    rf"""(?P<space>[ \t\r]+)
    |(?P<newline>\n)
    |(?P<line>//[^\n]*)
    |(?P<block>/\*[\s\S]*?\*/)
    |(?P<ident>[^\W\d]\w*)
    |(?P<lit>(?:0[xX](?:_?[0-9A-Fa-f])+(?:\.(?:[0-9A-Fa-f](?:_?[0-9A-Fa-f])*)?)?(?:[pP][+\-]?{_DIGITS})?
        |0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
        |{_DIGITS}(?:\.(?:{_DIGITS})?)?(?:[eE][+\-]?{_DIGITS})?
        |\.{_DIGITS}(?:[eE][+\-]?{_DIGITS})?)i?(?!\w)
        |'(?:[^'\\\n]|{_ESCAPE}|\\')')
    |(?P<str>"(?:[^"\\\n]|{_ESCAPE}|\\")*"|`[^`]*`)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!(){{}}\[\],;.:~])""",
    re.X,
)
OCTAL = re.compile(r"0_?[0-9_]*[89][0-9_]*$")


def tokens(text: str) -> tuple[list[str], list[int], int | None]:
    """Token kinds, their offsets, and the offset of a lexical error. Semicolons are inserted as the language has it."""
    kinds, at = [], []
    pos, size, last = (1 if text.startswith("﻿") else 0), len(text), ""
    match = TOKEN.match
    while pos < size:
        m = match(text, pos)
        if m is None:
            return kinds, at, pos
        g, s = m.lastgroup, m.group()
        end_of_line = g == "newline" or g == "block" and "\n" in s
        if end_of_line and last in ENDING:
            kinds.append(";"), at.append(pos)
            last = ""
        elif g == "ident":
            last = s if s in KEYWORDS else "ident"
            kinds.append(last), at.append(pos)
        elif g == "lit" or g == "str":
            if "\x00" in s or "﻿" in s or g == "lit" and OCTAL.match(s):
                return kinds, at, pos
            last = g
            kinds.append(g), at.append(pos)
        elif g == "op":
            last = "binary" if s in BINARY else "assign" if s in ASSIGN else "incdec" if s in ("++", "--") else "star" if s == "*" else s
            kinds.append(last), at.append(pos)
        elif g in ("line", "block") and ("\x00" in s or "﻿" in s):
            return kinds, at, pos
        pos = m.end()
    if last in ENDING:
        kinds.append(";"), at.append(size)
    return kinds, at, None


def listed(x, sep: str = ",") -> tuple:
    return (x, ("*", (sep, x)))


def trailed(x, sep: str = ",") -> tuple:
    return (x, ("*", (sep, x)), ("?", sep))


def _expressions(suffix: str, literals: bool) -> dict[str, object]:
    """Expressions; in headers of statements a literal's type may not be a bare name.

    Every type is an expression here too (a literal type, a starred or bracketed name), so that
    arguments, indices and cases need no second choice and deep nesting stays one chain.
    """
    e = lambda x: x + suffix
    named = [("ident", ("?", ". ident"), ("?", "TypeArgs"), "LiteralValue")] if literals else []
    return {
        e("Expr"): (e("Unary"), ("*", ("BinaryOp", e("Unary")))),
        e("Unary"): (("*", "UnaryOp"), e("Primary")),
        e("Primary"): ([e("Operand"), *named], ("*", "Suffix")),
        e("Operand"): ["lit", "str", "ident", ("(", "Expr", ")"), ("func", "Signature", ("?", "Block")), ("TypeLit", ("?", "LiteralValue"))],
        e("Exprs"): listed(e("Expr")),
        e("Simple"): [(e("Exprs"), ("?", (["=", "assign"], e("Exprs")))), (listed("ident"), ":=", e("Exprs")), (e("Expr"), "incdec"), (e("Expr"), "<-", e("Expr"))],
    }


RULES: dict[str, object] = {
    "File": ("package ident ;", ("*", ("Import", ";")), ("*", ("TopDecl", ";"))),
    "Import": ("import", ["ImportSpec", ("(", ("?", trailed("ImportSpec", ";")), ")")]),
    "ImportSpec": (("?", ["ident", "."]), "str"),
    "TopDecl": ["Decl", "FuncDecl"],
    "Decl": [
        ("const", ["ConstSpec", ("(", ("?", trailed("ConstSpec", ";")), ")")]),
        ("var", ["VarSpec", ("(", ("?", trailed("VarSpec", ";")), ")")]),
        ("type", ["TypeSpec", ("(", ("?", trailed("TypeSpec", ";")), ")")]),
    ],
    "ConstSpec": (listed("ident"), ("?", (("?", "Type"), "=", "Exprs"))),
    "VarSpec": (listed("ident"), [("Type", ("?", ("=", "Exprs"))), ("=", "Exprs")]),
    "TypeSpec": ("ident", ("?", "TypeParams"), ("?", "="), "Type"),
    "FuncDecl": ("func", ("?", "Params"), "ident", ("?", "TypeParams"), "Signature", ("?", "Block")),
    "TypeParams": ("[", trailed((listed("ident"), "Union")), "]"),
    "Union": ((("?", "~"), "Type"), ("*", ("|", ("?", "~"), "Type"))),
    "Signature": ("Params", ("?", ["Params", "Type"])),
    "Params": ("(", ("?", trailed("Param")), ")"),
    "Param": (("?", "ident"), ("?", "..."), "Type"),
    "Type": [("TypeName", ("?", "TypeArgs")), "TypeLit", ("(", "Type", ")")],
    "TypeName": ("ident", ("?", ". ident")),
    "TypeArgs": ("[", trailed("Type"), "]"),
    "TypeLit": [
        ("[", ["]", ("Expr", "]"), ("...", "]")], "Type"),
        ("struct {", ("?", trailed("Field", ";")), "}"),
        ("star", "Type"),
        ("func", "Signature"),
        ("interface {", ("?", trailed("Elem", ";")), "}"),
        ("map [", "Type", "]", "Type"),
        ("chan", ("?", "<-"), "Type"),
        ("<- chan", "Type"),
    ],
    "Field": ([(listed("ident"), "Type"), (("?", "star"), "TypeName", ("?", "TypeArgs"))], ("?", "str")),
    "Elem": [("ident", "Signature"), "Union"],
    **_expressions("", True),
    **_expressions("H", False),
    "BinaryOp": ["binary", "+", "-", "star", "&", "^", "|"],
    "UnaryOp": ["+", "-", "!", "^", "star", "&", "<-"],
    "Suffix": [
        (".", ["ident", ("(", ["Type", "type"], ")")]),
        ("[", [trailed("Expr"), (("?", "Expr"), ":", ("?", "Expr"), ("?", (":", "Expr")))], "]"),
        ("(", ("?", (listed("Expr"), ("?", "..."), ("?", ","))), ")"),
    ],
    "LiteralValue": ("{", ("?", trailed((["Expr", "LiteralValue"], ("?", (":", ["Expr", "LiteralValue"]))))), "}"),
    "Block": ("{", "Stmts", "}"),
    "Stmts": (("?", "Stmt"), ("*", (";", ("?", "Stmt")))),
    "Stmt": [
        "Decl", ("ident :", ("?", "Stmt")), "Simple", ("go", "Expr"), ("defer", "Expr"), ("return", ("?", "Exprs")), ("break", ("?", "ident")),
        ("continue", ("?", "ident")), "goto ident", "fallthrough", "Block", "If", "Switch", "Select", "For",
    ],
    "If": ("if", ("?", (("?", "SimpleH"), ";")), "ExprH", "Block", ("?", ("else", ["If", "Block"]))),
    "Switch": ("switch", ("?", (("?", "SimpleH"), ";")), ("?", "SimpleH"), "{", ("*", "Case"), "}"),
    "Case": ([("case", listed("Expr")), "default"], ":", "Stmts"),
    "Select": ("select {", ("*", ([("case", "Simple"), "default"], ":", "Stmts")), "}"),
    "For": (
        "for",
        ("?", ["ExprH", (("?", "SimpleH"), ";", ("?", "ExprH"), ";", ("?", "SimpleH")), (("?", [("ExprsH", "="), (listed("ident"), ":=")]), "range", "ExprH")]),
        "Block",
    ),
}


def grammar() -> Grammar:
    return Grammar(RULES, "File")
