"""Tokens and grammar of Kotlin source files, for recognition. Written from the published language specification."""

from __future__ import annotations

import re

from attestry.llm.derivatives import Grammar

# Hard keywords, modifiers, other soft keywords.
KEYWORDS = frozenset(
    "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split()
)
MODIFIERS = frozenset(
    "abstract annotation const crossinline data expect external final infix inline inner internal lateinit noinline open operator out override private protected "
    "public reified sealed suspend tailrec vararg actual value".split()
)
SOFT = frozenset("by catch companion constructor enum finally get import init set where".split())
BINARY = frozenset("/ % == != === !== <= >= && || ?: .. ..<".split())
ASSIGN = frozenset("+= -= *= /= %=".split())
#: After these a line break can't end anything; before those it doesn't.
OPEN = frozenset("binary = assign , ( [ { -> : :: . ?. as as? in !in is !is else + - not ; nl strb strm do try throw & @".split())
CARRIED = frozenset("?: && || . ?. as as? = -> { : , ) ] where by".split())

_DIGITS = r"[0-9](?:_*[0-9])*"
TOKEN = re.compile(
    rf"""(?P<space>[ \t\f]+)
    |(?P<newline>\r\n|\n|\r)
    |(?P<line>//[^\n\r]*)
    |(?P<block>/\*)
    |(?P<quote>\"\"\"|")
    |(?P<char>'(?:[^'\\\n\r]|\\(?:[tbnr'"\\$]|u[0-9A-Fa-f]{{4}}))')
    |(?P<jump>(?:return|break|continue|this|super)@[^\W\d]\w*)
    |(?P<label>(?:[^\W\d]\w*|`[^`\n\r]+`)@(?![\w(\[]))
    |(?P<asq>as\?|!in\b|!is\b)
    |(?P<ident>[^\W\d]\w*)
    |(?P<tick>`[^`\n\r]+`)
    |(?P<lit>(?:0[xX][0-9A-Fa-f](?:_*[0-9A-Fa-f])*|0[bB][01](?:_*[01])*|(?:{_DIGITS})?\.{_DIGITS}(?:[eE][+\-]?{_DIGITS})?|{_DIGITS}(?:[eE][+\-]?{_DIGITS})?)(?:[uU]?L?|[fF])(?!\w))
    |(?P<op>\.\.<|===|!==|\.\.|\?\.|\?:|::|->|\+\+|--|!!|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|[+\-*/%<>=!(){{}}\[\],;.:?@&])""",
    re.X,
)
PIECE = re.compile(r"""(?P<escape>\\(?:[tbnr'"\\$]|u[0-9A-Fa-f]{4}))|(?P<open>\$\{)|(?P<end>")|(?P<bad>[\n\r]|\\)|(?P<plain>[^"\\\n\r$]+|\$)""")
RAW = re.compile(r"""(?P<open>\$\{)|(?P<end>"{3,})|(?P<plain>[^"$]+|"|\$)""")
COMMENT = re.compile(r"/\*|\*/")


def tokens(text: str) -> tuple[list[str], list[int], int | None]:
    """Token kinds, their offsets, and the offset of a lexical error.

    Line breaks are tokens (nl) only where they can separate: not within parentheses or
    brackets, not after a token that calls for more, not before one that goes on.
    """
    kinds: list[str] = []
    at: list[int] = []
    stack: list[str] = []  # open brackets; a template in a string is '$"' or '$r'
    pos, size, pending = (1 if text.startswith("﻿") else 0), len(text), -1
    if text.startswith("#!", pos):
        pos = text.find("\n", pos) if "\n" in text else size

    def add(kind: str, where: int) -> None:
        nonlocal pending
        if pending >= 0:
            if kinds and kinds[-1] not in OPEN and kind not in CARRIED and kind not in (";",) and not (kind == "binary" and text.startswith(("?:", "&&", "||"), where)):
                kinds.append("nl"), at.append(pending)
            pending = -1
        kinds.append(kind), at.append(where)

    def string(start: int, raw: bool, resumed: bool) -> int | None:
        """Reads a string's text from start; returns the position after its end or after ${."""
        p, match, begin = start, (RAW if raw else PIECE).match, start
        while p < size:
            m = match(text, p)
            if m is None or m.lastgroup == "bad":
                return None
            if m.lastgroup == "end":
                add("stre" if resumed else "str", begin)
                return m.end()
            if m.lastgroup == "open":
                add("strm" if resumed else "strb", begin)
                stack.append("$r" if raw else '$"')
                return m.end()
            p = m.end()
        return None

    while pos < size:
        m = TOKEN.match(text, pos)
        if m is None:
            return kinds, at, pos
        g, s = m.lastgroup, m.group()
        nxt = m.end()
        if g == "newline":
            if pending < 0 and not (stack and stack[-1] in "(["):
                pending = pos
        elif g == "block":
            depth = 1
            while depth:
                c = COMMENT.search(text, nxt)
                if c is None:
                    return kinds, at, pos
                depth += 1 if c.group() == "/*" else -1
                nxt = c.end()
        elif g == "quote":
            done = string(nxt, s == '"""', False)
            if done is None:
                return kinds, at, pos
            nxt = done
        elif g == "ident":
            add(s if s in KEYWORDS or s in SOFT else "mod" if s in MODIFIERS else "ident", pos)
        elif g == "tick":
            add("ident", pos)
        elif g in ("lit", "char"):
            add("lit", pos)
        elif g == "jump":
            add(s.partition("@")[0], pos)
        elif g == "label":
            add("label", pos)
        elif g == "asq":
            add(s, pos)
        elif g == "op":
            if s in "([{":
                add(s, pos)
                stack.append(s)
            elif s in ")]}":
                if stack and stack[-1][0] == "$" and s == "}":
                    raw = stack.pop() == "$r"
                    pending = -1
                    done = string(nxt, raw, True)
                    if done is None:
                        return kinds, at, pos
                    nxt = done
                else:
                    if stack and stack[-1] == {")": "(", "]": "[", "}": "{"}[s]:
                        stack.pop()
                    add(s, pos)
            else:
                add("binary" if s in BINARY else "assign" if s in ASSIGN else "step" if s in ("++", "--") else "star" if s == "*" else "not" if s == "!" else "q" if s == "?" else s, pos)
        pos = nxt
    if not stack:
        kinds.append("nl"), at.append(size)
    return kinds, at, None


def trailed(x) -> tuple:
    return (x, ("*", (",", x)), ("?", ","))


NL = ("*", "nl")
SEMIS = ("*", ["nl", ";"])
_DECLS = ["Class", "EnumClass", "Object", "Fun", "Property", "TypeAlias"]

RULES: dict[str, object] = {
    "Name": ["ident", "mod", *sorted(SOFT)],
    "QName": ("Name", ("*", (".", "Name"))),
    "File": (
        SEMIS, ("*", ("@", "ident :", ["Unescaped", ("[", ("+", "Unescaped"), "]")], SEMIS)), ("?", ("Modifiers", "package", "QName", "Semis1")),
        ("*", ("import", "QName", ("?", [". star", ("as", "Name")]), "Semis1")), ("*", ("Decl", SEMIS)),
    ),
    # The package line or last import may end the file: tokens() gives every file a last line break.
    "Semis1": ("+", ["nl", ";"]),
    "Decl": ("Modifiers", _DECLS),
    "Modifiers": ("*", (["mod", "Annotation"], NL)),
    "Annotation": ("@", ("?", (["ident", "get", "set"], ":")), ["Unescaped", ("[", ("+", "Unescaped"), "]")]),
    "Unescaped": ("QName", ("?", "TypeArgs"), ("?", "ValueArgs")),
    "Class": (["class", "interface", ("fun", "interface")], "Name", ("?", "TypeParams"), ("?", "PrimaryCtor"), ("?", (":", "Delegs")), ("?", "Where"), ("?", "ClassBody")),
    "EnumClass": ("enum", NL, "Modifiers", "class", "Name", ("?", "PrimaryCtor"), ("?", (":", "Delegs")), ("?", "EnumBody")),
    "PrimaryCtor": (("?", ("Modifiers", "constructor")), "(", ("?", trailed("ClassParam")), ")"),
    "ClassParam": ("Modifiers", ("?", ["val", "var"]), "Name", ":", "Type", ("?", ("=", "Expr"))),
    "Delegs": ("Deleg", ("*", (",", "Deleg"))),
    "Deleg": ("Annotations", "Type", ("?", "ValueArgs"), ("?", ("by", "Expr"))),
    "Annotations": ("*", ("Annotation", NL)),
    "ClassBody": ("{", SEMIS, ("*", ("Member", SEMIS)), "}"),
    "EnumBody": ("{", SEMIS, ("?", ("EnumEntry", ("*", (",", "EnumEntry")), ("?", ","))), NL, ("?", (";", SEMIS, ("*", ("Member", SEMIS)))), "}"),
    "EnumEntry": ("Modifiers", "Name", ("?", "ValueArgs"), ("?", "ClassBody"), NL),
    "Member": ["Decl", ("Modifiers", "companion", NL, "Modifiers", "object", ("?", "Name"), ("?", (":", "Delegs")), ("?", "ClassBody")), ("init", NL, "Block"), ("Modifiers", "constructor", "Params", ("?", (":", ["this", "super"], "ValueArgs")), ("?", "Block"))],
    "Object": ("object", "Name", ("?", (":", "Delegs")), ("?", "ClassBody")),
    "Fun": ("fun", ("?", "TypeParams"), "FunName", "Params", ("?", (":", "Type")), ("?", "Where"), ("?", "FunBody")),
    "FunName": ["Name", ("Type", ".", "Name"), ("Type", "?.", "Name")],
    "FunBody": ["Block", ("=", NL, "Expr")],
    "Params": ("(", ("?", trailed("Param")), ")"),
    "Param": ("Modifiers", "Name", ":", "Type", ("?", ("=", "Expr"))),
    "Property": (["val", "var"], ("?", "TypeParams"), ["VarDecl", "MultiVar", ("Type", [".", "?."], "VarDecl")], ("?", "Where"), ("?", (["=", "by"], NL, "Expr")), ("*", (SEMIS, "Accessor"))),
    "Accessor": ("Modifiers", ["get", "set"], ("?", ("(", ("?", ("Modifiers", "Name", ("?", (":", "Type")), ("?", ","))), ")", ("?", (":", "Type")), "FunBody"))),
    "VarDecl": ("Annotations", "Name", ("?", (":", "Type"))),
    "MultiVar": ("(", trailed("VarDecl"), ")"),
    "TypeAlias": ("typealias", "Name", ("?", "TypeParams"), "=", "Type"),
    "TypeParams": ("<", trailed((("*", (["mod", "in", "Annotation"], NL)), "Name", ("?", (":", "Type")))), ">"),
    "Where": ("where", ("Constraint", ("*", (",", "Constraint")))),
    "Constraint": ("Annotations", "Name", ":", "Type"),
    "Type": (("*", (["mod", "Annotation"], NL)), ["FunctionType", "PlainType"]),
    "PlainType": (["UserType", ("(", "Type", ")")], ("*", "q"), ("?", ("&", "Type"))),
    "UserType": ("SimpleType", ("*", (".", "SimpleType"))),
    "SimpleType": ("Name", ("?", "TypeArgs")),
    "TypeArgs": ("<", trailed(["star", (("*", ["in", "mod"]), "Type")]), ">"),
    "FunctionType": (("?", ("PlainType", ".")), "(", ("?", trailed([("Name", ":", "Type"), "Type"])), ")", "->", "Type"),
    "Block": ("{", SEMIS, "Stmts", "}"),
    "Stmts": (("?", ("Stmt", ("*", (("+", ["nl", ";"]), "Stmt")))), SEMIS),
    "Stmt": (("*", (["label", "Annotation"], NL)), ["Decl", ("Expr", ("?", (["=", "assign"], NL, "Expr"))), "Loop"]),
    "Body": ["Block", "Stmt"],
    "Loop": [
        ("for", "(", "Annotations", ["VarDecl", "MultiVar"], "in", "Expr", ")", NL, ["Body", ";"]),
        ("while", "(", "Expr", ")", NL, ["Body", ";"]),
        ("do", NL, ("?", "Body"), NL, "while", "(", "Expr", ")"),
    ],
    "Expr": ("Unary", ("*", "Tail")),
    "Tail": [
        (["binary", "+", "-", "star", "<", ">", "in", "!in"], NL, "Unary"), ("Infix", NL, "Unary"), (["is", "!is", "as", "as?"], "Type"),
    ],
    "Infix": ["ident", "mod", *sorted(SOFT)],
    "Unary": (("*", ["step", "-", "+", "not", "label", ("Annotation", NL)]), "Primary", ("*", "Suffix")),
    "Suffix": [
        "step", "!!", ("[", trailed("Expr"), "]"), ("TypeArgs", ["ValueArgs", "Lambda"]), "ValueArgs", "Lambda",
        ([".", "?."], ["Name", ("(", "Expr", ")"), "class"]), ("::", ["Name", "class"]), ("q", "::", ["Name", "class"]),
    ],
    "ValueArgs": ("(", ("?", trailed(("Annotations", ("?", ("Name", "=")), ("?", "star"), "Expr"))), ")"),
    "Lambda": ("Annotations", ("?", "label"), "LambdaLit"),
    "LambdaLit": ("{", SEMIS, ("?", (("?", ("LambdaParam", ("*", (",", "LambdaParam")), ("?", ","))), NL, "->", SEMIS)), "Stmts", "}"),
    "LambdaParam": ["VarDecl", ("MultiVar", ("?", (":", "Type")))],
    "Primary": [
        ("(", "Expr", ")"), "Name", "lit", "true", "false", "null", "String", ("::", ["Name", "class"]), "LambdaLit", ("[", ("?", trailed("Expr")), "]"),
        ("Modifiers", "fun", ("?", ("Type", ".")), "Params", ("?", (":", "Type")), ("?", "FunBody")),
        (("?", "mod"), "object", ("?", (":", "Delegs")), "ClassBody"), "this", ("super", ("?", ("<", "Type", ">"))),
        "If", "When", "Try", ("throw", NL, "Expr"), ("return", ("?", "Expr")), "continue", "break", ("TypeArgs2", "::", ["Name", "class"]),
    ],
    # A generic type before :: (List<Int>::size).
    "TypeArgs2": ("Name", ("*", (".", "Name")), "TypeArgs", ("*", "q")),
    "String": ["str", ("strb", "Template", ("*", ("strm", "Template")), "stre")],
    "Template": (NL, "Expr", NL),
    "If": ("if", "(", "Expr", ")", NL, [("Body", ("?", (SEMIS, "else", NL, ["Body", ";"]))), (";", ("?", (NL, "else", NL, ["Body", ";"]))), ("else", NL, ["Body", ";"])]),
    "When": ("when", ("?", ("(", ("?", ("Annotations", "val", "VarDecl", "=")), "Expr", ")")), "{", SEMIS, ("*", ("WhenEntry", SEMIS)), "}"),
    "WhenEntry": ([("else", NL), (trailed("WhenCond"), NL, ("?", ("if", "Expr")))], "->", NL, "Body"),
    "WhenCond": ["Expr", (["in", "!in"], "Expr"), (["is", "!is"], "Type")],
    "Try": ("try", NL, "Block", [("Catches", ("?", (NL, "finally", NL, "Block"))), (NL, "finally", NL, "Block")]),
    "Catches": ("+", (NL, "catch", "(", "Annotations", "Name", ":", "Type", ("?", ","), ")", NL, "Block")),
}


def grammar() -> Grammar:
    return Grammar(RULES, "File")
