"""Problem 2: credentials in source code, found by line and redacted in place.

Method: the source is tokenized lexically (comments, quoted, raw and character literals,
names, punctuation of Go and Kotlin). A literal is flagged if it is no placeholder and is

* assigned, keyed or passed to a name that stands for a credential (words of camel or snake
  case, such as apiKey or DB_PASSWORD, but not secretName, passwordField or tokenCount), also
  through concatenation, joining and decoding calls, or
* the last argument of a call that logs in or connects.

Inside literals and comments the same is done once more: a second lexer reads their text as notes,
values that stand at a name: key=value, key: value and JSON pairs, environment and netrc lines,
command-line flags, parameters of links, and the places where a notation has a password without
naming it (user:password@ in URLs and addresses, secret links, authorization headers). A note is flagged by
the rule for literals: its name stands for a credential and its value is no placeholder; since a
note has no quotes, its value must not look like a word of prose either. Self-describing tokens
(published prefixes, signed tokens, private key blocks) need no name.

Redaction replaces a credential's characters only; quotes, escapes of delimiters and white
space, line breaks, key block headers and everything else stay.

Cases: null sources, imports and list elements have no credentials; empty and blank values,
placeholders, references to variables, files or stores, digests, ids, public keys and
certificates are none; of several credentials on one line one row is returned; a literal that
does not end is read to its line's end (raw: to the text's end); repeated rows give repeated
rows unless the caller asks for distinct ones; extra columns pass through redact().
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.runtime import spread, table

# Words of names that stand for a credential.
SECRET_WORDS = frozenset("password passwd pwd pw pass passphrase passcode secret token apikey apitoken credential credentials cred creds auth otp pat pin".split())
KEY_WORDS = frozenset("api auth access account admin service secret signing sign private encryption master client license shared storage session root deploy crypto hmac jwt ssh webhook app db".split())
# Last words that make such a name one of something else.
OTHER_WORDS = frozenset(
    "name names field fields file files path paths ref refs reference count counts id ids url uri type types length len index size hash digest policy label "
    "prompt env var variable header headers pattern regex expiry expires ttl column request response hint format prefix suffix store provider kind status "
    "error errors message title test tests dir folder location manager service client factory parser reader source vault alias mode level key_id cache "
    "method scheme realm form page input box state valid invalid required enabled service".split()
)
# Words of which placeholders are made.
PLACE_WORDS = frozenset(
    "your my the a an here password passwd pass pwd secret token key api apikey auth credential credentials user username new old current test example sample "
    "dummy fake mock placeholder changeme change me redacted removed hidden masked none null nil empty todo tbd fixme xxx value string insert replace with "
    "default invalid wrong expired bad missing valid any some foo bar baz admin root access client private session bearer basic undefined unknown".split()
)
# Published shapes of tokens that tell what they are.
SHAPES = re.compile(
    r"""(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])
    |AIza[0-9A-Za-z_\-]{35}
    |glpat-[0-9A-Za-z_\-]{20,}
    |gh[opsur]_[0-9A-Za-z]{36,}
    |github_pat_[0-9A-Za-z_]{22,}
    |npm_[0-9A-Za-z]{36}
    |pypi-[0-9A-Za-z_\-]{32,}
    |xox[abeoprs]-[0-9A-Za-z\-]{16,}
    |[srp]k_(?:live|prod)_[0-9A-Za-z]{16,}
    |SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}
    |dop_v1_[0-9a-f]{64}
    |hvs\.[0-9A-Za-z_\-]{20,}
    |shpat_[0-9a-f]{32}
    |eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,})""",
    re.X,
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?")

# Certificates, public keys and the like: no credentials, but what stands beside them may be one.
PUBLIC_BLOCK = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PRIVATE KEY)[A-Z0-9 ]+-----(?:[\s\S]*?-----END (?![A-Z0-9 ]*PRIVATE KEY)[A-Z0-9 ]+-----|(?:\s|\\[nrt]|[A-Za-z0-9+/=])*)")

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))
    |(?P<raw>\"{3}[\s\S]*?(?:\"{3,}|\Z)|`[^`]*(?:`|\Z))
    |(?P<text>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z))
    |(?P<char>'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))
    |(?P<name>[^\W\d]\w*)
    |(?P<op>:=|[=(){}\[\],;:+.?\n])""",
    re.X,
)
PAIR = re.compile(r"""(?P<k>[A-Za-z][\w.\-]*)(?:\\*["'])?[ \t]*(?:=>|->|:=|[:=])[ \t]*(?:\\*["'])?(?P<v>[^\s"'`,;\\&<>(){}]+)""")
WORDED = re.compile(r"""(?im)^[ \t]*(?:machine[ \t]+\S+[ \t]+)?(?:login[ \t]+\S+[ \t]+)?password[ \t]+(?P<v>[^\s"']+)[ \t]*$""")
FLAG = re.compile(r"""(?<![\w\-])(?:--?(?P<k>[A-Za-z][\w\-]*)[ =]|-(?P<u>[up])[ ]?)(?P<v>[^\s"'`]+)""")
USERINFO = re.compile(r"""[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s/:@"'`]*:(?P<v>[^\s/@"'`]+)@""")
# user:password@network(address), as drivers of databases are told where to connect
ADDRESS = re.compile(r"""(?<![\w/])[\w.\-]+:(?P<v>[^\s"'`]+)@(?:tcp[46]?|udp[46]?|unix|socket)\(""")
LINK = re.compile(r"""[?&](?P<k>[A-Za-z][\w\-]*)=(?P<v>[^\s"'`&#]{12,})""")
# Parameters of links that sign or open them.
SIGNATURES = frozenset("sig signature x-amz-signature sas key".split())
HOOK = re.compile(r"""https?://hooks?\.[^\s"'`/]+/(?P<v>(?:[\w\-]+/)*[\w\-]{16,})|https?://[^\s"'`]+/(?:web)?hooks?/(?P<w>(?:[\w\-]+/)*[\w\-]{20,})""", re.I)
SCHEME = re.compile(r"""\b(?P<s>basic|bearer|token)[ ]+(?P<v>[A-Za-z0-9+/=._~\-]{8,})""", re.I)
# Hints: one of them is in every text in which a name, call, notation or shape of this module can be; most texts have none.
_BOUNDED = ("pin", "pat", "pw")
_WORDS = [w for w in (SECRET_WORDS | {"key"}) if w not in _BOUNDED]
LOWER_HINTS = (*sorted(w for w in _WORDS if not any(v != w and v in w for v in _WORDS)), "login", "log_in", "signin", "sign_in", "connect", "://", "bearer", "basic", "-user", "@tcp", "@udp", "@unix(", "@socket(", "sig=", "signature=", "sas=")
CASED_HINTS = ("AKIA", "ASIA", "AIza", "glpat-", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "npm_", "pypi-", "xox", "_live_", "_prod_", "SG.", "dop_v1_", "hvs.", "shpat_", "eyJ")
BOUNDED = re.compile(r"(?i)(?:pin|pat|pw)(?:(?![a-z])|(?-i:[A-Z]))|(?-i:PIN|PAT|PW)")
SHORT_FLAG = re.compile(r"(?<![\w\-])-[upa]")

# How a credential was found: as a named literal, as a named value inside a literal or comment, by its own shape.
LITERAL, NOTE, SHAPE = "literal", "note", "shape"

PASSING = re.compile(r"(?i)^(?:decode\w*|fromBase64\w*|b64decode|listOf|arrayOf|of|join\w*|byte|bytes|string|toByteArray|trim\w*|concat|format|secret\w*string|Secret|Some|ptr|pointer|stringptr)$")
LOGIN = re.compile(r"(?i)^(?:log_?in\w*|sign_?in\w*|authenticate\w*|basic_?auth\w*|set_?basic_?auth|get_?connection|connect\w*|with_?credentials|credentials|userpass\w*)$")
SETTER = re.compile(r"^(?:set|with|use|add|put)(?=[A-Z_])|^(?:Set|With|Use|Add|Put)(?=[A-Z_])")
KEYED = re.compile(r"(?i)^(?:set|put|add|header|with|env|t?setenv|property|param|cookie|default|pair|entry)")


@lru_cache(1 << 16)
def names_credential(name: str) -> bool:
    """Whether a name's words say that its value is a credential."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    while words and (words[-1].isdigit() or words[-1] in ("live", "prod", "test", "value", "raw", "str", "text", "plain", "b", "a", "old", "new")):
        words.pop()
    if not words or words[-1] in OTHER_WORDS or "public" in words:
        return False
    if words[-1] == "key" or words[-1] == "keys":
        return any(w in KEY_WORDS for w in words[:-1])
    if words[-1] in SECRET_WORDS:
        return words[-1] not in ("pin", "pat", "otp") or len(words) == 1
    return words[-1].startswith("password") or words[-1].endswith(("password", "secret", "token", "apikey"))


def names_phrase(name: str) -> bool:
    """Whether a name's last word says that its value may be several words."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    return bool(words) and words[-1].lower() in ("passphrase", "password", "secret") and names_credential(name)


def placeholder(value: str) -> bool:
    """Whether a value stands for another one, or for none."""
    v = value.strip()
    if len(v) < 4 or len(set(v)) <= 2:
        return True
    if re.search(r"\$\{|\$\(|\{\{|\$[A-Za-z_]|%[sdv]|^<.*>$|^\[.*\]$|^\{.*\}$|\.\.\.|EXAMPLE|[xX*.#]{6,}", v):
        return True
    if re.match(r"(?:(?:/|\./|~/)[a-z_]+(?:/[a-z0-9_.\-]+)*$|file:|vault:|env:|secret:|ref:|arn:|aws:|gcp:|ssm:|op://|https?://[^@]*$)", v) and not re.search(r"[+=]", v):
        return True
    words = re.findall(r"[A-Za-z]+", v)
    return bool(words) and not re.search(r"\d", v) and all(w.lower() in PLACE_WORDS for p in words for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", p))


def telling(value: str) -> bool:
    """Whether a value outside any quotes looks like no word of prose."""
    return not placeholder(value) and len(value) >= 6 and bool(re.search(r"\d|[a-z][A-Z]|^[a-z]+(?:-[a-z]+){2,}$|[!@#%^*?~+/]", value)) and "()" not in value and not re.fullmatch(r"[A-Z]?[a-z\-]*[.:]", value)


def hinted(text: str) -> bool:
    """Whether text can hold a credential: a superset, made of the words and shapes that the scanners look for."""
    low = text.lower()
    for w in LOWER_HINTS:
        if w in low:
            return True
    for w in CASED_HINTS:
        if w in text:
            return True
    for w in _BOUNDED:
        if w in low:
            if BOUNDED.search(text):
                return True
            break
    return "-" in text and SHORT_FLAG.search(text) is not None


def _basic(value: str) -> bool:
    """Whether value is user:password in base 64."""
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def notes(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, start, end, certain) of the values that stand at a name in the text of a literal or comment.

    A place that a notation has for a password, secret or token has that name; certain: the
    notation itself says that the value is no word.
    """
    if "://" in text:
        for m in USERINFO.finditer(text):
            yield "password", *m.span("v"), True
        for m in HOOK.finditer(text):
            g = "v" if m["v"] else "w"
            if telling(m[g].rpartition("/")[2]):
                yield "secret", *m.span(g), True
    if "(" in text:
        for m in ADDRESS.finditer(text):
            yield "password", *m.span("v"), True
    for m in LINK.finditer(text):
        yield "signature_token" if m["k"].lower() in SIGNATURES else m["k"], *m.span("v"), False
    for m in SCHEME.finditer(text):
        if m["s"].lower() == "basic":
            if _basic(m["v"]):
                yield "password", *m.span("v"), True
        elif m["s"].lower() == "bearer" and len(m["v"]) >= 16:
            yield "token", *m.span("v"), False
    for m in PAIR.finditer(text):
        if not text.startswith("://", m.end("k")):
            yield m["k"], *m.span("v"), False
    for m in WORDED.finditer(text):
        yield "password", *m.span("v"), False
    for m in FLAG.finditer(text):
        if m["u"] == "u" or (m["k"] or "").lower() in ("u", "a", "auth", "user", "basic-auth"):
            user, colon, _ = m["v"].partition(":")
            if colon:
                yield "password", m.start("v") + len(user) + 1, m.end("v"), False
        elif m["k"]:
            yield m["k"], *m.span("v"), False
        elif "ssh" in text or "mysql" in text:
            yield "password", *m.span("v"), False


def in_text(text: str, base: int, out: list[tuple[int, int, str]]) -> None:
    """Adds (start, end, path) of the credentials inside a literal or comment."""
    if not hinted(text):
        return
    for m in PRIVATE_KEY.finditer(text):
        out.append((base + m.start(), base + m.end(), SHAPE))
    if "-----BEGIN" in text:
        text = PUBLIC_BLOCK.sub(lambda m: '"' * len(m.group()), text)  # no notation's value holds a quote
    for m in SHAPES.finditer(text):
        if not placeholder(m.group()):
            out.append((base + m.start(), base + m.end(), SHAPE))
    for name, a, b, certain in notes(text):
        if names_credential(name) and not placeholder(text[a:b]) and (certain or telling(text[a:b])):
            out.append((base + a, base + b, NOTE))


def _closed(start: int, end: int, text: str, raw: bool) -> tuple[int, int]:
    """The bounds of a literal's content."""
    q = 3 if raw and text.startswith('"""', start) else 1
    quote = text[start : start + q]
    return start + q, end - q if end - start >= 2 * q and text.endswith(quote, start, end) else end


def marks(source: str) -> list[tuple[int, int, str]]:
    """(start, end, path) of each credential in a source text, by start, without overlaps."""
    if not hinted(source):
        return []
    out: list[tuple[int, int, str]] = []
    toks = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(source)]
    calls: list[list] = []  # open brackets: [name of the call, target of the call's value, string arguments, bracket]
    target, names, key, n = "", [], "", len(toks)
    i = 0
    while i < n:
        kind, s, e = toks[i]
        if kind == "comment":
            in_text(source[s:e], s, out)
        elif kind in ("text", "raw") or kind == "char" and e - s > 4:
            # Literals joined by + are one value.
            parts = [_closed(s, e, source, kind == "raw")]
            while i + 2 < n and source[toks[i + 1][1]] == "+" and toks[i + 1][0] == "op":
                j = i + 2
                while j < n and source[toks[j][1]] == "\n":
                    j += 1
                if j < n and toks[j][0] in ("text", "raw"):
                    parts.append(_closed(toks[j][1], toks[j][2], source, toks[j][0] == "raw"))
                    i = j
                else:
                    break
            value = "".join(source[a:b] for a, b in parts)
            nxt = source[toks[i + 1][1] : toks[i + 1][2]] if i + 1 < n else ""
            found: list[tuple[int, int, str]] = []
            in_text(value, 0, found)
            call = calls[-1] if calls else None
            if call:
                call[2].append((value, parts))
            name = key or target
            passed = call and KEYED.match(call[0]) and not key and len(call[2]) > 1 and call[2][-2][0]
            named = name and names_credential(name) or call and SETTER.match(call[0]) and names_credential(SETTER.sub("", call[0]))
            named = named or passed and names_credential(passed) and re.fullmatch(r"[\w.\-]+", passed)
            phrase = any(names_phrase(x) for x in (name, SETTER.sub("", call[0]) if call and SETTER.match(call[0]) else "", passed or "") if x)
            if nxt in (":",) or nxt == "to" or nxt == "]":
                key = value if nxt != "]" else ""
                if nxt == "]":
                    names = [value]
            elif named and not found and not placeholder(value) and not re.search(r"[^\S ]" if phrase else r"\s", value.strip()) and "-----BEGIN" not in value:
                found = [(0, len(value), LITERAL)]
            if found:
                if len(parts) == 1:
                    out += [(parts[0][0] + a, parts[0][0] + b, path) for a, b, path in found]
                else:
                    out += [(*p, found[0][2]) for p in parts]
            if not (nxt in (":", "to")):
                key = ""
        elif kind == "name":
            word = source[s:e]
            if word == "to" and key:
                pass
            else:
                names.append(word)
        elif kind == "op":
            op = source[s:e]
            if op in (":=", "="):
                # creds, _ := ...; val token: String = ...; headers["X"] = ...
                target = next((x for x in names if names_credential(x)), names[-1] if names else "")
                names, key = [], ""
            elif op == ":":
                if not key and names:
                    key = names[-1]
            elif op == "(":
                call = names[-1] if names else ""
                inside = target or (calls[-1][1] if calls and PASSING.match(calls[-1][0]) else "")
                calls.append([call, inside, [], op])
                target, names, key = (inside if PASSING.match(call) else ""), [], ""
            elif op == "[" or op == "{":
                calls.append(["", target if op == "[" else "", [], op])
                names = names if op == "[" else []
                target, key = ("" if op == "{" else target), ""
            elif op in ")}]":
                if calls:
                    call = calls.pop()
                    target = call[1]
                    strings = call[2]
                    if op == ")":
                        if LOGIN.match(call[0]) and len(strings) >= 2:
                            value, parts = strings[-1]
                            if not placeholder(value) and not re.search(r"\s|://", value):
                                out += [(*p, LITERAL) for p in parts]
                        elif PASSING.match(call[0]) and len(strings) > 1:
                            whole: list[tuple[int, int, str]] = []
                            value = "".join(v for v, _ in strings)
                            in_text(value, 0, whole)
                            if whole:
                                out += [(*p, whole[0][2]) for _, parts in strings for p in parts if p[0] < p[1]]
                key = ""
            elif op == ",":
                key = ""
                if calls and calls[-1][0] and not PASSING.match(calls[-1][0]):
                    target = ""
                if calls and calls[-1][3] != "{":
                    names = []
            elif op in ";\n":
                if not calls or calls[-1][0] == "":
                    target, key = "", ""
                names = []
        i += 1
    return _apart(out)


def _apart(out: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """By start, overlapping ones made one."""
    merged: list[tuple[int, int, str]] = []
    for a, b, path in sorted(set(out)):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), min(path, merged[-1][2]))
        elif a < b:
            merged.append((a, b, path))
    return merged


def spans(source: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in marks(source)]


def import_marks(text: str) -> list[tuple[int, int, str]]:
    """The same of an import, which is read like a literal."""
    out: list[tuple[int, int, str]] = []
    in_text(text.replace("\n", " "), 0, out)
    return _apart(out)


def import_spans(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in import_marks(text)]


#: Line breaks and escapes of delimiters and white space; escapes that write a character in digits are content.
KEPT = re.compile(r"""(\r?\n|\\[nrtbfav\\"'`$])""")


def redacted(text: str, found: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """text with each span replaced; line breaks, escapes of delimiters and white space, and key block headers inside stay."""
    out, at = [], 0
    for a, b in found:
        out.append(text[at:a])
        body = text[a:b]
        if body.startswith("-----BEGIN"):
            out.append(re.sub(r"(?<!-)(?<!\\)(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{16,}|(?<=\\n)[A-Za-z0-9+/=]{4,}|^[A-Za-z0-9+/=]+$", mark, body, flags=re.M))
        else:
            out += [x if i % 2 else mark for i, x in enumerate(KEPT.split(body)) if x]
        at = max(at, b)
    return "".join(out) + text[at:]


def lines_of(text: str, found: list[tuple[int, int]]) -> list[int]:
    """The lines, from 1, on which spans begin, each once."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return sorted({bisect_right(ends, a - 1) + 1 if a else 1 for a, _ in found})


_FOUND = T.StructType([T.StructField("seq", T.LongType()), T.StructField("field", T.StringType()), T.StructField("position", T.LongType())])


def _find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        seq, field, position = [], [], []
        for n, source, imports in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for line in lines_of(source, spans(source)) if source else ():
                seq.append(n), field.append("source"), position.append(line)
            for k, element in enumerate(imports or (), 1):
                if element and import_spans(element):
                    seq.append(n), field.append("imports"), position.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(field, pa.string()), pa.array(position, pa.int64())], names=["seq", "field", "position"])


def find(evidence: DataFrame) -> DataFrame:
    """(seq, field, position) of each line or list element in which a credential begins, once per key."""
    return spread(evidence.select("seq", "source", "imports")).mapInArrow(_find, _FOUND).distinct()


def redact(evidence: DataFrame, mark: str = "REDACTED") -> DataFrame:
    """All columns and rows of evidence, with the credentials in source and imports replaced by mark; adds n_redacted."""
    evidence = evidence.drop("n_redacted")
    schema = T.StructType([*evidence.schema.fields, T.StructField("n_redacted", T.IntegerType())])
    names = evidence.columns

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            source, imports, counts = [], [], []
            for text, elements in zip(batch.column("source").to_pylist(), batch.column("imports").to_pylist(), strict=True):
                found = spans(text) if text else []
                source.append(redacted(text, found, mark) if found else text)
                inner = [import_spans(x) if x else [] for x in elements or ()]
                imports.append(None if elements is None else [redacted(x, f, mark) if f else x for x, f in zip(elements, inner, strict=True)])
                counts.append(len(found) + sum(map(len, inner)))
            columns = {c: batch.column(c) for c in names} | {"source": pa.array(source, pa.string()), "imports": pa.array(imports, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(counts, pa.int32())], names=[*columns, "n_redacted"])

    return spread(evidence).mapInArrow(over, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "test_evidence"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "test_evidence").select("seq", "source", "imports"))


def p2_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows with a credential and their share per repository as written."""
    rows = redact(table(spark, sf_dir, "test_evidence").select("seq", "repository", "source", "imports"))
    return rows.groupBy("repository").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_redacted") > 0).alias("n_with"), F.sum("n_redacted").alias("n_credentials"))


def _paths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        n: dict[tuple[str, str], int] = {}
        for source, imports in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for field, found in (("source", marks(source) if source else []), *(("imports", import_marks(x)) for x in imports or () if x)):
                for _, _, path in found:
                    n[field, path] = n.get((field, path), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(n.values(), pa.int64())], names=["field", "path", "n"])


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials per field and way of finding them, in every row as delivered."""
    rows = spread(table(spark, sf_dir, "test_evidence").select("source", "imports"))
    return rows.mapInArrow(_paths, "field string, path string, n bigint").groupBy("field", "path").agg(F.sum("n").alias("n_credentials"))


QUERIES = {"p2_paths": p2_paths, "p2_found": p2_found, "p2_redacted": p2_redacted, "p2_by_repository": p2_by_repository}
SQL: dict[str, str] = {}
