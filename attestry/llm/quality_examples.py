"""Labelled examples for the quality rules: blocks of every kind, written from a seed.

Examples are made, not collected: each family below is a way people or programs write
something, filled with random words and numbers. Their number is FAMILY per family, whatever
the size of the data the rules are later applied to.
"""

from __future__ import annotations

import base64
import random

FAMILY = 90

WORDS = (
    "river station budget member garden winter council engine letter market bridge school window forest travel painter signal camera village doctor paper "
    "supply method result sample record series threshold baseline feature order voucher ticket sensor ledger policy route cell label frame column index "
    "reservation certificate measurement subscription laboratory schedule reminder shipment transfer catalog oak fox pen sea gauge"
).split()
ADJECTIVES = "old large early missing quiet noisy rough simple shared weekly hidden useful stable careful slow recent".split()
PROSE = (
    "We looked at every {a} {w} and then asked whether the {w} would still hold.",
    "If the {w} looks {a}, go back to the first section and read it again.",
    "There are about {n} of them left, and it is not clear why the {w} is so {a}.",
    "What happens when we compare the {w} with a {a} {w}? Let us try it and see.",
    "The {w} of {n} was {a}, which is close enough for what we want to show here.",
    "Before we go on, here is a short note on who asked for the {w} and what it was for.",
    "As you can see, most of the {w} falls into one {w}, but a few of them, say {n}, do not.",
    "The {w} is {a}, so we sort it first; the {w}, the {w} and the {w} come later.",
    "I counted {n}, {n} and {n}, which, as far as I can tell, is what the {w} needs.",
    "In the end, the {a} {w} had to go, and with it, the {w}.",
    "It is {a}; yet, for the {w}, it will do.",
    "Auf den ersten Blick ist die {w} nicht so {a}, wie es in der Übersicht steht.",
    "Wir sehen hier, dass sich die {w} nach dem {n}. Schritt kaum noch ändert.",
    "On voit ici que la {w} ne change presque plus, et que les données sont dans le fichier.",
    "La moyenne est de {n}, ce qui n'est pas étonnant pour une {w} de ce genre.",
    "En la siguiente parte comparamos los dos modelos y vemos que la {w} no es la misma.",
    "No podemos decir si la culpa es de la {w} o de nosotros, pero lo veremos mañana.",
    "{w}の値は{n}で、この集まりとしては普通の値です。次の節で二つのモデルを比べます。",
    "まずデータを読み込み、{w}列に欠けがないかを確認します。",
    "なぜ{w}に穴が多いのかはまだ分かりませんが、明日もう一度調べます。",
    "試してみたい人は、ファイルと少しの時間があれば{n}回でも実行できます。",
)
VERSE = ("and yet a {w} and the {a} {w}", "under the {w} and the {a} {w}", "over a {w} and the {a} {w}", "where the {a} {w} was all we had", "as if the {w} were {a} to us")


def fill(r: random.Random, s: str) -> str:
    while "{w}" in s:
        s = s.replace("{w}", r.choice(WORDS), 1)
    while "{a}" in s:
        s = s.replace("{a}", r.choice(ADJECTIVES), 1)
    while "{n}" in s:
        s = s.replace("{n}", str(r.randrange(10, 9999)), 1)
    return s


def rows(r: random.Random, lo: int = 2, hi: int | None = None) -> range:
    return range(r.randint(lo, hi or r.choice([8, 30, 120])))


def _number(r: random.Random) -> str:
    return r.choice([str(r.randrange(9999)), str(r.randrange(9999)), f"{r.random() * 900:.{r.randint(2, 4)}f}", f"{r.random():.3f}", "NaN", "null", ""])


def _cell(r: random.Random) -> str:
    return _number(r) if r.random() < 0.7 else r.choice(WORDS)


def prose(r):
    own = r.choice([PROSE[:11], PROSE[:11], PROSE[11:13], PROSE[13:15], PROSE[15:17], PROSE[17:]])
    return r.choice([" ", "\n"]).join(fill(r, r.choice(own)) for _ in rows(r, 1, 7))


def prose_bullets(r):
    return "\n".join(r.choice("-*") + " " + " ".join(fill(r, r.choice(PROSE[:11])) for _ in rows(r, 1, 3)) for _ in rows(r, 1, 5))


def verse(r):
    return "\n".join(fill(r, r.choice(VERSE)) for _ in rows(r, 2, 20))


def heading(r):
    text = lambda: fill(r, r.choice(["The {a} {w}", "{a} {w}", "Compare the {w}", "{a} {w} {w}", "{w}"])).capitalize()
    return r.choice(["#" * r.randint(1, 4) + " ", "#" * r.randint(1, 4) + " ", ""]) + text() + r.choice(["", "", "\n## " + text()])


def code(r):
    lines = (
        'df = df[df["{w}"] > {n}.5]', "import numpy as np", "x = np.linspace(0, {n}, 80)", "for name, part in df.groupby('{w}'):", "    print(name, len(part))",
        "def {w}_{a}(x, n={n}):", "    out.append(x[i] * {n}.3)", "    return out", 'with open("{w}.json", "w") as fh:', "model.fit(X_train, y_train)", "SELECT {w}, count(*) AS n FROM {w} GROUP BY {w} HAVING count(*) > 2",
        "fit <- lm({w} ~ {w} + {w}, data = d)", "ggplot(d, aes(x = {w}, y = {w})) + geom_point()", "plt.plot(x, y, label='{w}')", "assert len(df) == {n}, len(df)", "res = [{w}(r) for r in rows if r.{w} is not None]",
        "d %>% group_by({w}) %>% summarise(m = mean({w}), n = n())", "!pip list | grep {w}", "%matplotlib inline", "plot!(p, {w}, {w})", "using DataFrames, Plots",
    )
    return "\n".join(fill(r, r.choice(lines)) for _ in rows(r, 1, 9))


def result(r):
    return fill(r, r.choice(["{n}", "True", "None", "'{w}_{w}'", "array([{n}.2, {n}.9, {n}.842])", "{'{w}': {n}, '{w}': 'ab12'}", "score: 0.{n}", "{w}: {n}", "{w} {n}\n{w} {n}", "KeyError: '{w}'", "KeyboardInterrupt:", "1. {w}({w}, {w})\n2. eval(expr, envir)", "<Axes: title='{w} by {w}'>", "WARNING: {w} is deprecated, use {w}", "$\\sum_i x_i = {n}$", "(20, {n})"]))


def scrap(r):
    return r.choice(["…", "🙂", "?", "...", "---", "$$", "-", "§", "→", "x = 1", "(!)", "👍🏽", "{}", "∑", "🇩🇪", "***", "==="])


def trace(r):
    head = ["-" * 75, fill(r, "KeyError" + " " * 34 + "Traceback (most recent call last)")] if r.random() < 0.5 else ["Traceback (most recent call last):"]
    body = [fill(r, r.choice(["Cell In[{n}], line {n}", '  File "{w}.py", line {n}, in {w}', "<ipython-input-{n}> in <module>", "----> {n} {w}.{w}()", "      1 {w} = {w}({n})", "File ~/env/lib/{w}.py:{n}, in {w}.{w}(self, key)", "    {n}     raise KeyError(key) from err", "Stacktrace:", " [1] top-level scope @ In[3]:{n}", "\tat org.{w}.{w}({w}.java:{n})"])) for _ in rows(r, 1, 6)]
    return "\n".join([*head, *body, fill(r, r.choice(["KeyError: '{w}'", "AttributeError: 'NoneType' object has no attribute '{w}'", "ValueError: operands could not be broadcast together with shapes ({n},) ({n},)", "ERROR: LoadError: UndefVarError: `{w}` not defined", "Error in {w}({w}, {w}) : object '{w}' not found"]))])


def bullets(r):
    mark = r.choice(["- ", "* ", "+ ", "• ", "- [ ] ", "- [x] "])
    if r.random() < 0.3:  # few items, many times
        items = [fill(r, "{a} {w}") for _ in range(r.randint(4, 12))]
        return "\n".join(" " * r.choice([0, 0, 4, 8]) + mark + r.choice(items) for _ in rows(r, 10, r.choice([30, 120])))
    return "\n".join(" " * r.choice([0, 0, 0, 2, 4, 8]) + mark + fill(r, r.choice(["{a} {w}", "{w}", "Plot the {w}", "{w} {w}", "{w} ({n})", "the {w} of the {w}", "{w} and {a} {w}"])) for _ in rows(r))


def numbered(r):
    style = r.choice(["{i}. ", "{i}) ", "({i}) ", "{c}) ", "{c}. "])
    return "\n".join(style.format(i=i + 1, c="abcdefghijklmnopqrstuvwxyz"[i % 26]) + fill(r, r.choice(["{a} {w}", "Plot the {w}", "{w} / {w}", "{w}", "Plot the {w} and the {w}", "Sort all {w} by {w}"])) for i in rows(r))


def links(r):
    return "\n".join(fill(r, "- [{a} {w}](https://docs.{w}.example.test/{w}/{n})") for _ in rows(r))


def entries(r):
    sep = r.choice([": ", " - ", ": ", " = "])
    return "\n".join(fill(r, r.choice(["{w}", "{w}"]).capitalize() + sep + r.choice(["{a} {w}", "{w}", "{w} {n}"])) for _ in rows(r))


def versions(r):
    return "\n".join(fill(r, "{w}-{w}") + "==" + ".".join(str(r.randrange(20)) for _ in range(3)) for _ in rows(r))


def plain_items(r):
    return "\n".join(fill(r, r.choice(["{a} {w}", "{w} {w}", "{w}", "{w}.csv", "{w}/{w}_{n}.json"])) for _ in rows(r, 6, 30))


def pipes(r):
    n = r.randint(3, 7)
    return "\n".join("| " + " | ".join(c) + " |" for c in [[r.choice(WORDS) for _ in range(n)], ["---"] * n, *([_cell(r) for _ in range(n)] for _ in rows(r))])


def grid(r):
    n = r.randint(3, 7)
    rule = "+" + "+".join(["-" * 12] * n) + "+"
    line = lambda: "|" + "|".join(_cell(r).rjust(12) for _ in range(n)) + "|"
    return "\n".join([rule, line(), rule, *(line() for _ in rows(r)), rule])


def frame(r):
    n = r.randint(2, 7)
    out = ["".ljust(5) + "".join(r.choice(WORDS).rjust(13) for _ in range(n))]
    exact, holes = r.random() < 0.7, r.choice([0, 0, 0.1])
    value = lambda: "NaN" if r.random() < holes else f"{r.random() * 900:.4f}" if exact else _number(r) or "NaN"
    return "\n".join(out + [str(i).ljust(5) + "".join(value().rjust(13) for _ in range(n)) for i in rows(r)])


def padded(r):
    n = r.randint(3, 7)
    return "\n".join("".join((_cell(r) or "-").ljust(12) for _ in range(n)) for _ in rows(r))


def markup(r):
    n = r.randint(2, 7)
    share = r.choice([0, 0.3, 1])
    value = lambda t: r.choice(WORDS) if t == "th" or r.random() < share else _number(r)
    line = lambda t: "<tr>" + "".join(f"<{t}>{value(t)}</{t}>" for _ in range(n)) + "</tr>"
    return "\n".join(['<table border="1">', line("th"), *(line("td") for _ in rows(r)), "</table>"])


def delimited(r):
    n, d = r.randint(3, 8), r.choice([",", ";", "\t", ","])
    return "\n".join([d.join(r.choice(WORDS) for _ in range(n)), *(d.join(_cell(r) for _ in range(n)) for _ in rows(r))])


def typeset(r):
    n = r.randint(3, 7)
    return "\n".join([" & ".join(r.choice(WORDS) for _ in range(n)) + " \\\\ \\hline", *(" & ".join(f"{r.random() * 50:.2f}" for _ in range(n)) + " \\\\" for _ in rows(r))])


def encoded(r):
    text = base64.b64encode(r.randbytes(r.randint(150, 3000))).decode()
    text = r.choice(["", "data:image/png;base64,", "![png](data:image/png;base64,"]) + text
    return "\n".join(text[i : i + 76] for i in range(0, len(text), 76)) if r.random() < 0.5 else text


def garbled(r):
    return "".join(r.choice("ÃÂâ€™œŸ±°£¿»¼©ï�") for _ in range(r.randint(60, 800)))


def noise(r):
    chars = "0123456789abcdef!#$%&()*+-/:;<=>?@[\\]^_`{|}~!#$%&()*+-/:;<=>?@[\\]^_`{|}~\x07\x1b�"
    return "".join(r.choice(chars) for _ in range(r.randint(80, 900)))


def minified(r):
    v = lambda: r.choice("abcdegkmnpuvwxyz")
    parts = (lambda: f"function {v()}({v()}){{return {v()}[{r.randrange(99)}]^{v()}<<{r.randrange(32)}}}", lambda: "var a=!0;", lambda: "void 0;", lambda: "!function(){}();", lambda: f"{v()}.{v()}={v()}&&{v()}({v()},{r.randrange(99)}),")
    if r.random() < 0.6:
        parts = parts[:4]
    return "".join(r.choice(parts)() for _ in rows(r, 8, 60))


def paths(r):
    body = " ".join(f"{r.random() * 800:.2f},{r.random() * 600:.2f}" for _ in rows(r, 8, 90))
    return r.choice(["{}", "![png]({})"]).format(f'<path d="M{body}z"/>')


def logs(r):
    stamp = lambda: f"2024-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02},{r.randrange(999):03}"
    return "\n".join(f"{stamp()} {r.choice(['INFO', 'WARN', 'DEBUG'])} worker-{r.randrange(60)} pid={r.randrange(99999)}: {r.choice(['tick', 'poll', 'sync'])} {r.randbytes(6).hex()}" for _ in rows(r, 3))


def progress(r):
    return r.choice("\n\r").join(f"{p:3}%|{'█' * (p * 40 // 100):40}| {p * 40 // 100}/40 [00:{r.randrange(60):02}<00:{r.randrange(60):02}, {r.random() * 50:.2f}it/s]" for p in sorted(r.sample(range(101), r.randint(3, 20))))


def rulers(r):
    return "\n".join(r.choice(["=", "-", "~", "#", "*", "_", "*-", "._.", "+="]) * r.randint(20, 90) for _ in rows(r, 2, 15))


def dump(r):
    text = "\n".join(f"{i * 16:08x}: {r.randbytes(16).hex(' ')}" for i in rows(r, 2))
    return f"![png]({text})" if r.random() < 0.3 else text


def repeated(r):
    return "\n".join([fill(r, "warning: {w} {w} ignored")] * r.randint(5, 40))


KINDS = {
    "none": (prose, prose, prose, prose, prose, prose_bullets, verse, verse, heading, heading, scrap, code, code, result, result, trace, trace),
    "list": (bullets, bullets, numbered, numbered, links, entries, entries, versions, plain_items),
    "table": (pipes, pipes, grid, frame, frame, padded, markup, markup, delimited, delimited, typeset),
    "junk": (encoded, encoded, garbled, noise, minified, minified, paths, logs, progress, rulers, dump, repeated),
}


def examples(seed: int = 11, per_family: int = FAMILY) -> list[tuple[str, str]]:
    """(text, kind) of per_family blocks of each family."""
    r = random.Random(seed)
    return [(make(r), kind) for kind, makers in KINDS.items() for make in makers for _ in range(per_family)]
