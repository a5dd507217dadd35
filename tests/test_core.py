"""The core: queries against SQL by value, and units of discovery, extraction, responses, evaluation and the CLI."""

import decimal
import glob
import http.server
import io
import json
import os
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry import cli
from attestry import taxonomy as X
from attestry.extract import go, kotlin
from attestry.extract.common import SyntaxFault
from attestry.functions import evidence as E
from attestry.functions.text import repository_key
from attestry.operators import discovery as D
from attestry.operators import evaluate as V
from attestry.operators import report as R
from attestry.operators import responses as A
from attestry import questions
from attestry.plans import cases, catalog
from attestry.runtime import hot_keys, join_hot, measured
from attestry.sources import records


def cell(x):
    """A value to compare: null, NaN and numbers are told apart, kinds of numbers are not."""
    if x is None:
        return None
    if isinstance(x, float) and x != x:
        return "NaN"
    if isinstance(x, bool | int | float | decimal.Decimal):
        return round(float(x), 6)
    return str(x)


def values(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, name):
    got = catalog.queries()[name](spark, sf)
    if name not in catalog.oracle_sql():
        assert got.count() > 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    assert values(got.columns, got.collect()) == values([d[0] for d in want.description], want.fetchall())


# -- discovery -----------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("pattern", "name", "want"),
    [("*_test.go", "pkg/order_test.go", True), ("order_test.go", "pkg/order_test.go", True), ("pkg/*_test.go", "pkg/order_test.go", True), ("pkg/**", "pkg/deep/order_test.go", True),
     ("**/*_test.go", "a/b/order_test.go", True), ("pkg/*.go", "other/order_test.go", False), ("pkg/order.go", "pkg/order_test.go", False), ("pkg/**", "pkg", True), ("[a-c]?.go", "x/bz.go", True),
     ("[^a-c]?.go", "x/bz.go", False), ("./a.go", "a.go", True), ("[", "[", False), ("a\\*", "a*", True), ("a\\*", "ab", False), ("", "a", False)],
)
def test_globs(pattern, name, want):
    import re

    regex = D.glob_regex(pattern)
    assert bool(regex and re.match(regex, "/" + name)) == want


def tree(tmp_path):
    for p in ("pkg/order_test.go", "pkg/helper.go", "pkg/OrderTest.kt", "pkg/Helper.kt", "pkg/secret_test.go", "vendor/dep/dep_test.go", "src/test/kotlin/Anything.kt", "x.kts"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("package p\n")
    return tmp_path


def test_discovery(spark, tmp_path):
    root = str(tree(tmp_path))
    paths = lambda **k: [r.path for r in D.candidates(D.list_files(spark, [root], k.get("exclude", ())), **k).orderBy("path").collect()]
    assert paths() == ["pkg/OrderTest.kt", "pkg/order_test.go", "pkg/secret_test.go", "src/test/kotlin/Anything.kt"]
    assert paths(exclude=["*secret_test.go"], include=["pkg/helper.go", "*.kts"]) == ["pkg/OrderTest.kt", "pkg/helper.go", "pkg/order_test.go", "src/test/kotlin/Anything.kt"]
    assert paths(exclude=["pkg/**"]) == ["src/test/kotlin/Anything.kt"]
    twice = D.candidates(D.list_files(spark, [root, f"{root}/pkg", f"{root}/vendor"]))
    assert twice.filter("path like '%order_test.go'").select("path").collect()[0][0] == "pkg/order_test.go" and twice.filter("path like '%dep_test.go'").count() == 1
    with pytest.raises(FileNotFoundError):
        D.list_files(spark, [root + "/none"])
    read = D.read_files(D.candidates(D.list_files(spark, [root])), most=5)
    assert {(r.content, r.reason) for r in read.collect()} == {(None, "file exceeds 5 byte limit")} and read.count() == 4


def test_listing_by_tasks(spark, tmp_path, monkeypatch):
    """Exact names (hidden ones, glob signs, blanks), links not followed, subtrees by tasks, unreadable files skipped."""
    monkeypatch.setattr(D, "FRONTIER", 2)
    names = ["a/[x]/{y}_test.go", "a/b/c/_under_test.go", "a/b/.hidden/d e_test.go", "Z_test.go", "a/*_test.go", "b/gone_test.go", "a/build/no_test.go", "skip/s_test.go"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("package p\n")
    (tmp_path / "b/link").symlink_to(tmp_path / "a")
    listed = D.list_files(spark, [str(tmp_path)], ["skip"])
    assert sorted(r.path for r in listed.collect()) == sorted(set(names) - {"a/build/no_test.go", "skip/s_test.go"})
    ordered = D.in_order(D.candidates(listed))
    assert [r.path for r in ordered.collect()] == sorted(set(names) - {"a/build/no_test.go", "skip/s_test.go"})
    kept = listed.collect()
    (tmp_path / "b/gone_test.go").unlink()
    read = D.read_files(spark.createDataFrame(kept, listed.schema))
    assert [(r.path, r.reason) for r in read.collect() if r.content is None] == [("b/gone_test.go", "read: No such file or directory")]
    one = D.list_files(spark, [str(tmp_path / "Z_test.go")]).first()
    assert one.path == str(tmp_path / "Z_test.go") and one.length == 10


# -- evidence ------------------------------------------------------------------------------------
def test_truncation_in_bytes(spark):
    for limit in (2, 30, 31, 33, 51, 512):
        texts = ["é" * 100, "abcdef", "a" + "漢" * 60, "🙂" * 30, "", "x" * limit, None]
        rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", E.truncated(F.col("t"), limit)).collect()
        for r in rows:
            if r.t is None or len(r.t.encode()) <= limit:
                assert r.c == r.t
                continue
            mark = X.TRUNCATED if limit > 30 else ""
            want = r.t.encode()[: limit - len(mark)].decode("utf-8", "ignore") + mark
            assert r.c == want and len(r.c.encode()) <= limit


def test_margins(spark):
    rows = [({"a": 0.75, "b": 0.2, "c": 0.05}, 0.55, 0.55), ({"a": 1.0}, 0.0, 0.0), ({}, 0.0, 0.0), ({"a": 0.5, "b": -0.5}, 0.5, 1.0), (None, 0.0, 0.0)]
    got = spark.createDataFrame([(r[0],) for r in rows], "p map<string,double>").select(E.margin(F.col("p")), E.margin(F.col("p"), False)).collect()
    assert [(round(a, 9), round(b, 9)) for a, b in got] == [(a, b) for _, a, b in rows]


def test_policy(spark):
    df = spark.createDataFrame([("unit", 0.8, 0.5), ("unit", 0.79, 0.5), ("unit", 0.9, 0.49), ("", 1.0, 1.0), (None, 1.0, 1.0), ("unit", None, 1.0)], "p string, c double, m double")
    say = lambda *t: [r[0] for r in df.select(E.decision(F.col("p"), F.col("c"), F.col("m"), *t)).collect()]
    assert say(0.8, 0.5) == ["accept", "review", "review", "review", "review", "review"] and set(say()) == {"review"} and say(0.0, 0.0)[:4] == ["accept", "accept", "accept", "review"]


def test_repository_forms(spark):
    forms = ["o/n", " O/N\n", "https://forge.example.test/o/n.git", "ssh://git@forge.example.test/o/n.git", "git@forge.example.test:o/n.git", "forge.example.test/o/n/", "HTTPS://FORGE.EXAMPLE.TEST/O/N/"]
    got = spark.createDataFrame([(f,) for f in [*forms, "", None]], "r string").select(repository_key(F.col("r"))).collect()
    assert [r[0] for r in got] == ["o/n"] * len(forms) + [None, None]
    odd = spark.createDataFrame([(f,) for f in ["a-b/c_1", "a-b/c_1\n", "o/n.git", "plain"]], "r string").select(repository_key(F.col("r"))).collect()
    assert [r[0] for r in odd] == ["a-b/c_1", "a-b/c_1", "o/n", "plain"]


def test_join_hot_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr("attestry.runtime.BROADCAST_BYTES", 0)
    monkeypatch.setattr("attestry.runtime.HOT_SHARE", 10)
    big = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1), ("c", 2), (None, 3), (None, 4)], "k string, v int")
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, w int")
    assert [r.k for r in hot_keys(big, ["k"]).collect()] == ["a"]
    for how in ("inner", "left"):
        got, want = join_hot(big, small, ["k"], how), big.join(small, ["k"], how)
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert join_hot(big.limit(0), small, ["k"]).count() == 0 and join_hot(big, small.limit(0), ["k"], "left").count() == 204


def test_measured_bytes_follow_the_values(spark):
    df = spark.createDataFrame([("x" * 1000, 1, ["y" * 500]), (None, None, None)], "s string, n long, a array<string>")
    assert 1500 < measured(df) < 2000 and measured(df.limit(0)) == 0


# -- extraction ----------------------------------------------------------------------------------
GO = '''package p

import (
	"testing"
	q "os"
)

func TestMain(m *testing.M) {}

func helper(t *testing.T) {}

func TestParcel(t *testing.T) {
	t.Parallel()
	for _, c := range []struct{ n string }{{"a"}} {
		t.Run(c.n, func(t *testing.T) {
			assertGolden(t, "x { y")
			t.Run("in ner", func(u *testing.T) { MatchSnapshot(u) })
		})
	}
	for i := 0; i < 3; i++ {
		t.Run(`raw "x"`, func(*testing.T) { assertGolden(t) })
	}
	t.Run("ref", other)
}

func FuzzLabel(f *testing.F) {}

func BenchmarkLabel(b *testing.B) {}
'''  # fmt: skip
KT = '''package p

import a.b.runBlocking as rb
import c.d;

class Outer(private val x: Int = 1) : Base<Int>() {
    @Test
    fun `adds parcels`() {
        assertGolden("a }")
    }

    @field:Nope
    @ParameterizedTest(name = "x)")
    @CsvSource("1, 2")
    fun <T> List<T>.many(a: Int) = runIt(a)

    class Inner {
        @org.junit.RepeatedTest(3) fun nested() { /* } /* } */ */ snapshotOf ("x") }
    }

    @Test

    fun lost() {}

    @Test
    // a comment line loses it
    fun alsoLost() {}
}

@Test
fun topLevel() {}
fun plain() {}
'''


def test_go_extraction():
    got = go.tests(GO.encode())
    assert [t["qualified"] for t in got] == ["TestParcel", "TestParcel/c.n", "TestParcel/c.n/in ner", 'TestParcel/raw "x"', "FuzzLabel", "BenchmarkLabel"]
    by = {t["qualified"]: t for t in got}
    assert by["TestParcel"]["features"] == ["go test function", "calls t.Parallel", "calls t.Run", "go table-driven subtest loop", "golden comparison call", "snapshot assertion call"]
    assert by["TestParcel/c.n"]["features"] == ["golden comparison call", "calls t.Run", "snapshot assertion call", "go table-driven subtest loop"]
    assert by["TestParcel/c.n/in ner"]["features"] == ["snapshot assertion call"] and by['TestParcel/raw "x"']["features"] == []
    assert by["FuzzLabel"]["source"] == "func FuzzLabel(f *testing.F) {}" and got[0]["imports"] == ["testing", "os"]
    for broken in ("package p\nfunc TestX(t *testing.T) {", "func x() {}", 'package p\nvar x = "a', "package p\n)"):
        with pytest.raises(SyntaxFault):
            go.tests(broken.encode())


@pytest.mark.parametrize(
    "code",
    ["var x := 1", "x := := 1", "var = 3", "const a", "func f( {}", "func f() { if x = 1 { } }", "func f() { for { }", "func f() { go f }", "func f() { switch x := 5 { } }", "func f() { a b }", "func f(a int, string) {}", "type T struct { a, }", "var s = \"\\q\"",
     "var r = 'ab'", "var n = 08", "var n = 0x", "func f() { return 1 2 }", "import \"late\"\nvar x = 1\nimport \"os\"", "<<<<<<< HEAD", "func f() { x = [2]int{1, 2 }\n", "func (t T) {}", "var x “y”", "func f() { else { } }", "func f() { case 1: }"],
)
def test_go_syntax_faults(code):
    with pytest.raises(SyntaxFault):
        go.tests(f"package p\n{code}\n".encode())


@pytest.mark.parametrize(
    "code",
    ["", "type T[K comparable, V int | ~string] map[K][]V", "type A [N * 2]int", "type A = B[int]", "type S struct { a, b int `tag`\n *T\n p.Q\n G[int]\n c [3]int }", "type I interface { m(int) (x, y error); ~int | string; fmt.Stringer }",
     "func (r *T[K]) m(a, b int, c ...string) (n int, err error) { return }", "var f = func(int, ...string) <-chan int { return nil }(1)", "const (\n a = iota\n b\n)", "func f() { L: for i, x := range []T{{1}, {2}} { if v, ok := m[T{1}]; !ok && v == (T{}) { continue L } } }",
     "func f() { switch y := x.(type) { case []int, nil: goto end; default: fallthrough }\nend: }", "func f() { select { case v, ok := <-c: _ = v; case c <- 1: default: } }", "func f() { for i := 0; i < 3; i++ { }; for range 3 { }; for ; ; { }; for x < T(1) { } }",
     "func f() { defer func() { recover() }(); go g(a...)\n x, y = y[1:2:3], z[:]\n *p++ ; c <- <-d }", "var m = map[string][]int{\"a\": {1, 2,},}\nvar n = 0x1p-2 + 1_000i + .5e3 + 0b11 + 'é' + '\\u00e9'", "func f() { if f := func() bool { return T{} == u }; f() { } else if g { } else { } }",
     "var x = f[int, []string](y)[0].(interface{ m() })", "func naïve(größe int) {}", "var p = (*T)(nil); var q = (<-chan int)(c)", "func f() { var x = struct{ a int }{1}; if (x == struct{ a int }{1}) { } }"],
)
def test_go_syntax(code):
    assert go.tests(f"package p\n{code}\n".encode()) == []


def test_deep_nesting():
    assert go.tests(b"package p\nvar x = " + b"(" * 3000 + b"1" + b")" * 3000 + b"\n") == []


def test_kotlin_extraction():
    got = kotlin.tests(KT.encode())
    assert [t["qualified"] for t in got] == ["Outer.adds parcels", "Outer.many", "Outer.Inner.nested", "topLevel"]
    assert got[0]["imports"] == ["a.b.runBlocking", "c.d"] and got[0]["features"] == ["kotlin @Test annotation", "golden comparison call"]
    assert got[1]["features"] == ["kotlin @ParameterizedTest annotation", "kotlin parameterized source annotation"] and got[1]["annotations"][1] == '@ParameterizedTest(name = "x)")'
    assert got[1]["source"].endswith("= runIt(a)") and got[2]["features"] == ["kotlin @RepeatedTest annotation", "snapshot assertion call"]
    for odd in (b"", b"`", b"@", b"@Test fun", b"class", b'"""', b"/* /*", b"@Test fun x(", b"import"):
        kotlin.tests(odd)


# -- responses -----------------------------------------------------------------------------------
def answer(**changes):
    doc = {"model": "m", "answers": {"primary_type": {"type": "choice", "choice": "unit", "probabilities": {"unit": 0.7, "other": 0.3}, "confidence": 0.9}}}
    doc["answers"] |= {f"trait_{t}": {"type": "noul", "noul": 0.6} for t in X.ASKED}
    for k, v in changes.items():
        (doc["answers"]["primary_type"] if k in ("type", "choice", "probabilities", "confidence") else doc)[k] = v
    return doc


def test_response_errors(spark):
    bad_noul = answer()
    bad_noul["answers"]["trait_property"]["noul"] = 1.5
    missing = answer()
    del missing["answers"]["trait_network"]
    below = answer(choice="other", probabilities={"unit": 0.34, "other": 0.33, "smoke": 0.33}, confidence=0.02)
    cases = [
        (json.dumps(answer()), None), (json.dumps(below), None), ("{", "invalid JSON"), (json.dumps(answer()) + " {}", "invalid JSON"), ('{"model": NaN}', "invalid JSON"), (json.dumps(answer(model="")), "missing model"),
        (json.dumps({"model": "m"}), "missing answers"), (json.dumps(missing), "trait network missing"), (json.dumps(answer(choice="odd")), "unknown primary type"), (json.dumps(answer(confidence=None)), "no confidence"),
        (json.dumps(answer(probabilities={"unit": 0.7})), "probability sum"), (json.dumps(bad_noul), "trait property out of range"), (json.dumps(answer(type="noul")), "primary answer type"), (json.dumps(answer()).replace('"model"', '"Model"'), None), (None, "invalid JSON"),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "seq long, response string")
    got = {r.seq: r.e for r in A.decoded(df).withColumn("e", A.response_error()).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_trait_merge(spark):
    ev = spark.createDataFrame([(1, [("calls t.Parallel", "parser"), ("golden comparison call", "parser")])], "seq long, features array<struct<name: string, source: string>>")
    doc = answer()
    doc["answers"]["trait_database"]["noul"] = 0.49
    row = A.predictions(ev, spark.createDataFrame([(1, json.dumps(doc))], "seq long, response string")).first()
    traits = {k: (v.present, v.probability, v.source) for k, v in row.traits.items()}
    assert traits["golden"] == (True, 1.0, "parser") and traits["database"] == (False, 0.49, "jev") and traits["property"] == (True, 0.6, "jev") and len(traits) == 9


class Handler(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Handler.seen.append(body)
        first = sum(b["state"]["test_name"] == body["state"]["test_name"] for b in Handler.seen) == 1
        code = 429 if body["state"]["test_name"] == "retry" and first else 401 if body["state"]["test_name"] == "denied" else 200
        self.send_response(code)
        self.end_headers()
        self.wfile.write(b"{}")

    def log_message(self, *_):
        pass


def test_http_provider(spark, monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ev = spark.createDataFrame([(1, "retry", "q"), (2, "denied", "q"), (3, "", "qualified")], "seq long, name string, qualified string")
    ev = ev.withColumns({"language": F.lit("go"), "annotations": F.lit(None).cast("array<string>"), "imports": F.array(F.lit("os")), "features": F.lit(None).cast("array<struct<name:string,source:string>>"), "source": F.lit("x" * 9000)})
    p = A.HttpProvider(f"http://127.0.0.1:{server.server_port}", "secret-key", "m-1", concurrency=2)
    got = {r.seq: (r.response, r.error) for r in p.responses(ev).collect()}
    server.shutdown()
    assert got == {1: ("{}", None), 2: (None, "authentication failed"), 3: ("{}", None)}
    last = next(b for b in Handler.seen if b["state"]["test_name"] == "qualified")
    assert last["state"]["annotations"] == [] and last["state"]["features"] == [] and len(last["state"]["source"]) == 8192
    with pytest.raises(ValueError):
        A.requests(ev, "m-latest")
    assert [A.backoff(n, jitter=lambda: 1.0) for n in range(6)] == [0.5, 1, 2, 4, 8, 8]


# -- evaluation ----------------------------------------------------------------------------------
def record(**k):
    base = {"id": "a", "repository": "r", "split": "development", "language": "go", "human_primary": "unit", "predicted_primary": "unit", "human_traits": [], "predicted_traits": [], "primary_probabilities": {"unit": 0.9, "other": 0.1}, "confidence": 0.9,
            "model": "m", "question_set_version": "1", "extractor_version": "1", "reviewer_a_primary": "unit", "reviewer_b_primary": "unit"}
    return base | k


def test_records_and_evaluator(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    lines = [record(), record(id="b", human_primary="smoke", predicted_primary="unit", confidence=0.2, reviewer_b_primary="smoke", human_traits=["fuzz", "fuzz"]), {"id": "p", "pending_human_review": True, "human_primary": "junk"}, {k.upper(): v for k, v in record(id="c").items()}]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    rows = records.strict_records(records.read_records(spark, str(path)))
    assert rows.count() == 3
    m = {r.label: (r.tp, r.fp, r.fn) for r in V.class_metrics(rows).collect()}
    assert m == {"unit": (2, 1, 0), "smoke": (0, 0, 1)}
    assert [(r.trait, r.fn) for r in V.trait_metrics(rows).collect()] == [("fuzz", 1)]
    a = V.acceptance(rows, 0.5, 0.5).first()
    assert (a.records, a.accepted, a.accepted_correct, a.coverage) == (3, 2, 2, 2 / 3) and V.acceptance(rows, -1, 0.5).first().accepted == 0
    assert V.kappa(rows.filter("id <> 'b'")).first().kappa == 1.0 and V.kappa(rows.limit(0)).first().kappa == 0.0
    text = V.report_text(rows, 0.5, 0.5)
    assert text.startswith("records: 3\nreviewer_cohens_kappa: 0.000\nmacro_f1: 0.400\nprimary:\n  smoke precision=0.000 recall=0.000 f1=0.000\n  unit precision=0.667 recall=1.000 f1=0.800\ntraits:\n  fuzz precision=0.000 recall=0.000 f1=0.000\n")
    assert "confusion_matrix:\n  smoke -> unit: 1\n  unit -> unit: 2\naccepted_coverage: 0.667\naccepted_accuracy: 1.000\nby_language:\n  go accuracy=0.667 n=3\n" in text and text.endswith("by_split:\n  development accuracy=0.667 n=3\n")
    s = V.summary(rows, 0.5, 0.5)
    assert abs(s["macro_f1"] - V.macro_f1(rows).first()[0]) < 1e-12 and abs(s["kappa"] - V.kappa(rows).first().kappa) < 1e-12 and V.summary(rows.limit(0))["kappa"] == 0.0
    for bad, why in ((json.dumps(record(split="x")), "line 1: split"), ("", "line 1"), (json.dumps(record(model=" ")), "line 1: blank model"), ('{"confidence": "1"}', "line 1: wrong type of confidence"), (json.dumps(record()) + " x", "line 1")):
        path.write_text(bad + "\n" + json.dumps(record()) + "\n")
        with pytest.raises(ValueError, match=why):
            records.strict_records(records.read_records(spark, str(path)))
    path.write_text(json.dumps(record()) + "\n" + json.dumps(record(split="holdout")))
    with pytest.raises(ValueError, match="more than one split"):
        records.strict_records(records.read_records(spark, str(path)))


def test_report_text(spark):
    t = spark.createDataFrame([("unit", "a,b", "0.88", "review", "p::x"), ("é", "", "0.10", "accept", "p::yy")], "type string, traits string, conf string, status string, test string")
    assert R.render(t) == "TYPE  TRAITS  CONF  STATUS  TEST\nunit  a,b     0.88  review  p::x\né             0.10  accept  p::yy\n"
    s = spark.createDataFrame([("b_test.go", "boom"), ("a_test.go", "bad syntax")], "path string, reason string")
    assert R.render_skipped(s) == "SKIPPED FILES\n  a_test.go: bad syntax\n  b_test.go: boom\n" and R.render_skipped(s.limit(0)) == ""


def test_cli(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a_test.go").write_text("package p\n\nfunc TestA(t *testing.T) {}\n")
    (tmp_path / "b_test.go").write_text("package p\n\nfunc TestB(t *testing.T) {\n")
    recorded = tmp_path / "answers.json"
    lines = [{"test_id": "a_test.go::TestA", "response": "old"}, {"test_id": "a_test.go::TestA", "response": json.dumps(answer())}]
    recorded.write_text("\n".join(map(json.dumps, lines)) + "\n")
    out, err = io.StringIO(), io.StringIO()
    assert cli.classify(spark, [str(tmp_path)], str(recorded), limits=(0.5, 0.2), out=out, err=err) == 1
    assert out.getvalue().split("\n")[1].split() == ["unit", ",".join(sorted(X.ASKED)), "0.90", "accept", "a_test.go::TestA"] and "b_test.go: parse" in err.getvalue()
    for argv in (
        ["classify", "--recorded", "x", "--min-confidence", "0.5"], ["classify", "--recorded", "x", "--min-confidence", "2", "--min-margin", "0.5"], ["nothing"], ["classify"], ["classify", "--recorded", "x", "--remote"],
        ["classify", "--recorded", "x", "--concurrency", "0"], ["classify", "--recorded", "x", "--timeout", "0s"], ["classify", "--recorded", "x", "--format", "json"], ["classify", "--remote"], ["evaluate"],
    ):
        assert cli.main(argv) == 2, argv
    a = cli.parsed(["classify", "p", "--include", "x", "q", "--recorded", "f", "r", "--timeout", "1m30s"])
    assert (a.paths, a.include, a.recorded, a.timeout) == (["p", "q", "r"], ["x"], "f", 90.0)
    monkeypatch.setenv(cli.KEY_VARIABLE, "k")
    monkeypatch.setenv(cli.URL_VARIABLE, "http://127.0.0.1:9")
    assert cli.main(["classify", "--remote", "--model", "m-latest"]) == 2


def test_cli_skipped_files_and_no_tests(spark, tmp_path):
    (tmp_path / "answers.json").write_text("")
    (tmp_path / "none").mkdir()
    run = lambda p, out, err: cli.classify(spark, [str(p)], str(tmp_path / "answers.json"), out=out, err=err)
    out, err = io.StringIO(), io.StringIO()
    assert run(tmp_path / "none", out, err) == 0 and err.getvalue() == "no tests found\n" and out.getvalue().split() == ["TYPE", "TRAITS", "CONF", "STATUS", "TEST"]
    (tmp_path / "none/a_test.go").write_text("package p\nx := := 1\n")
    out, err = io.StringIO(), io.StringIO()
    assert run(tmp_path / "none", out, err) == 1 and err.getvalue().startswith("SKIPPED FILES\n  a_test.go: parse a_test.go: expected declaration")
    (tmp_path / "none/b_test.go").write_text("package p\nfunc TestB(t *testing.T) {}\n")
    out, err = io.StringIO(), io.StringIO()
    assert run(tmp_path / "none", out, err) == 1 and "b_test.go::TestB: " in err.getvalue() and "SKIPPED FILES" in err.getvalue() and out.getvalue() == ""


class Always(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        assert set(body) == {"model", "state", "questions"} and len(body["questions"]) == 1 + len(X.ASKED)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer()).encode())

    def log_message(self, *_):
        pass


def test_cli_asks_a_service(spark, tmp_path):
    (tmp_path / "a_test.go").write_text("package p\n\nfunc TestA(t *testing.T) {}\n")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Always)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out, err = io.StringIO(), io.StringIO()
    assert cli.classify(spark, [str(tmp_path)], provider=A.HttpProvider(f"http://127.0.0.1:{server.server_port}", "k", "m-1"), out=out, err=err) == 0
    server.shutdown()
    assert err.getvalue() == cli.NOTICE + "\n" and "a_test.go::TestA" in out.getvalue()


def test_question_set():
    q = json.loads(questions.questions_json())
    assert list(q) == ["primary_type", *(f"trait_{t}" for t in X.ASKED)] and set(q["primary_type"]["criteria"]) == set(X.PRIMARY)
    assert {x["type"] for k, x in q.items() if k != "primary_type"} == {"noul"} and all(set(x["criteria"]) == {"true", "false"} for k, x in q.items() if k != "primary_type")
    assert list(questions.question_set(("database", "odd"))) == ["primary_type", "trait_database"]


def test_error_text():
    for body, want in [(b'{"error": {"message": "slow down"}}', "slow down"), (b'{"error": "no", "message": "yes"}', "no"), (b'{"error": 3, "message": "yes"}', "yes"), (b" plain ", "plain"), (b"x" * 500, "x" * 200), (b"", ""), ("\u00e9".encode() * 150, "\u00e9" * 100)]:
        assert A.error_text(body) == want


def test_stored_answers(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases.RESPONSES)], "seq long, response string")
    got = {r.seq: r.response_error for r in A.decoded(df).withColumn("response_error", A.response_error()).collect()}
    assert [got[i] for i in range(len(cases.RESPONSES))] == [e for _, e in cases.RESPONSES]


def test_cli_reports_every_faulty_answer(spark, tmp_path):
    (tmp_path / "a_test.go").write_text("package p\n" + "".join(f"\nfunc Test{25 - i:02}(t *testing.T) {{}}\n" for i in range(25)))
    (tmp_path / "answers.json").write_text("".join(json.dumps({"test_id": f"a_test.go::Test{i:02}", "response": "no"}) + "\n" for i in range(26)))
    out, err = io.StringIO(), io.StringIO()
    assert cli.classify(spark, [str(tmp_path)], str(tmp_path / "answers.json"), out=out, err=err) == 1
    assert [x.split(":: ")[0].split(": ")[0] for x in err.getvalue().splitlines()] == [f"a_test.go::Test{i:02}" for i in range(25, 0, -1)]  # in the order of the file


def test_stream(spark, tmp_path):
    from attestry.streaming.responses import response_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"seq": 1, "response": json.dumps(answer())}) + "\n" + json.dumps({"seq": 2, "response": "{"}) + "\n")
    q = response_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.seq: r.response_error for r in spark.table("answers").collect()} == {1: None, 2: "invalid JSON"}


@pytest.mark.parametrize("name", ["agg_2_class_metrics", "agg_4_trait_metrics", "agg_5_slices", "agg_8_kappa", "prj_8_merged_features", "src_4_set_1_candidates"])
def test_partitions_do_not_matter(spark, sf, name, monkeypatch):
    of = lambda df: values(df.columns, df.collect())
    want = of(catalog.queries()[name](spark, sf))
    for n in (1, 3):
        monkeypatch.setattr("attestry.plans.catalog.table", lambda s, d, t, n=n: s.read.parquet(f"{d}/{t}.parquet").repartition(n))
        assert of(catalog.queries()[name](spark, sf)) == want
