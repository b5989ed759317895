"""Front ends: exact rules of complexity, arity and callees, and tolerance of broken text."""

import ast
import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.parse import python_units, rust_units, ts_units, udtf


def cc(parser, source):
    return {f["name"]: f["cc"] for f in parser.parse(source).functions}


PY = {
    "if a and b:\n  pass": 2,
    "if a and b or c:\n  pass": 3,
    "if a and (b and c):\n  pass": 3,
    "if not (a or b) or c:\n  pass": 3,
    "x = lambda q: q and w": 0,
    "x = 1 if a else 2": 1,
    "for i in x:\n  if i:\n    continue\n  else:\n    break": 1 + 2 + 1 + 1 + 1,
    "while a:\n  x = 1 if b else 2": 1 + 2,
    "try:\n  f()\nexcept E:\n  if a:\n    raise\nelse:\n  g()\nfinally:\n  h()": 1 + 2 + 1 + 1,
    "if a:\n  pass\nelif b and c:\n  pass\nelse:\n  pass": 1 + 1 + 1 + 1,
    "match x:\n  case 1:\n    pass\n  case 2 if y:\n    return 3": 1 + 2 + 2,
    "with a and b:\n  if c:\n    pass": 2,
    "def g():\n  if a:\n    pass": 0,
    "return [x for x in y if x and z]": 1,
    "raise E": 0,
    'x = f"{a and b}"': 1,
}


@pytest.mark.parametrize("body,score", PY.items())
def test_python_complexity(body, score):
    source = "def f():\n" + "\n".join("  " + line for line in body.split("\n"))
    assert cc(python_units, source)["f"] == score


TS = {
    "if (a && b || c) {}": 3,
    "if (a) {} else if (b) {} else {}": 1 + 1 + 2 + 1,
    "if (a) b(); else c()": 2,
    "for (const x of y) { while (z) { break } }": 1 + 2 + 1,
    "do { a() } while (b && c)": 2,
    "switch (a) { case 1: if (b) {} break; default: c() }": 1 + 2 + 1,
    "try { a() } catch (e) { throw e } finally { if (b) {} }": 1 + 1 + 1,
    "const v = a ? b && c : d": 1 + 1,
    "xs.map((v) => v && w)": 0,
    "xs.map(function (v) { if (v) {} })": 0,
    "const t = `${a && b}`": 1,
    "const v = a ?? b": 0,
    "return a && (b && c)": 2,
}


@pytest.mark.parametrize("body,score", TS.items())
def test_ts_complexity(body, score):
    assert cc(ts_units, "function f() { " + body + " }")["f"] == score


RS = {
    "if a && b || c { }": 3,
    "for i in x { if i { continue; } else { return; } }": 1 + 2 + 1 + 1 + 1,
    "match x { 1 => {} _ => 2, }": 1 + 2 * (2 + 3),
    "loop { break; }": 2,
    "let f = |q| q && w;": 0,
    "xs.iter().map(|v| { if v { } })": 0,
    'println!("{}", a && b);': 0,
    "return 1;": 0,
    "let y = if a { 1 } else { 2 };": 2,
}


@pytest.mark.parametrize("body,score", RS.items())
def test_rust_complexity(body, score):
    assert cc(rust_units, "fn f() { " + body + " }")["f"] == score


def test_python_relations():
    p = python_units.parse("import a.b, c\nfrom .x import y\nfrom d.e import f\nclass K:\n    def m(self, a, b=1, *c, d: int, **e): return g(1, x=2, *z)(q)\n    def __init__(self, a): h(t for t in u if t)\ndef n(a, /, b, *, c): pass\n")
    assert [i["module"] for i in p.imports] == ["a", "d"]
    assert [(d["name"], d["min_args"], d["max_args"]) for d in p.definitions] == [("m", 3, None), ("__init__", 1, 1), ("n", 3, 3)]
    assert [(c["callee"], c["argc"]) for c in p.calls] == [("g", 3), ("g(1, x=2, *z)", 1), ("h", 3)]
    assert [f["name"] for f in p.functions] == ["K.m", "K.__init__", "n"]
    assert p.functions[0]["callees"] == ["g(1, x=2, *z)", "g"]


def test_byte_columns():
    p = python_units.parse('x = "é"; f("ü")\n')
    assert p.calls[0]["range"] == {"start": {"line": 0, "col": 10}, "end": {"line": 0, "col": 17}}


def test_ts_relations():
    p = ts_units.parse("class A { async m(a, b?: number, ...c: Map<string, number>[]) { x.y(z()) } get v() { return 1 } }\nfunction g(a: Map<string, number>, b = 2) {}\nconst h = async (q) => w(q), k = v => v\nexport default function () { gone() }\nabstract class B { abstract n(): void }\n")
    assert [f["name"] for f in p.functions] == ["A.m", "A.v", "g", "h", "k"]
    assert [(d["name"], d["min_args"], d["max_args"]) for d in p.definitions] == [("g", 1, 2), ("h", 1, 1)]
    assert p.functions[0]["callees"] == ["x.y", "z"]


def test_rust_relations():
    p = rust_units.parse("pub use a::b;\nuse {c, d};\nimpl<T> Tr for Thing<T> where T: X { fn f(&self) -> u8 { self.g(); Self::h::<u8>(1)? } }\ntrait Q { fn s(&self); }\nmod m { fn t() { fn inner() { deep() } u() } }\n")
    assert [i["module"] for i in p.imports] == ["a", "d"]
    assert {f["name"]: f["callees"] for f in p.functions} == {"Thing<T>::f": ["Self::h::<u8>", "self.g"], "Q::s": [], "m::t": ["u"], "m::t::inner": ["deep"]}


def test_python_front_end_agrees_with_ast():
    """On real modules: the same functions with the same last lines, and as many calls of bare names."""
    checked = 0
    for path in sorted(Path(ast.__file__).parent.glob("*.py"))[:40]:
        source = path.read_text(encoding="utf-8", errors="replace")
        if len(source) > 60_000:
            continue
        tree = ast.parse(source)
        want = sorted((n.name, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
        got = sorted((f["name"].split(".")[-1], f["range"]["end"]["line"] + 1) for f in python_units.parse(source).functions)
        assert got == want, path
        checked += len(want)
    assert checked > 300


PIECES = ["def f(", "):", "class A:", "\n", "\n  ", "if x:", "else:", "(", ")", "[", "]", "{", "}", "'", '"', '"""', "`", "${", "f'{", "#", "//", "/*", "lambda", "=>", "fn ", "impl ", "|", "||", "&&", "match ", "case ", "return", "a.b(c)", "é", ";", ",", ":", "=", "<", ">", "!", "?", "use ", "import ", "const x", "function ", "\\"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map(" ".join))
def test_front_ends_take_any_text(source):
    for parser in (python_units, ts_units, rust_units):
        for f in parser.parse(source).functions:
            r = f["range"]
            assert (r["start"]["line"], r["start"]["col"]) <= (r["end"]["line"], r["end"]["col"])


def test_broken_files_keep_what_can_be_read():
    names = [f["name"] for f in python_units.parse("def a(:\n  x(\n\ndef b():\n  y()\n\n@z\ndef c(): pass\n").functions]
    assert "b" in names and "c" in names
    assert [f["name"] for f in ts_units.parse("function a( {\nfunction b() { return 1 }\n").functions][-1:] in (["b"], ["a"], [])


def test_long_lines_and_deep_nesting():
    random.seed(2)
    sys.setrecursionlimit(5000)
    deep = "x = " + "(" * 300 + "1" + ")" * 300
    assert python_units.parse("def f():\n  " + deep).functions[0]["cc"] == 0
    assert python_units.parse("def f():\n  return " + " or ".join(["a"] * 5000)).functions[0]["cc"] == 1


def test_lines_that_read_the_same_are_looked_at_once(monkeypatch):
    seen = []
    looked = python_units.expression
    monkeypatch.setattr(python_units, "expression", lambda items, nesting: seen.append(1) or looked(items, nesting))
    body = "    if a and not b:\n        g(a, b).h(1)\n" * 500
    p = python_units.parse(f"def f(a, b):\n{body}    return a\n;\n  x = (1,\n  # no\n  2) ; y = 'p'\n{body}")
    assert p.functions[0]["cc"] == 1000 and p.functions[0]["callees"] == ["g(a, b).h", "g"]
    assert len(p.calls) == 1000 and p.calls[499]["range"] == {"start": {"line": 1000, "col": 8}, "end": {"line": 1000, "col": 15}}
    assert len(seen) < 50  # before, each line's expressions were walked again


def test_columns_are_those_of_the_rows():
    sources = ["import a\ndef f(x, *y):\n    if x:\n        return g(x)\n", "", "def (", "class K:\n    def m(self): self.n = [1]\n"]
    rows = [{"path": str(k), "language": "python", **python_units.parse(s).__dict__} for k, s in enumerate(sources)]
    schema = udtf._arrow_schema()
    assert udtf._batch(rows, schema).equals(pa.RecordBatch.from_pylist(rows, schema=schema))
    assert udtf._batch([], schema).num_rows == 0
