"""Definitions of languages without a parser: one source of each, nested and broken code, and the shape of what is extracted."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import answers, fixed, lexer, reprs

SOURCES = {
    "javascript": ("// function no() {}\nclass Box { size() { return '}'; } }\nfunction greet(n) {\n  const t = `a${n}}`;\n  if (n) { return t; }\n}\nconst twice = async (a, b) => {\n  return a * b;\n};\nlet s = 'function hidden() {}';\n", [("Box", "class", 2, 2), ("greet", "function", 3, 6), ("twice", "function", 7, 9)]),
    "typescript": ("export interface Shape { side: string }\ntype Pair = { b: number };\nexport default function area(a: number): void {\n}\nabstract class Base {\n}\n", [("Shape", "interface", 1, 1), ("Pair", "type", 2, 2), ("area", "function", 3, 4), ("Base", "class", 5, 6)]),
    "tsx": ("function View(p: Props) {\n  return <div>{p.name}</div>;\n}\nclass Old {}\n", [("View", "function", 1, 3), ("Old", "class", 4, 4)]),
    "go": ("package x\n// func no() {}\nfunc (s *T) Run(a int) error {\n  if true {\n  }\n}\ntype T struct {\n  a int\n}\ntype I int\n", [("Run", "func", 3, 6), ("T", "type", 7, 9), ("I", "type", 10, 10)]),
    "rust": ('impl<T: X> Foo for Bar<T> {\n  pub fn a(&self) -> i32 { 1 }\n}\nstruct P(i32);\npub(crate) enum E { A, B }\nconst S: &str = r#"fn no() {"#;\ntrait T { fn x(&self); }\n', [("Foo", "impl", 1, 3), ("a", "fn", 2, 2), ("P", "struct", 4, 4), ("E", "enum", 5, 5), ("T", "trait", 7, 7), ("x", "fn", 7, 7)]),
    "java": ("public class Jar extends Pot {\n  private int x = 1;\n  public Jar(int y) { this.x = y; }\n  @Override\n  public List<String> get(int a) throws E {\n    if (a > 1) { return other(a); }\n    return new X();\n  }\n}\ninterface Lid { void close(); }\n", [("Jar", "class", 1, 9), ("Jar", "function", 3, 3), ("get", "function", 4, 8), ("Lid", "interface", 10, 10)]),
    "ruby": ("module M\n  class A < B\n    def x(a)\n      if a\n        1\n      end\n      [1].each do |i|\n      end\n    end\n  end\nend\n# def no\n", [("M", "module", 1, 11), ("A", "class", 2, 10), ("x", "def", 3, 9)]),
    "c": ("#define F(x) { x\nstruct P { int a; };\nstatic int add(int a, int b)\n{\n  if (a) { return b; }\n  return a;\n}\nint main(void) { return add('}', 2); }\n", [("P", "struct", 2, 2), ("add", "function", 3, 7), ("main", "function", 8, 8)]),
    "cpp": ("template <class T>\nclass V : public B {\n public:\n  int f() const { return 1; }\n};\nint V::g(int a) { return a; }\n", [("V", "class", 1, 5), ("f", "function", 4, 4), ("V::g", "function", 6, 6)]),
    "c_sharp": ('namespace N {\n  public class A : B {\n    string s = @"a "" {";\n    public async Task<int> Run(int a) { return 1; }\n  }\n  interface I { }\n}\n', [("A", "class", 2, 5), ("Run", "function", 4, 4), ("I", "interface", 6, 6)]),
    "kotlin": ("data class P(val a: Int)\nfun <T> x(a: T): Int {\n  return 1\n}\nobject O { fun y() = 2 }\n", [("P", "class", 1, 1), ("x", "fun", 2, 4), ("O", "object", 5, 5), ("y", "fun", 5, 5)]),
    "swift": ("protocol P { func a() }\nstruct S: P {\n  func a() {\n  }\n}\nfinal class C {}\n", [("P", "protocol", 1, 1), ("a", "func", 1, 1), ("S", "struct", 2, 5), ("a", "func", 3, 4), ("C", "class", 6, 6)]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_definitions(language):
    code, want = SOURCES[language]
    assert [tuple(s) for s in lexer.spans(code, language)] == want
    # Windows' line ends change nothing, and neither does code that is cut off: what isn't closed reaches to the end.
    assert [s.name for s in lexer.spans(code.replace("\n", "\r\n"), language)] == [w[0] for w in want]
    for cut in range(0, len(code), 7):
        for s in lexer.spans(code[:cut], language):
            assert 1 <= s.line <= s.end_line <= code[:cut].count("\n") + 1


def test_unclosed_code():
    assert lexer.spans("class A {\n  int f() { return 1;\n", "java") == [("A", "class", 1, 2), ("f", "function", 2, 2)]
    assert lexer.spans('const s = "no end\nfunction f() {\n}\n', "javascript") == [("f", "function", 2, 3)]
    assert lexer.spans("def greet(x):\n  pass", "cobol") == []


def test_python_definitions():
    code = "class A:\n    def m(self):\n        pass\n\n\nasync def f():\n    pass\n"
    assert lexer.python_spans(code) == [("A", "class", 1, 3), ("m", "function", 2, 3), ("f", "function", 6, 7)]
    assert lexer.extracted(code, "python", False, 10, 2, 5)["symbols"] == ["class A:\n    def m(self):", "    def m(self):\n        pass", "async def f():\n    pass"]


def test_extracted(spark):
    rows = [(1, "function greet(name) { return `Hello, ${name}`; }\nclass Animal { constructor(n) { this.name = n; } }\n", "javascript", False), (2, "def broken(:", "python", False), (3, "x" * 2000, None, False), (4, "data", "c", True), (5, None, "go", False), (6, "some content", "unheard_of", False)]
    frame = spark.createDataFrame(rows, "id int, content string, language string, binary boolean")
    got = {r["id"]: r["x"] for r in frame.select("id", lexer.extracted_of()("content", "language", "binary").alias("x")).collect()}
    assert [s["name"] for s in got[1]["spans"]] == ["greet", "Animal"] and got[1]["symbols"][1].startswith("class Animal") and got[1]["error"] is None
    assert got[2]["symbols"] == [] and got[2]["error"].startswith("SyntaxError") and got[2]["fallback_excerpt"] == "def broken(:"
    assert got[3]["fallback_excerpt"] == "x" * 1000 and got[3]["spans"] == []
    assert got[4]["fallback_excerpt"] == fixed.BINARY_NOTICE and got[5]["fallback_excerpt"] == "" and got[6]["fallback_excerpt"] == "some content"


# Short texts of values


def test_values_in_short():
    held = []
    held.append(held)
    twice = [1]
    assert reprs.summary_of(held, 160) == "list [...]"
    assert reprs.summary_of([twice, twice], 160) == "list [[1], ...]"
    assert reprs.summary_of({"k": list(range(200))}, 160) == "dict {'k': list(len=200) [0, ...]}"
    assert reprs.summary_of({str(i): i for i in range(60)}, 160) == "dict(len=60) {...}"
    assert reprs.summary_of([[[1]]], 160) == "list [[list(len=1)]]"
    assert reprs.summary_of(("a" * 9,), 5) == "tuple (s..." and reprs.summary_of(7, 5) == "int 7"
    assert reprs.context_of({"a": {1}, "b": (2,)}) == "dict {'a': {1}, 'b': (2,)}"
    assert reprs.context_of({"id": "A", "text": "x" * 5000}).startswith("dict {'id': 'A', 'text': str(len=5000) xxx")


def test_values_as_columns(spark):
    rows = [('{"a": [1, "x", null, true]}',), ("[" + ",".join("1" * 150) + "]",), ("no json",), (None,), ('"text"',)]
    frame = spark.createDataFrame(rows, "v string")
    got = frame.select(reprs.summaries(40)("v").alias("s"), reprs.contexts()("v").alias("c"), reprs.literals()("v").alias("l")).collect()
    assert got[0] == ("dict {'a': [1, 'x', None, True]}", "dict {'a': [1, 'x', None, True]}", "{'a': [1, 'x', None, True]}")
    assert got[1]["s"] == "list(len=150) [1, ...]" and got[1]["c"].startswith("list [1, 1, ")
    assert got[2] == ("str 'no json'", "str 'no json'", "no json") and got[3] == (None, None, None) and got[4]["l"] == "text"


def test_answers_in_wrappings():
    assert answers.checked("> ```py\n>  x = 1\n> y = 2\n> ```")["code"] == "x = 1\ny = 2"
    assert answers.checked("text\n```\na = 1\n```\nmore\n```\nb = 2\n```")["code"] == "a = 1"
    assert answers.checked("```\nx = 1")["kind"] == "invalid_code"
    assert answers.checked("'''\nprint(1)\n'''")["code"] == "print(1)" and answers.checked("'a b'")["code"] == "'a b'"
    assert "'finish' is a reserved helper" in answers.checked("def finish(): pass")["error"]
    assert answers.checked("a > b\n> c")["kind"] == "invalid_code" and answers.checked("```\n```")["error"] == "No Python code remained after normalization."
    assert answers.checked(None)["error"].startswith("Model returned an empty")


def test_prose_is_not_searched_for_headers_before_a_brace(monkeypatch):
    class Never:
        pattern = lexer.FINDERS["java"][-1].pattern

        def search(self, *_):
            raise AssertionError("searched")

    monkeypatch.setitem(lexer.FINDERS, "java", [lexer.FINDERS["java"][0], Never()])
    assert [s.name for s in lexer.spans("some words (and more) of prose\n class Found of it", "java")] == ["Found"]
