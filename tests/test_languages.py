"""What counts as a definition, a call and a comment in each language, the misses that are kept among them."""

import pytest

from loomgraph.extract.lexical import LANGUAGES, extract
from loomgraph.extract.project import extract_code_graph, extract_project
from loomgraph.sources.files import in_memory


def calls_in(got, name):
    """The calls within the definition of that name."""
    start, end = next((d[2], d[3]) for d in got.definitions if d[1] == name)
    return sorted(c for c, at in got.calls if start < at < end)


CASES = {
    "python": [
        ("def outer():\n    def inner():\n        self.go(cb, key=other)\n    inner()\n", {"outer", "inner"}, set(), {"inner": ["cb", "go"]}),
        ("@deco(1)\nasync def f():\n    return await g()\n", {"f"}, set(), {"f": ["g"]}),
        ("class A(B):\n    h = lambda x: k(x)\n", {"h"}, {"A"}, {"h": ["k", "x"]}),
    ],
    "ruby": [
        ("def title=(v)\n  self.title = v\n  @x.other = v\n  a.b == v\nend\n", {"title="}, set(), {"title=": ["b"]}),
        ("def run\n  helper\n  ok?\n  x.safe?\n  each(&handler)\n  go(:sym)\nend\n", {"run"}, set(), {"run": ["each", "go", "handler", "ok?", "safe?"]}),
        ("module M::N\n  class C\n    def self.make\n      build()\n    end\n    def ==(o)\n      same(o)\n    end\n  end\nend\nf = ->(x) { go(x) }\n", {"make", "==", "f"}, {"N", "C"}, {"make": ["build"], "==": ["o", "same"], "f": ["go", "x"]}),
    ],
    "go": [
        ("var f = func(x int) { g(x) }\nfunc main() {\n\th := func() { k() }\n\ta, b := func() {}, 1\n\tstring(x)\n\tpkg.N(o)\n}\n", {"f", "main", "h"}, set(), {"h": ["k"], "f": ["g", "x"]}),
        ("type S struct { a int }\ntype I interface { M() }\nfunc (s *S) M() { s.N() }\nfunc (t T) M() { o() }\n", {"M"}, {"S", "I"}, {}),
    ],
    "java": [
        ("class A {\n  A(int x) { b(); }\n  Runnable r = () -> c();\n  void m() { list.forEach(this::d); e(A::f, g); new H(); }\n}\nrecord R(int a) {}\n@interface An {}\nenum En { X }\ninterface In { void sig(); }\n", {"A", "r", "m"}, {"A", "R", "An", "En", "In"}, {"r": ["c"], "m": ["d", "e", "f", "forEach"]}),
    ],
    "csharp": [
        ("class C {\n  C(int x) { D(); }\n  void M() { obj.N<T>(); F(name: v, w); P(nameof(S)); int L(int a) { return q(a); } var f = (int b) => G(b); }\n}\ninterface I2 {}\nrecord Rec(int X) {}\nstruct St {}\n", {"C", "M", "L", "f"}, {"C", "I2", "Rec", "St"}, {"L": ["a", "q"], "M": ["F", "G", "P", "a", "b", "q", "w"]}),
    ],
    "kotlin": [
        ("class K { constructor(x: Int) : this()\n companion object Named { fun z() = 1 }\n companion object { fun q() = 2 } }\nobject O { }\nval f = { x: Int -> g(x) }\nfun a() { use(::g); use(x::h); b?.c(); run { d() }; e(named = v); w(v) }\n", {"z", "q", "f", "a"}, {"K", "Named", "O"}, {"a": ["c", "d", "e", "g", "h", "run", "use", "use", "v", "w"]}),
    ],
    "rust": [
        ("impl Foo<T> { fn a(&self) { self.b(); C::d(); e::<u8>(f); g.h::<T>() } }\nimpl Show for Dot { fn s(&self) { t() } }\nimpl T for &Bar { }\nimpl path::Baz { }\nmod m { fn n() {} }\ntrait Q { fn sig(&self) -> i32; }\nenum E { A }\nlet k = |x| l(x);\n", {"a", "s", "n", "sig", "k"}, {"Foo", "Dot", "Q", "E"}, {"a": ["b", "d", "e", "f", "h"], "s": ["t"]}),
    ],
    "cpp": [
        ("struct S { int f(); ~S() { g(); } bool operator==(const S& o) { return h(); } };\nint* S::p(int x) { return q<int>(x); }\nint proto(int);\nauto l = [](int a) { return m(a); };\nnamespace n { void k() { a::b(); c->d(); e.f(); } }\n", {"~S", "p", "l", "k"}, {"S"}, {"~S": ["g"], "p": ["q", "x"], "k": ["b", "d", "f"]}),
    ],
    "php": [
        ("<?php\nclass A { function run() { new Foo(1); $x?->a(); B::c(); \\N\\d(); f($handler, name: $v); g(h(...)); } }\n$k = function($a) use ($b) { i(); };\n$j = fn($a) => l($a);\ninterface I {}\ntrait T {}\n", {"run", "k", "j"}, {"A", "I", "T"}, {"run": ["a", "c", "d", "f", "g", "h", "h", "handler"], "k": ["i"]}),
    ],
    "dart": [
        ("class A { A(this.x); A.named() { y(); }\n A() { z(); }\n int get v => w();\n set v(int q) { r(q); } }\nint get top { return u(); }\nvar f = (x) => g(x);\nvoid m() { int local(int a) => b(a); local(1); o?.p(); h(named: v, c); }\nmixin M { }\nextension E on A { }\n", {"v", "top", "f", "m", "local"}, {"A", "M", "E"}, {"top": ["u"], "m": ["a", "b", "c", "h", "local", "p"]}),
    ],
    "typescript": [
        ("class A { #m() { this.#n(cb); } get x() { return y(); } }\nfunction* gen() { }\nconst f = async <T>(x: T): Promise<T> => { await g(x); };\nconst C = class Named { };\n", {"#m", "x", "gen", "f"}, {"A", "Named"}, {"#m": ["#n", "cb"], "f": ["g", "x"]}),
    ],
    "tsx": [("const A = (p: P) => { return render(p) }\n", {"A"}, set(), {"A": ["p", "render"]})],
    "javascript": [("function a() { o.p?.(); }\nconst b = function () { c() };\nconst d = x => e(x);\n", {"a", "b", "d"}, set(), {"b": ["c"], "d": ["e", "x"]})],
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_capture_rules(language):
    for source, functions, classes, calls in CASES[language]:
        got = extract(source, language)
        assert {d[1] for d in got.definitions if d[0] == "function"} == functions, source
        assert {d[1] for d in got.definitions if d[0] == "class"} == classes, source
        assert not got.errors
        for name, want in calls.items():
            assert calls_in(got, name) == want, (name, source)


COMMENTS = {
    "python": 'x = "# no"\ny = 1 # yes\n"""\n# no\n"""\n', "ruby": 'x = "# no #{y}"\n# yes\n', "php": "<?php\n# yes\n$x = '# no';\n#[Attribute]\n", "rust": '/// yes\nlet x = "// no";\n', "java": '/* yes */ String x = "// no";',
    "dart": "/// yes\nvar x = '// no';", "go": "// yes\nvar x = `// no`\n", "kotlin": 'val x = """// no"""\n// yes\n', "csharp": 'var x = "// no"; // yes', "cpp": "/* yes */ char x = '/';", "typescript": "const x = `// no`; // yes", "tsx": "// yes", "javascript": "/* yes */",
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_comments(language):
    got = [c for c, _ in extract(COMMENTS[language], language).comments]
    assert len(got) == 1 and "yes" in got[0]


def test_a_broken_file_still_tells_its_comments():
    got = extract("def f(:\n    pass  # implements SPEC-1\n", "python")
    assert got.errors and [c for c, _ in got.comments] == ["# implements SPEC-1"]


def test_one_file_by_itself_knows_its_own_names_only(spark):
    files = in_memory(spark, [("a.ts", "function run() { here(); there(); }\nfunction here() { }\n"), ("b.ts", "function there() { }\n")])
    edges = lambda found: {(r["src"], r["dst"]) for r in found["CALLS"].collect()}
    alone, together = extract_code_graph(files), extract_project(files)
    assert edges(alone) == {("a.ts#run", "a.ts#here")} and edges(together) == edges(alone) | {("a.ts#run", "b.ts#there")}
    assert alone["counts"].first()["unresolved"] == 1 and {r["id"] for r in alone["Function"].collect()} == {r["id"] for r in together["Function"].collect()}
