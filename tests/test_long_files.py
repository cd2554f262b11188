"""Long sources are scanned in pieces, with the rows of the whole."""

import pytest

from loomgraph.extract import lexical, project

UNIT = {
    "typescript": "function f@(a, b) {\n  const s = `}\n function x() {`; g@(b, h); /* } */\n  return k => k.m(a);\n} // implements SPEC-@\nclass C@ { run() { this.go(); } }\nexport const z@ = async (a) => { f@(a); }\n",
    "java": "class C@ {\n  void f@() { g@(\"}\"); } // c@\n}\ninterface I@ { int q(); }\n",
    "csharp": "class C@ {\n  int f@() => g@(1);\n  void h() { k('{'); } /* c@ */\n}\nstruct S@ { }\n",
    "go": "func f@() {\n\tg@(x)\n} // c@\ntype T@ struct {\n\ta int\n}\nvar h@ = func() { k() }\n",
    "rust": "fn f@() {\n  g@('}');\n}\nimpl A for B@ {\n  fn r(&self) { self.q() }\n}\nlet c@ = |x| x.y();\n",
    "kotlin": "fun f@() { g@() }\nclass C@ { fun h() = k() }\nval l@ = { m() }\n",
    "cpp": "void f@() { g@(1); }\nclass C@ { int h() { return k(); } };\nint C@::r() { return f@(); }\n",
    "php": "function f@() { g@(1); } # c@\nclass C@ { function h() { $this->k(); } }\n$z = fn($x) => q($x);\n",
    "python": "def f@():\n    g@()\n", "ruby": "def f@\n  g@()\nend\n", "dart": "class C@ { C@(); void h() { k(); } }\nvoid f@() { g@(); }\n",
}


def _rows(language, source):
    return [r for rows in project._file_rows("x", language, source) for r in rows]


@pytest.mark.parametrize("language", UNIT)
@pytest.mark.parametrize("end", ["", "}\n(x\nfunction late() { g() }\n", "class Open { void h() {\n"])
def test_pieces_give_the_rows_of_the_whole(monkeypatch, language, end):
    source = "".join(UNIT[language].replace("@", str(k)) for k in range(30)) + end
    whole = sorted(map(repr, _rows(language, source)))
    monkeypatch.setattr(lexical, "PIECE", 200)
    parts = list(lexical.pieces(source, language))
    assert "".join(t for _, t in parts) == source and all(source.startswith(t, at) for at, t in parts)
    assert (len(parts) > 5) == (language not in ("python", "ruby", "dart"))
    assert sorted(map(repr, _rows(language, source))) == whole


def test_a_failure_in_a_late_piece_leaves_the_failure_alone(monkeypatch):
    source = "".join(UNIT["go"].replace("@", str(k)) for k in range(30))
    monkeypatch.setattr(lexical, "PIECE", 200)
    extract, seen = lexical.extract, []

    def fails(text, language):
        seen.append(text)
        if len(seen) == 3:
            raise ValueError("third")
        return extract(text, language)

    monkeypatch.setattr(lexical, "extract", fails)
    assert [(r[2], r[9]) for r in _rows("go", source)] == [("file", "third")]


def test_few_files_are_scanned_by_all_cores(spark):
    files = spark.createDataFrame([(f"f{k}.ts", "function f() { g(); }") for k in range(40)], "path string, source string").coalesce(1)
    assert project.scan_files(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
