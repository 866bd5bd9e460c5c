from lodestone.operators import extract as X

PY = '''import os
from a.b import c

class Service(Base):
    """def no(): pass"""
    def run(self):
        helper(1)  # other()
        return self.stop("call(me)")

def helper(x):
    return x

def test_helper():
    helper(2)
'''
GO = 'package p\n\nimport (\n\t"fmt"\n)\n\n// func no() {}\nfunc Run(a int) error {\n\tif a > 0 {\n\t\treturn helper("}")\n\t}\n\treturn nil\n}\n\nfunc helper(s string) error { return nil }\n'


def test_python():
    symbols, edges = X.extract("pkg/mod.py", "python", PY)
    assert [(s[0], s[2], s[4], s[5]) for s in symbols] == [
        ("module", "pkg.mod", 1, 15), ("class", "pkg.mod.Service", 4, 8), ("method", "pkg.mod.Service.run", 6, 8), ("function", "pkg.mod.helper", 10, 11), ("test", "pkg.mod.test_helper", 13, 14),
    ]
    assert ("pkg.mod.Service.run", "calls", "helper", X.LEXICAL) in edges and ("pkg.mod.test_helper", "tests", "helper", X.LEXICAL) in edges
    assert {e[2] for e in edges if e[1] == "imports"} == {"os", "a.b"}
    assert not any(e[2] in ("other", "call") for e in edges)


def test_go():
    symbols, edges = X.extract("p/x.go", "go", GO)
    assert [(s[0], s[1], s[4], s[5]) for s in symbols] == [("module", "x", 1, 16), ("function", "Run", 8, 13), ("function", "helper", 15, 15)]
    assert ("p.x.Run", "calls", "helper", X.LEXICAL) in edges and ("p.x", "imports", "fmt", X.IMPORTED) in edges


def test_odd_input():
    for language in (*X.SYNTAXES, "cobol"):
        for text in ("", "{", "}}}", '"', "/*", "'''", "\0", "class", "def (", "fn x" * 50):
            symbols, _ = X.extract("a/b.c", language, text)
            assert symbols[0][0] == "module" and all(1 <= s[4] <= s[5] for s in symbols)


def test_in_file_resolution(spark):
    files = spark.createDataFrame([("pkg/mod.py", "python", PY), ("p/x.go", "go", GO), ("e.py", "python", None)], "path string, language string, content string")
    rows = X.extractions(files)
    got = {(r["origin"], r["target"]): (r["resolved_to"], r["confidence"]) for r in X.resolve_in_file(rows).filter("kind in ('calls', 'tests')").collect()}
    assert got["p.x.Run", "helper"] == ("p.x.helper", X.IN_FILE) and got["pkg.mod.Service.run", "self.stop"] == (None, X.LEXICAL)
