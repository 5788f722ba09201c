"""Small inputs that the generated tables don't have: paths, URLs, sources, queries and source code."""

from __future__ import annotations

PATHS = [
    "main.go", "pkg/a_test.go", "node_modules/x/index.js", "src/vendor/lib.c", "docs/guide.md", "api/v1.pb.go", "web/app.min.js", "web/app.js.map",
    "Makefile", "build", "Dockerfile", "a/b/CMakeLists.txt", "yarn.lock", "x/Cargo.lock", "lib/FooTest.java", "lib/FooTests.kt", "spec/user_spec.rb",
    "gen/x.rs", "a/third_party/y.py", "README.rst", "noext", "a.b/c", ".venv/lib/z.py", "src/__generated__/q.ts", "m_pb2.py", "m.g.dart", "t/test_a.py",
    "examples/deps/one.TS", "weird.MIN.css", "é/ñ.PY", "data.json", "q.sql", "deep/a/b/c/d/e.hs", "e2e/x.spec.tsx", "a/.git/config", "trailing/",
]
GLOBS = ["en/*", "*.html", "**/*_test.go", "docs", "?akefile", "[a-m]*", "en/[0-9][0-9]", "a/**/b*", "src\\vendor"]
URLS = [
    "https://github.com/Owner/Repo.git", "git@github.com:Owner/Repo.git", "http://gitlab.com/a/b/", "owner/repo", " HTTPS://X.y/Z ",
    "ssh://git@host:22/a/b", "a:b:c", "",
]
SOURCES = [
    "Owner/Repo", "owner/repo@v1.2", "github.com/a/b", "https://github.com/a/b/tree/main/x", "git@github.com:a/b.git", "git@github.com:a/b@dev",
    "https://gitlab.com/g/s/r.git/", "bitbucket.org/x/y@t", "not a source", "single", "ssh://git@host/a/b", "http://h/x",
]
TARGETS = ["repo:a/b.go:10-20", "repo:a/b.go:7", "repo/a/b.go", "references/repo/a.py:3", "repo\\a\\b.c:1-2", "repo:", "nothing", "r:/x/:y:4", " r:p "]
QUERIES = [
    "parseConfig", "a.b.c", "Foo::bar", "x->y", "A#b", '"exact words"', '"', "how does it retry", "foo.*bar", "func (", "two words", "^x$ [a-z]+",
    "one two three *", "", "  spaced  ", "a-b",
]
HEADERS = ["// Code generated by x\n", "# DO NOT EDIT", "plain", "x" * 601 + "@generated", "/* Autogenerated */", "AUTOGENERATED"]

SOURCES_BY_LANGUAGE = [
    ("go", 'package q\n\n// Limit holds a bound.\ntype Limit struct {\n\tn int // "{"\n}\n\nconst one = 1\n\n// Up raises it.\n// By one.\nfunc (l *Limit) Up() {\n\tl.n++\n\tprintln("}")\n}\n'),
    ("python", "import os\n\n@wrap\ndef outer(a,\n          b):  # note\n    def inner():\n        return a\n\n    return inner\n\nclass Box:\n    def get(self):\n        return 1\n"),
    ("javascript", "const f = async (x) => {\n  if (x) {\n    return `{`\n  }\n}\nexports.run = function run() {\n  return f(1)\n}\nclass A {\n  go(n) {\n    return n\n  }\n}\n"),
    ("rust", "impl<'a> Scan<'a> {\n    pub fn next(&'a self) -> u8 {\n        b'{'\n    }\n}\nfn tail() {}\n"),
    ("ruby", "module M\n  def a(x)\n    x\n  end\n\n  def b = 1\nend\n"),
    ("lua", "local function add(a, b)\n  return a + b\nend\nM.f = function() return 1 end\n"),
    ("c", "#define N 3\nstruct s {\n  int a;\n};\nint main(int argc, char **argv) {\n  return 0;\n}\nint later(void);\n"),
    ("java", "public class A {\n  private final int n;\n  public int get() {\n    return n;\n  }\n}\n"),
    ("kotlin", "class A {\n    fun go(x: Int): Int {\n        return x\n    }\n}\n"),
    ("sql", "create table t (\n  a int\n);\nselect 1;\n"),
    ("markdown", "# One\ntext\n```\n# no heading\n```\n## Two\nmore\n"),
    ("shell", "run() {\n  echo hi\n}\nfunction stop {\n  exit 1\n}\n"),
    ("elixir", "defmodule A do\n  def one(x) do\n    x\n  end\n\n  def two(x), do: x\nend\n"),
    ("proto", "message M {\n  string a = 1;\n}\nservice S {\n  rpc Get(M) returns (M);\n}\n"),
    ("text", "a\nb\nc\n"),
]

# What the files above hold, line by line from their texts: path, kind of row, first and last line, name, kind.
DEFINITIONS = """
go/0 chunk 3 6 Limit type
go/0 chunk 10 15 Up method
go/0 symbol 4 6 Limit type
go/0 symbol 8 8 one var
go/0 symbol 12 15 Up method
python/1 chunk 3 9 outer func
python/1 chunk 11 13 Box class
python/1 symbol 4 9 outer func
python/1 symbol 6 7 inner method
python/1 symbol 11 13 Box class
python/1 symbol 12 13 get method
javascript/2 chunk 1 5 f func
javascript/2 chunk 6 8 run method
javascript/2 chunk 9 13 A class
javascript/2 symbol 1 5 f func
javascript/2 symbol 6 8 run method
javascript/2 symbol 9 13 A class
javascript/2 symbol 10 12 go method
rust/3 chunk 1 6 Scan impl
rust/3 symbol 1 6 Scan impl
rust/3 symbol 2 5 next func
rust/3 symbol 6 6 tail func
ruby/4 chunk 1 7 M class
ruby/4 symbol 1 7 M class
ruby/4 symbol 2 4 a func
ruby/4 symbol 6 6 b func
lua/5 chunk 1 3 add func
lua/5 symbol 1 3 add func
lua/5 symbol 4 4 M.f func
c/6 chunk 1 4 N macro
c/6 chunk 5 7 main func
c/6 symbol 1 4 N macro
c/6 symbol 2 4 s type
c/6 symbol 5 7 main func
java/7 chunk 1 6 A class
java/7 symbol 1 6 A class
java/7 symbol 3 5 get method
kotlin/8 chunk 1 5 A class
kotlin/8 symbol 1 5 A class
kotlin/8 symbol 2 4 go func
sql/9 chunk 1 4 - block
sql/9 symbol 1 1 t type
markdown/10 chunk 1 5 One section
markdown/10 chunk 6 7 - block
markdown/10 symbol 1 5 One section
markdown/10 symbol 6 7 Two section
shell/11 chunk 1 3 run func
shell/11 chunk 4 6 stop func
shell/11 symbol 1 3 run func
shell/11 symbol 4 6 stop func
elixir/12 chunk 1 7 A module
elixir/12 symbol 1 7 A module
elixir/12 symbol 2 4 one func
elixir/12 symbol 6 6 two func
proto/13 chunk 1 3 M type
proto/13 chunk 4 6 S type
proto/13 symbol 1 3 M type
proto/13 symbol 4 6 S type
proto/13 symbol 5 5 Get func
text/14 chunk 1 3 - block
"""
