"""Word lists, tables, patterns and numbers that results depend on."""

from __future__ import annotations

# Flags of a file.
TEST, VENDOR, GENERATED, DOC, SKIPPED = 1, 2, 4, 8, 16
TAGS = {"test": TEST, "vendor": VENDOR, "generated": GENERATED, "doc": DOC}

# Long words and the short forms that code uses for them.
ABBREVIATIONS = """
receive:recv message:msg maximum:max minimum:min configuration:config,cfg config:cfg request:req
response:resp,res error:err context:ctx initialize:init initialization:init parameter:param,params argument:arg,args
directory:dir reference:ref temporary:tmp,temp number:num length:len string:str buffer:buf
authentication:auth authorization:auth authenticate:auth connection:conn address:addr source:src
destination:dst,dest database:db allocate:alloc previous:prev current:cur,curr index:idx count:cnt
value:val variable:var library:lib package:pkg environment:env specification:spec command:cmd
sequence:seq execute:exec synchronize:sync synchronous:sync asynchronous:async information:info
iterator:iter iterate:iter document:doc object:obj attribute:attr expression:expr position:pos
character:char integer:int boolean:bool function:fn,func callback:cb certificate:cert
credential:cred,creds password:pwd,passwd transaction:tx,txn manager:mgr millisecond:ms
calculate:calc compare:cmp utility:util,utils statistic:stats administrator:admin
"""

# Words that are no search terms.
STOPWORDS = frozenset(
    """
a an the of to in on at for and or but not no is are was were be been being it its
this that these those there here how what where when which who whom why does do did done can could should would
will shall may might must i me my we our you your they them their he she his her us
with by from into onto about as than then so such via using use used uses
code file files function functions method methods logic implementation implement implemented
find show get gets where's whats thing things some any all way ways work works
""".split()
)
# Second words of compounds in spite of that.
PARTICLES = frozenset("in on out up off down back".split())

# Endings that the light stemmer strips.
ENDINGS = ("ing", "ed", "es", "s")

# Languages by extension and by file name.
EXTENSIONS = {
    "go": ".go", "python": ".py .pyi", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx .mts .cts .vue .svelte",
    "rust": ".rs", "java": ".java .groovy", "kotlin": ".kt .kts", "scala": ".scala", "csharp": ".cs", "dart": ".dart",
    "c": ".c .h .m", "cpp": ".cc .cpp .cxx .hpp .hh .hxx .mm", "swift": ".swift", "ruby": ".rb", "php": ".php", "lua": ".lua",
    "elixir": ".ex .exs", "zig": ".zig", "proto": ".proto", "shell": ".sh .bash .zsh", "powershell": ".ps1 .psm1", "sql": ".sql",
    "haskell": ".hs", "ocaml": ".ml", "clojure": ".clj", "erlang": ".erl", "julia": ".jl", "r": ".r", "markdown": ".md .mdx",
    "text": ".rst .txt .adoc", "config": ".json .yaml .yml .toml .ini .cfg .gradle .xml .tf .nix .graphql .gql",
    "html": ".html", "css": ".css .scss",
}
LANGUAGE_OF = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts.split()}
NAMED = {
    "makefile": "config", "dockerfile": "config", "cmakelists.txt": "config", "justfile": "config",
    "gemfile": "ruby", "rakefile": "ruby", "build": "config", "workspace": "config",
}

# Paths that aren't indexed.
SKIPPED_DIRS = "node_modules bower_components __pycache__ .venv venv .tox .mypy_cache .next .nuxt .git .yarn".split()
LOCKFILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml cargo.lock go.sum poetry.lock composer.lock gemfile.lock pipfile.lock bun.lockb uv.lock".split()
)

# Directory names and parts of file names that flag a path.
FLAG_DIRS = {
    VENDOR: "vendor third_party third-party thirdparty external extern deps".split(),
    TEST: "test tests __tests__ testdata testing spec specs e2e fixtures __mocks__ mocks benchmarks".split(),
    DOC: "docs doc documentation examples example".split(),
    GENERATED: "generated gen __generated__".split(),
}
TEST_NAMES = ("_test.", ".test.", ".spec.", "_spec.")
GENERATED_NAMES = (".pb.", "_pb2", ".generated.", ".gen.", "_generated.")
GENERATED_MARKS = ("Code generated", "DO NOT EDIT", "@generated", "auto-generated", "autogenerated", "Autogenerated")
# Bytes that are looked at for those marks, and limits of what is indexed.
MARK_BYTES, MAX_BYTES, MAX_CONFIG_BYTES, NUL_BYTES, DENSE_BYTES, DENSE_LINE = 600, 1 << 20, 256 << 10, 8000, 2000, 250

# Words of a query that lift the penalty of tests and of documentation.
TEST_WORDS = r"(?i)\b(test|tests|testing|spec|mock|fixture)"
DOC_WORDS = r"(?i)\b(doc|docs|readme|guide|example|examples|usage|tutorial)"
PENALTY = {"test": 0.5, "vendor": 0.4, "generated": 0.4, "doc": 0.75}
KIND_FACTOR = {"block": 0.9} | dict.fromkeys("func method class type impl module".split(), 1.1)
MATCH_SCORE = (1.0, 0.9, 0.6, 0.3)

# BM25 and the weights of symbol, path and body.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"symbol": 4.0, "path": 2.0, "body": 1.0}

# Lengths of windows, chunks and lists.
WINDOW, MAX_CHUNK, MIN_DEF, COMMENT_LINES, LONG_LINE = 80, 150, 3, 30, 400
TRIVIAL = ("", "}", "};", ")", "end", "]", "})", "});")
SHORTLIST, SYMBOL_LIST, PER_FILE, MATCHES_PER_FILE, MATCHES = 150, 200, 3, 50, 5000
CONCEPT_LIMIT, SYMBOL_LIMIT, GREP_LIMIT = 8, 10, 10
BLEND, RELEVANT, MENTIONED, WEAK_SHOWN = 0.4, 0.5, 0.3, 3
JUDGED, JUDGED_DEEP, JUDGE_BATCH, BUDGET = 30, 60, 30, 8000
