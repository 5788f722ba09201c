"""Paths, URLs and the other small languages of the catalog."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from ..errors import USER, CorpusError


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folders(path: Column) -> Column:
    """The segments of a path but its last."""
    segments = F.split(path, "/", -1)
    return F.slice(segments, F.lit(1), F.size(segments) - 1)


def extension(name: Column) -> Column:
    """From the last dot on, or empty."""
    return F.regexp_extract(name, r"\.[^.]*$", 0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def language(path: Column) -> Column:
    """The language of a path; empty when the file isn't indexed."""
    base = F.lower(basename(path))
    return F.coalesce(_lookup(C.NAMED)[base], _lookup(C.LANGUAGE_OF)[extension(base)], F.lit(""))


def language_of(path: str) -> str:
    base = path.rsplit("/", 1)[-1].lower()
    return C.NAMED.get(base) or C.LANGUAGE_OF.get(base[base.rfind(".") :] if "." in base else "", "")


def skip_path(path: Column) -> Column:
    base = F.lower(basename(path))
    in_dir = F.arrays_overlap(folders(path), F.array(*map(F.lit, C.SKIPPED_DIRS)))
    return in_dir | base.isin(C.LOCKFILES) | base.contains(".min.") | base.endswith(".map")


def path_flags(path: Column) -> Column:
    """The bitmask of test, vendor, generated and doc."""
    dirs, base = folders(F.lower(path)), F.lower(basename(path))
    name = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    by_name = {
        C.TEST: any_of([base.contains(x) for x in C.TEST_NAMES] + [base.startswith("test_"), name.endswith("Test"), name.endswith("Tests")]),
        C.GENERATED: any_of([base.contains(x) for x in C.GENERATED_NAMES] + [base.endswith(".g.dart")]),
        C.DOC: language(path).isin("markdown", "text"),
    }
    out = F.lit(0)
    for flag, names in C.FLAG_DIRS.items():
        hit = F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
        hit = hit | by_name[flag] if flag in by_name else hit
        out = out.bitwiseOR(F.when(hit, flag).otherwise(0))
    return out


def skip_content(language_: Column, text: Column) -> Column:
    """Too large, empty, binary or dense content."""
    size = F.octet_length(text)
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return (
        (size > C.MAX_BYTES)
        | (size == 0)
        | F.substring(text, 1, C.NUL_BYTES).contains("\u0000")
        | ((language_ == "config") & (size > C.MAX_CONFIG_BYTES))
        | ((size > C.DENSE_BYTES) & (F.floor(size / lines) > C.DENSE_LINE))
    )


def generated_header(text: Column) -> Column:
    head = F.substring(text, 1, C.MARK_BYTES)
    return any_of([head.contains(m) for m in C.GENERATED_MARKS])


def tags(flags: Column) -> Column:
    return F.filter(F.array(*[F.when(flags.bitwiseAND(bit) != 0, name) for name, bit in C.TAGS.items()]), lambda t: t.isNotNull())


def main_tag(flags: Column) -> Column:
    return F.coalesce(*[F.when(flags.bitwiseAND(C.TAGS[n]) != 0, n) for n in ("vendor", "test", "generated", "doc")], F.lit(""))


def penalty(flags: Column, query: str) -> Column:
    """The factor of a hit in tests, vendored, generated code or documentation, unless the query asks for it."""
    lifted = {"test": bool(re.search(C.TEST_WORDS, query)), "doc": bool(re.search(C.DOC_WORDS, query))}
    out = F.lit(1.0)
    for name, factor in C.PENALTY.items():
        if not lifted.get(name):
            out = out * F.when(flags.bitwiseAND(C.TAGS[name]) != 0, factor).otherwise(1.0)
    return out


# ---- globs ----


def glob_pattern(glob: str) -> str:
    """No wildcard: the path contains it.  ``*`` and ``**`` both cross folders."""
    glob = glob.replace("\\", "/")
    return re.sub(r"\*\*+", "*", glob) if re.search(r"[*?\[]", glob) else f"*{glob}*"


def glob_regex(glob: str) -> str:
    """An anchored regex, valid in Spark and elsewhere, for a normalised glob with ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "^" else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob_pattern(glob)))


# ---- URLs, sources, targets, categories ----


def normal_url(url: Column) -> Column:
    u = F.lower(F.trim(url))
    for pattern in ("/$", r"\.git$", "^https://", "^http://", "^git@"):
        u = F.regexp_replace(u, pattern, "")
    return F.regexp_replace(u, "^([^:]*):", "$1/")


def parse_source(source: Column) -> Column:
    """A struct of url, owner, name, ref; null where the source is none."""
    s = F.trim(source)
    at = F.regexp_extract(s, "^(.+)@([^/@]*)$", 1)
    ref = F.when(at != "", F.regexp_extract(s, "^(.+)@([^/@]*)$", 2)).otherwise("")
    s = F.when(at != "", at).otherwise(s)
    tree = r"^(https?://[^/]+/[^/]+/[^/]+)/tree/(.+)$"
    ref = F.when(s.rlike(tree), F.regexp_extract(s, tree, 2)).otherwise(ref)
    s = F.when(s.rlike(tree), F.regexp_extract(s, tree, 1)).otherwise(s)
    url = (
        F.when(s.rlike(r"^[\w.-]+/[\w.-]+$") & ~s.startswith("github.com"), F.concat(F.lit("https://github.com/"), s))
        .when(s.rlike(r"^(github\.com|gitlab\.com|bitbucket\.org)/"), F.concat(F.lit("https://"), s))
        .when(s.rlike("^(https://|http://|git@|ssh://)"), s)
    )
    url = F.regexp_replace(F.regexp_replace(url, "/$", ""), r"\.git$", "")
    fields = F.filter(F.split(url, "[/:]"), lambda p: p != "")
    return F.when(
        url.isNotNull() & (F.size(fields) >= 2),
        F.struct(url.alias("url"), F.lower(F.element_at(fields, -2)).alias("owner"), F.lower(F.element_at(fields, -1)).alias("name"), ref.alias("ref")),
    )


def parse_target(target: Column) -> Column:
    """A struct of repo, path, start, end (0 without lines); null where the target is none."""
    t = F.regexp_replace(F.trim(F.translate(target, "\\", "/")), "^references/", "")
    colon = t.rlike("^[^/:]*:")
    ok = colon | t.contains("/")
    repo = F.when(colon, F.regexp_extract(t, "(?s)^([^/:]*):", 1)).otherwise(F.regexp_extract(t, "(?s)^([^/]*)/", 1))
    rest = F.when(colon, F.regexp_extract(t, "(?s)^[^/:]*:(.*)$", 1)).otherwise(F.regexp_extract(t, "(?s)^[^/]*/(.*)$", 1))
    lines = r"^(.*?):(\d+)(?:-(\d+))?$"
    ranged = rest.rlike(lines)
    start = F.when(ranged, F.regexp_extract(rest, lines, 2).try_cast("int")).otherwise(0)
    last = F.regexp_extract(rest, lines, 3)
    end = F.when(ranged & (last != ""), last.try_cast("int")).otherwise(start)
    path = F.regexp_replace(F.when(ranged, F.regexp_extract(rest, lines, 1)).otherwise(rest), "^/+|/+$", "")
    return F.when(ok, F.struct(repo.alias("repo"), path.alias("path"), start.alias("start"), end.alias("end")))


def categories(text: Column) -> Column:
    """The lower-cased names of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda c: F.lower(F.trim(c))), lambda c: c != "")


def parse_categories(values: list[str]) -> list[str]:
    names = [c.strip().lower() for v in values for c in v.split(",") if c.strip()]
    for n in names:
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", n):
            raise CorpusError(USER, f"invalid category {n!r}", "use lowercase letters, digits and dashes")
    return names


# ---- modes ----

MODES = ("auto", "concept", "symbol", "exact", "regex")
_SYMBOL = r"[A-Za-z_$]\w*(?:(?:\.|::|#|->)[A-Za-z_$]\w*)*"
METACHARACTERS = r"[\\^$\[\]()|*+?{}]"


def detect_mode(query: Column) -> Column:
    """exact, symbol, regex or concept.  Whether a regex compiles is the caller's to check."""
    q = F.trim(query)
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return (
        F.when((F.length(q) >= 2) & q.startswith('"') & q.endswith('"'), "exact")
        .when(q.rlike(r"^[A-Za-z_$]\w*((\.|::|#|->)[A-Za-z_$]\w*)*$"), "symbol")
        .when((words <= 2) & q.rlike(METACHARACTERS), "regex")
        .otherwise("concept")
    )


def mode_of(query: str) -> str:
    q = query.strip()
    if len(q) >= 2 and q[0] == q[-1] == '"':
        return "exact"
    if re.fullmatch(_SYMBOL, q, re.ASCII):
        return "symbol"
    if len(q.split()) <= 2 and re.search(METACHARACTERS, q):
        try:
            re.compile(q)
            return "regex"
        except re.error:
            pass
    return "concept"
