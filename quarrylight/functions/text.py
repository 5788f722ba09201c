"""Terms of code and of queries, as column expressions and for single strings."""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ABBREVIATIONS, ENDINGS, PARTICLES, STOPWORDS

IDENTIFIER = r"[\p{L}\p{Nd}_$]+"
#: Places within an identifier where a part begins.
_BOUNDARY = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: What the index tokenises in a query's terms: letters and numbers.
TOKEN = r"[\p{L}\p{N}]+"


# ---- columns ----


def identifiers(text: Column) -> Column:
    """Runs of letters, digits, ``_`` and ``$``."""
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1)


def parts(token: Column) -> Column:
    """The lower-cased pieces of an identifier between ``_``, ``$`` and changes of case."""
    pieces = F.split(F.regexp_replace(token, _BOUNDARY, "_"), "[_$]+")
    return F.transform(F.filter(pieces, lambda p: p != ""), F.lower)


def _plain(token: Column) -> Column:
    """Whether a token surely has one part: no capital behind its first letter, no ``_`` and no ``$``.

    Nearly all words of prose pass this test, which is far cheaper than the patterns of ``parts``.
    """
    rest = F.substring(token, 2, 1 << 30)
    return (F.lower(rest) == rest) & ~F.contains(token, F.lit("_")) & ~F.contains(token, F.lit("$"))


def _several(token: Column) -> Column:
    """The parts of a token that has more than one, but those of one byte."""
    own = F.array_compact(F.transform(F.array(parts(token)), lambda p: F.when(F.size(p) > 1, F.filter(p, lambda x: F.octet_length(x) > 1))))
    return F.flatten(own)


def expand(text: Column) -> Column:
    """An array of what is indexed: each identifier in lower case, and its parts if there are several."""
    one = lambda t: F.when(_plain(t), F.array(F.lower(t))).otherwise(F.concat(F.array(F.lower(t)), _several(t)))
    return F.flatten(F.transform(identifiers(text), one))


def index_tokens(text: Column) -> Column:
    """The tokens of a column of the index, in order; ``_`` and ``$`` separate here."""
    cut = lambda x: F.filter(F.split(x, "[_$]+"), lambda w: w != "")
    one = lambda t: F.when(_plain(t), F.array(F.lower(t))).otherwise(F.concat(cut(F.lower(t)), _several(t)))
    return F.flatten(F.transform(identifiers(text), one))


def words(question: Column) -> Column:
    """The distinct words of a question in lower case, without stop words and single letters."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"([\p{L}\p{N}]+)"), 1))
    stop = F.array(*map(F.lit, sorted(STOPWORDS)))
    return F.filter(own, lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, w))


def stem_light(word: Column) -> Column:
    """One common English ending less, enough to join compounds."""
    out = word
    for ending in reversed(ENDINGS):
        base = F.substring(word, F.lit(1), F.length(word) - len(ending))
        if ending == "ed":
            doubled = (F.length(base) > 2) & (F.substring(base, -1, 1) == F.substring(base, -2, 1))
            base = F.when(doubled, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
        out = F.when((F.octet_length(word) > len(ending) + 2) & word.endswith(ending), base).otherwise(out)
    return out


# ---- single strings, for queries ----


def split_identifiers(text: str) -> list[str]:
    return regex.findall(IDENTIFIER, text)


def split_parts(token: str) -> list[str]:
    return [p.lower() for p in regex.split(r"[_$]+", regex.sub(_BOUNDARY, "_", token)) if p]


def expand_text(text: str) -> list[str]:
    out = []
    for token in split_identifiers(text):
        own = split_parts(token)
        out += [token.lower(), *(p for p in own if len(own) > 1 and len(p.encode()) > 1)]
    return out


def light_stem(word: str) -> str:
    ending = next((e for e in ENDINGS if word.endswith(e) and len(word.encode()) > len(e) + 2), "")
    base = word.removesuffix(ending) if ending else word
    return base[:-1] if ending == "ed" and len(base) > 2 and base[-1] == base[-2] else base


@cache
def abbreviations() -> dict[str, list[str]]:
    """Short forms of long words and long words of short forms; stems of either lead there too."""
    table: dict[str, list[str]] = {}
    for entry in ABBREVIATIONS.split():
        long, _, shorts = entry.partition(":")
        for short in shorts.split(","):
            table.setdefault(long, []).append(short)
            table.setdefault(short, []).append(long)
    stems: dict[str, list[str]] = {}
    for word in sorted(table):
        if (s := light_stem(word)) != word:
            stems.setdefault(s, []).extend(table[word])
    return {w: table.get(w, []) + stems.get(w, []) for w in table.keys() | stems.keys()}


def query_terms(query: str) -> list[str]:
    """Search terms of a query, in order: words and their parts, abbreviations, compounds of two words."""
    tokens = split_identifiers(query)
    words = [t.lower() for t in tokens]
    own = [split_parts(t) for t in tokens]
    found = [x for word, pieces in zip(words, own) for x in (word, *(pieces if len(pieces) > 1 else ()))]
    table = abbreviations()
    found += [a for w in words if w not in STOPWORDS for a in (*table.get(light_stem(w), ()), *table.get(w, ()))]
    for first, second in zip(words, words[1:]):
        a, b = light_stem(first), light_stem(second)
        if min(len(a.encode()), len(b.encode())) >= 2 and first not in STOPWORDS and (second not in STOPWORDS or second in PARTICLES):
            found.append(a + b)
    return [t for t in dict.fromkeys(found) if len(t.encode()) >= 2 and t not in STOPWORDS]


def match_expression(terms: list[str]) -> str:
    return " OR ".join('"' + t.replace('"', "") + '"' for t in terms)
