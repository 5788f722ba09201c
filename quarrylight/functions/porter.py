"""The Porter stemmer (Porter 1980) as full-text indexes use it, and folding of diacritics.

The rules are applied to UTF-8 bytes, of which all but a, e, i, o, u and some y are consonants.  Words
of fewer than three bytes or more than 64 stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_C, _V = "[^aeiou]", "[aeiouy]"
_CONS, _VOWS = _C + "[^aeiouy]*", _V + "[aeiou]*"
_M0 = re.compile(f"^({_CONS})?{_VOWS}{_CONS}")  # measure above 0
_M1 = re.compile(f"^({_CONS})?{_VOWS}{_CONS}({_VOWS})?$")  # measure 1
_M2 = re.compile(f"^({_CONS})?{_VOWS}{_CONS}{_VOWS}{_CONS}")  # measure above 1
_VOWEL = re.compile(f"^({_CONS})?{_V}")
_CVC = re.compile(f"^{_CONS}{_V}[^aeiouwxy]$")

# Endings of the second, third and fourth step.
_STEP2 = dict(
    x.split(":")
    for x in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate"
        " ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    ).split()
)
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    w = word.encode().decode("latin-1")
    if not 3 <= len(w) <= 64:
        return word
    if w[0] == "y":
        w = "Y" + w[1:]  # at the head it is a consonant
    # plurals
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    elif ending := next((e for e in ("ed", "ing") if w.endswith(e)), None):
        stem = w[: -len(ending)]
        if _VOWEL.match(stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"([^aeioulsz])\1$", w.lower()):
                w = w[:-1]
            elif _M1.match(w) and _CVC.search(w):
                w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (e := _longest(w, table)) and _M0.match(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    if e := _longest(w, _STEP4):
        stem = w[: -len(e)] + ("s" if e == "sion" else "t" if e == "tion" else "")
        if _M2.match(stem):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _M2.match(stem) or (_M1.match(stem) and not _CVC.search(stem)):
            w = stem
    if w.endswith("ll") and _M2.match(w[:-1]):
        w = w[:-1]
    return w.replace("Y", "y").encode("latin-1").decode("utf-8", "ignore")


def fold(word: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
