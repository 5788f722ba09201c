"""What a reader sees of a search: excerpts within a budget, a line about the whole, and what to ask next.

A result has at most as many hits as its limit, so their lines come to the driver and are laid out here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths
from ..sources.corpus import line_array
from .engine import Engine, Result

HEAD, CONCEPT_LINES, MATCH_LINES, SYMBOL_LINES, REACH, WIDTH = 6, 30, 15, 14, 400, 240


@dataclass
class Shown:
    query: str
    mode: str
    note: str
    hits: list[dict]
    truncated: bool = False
    next: str = ""
    repos: int = 0
    cost: float = 0.0


def render(lines: list[str], first: int, last: int, marks: set[int] | frozenset = frozenset()) -> str:
    """Lines by number from 1, right-aligned, with ``>`` before marked ones."""
    width = len(str(last))
    out = ""
    for n in range(max(first, 1), min(last, len(lines)) + 1):
        own = lines[n - 1].rstrip(" \t")
        out += f"{'>' if n in marks else ' '}{n:>{width}}| {own[:WIDTH] + '...' if len(own) > WIDTH else own}\n"
    return out


def concept_excerpt(lines: list[str], first: int, last: int, terms: list[str], most: int = CONCEPT_LINES) -> tuple[str, int]:
    """A chunk's head and its window densest in query terms; and how many lines that leaves out."""
    last = min(last, len(lines))
    if last - first + 1 <= most:
        return render(lines, first, last), 0
    wide = most - HEAD
    density = [sum(t in x.lower() for t in terms) for x in lines[first - 1 : last]]
    starts = range(first + HEAD, min(last - wide + 1, first + REACH + 1) + 1)
    best = max(starts, key=lambda s: (sum(density[s - first : s - first + wide]), -s))
    gap = "     ...\n" if best > first + HEAD else ""
    return render(lines, first, first + HEAD - 1) + gap + render(lines, best, best + wide - 1), last - first + 1 - most


def match_excerpt(lines: list[str], first: int, last: int, matches: list[int], most: int = MATCH_LINES) -> str:
    """Up to three windows of two lines around matches, merged where they touch."""
    islands: list[list[int]] = []
    for m in matches:
        a, b = max(first, m - 2), min(last, m + 2)
        if islands and a <= islands[-1][1] + 1:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    parts, left = [], most
    for a, b in islands[:3]:
        if left <= 0:
            break
        b = min(b, a + left - 1)
        parts.append(render(lines, a, b, set(matches)))
        left -= b - a + 1
    return "     ...\n".join(parts)


def symbol_excerpt(lines: list[str], first: int, last: int, line: int, most: int = SYMBOL_LINES) -> tuple[str, int]:
    """The definition; a long comment above it is left out."""
    start = line - 3 if line - first > 6 else first
    end = min(last, start + most - 1)
    return render(lines, start, end, {line}), max(0, last - end)


def location(h: dict) -> str:
    span = f"{h['start_line']}-{h['end_line']}" if h["end_line"] > h["start_line"] else f"{h['start_line']}"
    return f"{h['repo']}:{h['path']}:{span}"


def present(engine: Engine, query: str, result: Result, budget: int = C.BUDGET) -> Shown:
    tagged = result.hits.join(engine.files.select("repo", "path", paths.tags(F.col("flags")).alias("tags"), line_array(F.col("text")).alias("lines")), ["repo", "path"])
    hits = [r.asDict(recursive=True) for r in tagged.orderBy("place").collect()]
    mode, used, truncated = result.mode.split("->")[-1], 0, False
    for i, h in enumerate(hits):
        lines, span = h.pop("lines"), (h["start_line"], h["end_line"])
        h["omitted"] = 0
        if mode == "concept":
            weak = h.get("weak")
            h["excerpt"], h["omitted"] = ("", 0) if weak else concept_excerpt(lines, *span, result.terms)
        elif mode == "symbol":
            h["excerpt"], h["omitted"] = symbol_excerpt(lines, *span, h["line"])
        else:
            h["excerpt"] = match_excerpt(lines, *span, list(h["match_lines"]))
        size = len(h["excerpt"].encode())
        if i and used + size > budget:
            truncated |= size > 0
            h["excerpt"], h["omitted"] = "", 0
        else:
            used += size
    return Shown(query, result.mode, result.note, hits, truncated, following(query, mode, hits, truncated), len(engine.repos), result.cost)


def following(query: str, mode: str, hits: list[dict], truncated: bool) -> str:
    """One command that leads on."""
    quoted = query.replace('"', '\\"')
    if not hits:
        return f'search "{quoted}" --mode {"exact" if mode == "concept" else "concept"}'
    first = hits[0]
    if first.get("weak"):
        return f'search "{quoted}" --deep'
    if first["omitted"] or not first["excerpt"]:
        return "show " + location(first)
    if truncated:
        return "show " + location(hits[1])
    return f"show {first['repo']}:{first['path']}:{max(1, first['start_line'] - 20)}-{first['end_line'] + 40}"


def plural(n: int, word: str) -> str:
    return f"{n} {word}" + "s" * (n != 1)


def as_text(s: Shown) -> str:
    out = f'# {plural(len(s.hits), "result")} for "{s.query}" | {s.mode} | {plural(s.repos, "repo")}\n'
    for i, h in enumerate(s.hits, 1):
        named = h["symbol"] and (f"  {h['kind']} {h['symbol']}" if h["kind"] not in ("", "block") else f"  in {h['symbol']}")
        judged = f"  p={h['p']:.2f}" + " weak" * bool(h["weak"]) if "p" in h else ""
        out += f"[{i}] {location(h)}{named}{judged}{''.join(f' [{t}]' for t in h['tags'])}\n{h['excerpt']}"
        out += f"     ... +{h['omitted']} lines\n" if h["omitted"] else ""
    out += f"# note: {s.note}\n" if s.note else ""
    out += f"# judged for ${s.cost:.6f}\n" if s.cost else ""
    out += "# output budget reached: later results show location only\n" if s.truncated else ""
    return out + (f"# next: {s.next}\n" if s.next else "")
