"""The SQL that each query must agree with, for DuckDB."""

from __future__ import annotations

from ..functions import constants as C
from ..functions import paths
from ..functions import text as terms_of
from ..functions.text import abbreviations
from . import made_sources as made
from . import samples
from .queries import AUTO, EITHER, EXACT, REGEX, SHORT, SYMBOL, TILE


def q(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list) -> str:
    return ", ".join("(" + ", ".join(q(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def strings(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def any_contains(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


LF = "chr(10)"
HEAD = f"substring(text, 1, {C.MARK_BYTES})"
FILES = f"""files AS (
  SELECT source AS repo, lang || '/doc_' || doc_id || '.txt' AS path, lang, md5(text) AS blob, octet_length(encode(text))::INT AS size,
         CASE WHEN {any_contains(HEAD, C.GENERATED_MARKS)} THEN {C.DOC | C.GENERATED} ELSE {C.DOC} END AS flags, text
  FROM documents
)"""


def line_list(x: str) -> str:
    l0 = f"string_split(replace({x}, chr(13) || {LF}, {LF}), {LF})"
    return f"(CASE WHEN ({l0})[-1] = '' THEN ({l0})[1:len({l0}) - 1] ELSE {l0} END)"


LINE_LISTS = f"line_lists AS (SELECT repo, path, {line_list('text')} AS ls FROM files)"
LINES = "lines AS (SELECT repo, path, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS text FROM line_lists)"


def chunks(tile: int = TILE) -> str:
    trivial = ", ".join(map(q, C.TRIVIAL))
    return f"""chunks AS (
  SELECT repo, path, min(line) AS start_line, max(line) AS end_line, '' AS symbol, 'block' AS kind, string_agg(text, {LF} ORDER BY line) AS body
  FROM lines GROUP BY repo, path, (line - 1) // {tile}
  HAVING count(*) FILTER (trim(text, ' ' || chr(9) || chr(13)) NOT IN ({trivial})) >= 2
)"""


BASE = f"WITH {FILES}, {LINE_LISTS}, {LINES}, {chunks()}"
IDENT = r"[\p{L}\p{Nd}_$]+"


def parts(t: str) -> str:
    marked = rf"regexp_replace(regexp_replace({t}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g')"
    return f"list_transform(list_filter(string_split_regex({marked}, '[_$]+'), lambda p: p <> ''), lambda p: lower(p))"


def expand(x: str) -> str:
    more = f"CASE WHEN len({parts('t')}) > 1 THEN list_filter({parts('t')}, lambda p: octet_length(encode(p)) > 1) ELSE [] END"
    return f"flatten(list_transform(regexp_extract_all({x}, '{IDENT}'), lambda t: list_concat([lower(t)], {more})))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(array_to_string({expand(x)}, ' '), '[\p{{L}}\p{{N}}]+')"


DOCS = f"""docs AS (SELECT repo, path, start_line, {tokens('path')} AS tp, {tokens('body')} AS tb FROM chunks),
stats AS (SELECT count(*) AS n_docs, coalesce(sum(len(tp) + len(tb)), 0)::BIGINT AS n_tokens FROM docs),
occ AS (
  SELECT repo, path, start_line, len(tp) + len(tb) AS dl, unnest(tp) AS term, {C.WEIGHTS['path']} AS w FROM docs
  UNION ALL SELECT repo, path, start_line, len(tp) + len(tb), unnest(tb), {C.WEIGHTS['body']} FROM docs
)"""
ASKED = rf"""queries AS (
  SELECT item_id, trim(regexp_extract(text, '^([^.\n]*)', 1)) AS q FROM benchmark WHERE trim(regexp_extract(text, '^([^.\n]*)', 1)) <> ''
),
asked AS (
  SELECT * FROM (
    SELECT item_id AS query, q,
           list_filter(list_distinct(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+')),
                       lambda w: octet_length(encode(w)) >= 2 AND NOT list_contains({strings(sorted(C.STOPWORDS))}, w)) AS terms
    FROM queries
  ) WHERE len(terms) > 0
)"""
BM25 = f"""terms AS (SELECT query, unnest(terms) AS term FROM asked),
per AS (
  SELECT term, repo, path, start_line, sum(w) AS f, any_value(dl) AS dl FROM occ WHERE term IN (SELECT term FROM terms) GROUP BY ALL
),
idf AS (
  SELECT term, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE {C.LEAST_IDF} END AS idf
  FROM (SELECT term, count(*) AS n FROM per GROUP BY term), stats
),
bm AS (
  SELECT query, repo, path, start_line,
         sum(idf * f * ({C.K1} + 1) / (f + {C.K1} * (1 - {C.B} + {C.B} * dl / (n_tokens::DOUBLE / n_docs))))::DOUBLE AS bm25
  FROM per JOIN idf USING (term) JOIN terms USING (term), stats GROUP BY query, repo, path, start_line
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(bm25, 9) DESC, repo, path, start_line) AS rank FROM bm
)"""
CONCEPT = f"{BASE}, {DOCS}, {ASKED}, {BM25}"
#: The same with the question's pairs of neighbouring words as further terms.
PAIRS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
PHRASES = rf"""asked_pairs AS (
  SELECT DISTINCT query, w[i] || ' ' || w[i + 1] AS term FROM (
    SELECT query, terms, w, unnest(range(1, len(w))) AS i FROM (SELECT *, regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+') AS w FROM asked)
  ) WHERE list_contains(terms, w[i]) AND list_contains(terms, w[i + 1])
),
occ_all AS (
  SELECT repo, path, start_line, dl, term, w FROM occ
  UNION ALL SELECT repo, path, start_line, len(tp) + len(tb), unnest({PAIRS.format('tp')}), {C.WEIGHTS['path']} FROM docs
  UNION ALL SELECT repo, path, start_line, len(tp) + len(tb), unnest({PAIRS.format('tb')}), {C.WEIGHTS['body']} FROM docs
),
{BM25.replace("terms AS (SELECT query, unnest(terms) AS term FROM asked)", "terms AS (SELECT query, unnest(terms) AS term FROM asked UNION ALL FROM asked_pairs)").replace("FROM occ", "FROM occ_all")}"""
PENALTY = f"(CASE WHEN flags & {C.GENERATED} <> 0 THEN {C.PENALTY['generated']} ELSE 1 END * CASE WHEN flags & {C.DOC} <> 0 THEN {C.PENALTY['doc']} ELSE 1 END)"


def scored(mention: str = "1.0") -> str:
    return f"""{CONCEPT},
scored AS (
  SELECT r.query, r.repo, r.path, r.start_line, flags, bm25,
         bm25 / max(bm25) OVER (PARTITION BY r.query)
         * (1 + 0.25 * len(list_filter(terms, lambda t: contains(lower(r.path), t))) / len(terms)) * 0.9 * {PENALTY} * {mention} AS score
  FROM ranked r JOIN asked a ON a.query = r.query JOIN files f ON f.repo = r.repo AND f.path = r.path WHERE rank <= {C.SHORTLIST}
)"""


CAPPED = f"""{scored()},
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, repo, path ORDER BY round(score, 9) DESC, start_line) AS in_file FROM scored)
  WHERE in_file <= {C.PER_FILE}
),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, repo, path, start_line) AS place FROM capped)"""

BASENAME = "split_part(path, '/', -1)"
FOLDERS = "string_split(lower(path), '/')[:-2]"
LANGUAGE = f"""coalesce((SELECT lang FROM (VALUES {values(list(C.NAMED.items()))}) AS v(name, lang) WHERE name = lower({BASENAME})),
  (SELECT lang FROM (VALUES {values(list(C.LANGUAGE_OF.items()))}) AS v(ext, lang) WHERE ext = regexp_extract(lower({BASENAME}), '\\.[^.]*$', 0)), '')"""
ALL_PATHS = f"""all_paths AS (
  SELECT substr(u, strpos(u || '/', '/') + 1) AS path FROM (SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS u FROM pages)
  UNION SELECT * FROM (VALUES {values(samples.PATHS)})
)"""
STEM = f"regexp_replace({BASENAME}, '\\.[^.]*$', '')"


def flagged(bit: int, names: str = "false") -> str:
    return f"CASE WHEN list_has_any({FOLDERS}, {strings(C.FLAG_DIRS[bit])}) OR {names} THEN {bit} ELSE 0 END"


LOWER_NAME = f"lower({BASENAME})"
FLAGS = " | ".join(
    [
        flagged(C.VENDOR),
        flagged(C.TEST, f"({any_contains(LOWER_NAME, C.TEST_NAMES)} OR starts_with({LOWER_NAME}, 'test_') OR ends_with({STEM}, 'Test') OR ends_with({STEM}, 'Tests'))"),
        flagged(C.DOC, "lang IN ('markdown', 'text')"),
        flagged(C.GENERATED, f"({any_contains(LOWER_NAME, C.GENERATED_NAMES)} OR ends_with({LOWER_NAME}, '.g.dart'))"),
    ]
)
SYMBOLS = rf"""symbols AS (
  SELECT * FROM (SELECT repo, path, regexp_extract(text, '(?:^|[^\p{{L}}\p{{Nd}}_])(\p{{Lu}}[\p{{L}}\p{{Nd}}_]*)', 1) AS name, line FROM lines) WHERE name <> ''
)"""


def listed(symbol: str) -> str:
    return f"""{BASE}, {SYMBOLS},
listed AS (
  SELECT *, row_number() OVER (ORDER BY match, (flags & 7 <> 0)::INT, octet_length(encode(name)), repo, path, line, name) AS list_place
  FROM (
    SELECT s.*, f.flags, CASE WHEN name = {q(symbol)} THEN 0 WHEN lower(name) = {q(symbol.lower())} THEN 1
      WHEN starts_with(lower(name), {q(symbol.lower())}) THEN 2 WHEN contains(lower(name), {q(symbol.lower())}) THEN 3 END AS match
    FROM symbols s JOIN files f USING (repo, path)
  ) WHERE match IS NOT NULL
  ORDER BY list_place LIMIT {C.SYMBOL_LIST}
)"""


def symbol_hits(symbol: str) -> str:
    return f"""{listed(symbol)},
hits AS (
  SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, repo, path, line, list_place) AS place FROM (
    SELECT *, [1.0, 0.9, 0.6, 0.3][match + 1]::DOUBLE * {PENALTY} AS score FROM listed
    WHERE greatest(match, 1) = (SELECT min(greatest(match, 1)) FROM listed) OR list_place - 1 < {C.SYMBOL_LIMIT // 2}
  ) QUALIFY place <= {C.SYMBOL_LIMIT}
)"""


LISTED, SYMBOL_HITS = listed(SYMBOL), symbol_hits(SYMBOL)


def matching(condition: str, most: str = f"LIMIT {C.MATCHES}", capped: bool = True) -> str:
    return f"""matches AS (
  SELECT repo, path, line, text FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS r FROM lines
    JOIN (SELECT repo, path FROM files WHERE size <= {C.MAX_BYTES}) USING (repo, path) WHERE {condition})
  WHERE r <= {C.MATCHES_PER_FILE if capped else 1 << 30} ORDER BY repo, path, line {most}
)"""


#: Lines that hold the question of an item, as many searches for a fixed text.
MANY = f"""many AS (
  SELECT query, repo, path, line, text FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY repo, path, line) AS nth FROM (
      SELECT item_id AS query, repo, path, line, l.text, row_number() OVER (PARTITION BY item_id, repo, path ORDER BY line) AS r
      FROM lines l JOIN (SELECT repo, path FROM files WHERE size <= {C.MAX_BYTES}) USING (repo, path)
      JOIN queries ON CASE WHEN q = lower(q) THEN contains(lower(l.text), q) ELSE contains(l.text, q) END
    ) WHERE r <= {C.MATCHES_PER_FILE}
  ) WHERE nth <= {C.MATCHES}
)"""
EXACT_MATCH = f"contains(lower(text), {q(EXACT.lower())})"
REGEX_MATCH = f"regexp_matches(text, {q(REGEX)}, 'i')"


def indexed() -> str:
    """The matches of each search of ``grep_indexed``."""
    conditions = {"exact": EXACT_MATCH, "regex": REGEX_MATCH, "either": f"regexp_matches(text, {q(EITHER)})", "short": f"contains(text, {q(SHORT)})"}
    tables = [matching(c).replace("matches AS", f"{name}_matches AS", 1) for name, c in conditions.items()]
    return f"{BASE}, {', '.join(tables)} " + " UNION ALL ".join(f"SELECT '{name}' AS search, * FROM {name}_matches" for name in conditions)




def grouped(condition: str) -> str:
    return f"""{BASE}, {matching(condition)},
groups AS (
  SELECT m.repo, m.path, coalesce(c.start_line, greatest(1, m.line - 5)) AS start_line, arg_min(coalesce(c.end_line, m.line + 5), m.line) AS end_line,
         arg_min(coalesce(c.symbol, ''), m.line) AS symbol, arg_min(coalesce(c.kind, 'match'), m.line) AS kind, count(*) AS n, list_sort(list(m.line)) AS match_lines
  FROM matches m LEFT JOIN chunks c ON c.repo = m.repo AND c.path = m.path AND m.line BETWEEN c.start_line AND c.end_line
  GROUP BY 1, 2, 3
)"""


GROUPS = grouped(EXACT_MATCH)
REPOS = """repos AS (
  SELECT name, 'https://example.com/corpus/' || name AS url, 'main' AS ref, coalesce(n % 5 = 0, false) AS pinned, sha1(name) AS sha,
         list_sort(list_filter([CASE WHEN n % 2 = 0 THEN 'even' END, CASE WHEN n % 3 = 0 THEN 'third' END, CASE WHEN n % 7 = 0 THEN 'seventh' END],
                               lambda x: x IS NOT NULL)) AS categories,
         TIMESTAMP '2026-01-05 10:00:00' AS added_at, TIMESTAMP '2026-01-05 10:00:00' + to_hours(coalesce(n, 0)) AS updated_at
  FROM (SELECT DISTINCT source AS name, TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS n FROM documents)
)"""
STATS = f"""{BASE}, repo_stats AS (
  SELECT repo, count(*) FILTER (flags & {C.SKIPPED} = 0) AS files, coalesce(any_value(n), 0) AS chunks
  FROM files LEFT JOIN (SELECT repo, count(*) AS n FROM chunks GROUP BY repo) USING (repo) GROUP BY repo
),
langs AS (
  SELECT repo, list(lang ORDER BY n DESC, lang)[:3] AS langs
  FROM (SELECT repo, lang, count(*) AS n FROM files WHERE lang NOT IN ('config', 'text', 'markdown', 'html', 'css', '') AND flags & {C.SKIPPED} = 0 GROUP BY ALL)
  GROUP BY repo
)"""
CONTAINED = """expected AS (
  SELECT item_id, repo || ':' || path AS place FROM benchmark b JOIN files f ON contains(f.text, b.text)
)"""
NEXT = r"""next_files AS (
  SELECT source AS repo, lang || '/doc_' || doc_id || '.txt' AS path, md5(CASE WHEN doc_id % 10 = 1 THEN text || chr(10) || 'changed' ELSE text END) AS blob
  FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT source, 'new/' || lang || '/doc_' || doc_id || '.txt', md5(text) FROM documents WHERE doc_id % 10 = 2
)"""
WORDS = f"vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{IDENT}')) AS token FROM files)"


def stem(w: str) -> str:
    cases = ""
    for e in C.ENDINGS:
        base = f"left({w}, length({w}) - {len(e)})"
        if e == "ed":
            base = f"CASE WHEN length({base}) > 2 AND right({base}, 1) = substr({base}, -2, 1) THEN left({base}, length({base}) - 1) ELSE {base} END"
        cases += f" WHEN octet_length(encode({w})) > {len(e) + 2} AND ends_with({w}, {q(e)}) THEN {base}"
    return f"CASE{cases} ELSE {w} END"


_TREE_REF = "^(https?://[^/]+/[^/]+/[^/]+)/tree/(.+)$"
PARSE_SOURCE = rf"""
WITH s0 AS (SELECT url AS source FROM pages UNION SELECT * FROM (VALUES {values(samples.SOURCES)})),
s1 AS (SELECT source, trim(source) AS t, regexp_extract(trim(source), '^(.+)@([^/@]*)$', 1) AS before FROM s0),
s2 AS (SELECT source, CASE WHEN before <> '' THEN before ELSE t END AS t, CASE WHEN before <> '' THEN regexp_extract(t, '^(.+)@([^/@]*)$', 2) ELSE '' END AS ref FROM s1),
s3 AS (
  SELECT source, CASE WHEN regexp_matches(t, '{_TREE_REF}') THEN regexp_extract(t, '{_TREE_REF}', 1) ELSE t END AS t,
         CASE WHEN regexp_matches(t, '{_TREE_REF}') THEN regexp_extract(t, '{_TREE_REF}', 2) ELSE ref END AS ref FROM s2
),
s4 AS (
  SELECT source, ref, regexp_replace(regexp_replace(CASE WHEN regexp_matches(t, '^[\w.-]+/[\w.-]+$') AND NOT starts_with(t, 'github.com') THEN 'https://github.com/' || t
    WHEN regexp_matches(t, '^(github\.com|gitlab\.com|bitbucket\.org)/') THEN 'https://' || t
    WHEN regexp_matches(t, '^(https://|http://|git@|ssh://)') THEN t END, '/$', ''), '\.git$', '') AS url FROM s3
),
s5 AS (SELECT *, list_filter(string_split_regex(url, '[/:]'), lambda p: p <> '') AS f FROM s4)
SELECT source, CASE WHEN len(f) >= 2 THEN url END AS url, CASE WHEN len(f) >= 2 THEN lower(f[-2]) END AS owner,
       CASE WHEN len(f) >= 2 THEN lower(f[-1]) END AS name, CASE WHEN len(f) >= 2 THEN ref END AS ref
FROM s5
"""
_LINES = r"^(.*?):(\d+)(?:-(\d+))?$"
PARSE_TARGET = rf"""
WITH {FILES},
t0 AS (
  SELECT repo || ':' || path || ':3-' || length(repo) AS target FROM files UNION SELECT * FROM (VALUES {values(samples.TARGETS)})
),
t1 AS (SELECT target, regexp_replace(trim(replace(target, '\', '/')), '^references/', '') AS t FROM t0),
t2 AS (SELECT target, t, regexp_matches(t, '^[^/:]*:') AS colon FROM t1),
t3 AS (
  SELECT target, CASE WHEN colon THEN regexp_extract(t, '^([^/:]*):', 1) ELSE regexp_extract(t, '^([^/]*)/', 1) END AS repo,
         CASE WHEN colon THEN regexp_extract(t, '^[^/:]*:(.*)$', 1) ELSE regexp_extract(t, '^[^/]*/(.*)$', 1) END AS rest, colon OR contains(t, '/') AS ok FROM t2
),
t4 AS (SELECT *, regexp_matches(rest, '{_LINES}') AS ranged FROM t3),
t5 AS (
  SELECT *, CASE WHEN ranged THEN TRY_CAST(regexp_extract(rest, '{_LINES}', 2) AS INT) ELSE 0 END AS s, regexp_extract(rest, '{_LINES}', 3) AS last FROM t4
)
SELECT target, CASE WHEN ok THEN repo END AS repo,
       CASE WHEN ok THEN regexp_replace(CASE WHEN ranged THEN regexp_extract(rest, '{_LINES}', 1) ELSE rest END, '^/+|/+$', '', 'g') END AS path,
       CASE WHEN ok THEN s END AS start_line, CASE WHEN ok THEN CASE WHEN ranged AND last <> '' THEN TRY_CAST(last AS INT) ELSE s END END AS end_line
FROM t5
"""


def rendered(first: str, last: str, mark: str) -> str:
    own = "regexp_replace(ls[n], '[ ' || chr(9) || ']+$', '')"
    cut = f"CASE WHEN length({own}) > 240 THEN left({own}, 240) || '...' ELSE {own} END"
    number = f"lpad(n::VARCHAR, length(({last})::VARCHAR)::INT, ' ')"
    return f"coalesce(array_to_string(list_transform(range({first}, {last} + 1), lambda n: {mark} || {number} || '| ' || {cut} || {LF}), ''), '')"


def query_terms() -> str:
    """Words and parts, then abbreviations, then compounds; the first of equal ones, no stopwords."""
    table = ", ".join(f"{q(k)}: {strings(v)}" for k, v in abbreviations().items())
    stop = strings(sorted(C.STOPWORDS))
    more = f"CASE WHEN len({parts('t')}) > 1 THEN {parts('t')} ELSE []::VARCHAR[] END"
    a, b = stem("ws[i]"), stem("ws[i + 1]")
    second = f"(NOT list_contains({stop}, ws[i + 1]) OR list_contains({strings(sorted(C.PARTICLES))}, ws[i + 1]))"
    joins = f"octet_length(encode({a})) >= 2 AND octet_length(encode({b})) >= 2 AND NOT list_contains({stop}, ws[i]) AND {second}"
    return f"""WITH {ASKED}, abbr AS (SELECT MAP {{{table}}} AS m),
w AS (SELECT item_id, q, regexp_extract_all(q, '{IDENT}') AS ids, list_transform(regexp_extract_all(q, '{IDENT}'), lambda t: lower(t)) AS ws FROM queries),
f AS (
  SELECT item_id, q, list_concat(
    flatten(list_transform(ids, lambda t: list_concat([lower(t)], {more}))),
    flatten(list_transform(list_filter(ws, lambda w: NOT list_contains({stop}, w)), lambda w: list_concat(coalesce(m[{stem('w')}], []), coalesce(m[w], [])))),
    list_transform(list_filter(range(1, len(ws)), lambda i: {joins}), lambda i: {a} || {b})) AS found
  FROM w, abbr
)
SELECT item_id, q, list_filter(found, lambda x, i: list_position(found, x) = i AND octet_length(encode(x)) >= 2 AND NOT list_contains({stop}, x)) AS terms FROM f"""



# ---- searches whose mode follows from the query ----

NO_HITS = "repo, path, start_line, end_line, symbol, kind, score, place"


def concept_of(asked: str) -> str:
    """The hits of one query in concept mode."""
    one = f"asked AS (SELECT 0 AS query, {q(asked)} AS q, {strings(terms_of.query_terms(asked))} AS terms)"
    return f"""{CAPPED.replace(ASKED, one)} SELECT p.repo, p.path, p.start_line, end_line, p.symbol, p.kind, round(score, 9) AS score, place
FROM (SELECT *, '' AS symbol, 'block' AS kind FROM placed) p JOIN chunks USING (repo, path, start_line) WHERE place <= {C.CONCEPT_LIMIT}"""


def symbol_of(asked: str) -> str:
    return f"""{symbol_hits(asked)} SELECT h.repo, h.path, coalesce(c.start_line, h.line) AS start_line, coalesce(c.end_line, h.line) AS end_line, h.name AS symbol, 'line' AS kind,
  round(score, 9) AS score, place FROM hits h LEFT JOIN chunks c ON c.repo = h.repo AND c.path = h.path AND h.line BETWEEN c.start_line AND c.end_line"""


def lines_of(condition: str, named: str = "1.0") -> str:
    """The hits of a search for lines; ``named`` is the factor for the file's name, with the path ``g.path``."""
    return f"""{grouped(condition)}, s AS (SELECT g.*, (1 + ln(1 + n::DOUBLE)) * {named} * {PENALTY} AS score FROM groups g JOIN files f USING (repo, path))
SELECT repo, path, start_line, end_line, symbol, kind, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, repo, path, start_line) AS place
FROM s QUALIFY place <= {C.GREP_LIMIT}"""


def exact_of(asked: str) -> str:
    in_name = f"contains(lower({BASENAME.replace('path', 'g.path')}), {q(asked)})"
    return lines_of(f"contains(lower(text), {q(asked)})", f"CASE WHEN {in_name} THEN 1.3 ELSE 1.0 END")


def auto_search() -> str:
    concept, symbol, quoted, pattern = AUTO
    bare = quoted.strip('"')
    parts = [
        f"SELECT {q(concept)} AS asked, 'concept' AS mode, * FROM ({concept_of(concept)})",
        f"SELECT {q(symbol)}, 'symbol', * FROM ({symbol_of(symbol)})",
        f"SELECT {q(symbol)}, 'symbol->exact', * FROM ({exact_of(symbol)}) WHERE NOT EXISTS (FROM ({symbol_of(symbol)}))",
        f"SELECT {q(quoted)}, 'exact', * FROM ({exact_of(bare)})",
        f"SELECT {q(pattern)}, 'regex', * FROM ({lines_of(f'regexp_matches(text, {q(pattern)}, {q("i")})')})",
    ]
    return " UNION ALL ".join(parts)


# ---- definitions of sources made from documents ----


def by_language(values_of: dict[str, str]) -> str:
    return "CASE lang " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in values_of.items()) + " END"


def chunk_defs() -> str:
    ends = {k: "1" if p[3] else "0" for k, p in made.PARTS.items()}
    comments = {k: "k % 3" if p[0] else "0" for k, p in made.PARTS.items()}
    is_class, is_long = f"(lang = 'python' AND k % 5 = {made.CLASS_AT})", f"(lang = 'python' AND k % 50 = {made.LONG_AT})"
    return f"""WITH docs AS (
  SELECT source AS repo, {strings(made.LANGUAGES)}[doc_id % {len(made.LANGUAGES)} + 1] AS lang, doc_id, len({line_list('text')}) AS n FROM documents
),
pieces AS (
  SELECT repo, lang || '/doc_' || doc_id AS path, lang, k, {by_language(comments)} AS c, {by_language(ends)} AS e, k % 2 AS blank,
         CASE WHEN {is_long} THEN {made.LONG_BODY} ELSE 1 + (7 * k + doc_id) % 4 END + CASE WHEN {is_class} AND NOT {is_long} THEN 2 ELSE 0 END AS body
  FROM (SELECT *, unnest(range(0, n)) AS k FROM docs)
),
placed AS (SELECT *, coalesce(sum(c + 1 + body + e + blank) OVER (PARTITION BY repo, path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM pieces),
defs AS (
  SELECT repo, path, lang, k, c, base + c + 1 AS s, base + c + 1 + CASE lang WHEN 'markdown' THEN body + blank WHEN 'sql' THEN 0 ELSE body + e END AS f, 'f' || k AS name,
         CASE WHEN {is_class} THEN 'class' WHEN lang = 'markdown' THEN 'section' WHEN lang = 'sql' THEN 'type' ELSE 'func' END AS kind
  FROM placed
),
symbols AS (
  SELECT repo, path, s, f, name, kind FROM defs
  UNION ALL SELECT repo, path, base + c + body, base + c + body + 1, 'm' || k, 'method' FROM placed WHERE {is_class} AND NOT {is_long}
),
whole AS (SELECT *, s - c AS top, row_number() OVER (PARTITION BY repo, path ORDER BY s) AS r FROM defs WHERE f - s + 1 >= {C.MIN_DEF} AND lang <> 'sql'),
heads AS (SELECT repo, path, top AS s, CASE WHEN f - top + 1 <= {C.MAX_CHUNK} THEN f ELSE top + {C.COMMENT_LINES} END AS f, name, kind FROM whole),
totals AS (SELECT repo, path, max(base + c + 1 + body + e + blank) AS total FROM placed GROUP BY repo, path),
gaps AS (
  SELECT repo, path, coalesce(lag(f) OVER (PARTITION BY repo, path ORDER BY s), 0) + 1 AS lo, top - 1 AS hi, '' AS owner FROM whole
  UNION ALL SELECT t.repo, t.path, coalesce(max(f), 0) + 1, any_value(total), '' FROM totals t LEFT JOIN whole w ON w.repo = t.repo AND w.path = t.path GROUP BY t.repo, t.path
  UNION ALL SELECT repo, path, top + {C.COMMENT_LINES} + 1, f, name FROM whole WHERE f - top + 1 > {C.MAX_CHUNK}
),
tiles AS (SELECT repo, path, owner, hi, unnest(range(lo, hi + 1, {C.WINDOW})) AS s FROM gaps WHERE lo <= hi),
cut AS (SELECT repo, path, owner, s, least(s + {C.WINDOW - 1}, hi) AS f FROM tiles),
solid AS (SELECT repo, path, unnest(range(base + 1, base + c + 1 + body + e + 1)) AS line FROM placed),
blocks AS (SELECT t.repo, t.path, t.s, t.f, owner FROM cut t JOIN solid l ON l.repo = t.repo AND l.path = t.path AND line BETWEEN t.s AND t.f GROUP BY ALL HAVING count(*) >= 2)
SELECT repo, path, 'symbol' AS what, s::INT AS start_line, f::INT AS end_line, name, kind FROM symbols
UNION ALL SELECT repo, path, 'chunk', s::INT, f::INT, name, kind FROM heads
UNION ALL SELECT repo, path, 'chunk', s::INT, f::INT, owner, 'block' FROM blocks"""


# ---- the Porter stemmer, step by step ----


def porter_sql() -> str:
    """Words of letters a to z after folding, and some others: consonants and vowels as patterns, a step to a table."""
    from ..functions import porter as rules

    cons, vows = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m2 = f"^({cons})?{vows}{cons}", f"^({cons})?{vows}{cons}{vows}{cons}"
    m1, vowel, cvc = f"^({cons})?{vows}{cons}({vows})?$", f"^({cons})?[aeiouy]", f"^{cons}[aeiouy][^aeiouwxy]$"
    has = lambda pattern, x: f"regexp_matches({x}, {q(pattern)})"
    less = lambda x, n: f"left({x}, length({x}) - {n})"

    def longest(x: str, endings: dict[str, str], measure: str) -> str:
        """The longest ending that fits is replaced where what it leaves has the measure."""
        cases = "".join(
            f" WHEN ends_with({x}, {q(e)}) THEN CASE WHEN {has(measure, f'{less(x, len(e))} || {q(keep)}')} THEN {less(x, len(e))} || {q(keep + new)} ELSE {x} END"
            for e, (keep, new) in sorted(endings.items(), key=lambda kv: -len(kv[0]))
        )
        return f"CASE{cases} ELSE {x} END"

    step2, step3 = ({e: ("", new) for e, new in t.items()} for t in (rules._STEP2, rules._STEP3))
    step4 = {e: ({"sion": "s", "tion": "t"}.get(e, ""), "") for e in rules._STEP4}
    after = f"""CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
  WHEN length(w) > 1 AND right(w, 1) = substr(w, -2, 1) AND NOT regexp_matches(w, '[aeioulsz]$') THEN {less('w', 1)}
  WHEN {has(m1, 'w')} AND {has(cvc, 'w')} THEN w || 'e' ELSE w END"""
    return f"""WITH {FILES}, found AS (SELECT DISTINCT unnest({tokens('text')}) AS word FROM files),
folded AS (SELECT word, lower(strip_accents(lower(word))) AS z FROM found),
-- a letter of two bytes is two consonants
p0 AS (SELECT word, z, replace(replace(regexp_replace(z, '^y', 'Y'), 'ß', '#%'), 'ø', '#&') AS w FROM folded),
p1 AS (SELECT * REPLACE (CASE WHEN (ends_with(w, 'sses') AND length(w) > 4) OR (ends_with(w, 'ies') AND length(w) > 3) THEN {less('w', 2)}
  WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {less('w', 1)} ELSE w END AS w) FROM p0),
p2 AS (SELECT *, CASE WHEN ends_with(w, 'eed') THEN '' WHEN ends_with(w, 'ed') AND {has(vowel, less('w', 2))} THEN 'ed' WHEN ends_with(w, 'ing') AND {has(vowel, less('w', 3))} THEN 'ing' ELSE '' END AS cut FROM p1),
p3 AS (SELECT word, z, cut, CASE WHEN ends_with(w, 'eed') AND {has(m0, less('w', 3))} THEN {less('w', 1)} ELSE left(w, length(w) - length(cut)) END AS w FROM p2),
p4 AS (SELECT word, z, CASE WHEN cut <> '' THEN {after} ELSE w END AS w FROM p3),
p5 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'y') AND {has(vowel, less('w', 1))} THEN {less('w', 1)} || 'i' ELSE w END AS w) FROM p4),
p6 AS (SELECT * REPLACE ({longest('w', step2, m0)} AS w) FROM p5),
p7 AS (SELECT * REPLACE ({longest('w', step3, m0)} AS w) FROM p6),
p8 AS (SELECT * REPLACE ({longest('w', step4, m2)} AS w) FROM p7),
p9 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'e') AND ({has(m2, less('w', 1))} OR ({has(m1, less('w', 1))} AND NOT {has(cvc, less('w', 1))})) THEN {less('w', 1)} ELSE w END AS w) FROM p8),
p10 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'll') AND {has(m2, less('w', 1))} THEN {less('w', 1)} ELSE w END AS w) FROM p9)
SELECT word, CASE WHEN octet_length(encode(z)) BETWEEN 3 AND 64 THEN replace(replace(replace(w, 'Y', 'y'), '#%', 'ß'), '#&', 'ø') ELSE z END AS term FROM p10"""


ORACLES: dict[str, str] = {
    "query_terms": query_terms(),
    "lines_scan": f"{BASE} SELECT * FROM lines",
    "scan_files": f"WITH {FILES} SELECT * EXCLUDE (text) FROM files",
    "tok_identifiers": f"WITH {FILES} SELECT repo, path, regexp_extract_all(text, '{IDENT}') AS tokens FROM files",
    "tok_parts": f"WITH {FILES}, {WORDS} SELECT token, {parts('token')} AS parts FROM vocabulary",
    "tok_expand": f"WITH {FILES} SELECT repo, path, len(e)::INT AS n, md5(array_to_string(e, ' ')) AS digest FROM (SELECT repo, path, {expand('text')} AS e FROM files)",
    "stem_light": f"WITH {FILES}, {WORDS} SELECT word, {stem('word')} AS stem FROM (SELECT DISTINCT lower(token) AS word FROM vocabulary)",
    "detect_mode": rf"""WITH {ASKED}
SELECT q, CASE WHEN length(trim(q)) >= 2 AND starts_with(trim(q), '"') AND ends_with(trim(q), '"') THEN 'exact'
  WHEN regexp_matches(trim(q), '^[A-Za-z_$]\w*((\.|::|#|->)[A-Za-z_$]\w*)*$') THEN 'symbol'
  WHEN len(list_filter(string_split_regex(trim(q), '\s+'), lambda w: w <> '')) <= 2 AND regexp_matches(q, '{paths.METACHARACTERS}') THEN 'regex' ELSE 'concept' END AS mode
FROM (SELECT q FROM queries UNION SELECT * FROM (VALUES {values(samples.QUERIES)}))""",
    "classify_lang": f"WITH {ALL_PATHS} SELECT path, {LANGUAGE} AS lang FROM all_paths",
    "path_flags": f"""WITH {ALL_PATHS}, f AS (SELECT path, ({FLAGS})::INT AS flags FROM (SELECT path, {LANGUAGE} AS lang FROM all_paths))
SELECT path, flags, list_filter([CASE WHEN flags & 1 <> 0 THEN 'test' END, CASE WHEN flags & 2 <> 0 THEN 'vendor' END, CASE WHEN flags & 4 <> 0 THEN 'generated' END,
  CASE WHEN flags & 8 <> 0 THEN 'doc' END], lambda t: t IS NOT NULL) AS tags,
  CASE WHEN flags & 2 <> 0 THEN 'vendor' WHEN flags & 1 <> 0 THEN 'test' WHEN flags & 4 <> 0 THEN 'generated' WHEN flags & 8 <> 0 THEN 'doc' ELSE '' END AS main_tag FROM f""",
    "filter_skip_path": f"""WITH {ALL_PATHS} SELECT path FROM all_paths WHERE NOT (list_has_any(string_split(path, '/')[:-2], {strings(C.SKIPPED_DIRS)})
  OR {LOWER_NAME} IN ({', '.join(map(q, C.LOCKFILES))}) OR contains({LOWER_NAME}, '.min.') OR ends_with({LOWER_NAME}, '.map'))""",
    "filter_skip_content": f"""WITH {FILES} SELECT repo, path FROM files WHERE NOT (size > {C.MAX_BYTES} OR size = 0 OR contains(substring(text, 1, {C.NUL_BYTES}), chr(0))
  OR (size > {C.DENSE_BYTES} AND size // (length(text) - length(replace(text, {LF}, '')) + 1) > {C.DENSE_LINE}))""",
    "flag_generated": f"SELECT md5(text) AS blob, {any_contains(HEAD, C.GENERATED_MARKS)} AS generated FROM (SELECT text FROM documents UNION ALL SELECT * FROM (VALUES {values(samples.HEADERS)}))".replace("chr(10)", LF),
    "filter_conj": rf"WITH {FILES} SELECT repo, path FROM files WHERE repo IN ('src1', 'src3', 'src12') AND lang IN ('en', 'fr') AND regexp_matches(path, '^.*/doc_.*[135]\.txt$')",
    "filter_glob": f"WITH {ALL_PATHS} " + " UNION ALL ".join(f"SELECT {q(g)} AS glob, path FROM all_paths WHERE regexp_matches(path, {q(paths.glob_regex(paths.glob_pattern(g)))})" for g in samples.GLOBS),
    "url_normalize": rf"""SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '/$', ''), '\.git$', ''),
  '^https://', ''), '^http://', ''), '^git@', ''), '^([^:]*):', '\1/') AS normal FROM (SELECT url FROM pages UNION SELECT * FROM (VALUES {values(samples.URLS)}))""",
    "parse_source": PARSE_SOURCE,
    "parse_target": PARSE_TARGET,
    "chunk_windows": f"{BASE} SELECT * EXCLUDE (body) FROM chunks",
    "symbol_enclosing": f"""{BASE}, {SYMBOLS} SELECT s.repo, s.path, name, line, coalesce(start_line, line) AS start_line, coalesce(end_line, line) AS end_line
FROM symbols s LEFT JOIN chunks c ON c.repo = s.repo AND c.path = s.path AND line BETWEEN start_line AND end_line""",
    "file_chunks": f"""{BASE}, longest AS (SELECT repo, path FROM files QUALIFY row_number() OVER (PARTITION BY repo ORDER BY size DESC, path DESC) = 1)
SELECT * EXCLUDE (body) FROM chunks SEMI JOIN longest USING (repo, path)""",
    "chunk_defs": chunk_defs(),
    "chunk_samples": f"""SELECT 'inline' AS repo, path, what, first::INT AS start_line, last::INT AS end_line, replace(name, '-', '') AS name, kind
FROM (VALUES {values([tuple(x.split()) for x in samples.DEFINITIONS.split(chr(10)) if x])}) AS v(path, what, first, last, name, kind)""",
    "tok_porter": porter_sql(),
    "auto_search": auto_search(),
    "fts_stats": f"{BASE}, {DOCS} SELECT n_docs, n_tokens, round(n_tokens::DOUBLE / n_docs, 9) AS avgdl FROM stats",
    "index_build": f"{BASE}, {DOCS} SELECT term, count(DISTINCT (repo, path, start_line)) AS n_chunks, sum(w)::DOUBLE AS weighted, count(*) AS n_tokens FROM occ GROUP BY term",
    "concept_bm25": f"{CONCEPT} SELECT query, repo, path, start_line, round(bm25, 9) AS bm25, rank FROM ranked WHERE rank <= 10",
    "concept_phrases": f"""{BASE}, {DOCS}, {ASKED}, {PHRASES} SELECT query, repo, path, start_line, round(bm25, 9) AS bm25, rank FROM ranked WHERE rank <= 10""",
    "concept_score": f"{scored()} SELECT query, repo, path, start_line, round(score, 9) AS score FROM scored",
    "concept_repo_boost": f"""{scored("CASE WHEN r.repo = 'src' || (r.query % 20) THEN 2.0 ELSE 1.0 END")}
SELECT * FROM (SELECT query, repo, path, start_line, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, repo, path, start_line) AS place FROM scored)
WHERE place <= 10""",
    "cap_per_file": f"{CAPPED} SELECT query, repo, path, start_line, round(score, 9) AS score FROM capped",
    "concept_search": f"{CAPPED} SELECT query, repo, path, start_line, round(score, 9) AS score, place FROM placed WHERE place <= {C.CONCEPT_LIMIT}",
    "excerpt_densest": f"""{CONCEPT}, t AS (SELECT DISTINCT query, repo, path FROM ranked WHERE rank <= {C.SHORTLIST}),
m AS (SELECT repo, path, max(line) AS total FROM lines GROUP BY ALL HAVING max(line) > 30),
n AS (
  SELECT t.query, l.repo, l.path, line, total, len(list_filter(a.terms, lambda x: contains(lower(text), x))) AS s
  FROM t JOIN asked a USING (query) JOIN lines l ON l.repo = t.repo AND l.path = t.path JOIN m ON m.repo = l.repo AND m.path = l.path
),
w AS (SELECT *, sum(s) OVER (PARTITION BY query, repo, path ORDER BY line ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS hits FROM n)
SELECT query, repo, path, arg_min(line, (-hits, line))::INT AS best FROM w WHERE line >= 7 AND line <= least(total - 23, 402) GROUP BY query, repo, path""",
    "symbol_lookup": f"{LISTED} SELECT repo, path, name, line, match, list_place FROM listed",
    "symbol_indexed": f"{LISTED} SELECT repo, path, name, line, match, list_place FROM listed",
    "symbol_ranked": f"{SYMBOL_HITS} SELECT repo, path, name, line, round(score, 9) AS score, place FROM hits",
    "symbol_search": f"""{SYMBOL_HITS}, e AS (
  SELECT h.place, h.repo, h.path, h.name, h.line, coalesce(c.start_line, h.line) AS s, coalesce(c.end_line, h.line) AS last0
  FROM hits h LEFT JOIN chunks c ON c.repo = h.repo AND c.path = h.path AND h.line BETWEEN c.start_line AND c.end_line
),
e2 AS (SELECT *, CASE WHEN line - s > 6 THEN line - 3 ELSE s END AS first FROM e),
e3 AS (SELECT *, least(last0, first + 13) AS last FROM e2)
SELECT place, repo, path, name, line, first, last, {rendered('first', 'least(last, len(ls))', "CASE WHEN n = line THEN '>' ELSE ' ' END")} AS excerpt FROM e3 JOIN line_lists USING (repo, path)""",
    "grep_exact": f"{BASE}, {matching(EXACT_MATCH)} SELECT * FROM matches",
    "grep_indexed": indexed(),
    "grep_many": f"{BASE}, {ASKED}, {MANY} SELECT * FROM many",
    "grep_regex": f"{BASE}, {matching(f'regexp_matches(text, {q(REGEX)}, {q('i')})')} SELECT * FROM matches",
    "grep_group_chunks": f"{GROUPS} SELECT * FROM groups",
    "grep_scored": f"""{GROUPS}, s AS (
  SELECT g.*, (1 + ln(1 + n::DOUBLE)) * CASE WHEN contains(lower({BASENAME.replace('path', 'g.path')}), {q(EXACT)}) THEN 1.3 ELSE 1.0 END * {PENALTY} AS score FROM groups g JOIN files f USING (repo, path)
)
SELECT repo, path, start_line, end_line, n, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, repo, path, start_line) AS place
FROM s QUALIFY place <= {C.GREP_LIMIT}""",
    "excerpt_islands": f"""WITH {FILES}, {LINE_LISTS}, {LINES}, {chunks(C.WINDOW)}, {matching(f"contains(lower(text), {q('tion')})", '')},
w AS (
  SELECT m.repo, m.path, c.start_line, m.line, greatest(c.start_line, m.line - 2) AS a, least(c.end_line, m.line + 2) AS b
  FROM matches m JOIN chunks c ON c.repo = m.repo AND c.path = m.path AND m.line BETWEEN c.start_line AND c.end_line
),
i AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY repo, path, start_line ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM w),
k AS (SELECT *, sum(new) OVER (PARTITION BY repo, path, start_line ORDER BY line) AS island FROM i)
SELECT repo, path, start_line, island, min(a) AS first_line, max(b) AS last_line, count(*) AS matches FROM k WHERE island <= 3 GROUP BY repo, path, start_line, island""",
    "repos_scan": f"WITH {REPOS} SELECT * FROM repos",
    "repo_stats": f"{STATS} SELECT * FROM repo_stats",
    "repo_top_langs": f"{STATS} SELECT * FROM langs",
    "repo_list": f"""{STATS}, {REPOS} SELECT name, url, ref, pinned, left(sha, 7) AS sha, strftime(updated_at, '%Y-%m-%d') AS updated, categories,
  coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, coalesce(langs, []) AS langs FROM repos LEFT JOIN repo_stats s ON s.repo = name LEFT JOIN langs l ON l.repo = name""",
    "category_counts": f"""WITH {REPOS}, e AS (SELECT name, unnest(categories) AS category FROM repos UNION ALL SELECT name, '' FROM repos WHERE len(categories) = 0)
SELECT category, count(*) AS n, list_sort(list(name)) AS repos FROM e GROUP BY category""",
    "category_filter": f"WITH {REPOS} SELECT name, categories FROM repos WHERE list_has_any(categories, ['third', 'seventh'])",
    "tag_untag": f"""WITH {REPOS} SELECT name, CASE name WHEN 'src2' THEN list_sort(list_distinct(list_concat(categories, ['web', 'even', 'alpha'])))
  WHEN 'src6' THEN list_filter(categories, lambda c: c <> 'even') ELSE categories END AS categories FROM repos""",
    "status_issues": f"""{STATS}, {REPOS},
kept AS (SELECT name, sha FROM repos WHERE name <> 'src1' UNION ALL VALUES ('ghost', '0'), ('empty', '1')),
there AS (SELECT name, CASE WHEN name = 'src3' THEN 'old' ELSE sha END AS sha FROM repos WHERE name <> 'src2' UNION ALL VALUES ('empty', '1'), ('.hidden', '2'), ('stray', '3'))
SELECT name AS repo, 'checkout missing' AS problem FROM kept WHERE name NOT IN (SELECT name FROM there)
UNION ALL SELECT k.name, 'checkout differs from manifest' FROM kept k JOIN there t USING (name) WHERE k.sha <> t.sha
UNION ALL SELECT k.name, 'not indexed' FROM kept k JOIN there t USING (name) WHERE k.name NOT IN (SELECT repo FROM repo_stats WHERE files > 0)
UNION ALL SELECT repo, 'index rows for untracked repo' FROM repo_stats WHERE repo NOT IN (SELECT name FROM kept)
UNION ALL SELECT name, 'untracked directory in references/' FROM there WHERE name NOT LIKE '.%' AND name NOT IN (SELECT name FROM kept)""",
    "tree_rollup": f"""WITH {FILES}, f AS (SELECT repo, path, split_part(path, '/', 1) AS dir, row_number() OVER (PARTITION BY repo, split_part(path, '/', 1) ORDER BY path) AS r,
  count(*) OVER (PARTITION BY repo, split_part(path, '/', 1)) AS c FROM files)
SELECT repo, dir || '/' AS path, true AS is_dir, any_value(c) AS files, 1 AS depth, '' AS tag FROM f GROUP BY repo, dir
UNION ALL SELECT repo, path, false, 0, 2, '' FROM f WHERE r <= 25
UNION ALL SELECT DISTINCT repo, dir || '/... +' || (c - 25) || ' files', false, 0, 2, '' FROM f WHERE c > 25""",
    "show_range": f"""{BASE}, s AS (SELECT repo, path, ls, 2 AS start_line, len(ls)::INT AS total, least(len(ls), 6)::INT AS end_line FROM line_lists WHERE len(ls) >= 2)
SELECT repo, path, start_line, end_line, total,
  array_to_string(list_transform(range(start_line, end_line + 1), lambda n: lpad(n::VARCHAR, length(end_line::VARCHAR)::INT, ' ') || '| ' || regexp_replace(ls[n], '[ ' || chr(9) || ']+$', '') || {LF}), '') AS content,
  CASE WHEN end_line < total THEN repo || ':' || path || ':' || (end_line + 1) || '-' || least(total, end_line + 200) END AS next FROM s""",
    "hits_json": f"""{CAPPED} SELECT query, place, '{{"repo":"' || repo || '","path":"' || path || '","start_line":' || start_line || ',"tags":["doc"],"loc":"' || repo || ':' || path || ':' || start_line || '"}}' AS hit
FROM placed WHERE place <= {C.CONCEPT_LIMIT}""",
    "incremental_diff": f"""WITH {FILES}, {NEXT} SELECT coalesce(f.repo, n.repo) AS repo, coalesce(f.path, n.path) AS path,
  CASE WHEN f.blob IS NULL THEN 'added' WHEN n.blob IS NULL THEN 'removed' WHEN f.blob = n.blob THEN 'unchanged' ELSE 'changed' END AS status
FROM files f FULL JOIN next_files n ON f.repo = n.repo AND f.path = n.path""",
    "delete_repo": f"{BASE} SELECT * EXCLUDE (body) FROM chunks WHERE repo NOT IN ('src1', 'src4')",
    "rerank_blend": rf"""{CAPPED},
h AS (SELECT p.*, c.body, a.q, list_distinct(regexp_extract_all(lower(a.q), '[\p{{L}}\p{{N}}]+')) AS ws FROM placed p JOIN chunks c USING (repo, path, start_line) JOIN asked a USING (query) WHERE place <= {C.JUDGED}),
j AS (SELECT *, len(list_filter(ws, lambda t: contains(lower(path || ' ' || body), t)))::DOUBLE / len(ws) AS p FROM h),
b AS (SELECT *, round(p, 2) + {C.BLEND} * score / max(score) OVER (PARTITION BY query) AS blended, p < {C.RELEVANT} AS weak, max((p >= {C.RELEVANT})::INT) OVER (PARTITION BY query) AS strong FROM j),
o AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query ORDER BY round(blended, 9) DESC, repo, path, start_line) AS place FROM b WHERE strong = 0 OR NOT weak)
SELECT query, repo, path, start_line, round(p, 9) AS p, round(blended, 9) AS blended, weak, place FROM o WHERE strong = 1 OR place <= {C.WEAK_SHOWN}""",
    "pack_budget": f"""{CAPPED.replace('WITH ', 'WITH RECURSIVE ', 1)},
x AS (SELECT query, place, octet_length(encode(body)) AS size FROM placed JOIN chunks USING (repo, path, start_line) WHERE place <= {C.CONCEPT_LIMIT}),
walk AS (
  SELECT query, place, size, true AS kept, size AS used FROM x WHERE place = 1
  UNION ALL SELECT x.query, x.place, x.size, w.used + x.size <= 2000, CASE WHEN w.used + x.size <= 2000 THEN w.used + x.size ELSE w.used END
  FROM walk w JOIN x ON x.query = w.query AND x.place = w.place + 1
)
SELECT query, place, CASE WHEN kept THEN size ELSE 0 END::INT AS size, kept FROM walk""",
    "eval_cases": f"WITH {FILES}, {ASKED}, {CONTAINED} SELECT q, list_sort(list(place)) AS expect FROM queries JOIN expected USING (item_id) GROUP BY item_id, q",
    "eval_metrics": f"""{CAPPED}, {CONTAINED},
ranks AS (SELECT item_id, min(p.place) AS rank FROM (SELECT DISTINCT item_id FROM expected) JOIN expected e USING (item_id) LEFT JOIN placed p ON p.query = item_id AND p.place <= 10 AND p.repo || ':' || p.path = e.place GROUP BY item_id)
SELECT count(*) AS cases, round(avg((coalesce(rank, 99) = 1)::INT), 9) AS hit1, round(avg((coalesce(rank, 99) <= 5)::INT), 9) AS hit5, round(avg(coalesce(1.0 / rank, 0))::DOUBLE, 9) AS mrr FROM ranks""",
}
