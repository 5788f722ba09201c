from quarrylight.plans import present

LINES = [f"line {i}" + (" hit" if i in (3, 60, 61, 70) else "") for i in range(1, 101)]


def test_concept_excerpt_shows_head_and_densest_window():
    out, left = present.concept_excerpt(LINES, 1, 100, ["hit"])
    numbers = [int(x.split("|")[0]) for x in out.splitlines() if "|" in x]
    assert numbers == [*range(1, 7), *range(47, 71)] and left == 70
    assert present.concept_excerpt(LINES, 1, 20, ["hit"])[1] == 0


def test_match_excerpt_merges_windows():
    out = present.match_excerpt(LINES, 1, 100, [3, 60, 61, 70, 90])
    assert [x.split(" line")[0].strip() for x in out.splitlines()] == ["1|", "2|", ">3|", "4|", "5|", "...", "58|", "59|", ">60|", ">61|", "62|", "63|", "...", "68|", "69|", ">70|", "71|"]


def test_symbol_excerpt_skips_long_comments():
    out, left = present.symbol_excerpt(LINES, 1, 40, 20)
    assert out.splitlines()[0].strip() == "17| line 17" and left == 10


def test_following():
    hit = {"repo": "r", "path": "p", "start_line": 30, "end_line": 31, "omitted": 0, "excerpt": "x"}
    assert present.following("q", "concept", [], False) == 'search "q" --mode exact'
    assert present.following("q", "exact", [hit], False) == "show r:p:10-71"
    assert present.following("q", "exact", [hit | {"omitted": 3}], False) == "show r:p:30-31"
    assert present.following("q", "concept", [hit | {"weak": True}], False).endswith("--deep")
