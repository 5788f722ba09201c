"""Pages, URLs, vectors, components and the pipeline."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from quarrylight.llm import embed_dedup, html_text, mixing, pieces, quality, registry, url_rules
from quarrylight.llm.components import components
from quarrylight.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"

PAGES = [
    (
        "<html><body><header><h1>Site</h1><nav>x</nav></header><div class='content'><h1>Title</h1><p>Long text here, with commas, and more."
        " Yes.</p><p>Short.</p></div><div id='comments'><p>I like this, really, a lot. Great text, many words, and more, and more.</p></div>"
        "<div class='sidebar'><p>Side, text.</p></div><footer>c</footer></body></html>",
        "Title\nLong text here, with commas, and more. Yes.\nShort.",
    ),
    ("<p>Only &amp; one &lt; two&nbsp;&nbsp;three", "Only & one < two three"),
    ("", ""),
    (None, ""),
    ("a < b", "a < b"),
    ("<script>x", ""),
    ("<div>a</div><!-- x", "a"),
    ("<article><header><h1>T</h1><p>by X</p></header><p>Body one, two. three.</p><aside>no</aside><form>f</form></article>", "T\nBody one, two. three."),
    ("<body><nav><a href='/'>n</a></nav><div class=ad>Buy, now. Cheap, good.</div><article><h1>H</h1><p><b>A, b. c.<br><p>D<br>e.</p></article>", "H\nA, b. c.\nD e."),
    ("<p title=it's>Don't, <b>we'll.</b> <i class='a>b' id=\"x>y\">Yes</i><a href=", "Don't, we'll. Yes"),
    ("<a =\"" * 3000 + "<p>x", "x"),
    ("<p>" + "w, " * 20000 + "</p>", " ".join(["w,"] * 20000)),
]


def test_main_text(spark):
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "x"), (None, None, "<p>q</p>", None)]
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "q" if r["page_id"] is None else PAGES[r["page_id"]][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG, SHORT = "One long sentence, with commas, stands here; it goes on. " * 12, "A shorter sentence, it has commas; and ends here. " * 4


@pytest.mark.parametrize(
    "html",
    [
        "<div id=content><h1>T</h1><p>LEAD</p><section><p>LONG</p><p>LONG</p><p>LONG</p></section><section><p>REST</p></section></div>",
        "<div id=content><p>LEAD</p><ul><li>LONG</li><li>LONG</li><li>LONG</li></ul><p>REST</p></div>",
        "<div id=content><p>LEAD</p><ul><li>LONG</li><li>LONG</li></ul></div>",
        "<body><div><h1>T</h1><div class=body><p>LONG</p><p>LONG</p></div></div></body>",
        "<div><h1>T</h1><p>LEAD</p><div><p>LONG</p><div><p>LONG</p></div><table><tr><td>REST</td></tr></table></div></div>",
    ],
)
def test_main_text_over_several_containers(html):
    page = html.replace("LONG", LONG).replace("REST", SHORT).replace("LEAD", SHORT)
    want = [x.strip() for x in re.split("<[^>]*>", page) if x.strip()]
    menu = "<div class=menu><a href=/>Home</a></div>"
    assert html_text.main_text(f"<html><body>{menu}{page}<div class=footer>Rights, all. Reserved.</div></body></html>").split("\n") == want


MENU = "<div><a href=/a>Home</a></div><div><a href=/b>News</a></div>"
UNNAMED = [  # pages without a name or tag that tells anything: page, article
    (f"<body>{MENU}<div><h2>T</h2><p>LONG</p><p>REST</p><p>Short</p></div><div><span>Ours since 2001</span></div></body>", "T LONG REST Short"),
    (f"<body>{MENU}<div class=x1><h1>T</h1><div class=x2>LONG</div><div class=x3>Deals</div><div class=x2>LONG</div>"
     "<div class=x2>LONG</div><div class=x2>REST</div></div><table><tr><td>Imprint</td></tr></table></body>", "T LONG Deals LONG LONG REST"),
    (f"<body><ul><li>One</li><li>Two</li></ul><div><div><h1>T</h1></div><div><p>REST</p><ul><li>a</li><li>b</li></ul><p>LONG</p></div></div>{MENU}</body>", "T REST a b LONG"),
    ("<body><section><em>x</em></section><section><p>LONG</p><p>LONG</p></section><section><b>Call</b> us</section></body>", "LONG LONG"),
]


@pytest.mark.parametrize(("page", "article"), UNNAMED)
def test_main_text_by_ratios_alone(page, article, monkeypatch):
    """Ratios decide where the article is: with all paths selected, the text is another one."""
    fill = lambda x: x.replace("LONG", LONG.strip()).replace("REST", SHORT.strip())
    want = [fill(x) for x in article.split(" ")]
    assert html_text.main_text(f"<html>{fill(page)}</html>").split("\n") == want
    monkeypatch.setattr(html_text._Page, "_chosen", lambda self, own: (set(own), set(own)))
    assert html_text.main_text(f"<html>{fill(page)}</html>").split("\n") != want


def article_of(body):
    page = f"<html><body><nav><a>Home</a></nav><div class=ad>Buy, now.</div>{body}<div class='comment-list'><p>{LONG}</p></div><footer>Rights, all.</footer></body></html>"
    return html_text.main_text(page.replace("P", LONG)).replace(LONG.strip(), "P").split("\n")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<main><h1>T</h1><p>P</p><article><h2>U</h2>" + "<p>P</p>" * 9 + "</article><p>P</p></main>", "T P U P P P P P P P P P P"),
        ("<article><h1>T</h1>Lead<p>P</p><div class=lead>Short</div><details><summary>Sum</summary></details>Tail</article>", "T Lead P Short Sum Tail"),
        ("<article><h1>T</h1><p>P</p><ul><li><a>Alpha</a></li><li><a>Beta</a></li></ul></article>", "T P Alpha Beta"),
        ("<article><h1>T</h1><p>P</p><section class='related-work'><h2>R</h2><p>P</p></section></article>", "T P R P"),
        ("<article><h1>T</h1><p>P</p><div id='search-algorithms'><p>P</p></div><div class='menu-recipes'><p>P</p></div></article>", "T P P P"),
        ("<article><h1>T</h1><p>P</p><p class='search-results-summary'>P</p></article>", "T P P"),
        ("<article><h1>T</h1><p>P</p><div class='share-buttons'><a>X</a></div><div class='related-posts'><ul><li><a>One</a></ul></div></article>", "T P"),
        ("<article><h1>T</h1><p>P</p><div class='cookie-notice'><p>P</p></div><div class=sidebar>P</div></article>", "T P"),
        ("<article>" + "<div class=t>P</div>" * 5 + "<div class=z>One</div><div class=z>Two</div></article>", "P P P P P One Two"),
    ],
)
def test_an_article_keeps_all_that_is_not_marked(body, want):
    assert article_of(body) == want.split(" ")


def test_given_pages_without_names(monkeypatch):
    """Pages of sf0.01 whose menus, adverts and footers have no tag or class that tells: ratios find the article."""
    import pyarrow.parquet as pq

    plain = lambda html: re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", html.replace(' class="ad"', ""))
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    named = [html_text.main_text(h) for h in pages]
    found = [html_text.main_text(plain(h)) for h in pages]
    right = [a == b for a, b in zip(named, found)]
    assert sum(right) >= 0.8 * len(pages)
    assert all(r for r, h in zip(right, pages) if len(h) > 4000)  # an advert of one sentence is as rich as an article of two
    monkeypatch.setattr(html_text._Page, "_chosen", lambda self, own: (set(own), set(own)))
    by_all = sum(a == html_text.main_text(plain(h)) for a, h in zip(named, pages))
    assert by_all == 0


def test_pages_equal_the_documents_they_were_made_from(spark):
    """Heading and lines of a document, for all pages of sf0.1."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    known = {tuple(x for x in (" ".join(line.split()) for line in (r["text"] or "").split("\n")) if x) for r in rows}
    pages = html_text.op6_main_text(spark, sf).collect()
    assert len(pages) == 2500
    assert [r["page_id"] for r in pages if tuple(r["text"].split("\n")[1:]) not in known] == []


@pytest.mark.parametrize(
    "html",
    [
        "<p " + "x" * (1 << 20) + ">y", "<p a" + " " * (1 << 20) + ">y", "<p " + "a= " * 300_000 + ">y", "<p " + "hidden-" * 150_000 + ">y",
        "<div>" * 80_000 + "</b></section>" * 70_000 + "y", "y<script>" + "</script " * 110_000, "<table><tr>" + "<div>" * 100_000 + "<td></td>" * 50_000 + "y",
        "<article><header>" + "<div>" * 50_000 + "<h2>y" * 100_000, '<a b="' * 170_000 + '"><p>y', "<" * (1 << 20) + "<p>y", "<p>y" * 250_000,
    ],
    ids=lambda html: html[:12],
)
def test_a_megabyte_of_broken_markup_takes_seconds(html):
    before = time.process_time()
    assert html_text.main_text(html).endswith("y")
    assert time.process_time() - before < 10


def verdict(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h + p), len(h), a == "block", h + p, a)
        for h, p, a in rules
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "example.com", "org", "q.org", "", "EXAMPLE.net", "example.net."]
    paths = ["", "/", "/en/", "/en/1", "/de/2?x=/en/", "/fr/#top", "?q", "#f", "/EN/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "x://", "://"] + ["http://hot.example.net/en/"] * 300
    rules = [*url_rules.RULES, ("a.example.net", "/", "block"), ("", "/fr/", "block"), ("net", "/en/", "block"), ("net", "/en/", "allow")]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, part string")
    out = url_rules.url_verdicts(frame, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(urls[r["page_id"]], rules)
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.url_verdicts(none, spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 900), (901, 902), (902, 901)]
    rng.shuffle(edges)
    out = components(spark.createDataFrame(edges, "x long, y long"), Scratch(spark, "test"), "c").collect()
    expected = {i: 0 for i in range(1, 201)} | {500 + i: 500 for i in range(1, 60)} | {902: 901}
    assert {r["node"]: r["root"] for r in out} == expected and len(out) == len(expected)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 16))
    family = base[0] + 0.05 * rng.standard_normal((150, 16))
    pairs = base[50:70] + 0.1 * rng.standard_normal((20, 16))
    x = np.concatenate([base, family, pairs, base[:3], base[10:11] * 2]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    frame = spark.createDataFrame([*rows, *odd, rows[5], (None, rows[0][1])], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    expected = {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))}
    expected |= {i: (0, i) for i in range(9000, 9006)} | {9006: (1, 9006), 9007: (1, 9006)}
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    monkeypatch.setattr(embed_dedup, "PART", 30)
    out = embed_dedup.link_vectors(frame).collect()
    assert len(out) == len(rows) + len(odd) + 2
    for r in out:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == expected[r["vec_id"]]
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert embed_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def links_and_components(x):
    """id: (n_links, component) by brute force."""
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label, new = None, np.arange(len(x))
    while label is None or (new != label).any():
        label = new
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
    return {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))}


def vectors_found(frame):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.link_vectors(frame).collect()}


def test_a_large_group_does_not_hide_lost_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 32))
    family = base[0] + 0.02 * rng.standard_normal((200, 32))
    x = np.concatenate([base, base[20:60] + 0.02 * rng.standard_normal((40, 32)), family])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    descend = embed_dedup._descend

    def only_family(graph, *rest):
        """Links outside the large group are never found."""
        return descend(graph, *rest).where("u >= 160 and v >= 160")

    monkeypatch.setattr(embed_dedup, "_descend", only_family)
    monkeypatch.setattr(embed_dedup, "ROUNDS", 1)
    monkeypatch.setattr(embed_dedup, "PIVOTS", 100)
    assert vectors_found(frame) == links_and_components(x)


def test_pairs_in_a_dense_topic(spark, monkeypatch):
    """Leaves of the topic are cut; its pairs have one link each, and neither descent nor audit helps."""
    rng = np.random.default_rng(6)
    topic = 1.7 * rng.standard_normal(64) + rng.standard_normal((3000, 64))
    x = np.concatenate([topic, topic[:150] + 0.7 * rng.standard_normal((150, 64))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embed_dedup, "PIECE", 32)
    monkeypatch.setattr(embed_dedup, "TURNS", 0)
    monkeypatch.setattr(embed_dedup, "_recall", lambda *_: 1.0)
    expected = links_and_components(x)
    assert sum(n > 0 for n, _ in expected.values()) > 100
    assert vectors_found(frame) == expected


def test_vectors_with_a_common_direction(spark):
    """All cosines are around 0.55, of groups and pairs above 0.9; nothing is patched."""
    rng = np.random.default_rng(11)
    base = 1.1 * np.ones(32) + rng.standard_normal((2500, 32))
    groups = [base[i] + 0.25 * rng.standard_normal((n, 32)) for i, n in ((0, 300), (1, 40), (2, 8), (3, 3))]
    x = np.concatenate([base, *groups, base[100:250] + 0.45 * rng.standard_normal((150, 32))])
    frame = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id int, embedding array<double>, id string, n int")
    report = {}
    out = embed_dedup.link_vectors(frame, report=report)
    assert out.schema["vec_id"].dataType == out.schema["component_id"].dataType == frame.schema["vec_id"].dataType
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = {i: n - 1 for i, n in enumerate((u @ u.T >= 0.9).sum(1))}
    found = {r["vec_id"]: r["n_links"] for r in out.collect()}
    linked = [i for i in true if true[i]]
    assert all(found[i] <= true[i] for i in true)
    assert np.mean([found[i] / true[i] for i in linked]) > 0.99
    assert report["with_links"] >= 50 and report["recall"] >= embed_dedup.TARGET


def test_pivots_that_run_out(spark, monkeypatch):
    """A long chain of vectors, each linked to some neighbours: those without a pivot are compared with all."""
    rng = np.random.default_rng(4)
    x = [rng.standard_normal(12)]
    for _ in range(700):
        x.append(x[-1] / np.linalg.norm(x[-1]) + 0.1 * rng.standard_normal(12) / np.sqrt(12) * 1.5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embed_dedup, "PIVOT_TURNS", 1)
    expected = links_and_components(np.array(x))
    assert np.mean([n for n, _ in expected.values()]) > 5
    assert vectors_found(frame) == expected


def test_groups_that_only_meet_beyond_their_lists(spark):
    """Two groups of near copies, all pairs of which are linked, though the lists of each hold only its own."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal(32)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(32)
    b -= (a @ b) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
    x = np.concatenate([rng.standard_normal((300, 32)), a + 0.004 * rng.standard_normal((200, 32)), b + 0.004 * rng.standard_normal((150, 32))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    expected = links_and_components(x)
    assert expected[300] == (349, 300) and expected[649] == (349, 300)
    assert vectors_found(frame) == expected


def test_sparse_links_are_measured_on_planted_pairs(spark, monkeypatch):
    """30 pairs at cosine 0.9 to 0.93 among 12,000 vectors: an audit meets too few of them, so planted pairs are measured."""
    monkeypatch.setattr(embed_dedup, "AUDIT", 1024)
    monkeypatch.setattr(embed_dedup, "MOST_AUDITED", 1024)
    rng = np.random.default_rng(21)
    x = rng.standard_normal((12_000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(30):
        d = rng.standard_normal(48)
        d -= (d @ x[i]) * x[i]
        c = 0.901 + 0.001 * i
        x[-1 - i] = c * x[i] + math.sqrt(1 - c * c) * d / np.linalg.norm(d)
    report = {}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(frame, report=report).collect()}
    true = {i: int(n) - 1 for i, n in enumerate((x @ x.T >= 0.9).sum(1))}
    assert found == true and sum(true.values()) >= 60
    assert report["planted"] and report["recall"] >= embed_dedup.TARGET


def test_links_too_rare_for_an_audit(spark, monkeypatch):
    """With a target that trees alone don't reach, all vectors are compared at the end."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 24))
    x[:3] = x[3:6] + 0.01
    monkeypatch.setattr(embed_dedup, "AUDIT", 16)
    monkeypatch.setattr(embed_dedup, "MOST_AUDITED", 64)
    monkeypatch.setattr(embed_dedup, "PLANTED_ROUNDS", 2)
    monkeypatch.setattr(embed_dedup, "TARGET", 1.1)
    report = {}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(frame, report=report).collect()}
    assert 0 < report["recall"] <= 1
    assert (report["planted"], report["rounds"], report["audited"], report["swept"]) == (True, 2, 64, True)
    assert sum(found.values()) == 6
    with pytest.raises(TypeError):
        embed_dedup.link_vectors(frame.withColumn("vec_id", frame["vec_id"].cast("string")))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def poisson_copies(seed, ident, rate):
    """The inverse of the Poisson distribution at a hashed number, by plain summation."""
    draws = max(1, math.ceil(rate / mixing.LARGEST_RATE))
    r, n = rate / draws, 0
    for i in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{ident}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-r)
        k = 0
        while c <= u and k < r + 12 * math.sqrt(r) + 30:
            k += 1
            p *= r / k
            c += p
            n += 1
    return n


def pipeline_by_brute_force(spark, docs, labels):
    """(row without ids, ids) of each row of the result."""
    sentencepiece = pytest.importorskip("sentencepiece")
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    accepted = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    rows = [r.asDict() for r in docs.collect() if r["doc_id"] in accepted]
    low = lambda r: -math.inf if r["doc_id"] is None else r["doc_id"]
    by_text = {}
    for r in sorted(rows, key=lambda r: (low(r), [str(v) for v in reversed(r.values())])):
        by_text[r["text"] or ""] = r
    rows = list(by_text.values())
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and rows[i]["doc_id"] is not None and rows[j]["doc_id"] is not None:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(least.get(g, low(r)), low(r))
    rows = [r for g, r in zip(group, rows) if low(r) == least[g]]
    n = collections.Counter(r["source"] for r in rows)
    out = []
    for r in rows:
        ident = "null" if r["doc_id"] is None else r["doc_id"]
        for _ in range(poisson_copies(42, ident, len(rows) / len(n) / n[r["source"]])):
            out.append((tuple(v for k, v in r.items() if k != "ids"), tuple(public.encode(r["text"] or ""))))
    return sorted(out, key=str)


def pipeline_rows(frame):
    return sorted(((tuple(v for k, v in r.asDict().items() if k != "ids"), tuple(r["ids"])) for r in frame.collect()), key=str)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    expected = pipeline_by_brute_force(spark, docs, labels)
    assert expected and pipeline_rows(corpus_pipeline.run(spark, SF)) == expected


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names."""
    import corpus_pipeline

    rng = random.Random(3)
    words = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n)]
    base = words(60)
    texts = [None, "", "", " \n", "one", "One", " ".join(base), " ".join(base), " ".join([*base[:-1], "x"]), " ".join(words(30_000)), "日本 é " + " ".join(words(9))]
    texts += [" ".join(words(rng.randint(3, 50))) for _ in range(40)]
    rows = [(i if i % 9 else None, t, ["a", "b", None][i % 3], "g", "c", i, "s", "t") for i, t in enumerate(texts)]
    rows += [rows[7], rows[20], (20, "another text of id twenty", "a", "g", "c", 1, "s", "t")]
    schema = "doc_id long, text string, source string, gone string, copy string, `__id` long, row string, ids string"
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, 1 if i % 7 else None) for i in range(50)], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == docs.columns
    expected = pipeline_by_brute_force(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    assert expected and pipeline_rows(out) == expected


def test_pipeline_leaves_its_result_alone(spark):
    """What stages wrote on their way is gone; no table stays in the catalog."""
    from pathlib import Path

    import corpus_pipeline
    from quarrylight.llm.scratch import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:").replace("//", "/")) / "quarrylight"
    before, tables = set(folder.iterdir()) if folder.exists() else set(), {t.name for t in spark.catalog.listTables()}
    out = corpus_pipeline.run(spark, SF)
    (left,) = set(folder.iterdir()) - before
    assert left.name.startswith("pipeline-") and [x.name for x in left.iterdir() if x.is_dir()] == ["stage-4"]
    assert {t.name for t in spark.catalog.listTables()} == tables and out.count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quarrylight.llm.scratch import shared_folder

    none = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_url_rules_with_many_paths_of_one_host(spark):
    rng = random.Random(2)
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 7)))
    rules = [("h.net", path(), rng.choice(["allow", "block"])) for _ in range(300)] + [("net", "/a", "block")]
    urls = [f"http://{rng.choice(['', 'x.'])}h.net{path()}" for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.url_verdicts(frame, spark.createDataFrame(rules, "host string, path string, action string")).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(urls[r["page_id"]], rules)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        kept = after.toPandas()
        assert set(kept["doc_id"]) <= ids, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns, name
        else:
            assert len(kept) == before.count()
        before = after
    assert corpus_pipeline.run(spark, SF).count() == len(kept)
