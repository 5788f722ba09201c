"""Importance resampling and byte repeats against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrylight.llm import byte_repeats, resample

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghABCé日") for _ in range(rng.randint(1, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# ---- importance resampling ----

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    runs = [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r) % 10000 for r in runs]


def expected_rows(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, x in docs:
        n, own = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def by_all(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def documents():
    texts = [None, "", " .,- ", "one", "One two", "ÀB cd", "a\x00b c_d", "w " * 30_000] + [prose(rng.randint(1, 90)) for _ in range(300)]
    rows = [(None if i % 19 == 0 else i % 211, t) for i, t in enumerate(texts)]
    return rows + [rows[40]] * 5 + [(None, texts[30])] * 3


def test_resample_equals_brute_force(spark, documents):
    target = [prose(40) for _ in range(20)] + [None, "", documents[50][1]]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in documents], "doc_id long, text string, score string, id string, rank int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 50, 100):
        out = resample.resample(df, goal, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert by_all(map(tuple, out)) == by_all(expected_rows(documents, target, percent))


def test_the_drawn_documents_keep_their_columns(spark, documents):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in documents], "doc_id long, text string, id string, row string")
    goal = spark.createDataFrame([("one two three",)], "text string")
    ids = {r[0] for r in expected_rows(documents, ["one two three"], 20) if r[4]}
    kept = resample.draw(df, goal, percent=20)
    assert kept.columns == df.columns
    assert by_all(map(tuple, kept.collect())) == by_all((i, t, "a", "b") for i, t in documents if i in ids)


def test_resample_of_empty_tables(spark, documents):
    docs, none = spark.createDataFrame(documents[:40], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none.select("text")).count() == 0
    out = resample.resample(docs, none.select("text")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert by_all(map(tuple, out)) == by_all(expected_rows(documents[:40], []))


def test_equal_rows_have_consecutive_ranks(spark):
    """A third of all rows are one document: they share the ranks that their number gives."""
    rows = [(7, "the same words " * 10)] * 400 + [(i, prose(30)) for i in range(800)]
    out = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the same words",)], "text string"), percent=60).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"])
    assert ranks == list(range(1, 721))
    same = sorted(r["rank"] for r in out if r["doc_id"] == 7 and r["n_features"] == 87 and r["rank"])
    assert same == list(range(same[0], same[0] + len(same)))


# ---- byte repeats ----


def removed(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if gone.any() else None))
    return out


@pytest.fixture(scope="module")
def texts():
    passages = [prose(60), prose(45), prose(80), "x" * 700, "ab" * 400, prose(30), "\x00" * 300, "日本語" * 100]
    out = [None, None, "", "a", "y" * 199, "z" * 200, "z" * 200, "q" * 201, "日本語" * 90, "é" * 100 + "e" * 99]
    for _ in range(150):
        t = prose(rng.randint(1, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randrange(len(p) // 3) : len(p) - rng.randrange(len(p) // 3)] + prose(rng.randint(0, 30))
        out.append(t)
    return out + [out[20]] * 4 + [out[30] + "!"]


@pytest.mark.parametrize(("window", "group"), [(200, 4096), (200, 3), (60, 4096)])
def test_byte_repeats_equal_brute_force(spark, texts, window, group):
    rows = [(None if i % 17 == 0 else i % 60, t, "k", "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, copies string, s string").repartition(3)
    out = byte_repeats.remove_repeated_bytes(df, window=window, group=group).collect()
    want = [(i, *w) for (i, *_), w in zip(rows, removed(texts, window))]
    assert by_all((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept_bytes"] and bytes(r["kept_bytes"]) or None) for r in out) == by_all(
        (*w[:5], w[5] or None) for w in want
    )
    for r in out:
        assert (r["spans"] is None) == (r["n_removed"] == 0)
        assert r["spans"] is None or (len(r["spans"]), sum(s["number"] for s in r["spans"])) == (r["n_spans"], r["n_removed"])


def test_prefix_free_parsing_finds_what_comparing_finds():
    for seed in range(30):
        r = random.Random(seed)
        base = bytes(r.choice(b"abc") for _ in range(500)) if seed % 3 else b"ab" * 250
        texts, wins = [], []
        for _ in range(r.randint(1, 40)):
            a, n = r.randrange(280), r.randint(1, 20)
            piece = bytearray(base[a : a + 199 + n])
            for _ in range(r.randint(0, 2)):
                piece[r.randrange(len(piece))] = r.choice(b"abc\x00\xff")
            texts.append(bytes(piece)), wins.append(n)
        windows = [t[i : i + 200] for t, n in zip(texts, wins) for i in range(n)]
        seen = Counter(windows)
        assert byte_repeats.repeated_windows(texts, np.array(wins), 200).tolist() == [seen[w] > 1 for w in windows]


def test_dictionary_and_parse_orders_are_those_of_their_suffixes():
    r = random.Random(5)
    phrases = sorted({bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 300))) for _ in range(40)})
    rank, begin = byte_repeats.dictionary_order(phrases, 200)
    suffixes = [(p[i:][:224], rank[begin[k] + i]) for k, p in enumerate(phrases) for i in range(len(p))]
    by_rank = [s for s, _ in sorted(suffixes, key=lambda x: x[1])]
    assert by_rank == sorted(s for s, _ in suffixes)
    parse = np.array([3, 1, 3, 1, 2, 3, 1])
    order = byte_repeats.parse_order(parse, np.arange(7) * 10, np.full(7, 7), 200)
    assert np.argsort(order, kind="stable").tolist() == sorted(range(7), key=lambda i: parse[i:].tolist())


def test_windows_are_in_stretches_or_bare():
    data = np.frombuffer((prose(300) + "x" * 900 + prose(300)).encode(), np.uint8)
    at = np.array([0, 150, 150, len(data) - 500, len(data)])
    s = byte_repeats.stretches(data, at, 200)
    first, number = byte_repeats.bare_windows(s, at, 200)
    held = sorted(x for a, n in [*zip(s["at"], s["wins"]), *zip(first, number)] for x in range(a, a + n))
    assert held == [x for a, b in zip(at, at[1:]) for x in range(a, b - 199)]
    assert (s["at"] + s["lead"] + byte_repeats.ANCHOR <= s["at"] + 200).all()


def test_byte_repeats_of_one_text_in_a_third_of_the_rows(spark):
    passage = prose(80)
    rows = [(i, passage if i % 3 == 0 else prose(20) + passage + prose(20)) for i in range(900)]
    out = byte_repeats.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=False).collect()
    n = len(passage.encode())
    assert all(r["n_removed"] == n if r["doc_id"] % 3 == 0 else r["n_removed"] >= n for r in out)
    assert byte_repeats.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
