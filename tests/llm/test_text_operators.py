"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quarrylight.llm import chat_threads, exact_dedup, mixing, near_dedup, pieces, quality, repeats, wordhash
from quarrylight.llm.scratch import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("id", T.StringType()),  # names that operators use themselves
        T.StructField("n", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("rate", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def some_texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(40)
    texts = [None, None, "", "", " \t\n", "one", "one two", "One  two", "one two three", "x" * 5000, "wort " * 3000]
    texts += [text(rng.randint(1, 90)) for _ in range(40)]
    texts += [base] * 7 + [text(9) + " " + passage + "\n" + text(5) for _ in range(5)] + [passage, passage + " " + passage]
    for edits in (1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["ñ 日本 é\x00 " + text(30), "Ñ 日本 é " + text(30)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, "a", None, "b", "c", ["s0", "s1", None][i % 3]) for i, t in enumerate(some_texts())]
    rows += [rows[12], rows[60], (None, "one two three four five six", "z", "z", "z", "z", "s1"), (None, None, "z", "z", "z", "z", "s1")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_exact_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == len({(i, t or "") for i, t in rows})
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_sha[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)


def test_exact_dedup_keeps_one_row_of_each_text(docs):
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [t or "" for t in kept.toPandas()["text"]]
    assert sorted(texts) == sorted({r["text"] or "" for r in docs.collect()})


def test_the_same_batch_again_gives_the_same_rows(spark, docs):
    """As after a driver that was lost before its caller had written anything, or while it appended."""
    scratch = Scratch(spark, "test")
    index = exact_dedup.new_index(docs, scratch, "doc_id")
    try:
        exact_dedup.exact_dedup(docs.where("doc_id < 20"), index=index)
        first = sorted(map(tuple, exact_dedup.exact_dedup(docs, index=index).fillna("").collect()), key=str)
        size = index.rows().count()
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs.repartition(5), index=index).fillna("").collect()), key=str) == first
        exact_dedup.exact_dedup(docs.where("doc_id > 20"), index=index)
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs, index=index).fillna("").collect()), key=str) == first
        assert index.rows().count() == size
        assert len({r["text_sha256"] for r in exact_dedup.exact_dedup(docs, index=index).where("kept").collect()}) > 20
    finally:
        index.drop()


def test_no_table_stays_in_the_catalog(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


CLASHING = "id long, doc_id long, text string, source string, `__n` long, `__source` string, `__digest` string, `__id` long, gone long, mid long, row long, copy string, n long, digest string, `a.b` string, again string, place string, ident string, ids string"


@pytest.fixture(scope="module")
def clashing(spark):
    base = " ".join(f"w{k}" for k in range(40))
    texts = [base, base, base + " x", "one", None, "", "two words", "two words"]
    rows = [(9 - i, i % 7, t, ["s", "r", None][i % 3], 7, "q", "d", 5, 6, 7, 8, "c", 1, "e", "f", str(i), "h", "i", "j") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], rows[6]], CLASHING)


def test_columns_pass_whatever_their_names(spark, clashing):
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    kept = [
        exact_dedup.keep_one_of_each(clashing), near_dedup.keep_one_of_each(clashing), quality.drop_rejected(clashing, labels),
        mixing.mix_sources(clashing, copy_col=None), mixing.mix_sources(clashing).drop("copy"), pieces.encode(clashing).drop("ids"),
        pieces.decode(pieces.encode(clashing, ids_col="new"), ids_col="new").drop("new"),
    ]
    before = {tuple(r.asDict().items()) for r in clashing.collect()}
    for out in kept:
        missing = set(clashing.columns) - set(out.columns)
        assert missing <= {"copy", "ids", "text"}
        rows = [tuple((k, v) for k, v in r.asDict().items() if k != "text") for r in out.collect()]
        assert rows
        for r in rows:
            assert any(set(r) <= set(b) for b in before)
    for out in (
        exact_dedup.exact_dedup(clashing), near_dedup.near_duplicates(clashing), repeats.remove_repeats(clashing), quality.score_quality(clashing, labels),
    ):
        assert out.select("doc_id").count() > 0
    texts = [r["text"] or "" for r in exact_dedup.keep_one_of_each(clashing).collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in clashing.collect()})


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(1, "t", f"v{i}") for i in range(50)] + [(1, "t", None), (2, "u", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, other string")
    kept = [sorted(map(tuple, exact_dedup.keep_one_of_each(frame.repartition(n, "other")).collect())) for n in (1, 5, 9)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_digest_index_knows_earlier_batches(spark, docs):
    scratch = Scratch(spark, "test")
    index = exact_dedup.new_index(docs, scratch, "doc_id")
    first = exact_dedup.exact_dedup(docs.where("doc_id < 50"), index=index).where("kept").collect()
    second = exact_dedup.exact_dedup(docs, index=index).collect()
    known = {r["text_sha256"]: r["doc_id"] for r in first}
    for r in second:
        if r["text_sha256"] in known:
            assert (r["keep_id"], r["kept"]) == (known[r["text_sha256"]], False)
    assert index.rows().count() == len({r["text_sha256"] for r in second})
    again = exact_dedup.DigestIndex(spark, index.table + "_again", index.location, index.buckets)
    assert again.rows().count() == index.rows().count()


def thue_morse(n):
    """Two strings of 2**n letters that polynomial fingerprints modulo 2**64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_names_of_words_and_runs():
    import pyarrow as pa

    a, b = thue_morse(10)
    (w,) = wordhash.words(pa.array([a, b, " ".join(a), " ".join(b), None, "x" * 65, "x" * 66, "ab c", "a bc", "\0", "\0\0"]))
    for lane in (0, 1):
        names, whole = w.names(lane), w.whole(lane)
        assert names[0] != names[1]
        assert len(set(whole.tolist())) == 11
        at, runs = w.runs(20, lane)
        raw = w.data.tobytes()
        text = [raw[w.starts[i] : w.ends[i + 19]] for i in at]
        assert len(set(zip(text, runs.tolist()))) == len(set(text)) == len(set(runs.tolist()))


def repeats_by_brute_force(rows):
    """id: what may come out for it (n_words, n_removed, kept_sha256)."""
    rows = sorted({(-(10**9) if i is None else i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or ""))
    words = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    seen, expected = {}, {}
    for i, w in words:
        for s in range(len(w) - 19):
            seen[tuple(w[s : s + 20])] = min(seen.get(tuple(w[s : s + 20]), (i, s)), (i, s))
    for i, w in words:
        gone = set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] < (i, s):
                gone.update(range(s, s + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.setdefault(i, set()).add((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return expected


def check_repeats(frame, **options):
    expected = repeats_by_brute_force([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    out = repeats.remove_repeats(frame, **options).collect()
    assert len(out) == frame.count()
    for r in out:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) in expected[-(10**9) if r["doc_id"] is None else r["doc_id"]]
        if r["kept_text"] is not None:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
            assert sum(x["last"] - x["first"] + 1 for x in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize(("group", "forest", "most"), [(1, 16_384, 0), (3, 5, 0), (50, 40, 1000), (4096, 16_384, 1000)])
def test_repeats(docs, monkeypatch, group, forest, most):
    """Groups of any size, split by longer prefixes or not, and forests of one group or many."""
    monkeypatch.setattr(repeats, "BROADCAST_IDS", most)
    monkeypatch.setattr(repeats, "FOREST", forest)
    check_repeats(docs, group=group)


@pytest.mark.parametrize("group", [2, 4096])
def test_repeats_of_a_shared_passage(spark, group):
    """A passage between different words, at every offset; one text many times over; words that only differ by structure."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
    passage = [word() for _ in range(55)]
    a, b = thue_morse(10)
    rows = []
    for i in range(60):
        head, tail = [word() for _ in range(rng.randint(0, 25))], [word() for _ in range(rng.randint(0, 25))]
        lo, hi = sorted(rng.sample(range(56), 2))
        rows.append((i, " ".join(head + passage[lo:hi] + tail)))
    rows += [(100, " ".join(passage * 30)), (101, " ".join(["x"] * 400)), (102, "y " + " ".join(["x"] * 300)), (103, None), (104, " ".join(passage) * 2)]
    q = [f"q{k}" for k in range(25)]
    rows += [(105, " ".join([a, *q])), (106, " ".join([b, *q])), (107, " ".join(a)), (108, " ".join(b)), (None, " ".join(passage))]
    rows += [(7, " ".join([word() for _ in range(30)] + passage))]  # an id with two texts
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), group=group)


def test_repeats_of_other_ids(spark):
    frame = spark.createDataFrame([(i, " ".join(map(str, range(30)))) for i in range(3)], "doc_id int, text string")
    out = repeats.remove_repeats(frame)
    assert out.schema["doc_id"].dataType == T.IntegerType()
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {0: 0, 1: 30, 2: 30}
    with pytest.raises(TypeError):
        repeats.remove_repeats(frame.withColumn("doc_id", frame["doc_id"].cast("string")))


def shingle_set(text, n):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, shingle, percent):
    rows = docs.where("doc_id is not null").select("doc_id", "text").distinct().collect()
    sets = {r["doc_id"]: shingle_set(r["text"], shingle) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = near_dedup.near_duplicates(docs, shingle=shingle, percent=percent).collect()
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            c = find(r["doc_id"])
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), c, c == r["doc_id"])


def test_near_duplicates_of_structured_words(spark):
    """Sets of one shingle each, which polynomial fingerprints take for equal."""
    a, b = thue_morse(10)
    frame = spark.createDataFrame([(1, a), (2, b), (3, a), (4, " ".join(a[:200])), (5, " ".join(b[:200]))], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, shingle=3, percent=85).collect()}
    sets = {i: shingle_set(" ".join(x[:200]), 3) for i, x in ((4, a), (5, b))}
    same = 100 * len(sets[4] & sets[5]) >= 85 * len(sets[4] | sets[5])
    assert out == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4 if same else 5}


def test_near_duplicates_finish_buckets_with_several_components(docs, monkeypatch):
    """Small blocks and chunks: the same links."""
    before = {tuple(r) for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 1)
    monkeypatch.setattr(near_dedup, "CHUNK", 2)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()} == before


def test_pairs_at_the_threshold_share_a_band(spark):
    """20,000 pairs with 8 of 10 shingles in common: 20 bands of 5 miss two of them."""
    rng = np.random.default_rng(8)
    rows = []
    for i, words in enumerate(rng.integers(10**9, 10**10, (20_000, 14)).tolist()):
        rows += [(2 * i, " ".join(map(str, words[1:]))), (2 * i + 1, " ".join(map(str, [words[0], *words[2:]])))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, percent=80)
    assert [r["doc_id"] for r in out.where("component_id <> doc_id - doc_id % 2").collect()] == []


def test_pieces_equal_the_public_library_and_decode(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = pieces.encode(docs)
    assert set(coded.columns) == {*docs.columns, "ids"}
    for r in coded.collect():
        assert r["ids"] == public.encode(r["text"] or "")
    for r in pieces.decode(coded, text_col="back").collect():
        assert r["back"] == (r["text"] or "")


def test_stretches_with_one_name_keep_their_ids(monkeypatch):
    """Names only propose; characters decide.  Also across batches."""
    import pyarrow as pa

    sentencepiece = pytest.importorskip("sentencepiece")
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    a, b = thue_morse(10)
    texts = [a, b, " ".join((a, b, a[:40], b[:40])), "the same words and other words", "", "日本 the é"]
    for names in (pieces.byte_names, lambda data, starts, ends: np.zeros(len(starts), np.uint64)):
        monkeypatch.setattr(pieces, "byte_names", names)
        v = pieces.Vocabulary.load(pieces.MODEL)
        for batch in (texts[:1], texts, texts[::-1]):
            ids, at = pieces.encode_batch(pa.array(batch), v)
            assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == public.encode(batch)


def test_pieces_on_random_texts():
    import pyarrow as pa

    sentencepiece = pytest.importorskip("sentencepiece")
    public, v = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Vocabulary.load(pieces.MODEL)
    rng = random.Random(9)
    alphabet = "abcde theinr\n\t é日🎉0123.,▁<>x|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(600)] + ["ab" * 300, "a" * 999, " " * 70]
    ids, at = pieces.encode_batch(pa.array(texts), v)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == public.encode(texts)
    with pytest.raises(ValueError):
        pieces.decode_batch(pa.array([[10**6]], pa.list_(pa.int32())), v)


def test_quality(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) + "."
    bad = [
        lambda: " ".join([rng.choice(words)] * rng.randint(10, 60)),
        lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(10, 60))),
    ]
    rows, labels = [], []
    for i in range(900):
        q = rng.random() < 0.7
        rows.append((i, good() if q else rng.choice(bad)()))
        labels.append((i, int(q)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "a"), (3, rows[3][1])], "doc_id long, text string")
    out = quality.score_quality(docs, spark.createDataFrame([*labels, (5, None)], "doc_id long, quality int")).collect()
    assert len(out) == 904
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    kept = quality.drop_rejected(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns


def test_quality_equals_a_direct_fit(spark):
    """Sums over partitions, in several lots, against the normal equations and the isotonic fit of all rows at once."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.5
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words) if good or rng.random() < 0.2 else " ".join(words[:3] * 9).upper() + "!!"))
        labels += [(i, int(good))] * (1 + (i % 50 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    stats = {r["id"]: np.array(r["stats"], np.float64) for r in quality.extract(docs, "doc_id", "text").collect()}
    x = np.array([stats[i] for i in range(400)])
    centre = x.mean(0)
    scale = np.sqrt(np.maximum((x * x).mean(0) - centre**2, 0)) + 1e-3
    crc = lambda t: zlib.crc32(t.encode())
    learn = [(i, y) for i, y in labels if crc(str(i)) % 5]
    own, y = np.array([i for i, _ in learn]), np.array([y for _, y in learn], float)
    fold = np.array([crc(f"fold:{i}") % quality.FOLDS for i in own])
    z = quality.fourier((x - centre) / scale)

    def solve(rows, penalty):
        a = z[own[rows]]
        ridge = np.eye(a.shape[1]) * penalty * max(len(a), 1)
        ridge[-1, -1] = 1e-9
        return np.linalg.solve(a.T @ a + ridge, a.T @ y[rows])

    def out_of_fold(penalty):
        return [solve(fold != f, penalty) for f in range(quality.FOLDS)]

    best = min(quality.PENALTIES, key=lambda p: sum(((z[own[fold == f]] @ b - y[fold == f]) ** 2).sum() for f, b in enumerate(out_of_fold(p))))
    crossed = np.array([z[i] @ out_of_fold(best)[f] for i, f in zip(own, fold)])
    at = np.clip(((crossed + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(at)
    weight = np.array([(at == b).sum() for b in bins])
    mean = np.array([y[at == b].mean() for b in bins])
    fitted = [max(min(np.average(mean[lo:hi], weights=weight[lo:hi]) for hi in range(k + 1, len(bins) + 1)) for lo in range(k + 1)) for k in range(len(bins))]
    raw = z @ solve(np.ones(len(own), bool), best)
    tie = 1 / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50)))
    expected = np.clip(0.999 * np.interp(raw, (bins + 0.5) / quality.BINS * 2 - 0.5, fitted) + 0.001 * tie, 0, 1)
    assert np.abs(expected - [scores[i] for i in range(400)]).max() < 1e-5


def test_quality_takes_the_cut_itself_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_000_000), (3, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels, cut=1.0).collect()
    assert [r["predicted"] for r in out if r["score"] == 1.0] == [1] * sum(r["score"] == 1.0 for r in out)
    assert {r["doc_id"] for r in out} == {1, 2, 3}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(r["score"], 2) for r in quality.score_quality(docs, none).collect()] == [0.5, 0.5]


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0.0, 2.0, 1.0]), np.ones(4)).tolist() == [0.5, 0.5, 1.5, 1.5]
    assert quality.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_mixing(spark, docs):
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), (None, 0.0), ("s9", 5.0)], "source string, weight double")
    out = mixing.mix_sources(docs, weights, total=4000).toPandas()
    assert set(out["source"]) == {"s0", "s1"}
    share = (out["source"] == "s0").mean()
    assert 0.7 < share < 0.8 and 3600 < len(out) < 4400
    assert (out.groupby(["doc_id", "text", "source"], dropna=False)["copy"].min() == 1).all()
    again = mixing.mix_sources(docs.repartition(7), weights, total=4000).toPandas()
    order = ["doc_id", "text", "source", "copy"]
    assert out.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


@pytest.mark.parametrize("most", [0, 10_000])
def test_mixing_sorts_and_merges_many_sources(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    frame = spark.createDataFrame([(i, "x", f"s{i % 9}" if i % 10 else None) for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s1", 1.0), ("s1", 1.0), ("s2", 1.0), (None, 1.0), ("s3", None), ("s4", -1.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.mix_sources(frame, weights, total=8000).groupBy("source").count().collect()}
    assert set(n) == {"s1", "s2", None}
    assert 3700 < n["s1"] < 4300 and 1800 < n["s2"] < 2200 and 1800 < n[None] < 2200


def test_mixing_draws_large_rates_in_parts(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(40)], "doc_id long, text string, source string")
    n = mixing.mix_sources(docs, total=8000).groupBy("doc_id").count().toPandas()["count"]
    assert 190 < n.mean() < 210 and 8 < n.std() < 21


def test_chats(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks."), (1, 2, " ", "Unrelated"),
        (1, 3, "user", "> > How are you?\n> Fine, thanks.\nGood."), (1, 4, None, ">>> nothing known\nx"), (1, 5, "User", "> Unrelated\n\nok\n"),
        (2, 0, "user", "> a\nb"), (2, 0, "user", "> a\nb"), (2, 1, "user", ">b\nc"), (3, None, "user", "x"), (None, 1, "user", None),
    ]
    out = chat_threads.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["place"])
    assert [(r["turn"], r["reply_to"], r["root"], r["depth"]) for r in one] == [
        (0, None, 0, 0), (1, 0, 0, 1), (3, 1, 0, 2), (2, None, 2, 0), (5, 2, 2, 1), (4, None, 4, 0),
    ]
    assert [r["place"] for r in one] == [1, 2, 3, 4, 5, 6]
    assert one[1]["chat"] == "<|im_start|>assistant\nFine, thanks.<|im_end|>\n"
    assert len(out) == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_chats_equal_the_sql_on_quotes(spark, seed):
    """Several levels, ties, null turns and conversations, repeated rows, long texts, clashing names."""
    duckdb = pytest.importorskip("duckdb")
    pd = pytest.importorskip("pandas")
    rng = random.Random(seed)
    said = ["Hello there", "How are  you?", "fine, thanks.", "a\nb", "b", "same words", "long " * 20_000, ""]
    rows = []
    for conv in [None, 1, 2, 3, 4, 5]:
        messages: list[str] = []
        for turn in range(rng.randint(1, 9)):
            text = "\n".join(rng.choice(said) for _ in range(rng.randint(0, 3)))
            if messages and rng.random() < 0.7:
                quoted = rng.choice(messages)
                mark = rng.choice(["> ", ">", " > "])
                text = "\n".join(mark + line.upper() if rng.random() < 0.2 else mark + line for line in quoted.split("\n")) + "\n" + text
                if rng.random() < 0.3:
                    text += "\n> " + rng.choice(said).split("\n")[0]
            messages.append(text)
            rows.append((conv, None if rng.random() < 0.1 else turn, rng.choice(["user", " Assistant ", "", None]), text if rng.random() < 0.95 else None))
    rows += rng.sample(rows, 3) + [(1, 1, "user", "> same words"), (1, 1, "user", "zz")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, root string")
    con = duckdb.connect()
    con.register("rows", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM rows")
    expected = con.execute(chat_threads.OP4_SQL).fetchall()
    names = [d[0] for d in con.description]
    out = chat_threads.format_chats(frame).select(*names).collect()
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    assert any(r["reply_to"] is not None for r in out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (
        exact_dedup.exact_dedup(none), exact_dedup.keep_one_of_each(none), repeats.remove_repeats(none), near_dedup.near_duplicates(none),
        pieces.encode(none), quality.score_quality(none, labels), mixing.mix_sources(none), chat_threads.format_chats(chats),
    ):
        assert out.count() == 0


@pytest.mark.parametrize("same_id", [None, 7])
def test_five_thousand_rows_of_one_id(spark, same_id):
    """Rows that share an id are joined by their texts too: each has its own lists."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(n))
    passages = [text(40) for _ in range(40)]
    texts = [text(rng.randint(5, 60)) + " " + rng.choice(passages) + " " + text(20) for _ in range(5000)]
    rows = [(same_id, t) for t in texts]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), with_text=False).collect()
    first = {}
    words = [t.split() for t in texts]
    for w in words:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, i), i)
    want = []
    for w in words:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < i:
                gone.update(range(i, i + 20))
        want.append((len(w), len(gone)))
    assert sorted((r["n_words"], r["n_removed"]) for r in out) == sorted(want)
