"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A batch of texts is cut into the stretches that no piece crosses (before blanks, around characters
that no longer piece holds), and each distinct stretch is worked on once; a worker keeps the ids of a
bounded number of them for its next batches.  Stretches are found by name and then compared character
by character, so ids are only shared between equal ones.  The others are laid end to end and indexed
by a suffix array over the longest piece's length; every piece is binary-searched in it, and its range
gives all its occurrences: edges from position to position.  The edges are sorted by position and
relaxed in all stretches at once: in each round a stretch takes its edge of the best score (the
leftmost of equals) among those that span exactly two of its current symbols.  That is the order of
merges that defines BPE, so the ids are those of the public library.  Stretches of more than LONG
characters take their edges from a heap instead, in the same order.

Texts don't move between tasks.  The vocabulary, of fixed size, is sent to all.

Defined results
---------------
* Null counts as empty; an empty text has no ids, and no ids decode to the empty text.
* Decoding gives the text back, except that U+2581 in a text decodes to a blank, as the format has it.
* Ids outside the vocabulary raise an error; byte pieces that are no UTF-8 decode to U+FFFD.
* All columns pass; a column named like the new one is replaced.  Repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches
from .wordhash import byte_names, slices, sparing, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text that are indexed at once; longer stretches than LONG go through a heap.
BATCH_BYTES, LONG = 1 << 20, 48
#: Stretches of earlier batches whose ids a worker keeps, a few dozen MB at most.
REMEMBERED = 300_000
_U = np.uint64
_NEVER = np.iinfo(np.int64).max


class _Known:
    """Ids of stretches by name, up to a number, and their characters."""

    def __init__(self) -> None:
        self.names, self.lo, self.count, self.ids = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.begin, self.size, self.code = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, names: np.ndarray, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the stretches would be, whether their names are known, and whether the stretches are."""
        at = np.searchsorted(self.names, names)
        named = at < len(self.names)
        named[named] = self.names[at[named]] == names[named]
        found = named.copy()
        own = at[named]
        found[named] = _equal(code, begin[named], size[named], self.code, self.begin[own], self.size[own])
        return at, named, found

    def add(self, names: np.ndarray, ids: np.ndarray, count: np.ndarray, new: np.ndarray, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """The ``new`` ones among some stretches and their ids, one after the other."""
        keep = np.flatnonzero(new & (size <= LONG))[: max(0, REMEMBERED - len(self.names))]
        if not len(keep):
            return
        lo = np.cumsum(count) - count
        own, letters = ids[_ragged(lo[keep], count[keep])], code[_ragged(begin[keep], size[keep])]
        count, size = count[keep], size[keep]
        names = np.concatenate([self.names, names[keep]])
        order = np.argsort(names)
        self.lo = np.concatenate([self.lo, len(self.ids) + np.cumsum(count) - count])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.begin = np.concatenate([self.begin, len(self.code) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.names, self.ids, self.code = names[order], np.concatenate([self.ids, own]), np.concatenate([self.code, letters])


def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether a[at : at + size] and b[at : at + size] are equal, for each pair."""
    same = a_size == b_size
    some = np.flatnonzero(same & (a_size > 0))
    if len(some):
        size = a_size[some]
        differ = a[_ragged(a_at[some], size)] != b[_ragged(b_at[some], size)]
        same[some] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return same


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file; of the many kinds of models, those that need no further normalisation."""
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        how, rule = model.trainer_spec, model.normalizer_spec
        if how.model_type != 2 or not how.byte_fallback or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError(f"{path}: only BPE models with byte fallback and the identity normaliser are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], rule.add_dummy_prefix)

    # What follows is derived once in each worker.

    @cached_property
    def known(self) -> _Known:
        return _Known()

    @cached_property
    def bytes_at(self) -> np.ndarray:
        """The id of each byte's piece."""
        at = np.zeros(256, np.int32)
        for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == 6:
                at[int(p[3:5], 16)] = i
        return at

    @cached_property
    def alphabet(self) -> np.ndarray:
        """All characters of normal pieces, sorted; a character's symbol is its place from 1 on."""
        return np.array(sorted({ord(c) for p, k in zip(self.pieces, self.kinds) if k == 1 for c in p}), np.uint32)

    @cached_property
    def single(self) -> np.ndarray:
        """The id of each symbol as a piece of its own, or -1."""
        ids = np.full(len(self.alphabet) + 1, -1, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == 1 and len(p) == 1:
                ids[np.searchsorted(self.alphabet, ord(p)) + 1] = i
        return ids

    @cached_property
    def joins(self) -> np.ndarray:
        """Whether a symbol is part of a longer piece."""
        yes = np.zeros(len(self.alphabet) + 1, bool)
        for p, k in zip(self.pieces, self.kinds):
            if k == 1 and len(p) > 1:
                yes[self.symbols(p)] = True
        return yes

    @cached_property
    def blank_leads(self) -> bool:
        """Whether blanks stand only at the head of pieces, so that none crosses into a blank."""
        return not any(k == 1 and SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds))

    def symbols(self, text: str) -> np.ndarray:
        return self.symbols_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))

    def symbols_of(self, code: np.ndarray) -> np.ndarray:
        """Symbols of code points; 0 for those outside the alphabet."""
        return self.symbol_at[code]

    @cached_property
    def symbol_at(self) -> np.ndarray:
        table = np.zeros(0x110000, np.uint16)
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table

    @cached_property
    def longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of two symbols and more: ids, lengths, and the lower and upper keys of their suffixes."""
        ids = np.array([i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1 and len(p) > 1], np.int32)
        length = np.array([len(self.pieces[i]) for i in ids], np.int64)
        width = -(-int(length.max()) // 4) * 4
        low, high = np.zeros((len(ids), width), np.uint16), np.full((len(ids), width), 0xFFFF, np.uint16)
        for r, i in enumerate(ids):
            s = self.symbols(self.pieces[i])
            low[r, : len(s)], high[r, : len(s)] = s, s
        return ids, length, _keys(low), _keys(high)

    @cached_property
    def rank(self) -> np.ndarray:
        """Places of the pieces from the best score on; equal scores have equal places."""
        return np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int64)

    @cached_property
    def surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that pieces decode to, where each begins, and whether it is a byte or a control piece."""
        out = [
            bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.array(self.kinds)


def _keys(symbols: np.ndarray) -> np.ndarray:
    """Rows of symbols, four to a 64-bit number."""
    s = symbols.astype(_U).reshape(len(symbols), -1, 4)
    return (s[:, :, 0] << _U(48)) | (s[:, :, 1] << _U(32)) | (s[:, :, 2] << _U(16)) | s[:, :, 3]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class SuffixArray:
    """Suffixes of a symbol array in order of their first ``width`` symbols."""

    def __init__(self, text: np.ndarray, width: int):
        padded = np.concatenate([text, np.zeros(width + 4, np.uint16)]).astype(_U)
        n = len(text)
        four = (padded[: n + width] << _U(48)) | (padded[1 : n + width + 1] << _U(32)) | (padded[2 : n + width + 2] << _U(16)) | padded[3 : n + width + 3]
        self.keys = [four[o : o + n] for o in range(0, width, 4)]
        rank, reach = four, 4
        while True:  # ranks by 4 symbols, then by 8, 16, ...
            order = np.argsort(rank[:n])
            if reach >= width:
                break
            s = rank[:n][order]
            dense = np.empty(n + reach, np.int64)
            dense[n:] = 0
            dense[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
            rank = (dense[:n].astype(_U) << _U(32)) | dense[reach : n + reach].astype(_U)
            reach *= 2
        self.order = order

    def bound(self, keys: np.ndarray, after: bool) -> np.ndarray:
        """For each key the number of suffixes below it (or not above it), by binary search."""
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            at = self.order[mid]
            less, tie = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k, own in enumerate(self.keys):
                x, y = own[at], keys[open_, k]
                less |= tie & (x < y)
                tie &= x == y
                if not tie.any():
                    break
            go = less | tie if after else less
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
        return lo


def _edges(text: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of longer pieces: where they start and end and their ids, sorted by start."""
    ids, length, low, high = vocabulary.longer
    index = SuffixArray(text, low.shape[1] * 4)
    a, b = index.bound(low, False), index.bound(high, True)
    found = np.flatnonzero(b > a)
    count = (b - a)[found]
    start = index.order[_ragged(a[found], count)].astype(np.int32)
    piece = np.repeat(found.astype(np.int32), count)
    by_start = np.argsort(start, kind="stable")
    start, piece = start[by_start], piece[by_start]
    return start, start + length[piece].astype(np.int32), ids[piece]


def _relax(text: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For the stretches that begin at ``at``: which positions begin a final symbol, and its piece (-1: none)."""
    n = len(text)
    starts, token = np.ones(n + 1, bool), vocabulary.single[text]
    start, end, piece = _edges(text, vocabulary)
    following = np.arange(1, n + 2)
    following[n] = n
    rank = vocabulary.rank[piece]
    stretch = np.searchsorted(at, start, "right") - 1
    size = np.diff(np.append(at, n))
    long = size[stretch] > LONG
    if long.any():
        for w in np.unique(stretch[long]):
            e = slice(*np.searchsorted(stretch, [w, w + 1]))
            _by_heap(start[e], end[e], piece[e], rank[e], starts, token, following)
        start, end, piece, rank, stretch = (x[~long] for x in (start, end, piece, rank, stretch))
    place = start - at[stretch]
    key = rank * (LONG + 1) + place
    while len(start):
        middle = following[start]
        fits = following[middle] == end
        best_of = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        best = np.minimum.reduceat(np.where(fits, key, _NEVER), best_of)
        each = np.repeat(best, np.diff(np.append(best_of, len(start))))
        take = fits & (key == each)
        s = start[take]
        starts[middle[take]] = False
        following[s] = end[take]
        token[s] = piece[take]
        # Edges live on while both ends are ends of symbols and more than one symbol lies between.
        live = (each != _NEVER) & starts[start] & starts[end] & (following[start] != end)
        start, end, piece, stretch, key = start[live], end[live], piece[live], stretch[live], key[live]
    return starts[:n], token


def _by_heap(start, end, piece, rank, starts, token, following) -> None:
    """The same order of merges for one stretch: the best pair first, pairs anew as symbols grow."""
    span = {(s, e): (r, p) for s, e, r, p in zip(start.tolist(), end.tolist(), rank.tolist(), piece.tolist())}
    lo, hi = int(start[0]), int(end.max())
    lo = min(lo, int(start.min()))
    nxt = {i: i + 1 for i in range(lo, hi)}
    prv = {i + 1: i for i in range(lo, hi)}
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        m = nxt.get(a)
        e = nxt.get(m) if m is not None else None
        if e is not None and (x := span.get((a, e))):
            heapq.heappush(heap, (x[0], a, m, e))

    for i in range(lo, hi):
        offer(i)
    while heap:
        _, a, m, e = heapq.heappop(heap)
        if nxt.get(a) != m or nxt.get(m) != e:
            continue
        nxt[a], prv[e] = e, a
        del nxt[m]
        starts[m] = False
        following[a] = e
        token[a] = span[a, e][1]
        offer(a)
        if a in prv:
            offer(prv[a])


def encode_batch(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column, one after the other, and where each text's begin."""
    raw, at = text_bytes(column)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo, hi in slices(at, BATCH_BYTES):
        i, c = _encode_slice(raw[at[lo] : at[hi]].tobytes(), at[lo : hi + 1] - at[lo], vocabulary)
        ids.append(i)
        counts.append(c)
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _encode_slice(raw: bytes, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row_at = heads[at]  # in characters
    code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    rows = len(at) - 1
    blank = ord(SPACE)
    code = np.where(code == 32, np.uint32(blank), code)
    full = np.flatnonzero(row_at[1:] > row_at[:-1])
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    if v.dummy_prefix:
        code = np.insert(code, row_at[full], np.uint32(blank))
        row_at = row_at + np.concatenate([[0], np.cumsum(np.isin(np.arange(rows), full))])
    symbol = v.symbols_of(code)
    n = len(code)
    cut = np.zeros(n, bool)
    cut[row_at[full]] = True
    if v.blank_leads:
        cut[1:] |= (code[1:] == blank) & (code[:-1] != blank)
    alone = ~v.joins[symbol]
    cut |= alone
    cut[1:] |= alone[:-1]
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, n))
    name = byte_names(code.view(np.uint8), 4 * begin, 4 * (begin + size))
    names, first, which = np.unique(name, return_index=True, return_inverse=True)
    rep = first[which]
    other = np.flatnonzero(~_equal(code, begin, size, code, begin[rep], size[rep]))
    which[other] = len(names) + np.arange(len(other))  # stretches that only share a name
    first, names = np.concatenate([first, other]), np.concatenate([names, name[other]])
    begins, sizes = begin[first], size[first]
    known = v.known
    at_known, named, found = known.look_up(names, code, begins, sizes)
    fresh = np.flatnonzero(~found)
    own, own_count = _encode_stretches(code, symbol, begins[fresh], sizes[fresh], v)
    # ids of all distinct stretches: those known before, then the fresh ones
    lo, count = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    lo[found], count[found] = known.lo[at_known[found]], known.count[at_known[found]]
    lo[fresh], count[fresh] = len(known.ids) + np.cumsum(own_count) - own_count, own_count
    out = np.concatenate([known.ids, own])
    new = ~named[fresh] & (fresh < len(names) - len(other))
    known.add(names[fresh], own, own_count, new, code, begins[fresh], sizes[fresh])
    each = count[which]
    total = np.concatenate([[0], np.cumsum(each)])
    return out[_ragged(lo[which], each)], np.diff(total[np.searchsorted(begin, row_at)])


def _encode_stretches(code: np.ndarray, symbol: np.ndarray, begin: np.ndarray, length: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some stretches of a batch, one after the other, and their numbers."""
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    # end to end; the symbol 0 behind each is in no piece
    begin2 = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    text = np.zeros(int((length + 1).sum()), np.uint16)
    place, source = _ragged(begin2, length), _ragged(begin, length)
    text[place] = symbol[source]
    letters = np.zeros(len(text), np.uint32)
    letters[place] = code[source]
    starts, token = _relax(text, begin2, v)
    starts[begin2 + length] = False
    where = np.flatnonzero(starts)
    token, letter = token[where], letters[where]
    # bytes stand for symbols without a piece
    missing = np.flatnonzero(token < 0)
    wide = np.ones(len(where), np.int64)
    fallback = np.zeros(0, np.int32)
    if len(missing):
        encoded = letter[missing].tobytes().decode("utf-32-le").encode()
        b = np.frombuffer(encoded, np.uint8)
        wide[missing] = np.diff(np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b)))
        fallback = v.bytes_at[b]
    out = np.repeat(token, wide)
    out[out < 0] = fallback
    cum = np.concatenate([[0], np.cumsum(wide)])
    at = cum[np.searchsorted(where, begin2)]
    return out, cum[np.searchsorted(where, begin2 + length)] - at


def decode_batch(column: pa.Array, vocabulary: Vocabulary) -> list[str]:
    """The text of each list of ids."""
    flat, at = _flat(column)
    data, begin, kind = vocabulary.surface
    if len(flat) and (flat.min() < 0 or flat.max() >= len(kind)):
        raise ValueError("an id is outside the vocabulary")
    texts = []
    for lo, hi in slices(at, BATCH_BYTES):
        own = flat[at[lo] : at[hi]]
        size = (begin[1:] - begin[:-1])[own]
        out = data[_ragged(begin[own], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[at[lo : hi + 1] - at[lo]].tolist()
        for a, z in zip(ends, ends[1:]):
            t = out[a:z].decode("utf-8", "replace")
            texts.append(t[1:] if vocabulary.dummy_prefix and t.startswith(" ") else t)
    return texts


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])


def _with_columns(df: DataFrame, source: str, columns: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns that ``make`` gives from a column of each Arrow batch, a few MB at a time."""
    small_batches(df.sparkSession)
    names = df.columns
    kept, at = [i for i, c in enumerate(names) if c not in columns], names.index(source)
    plain = [f"c{i}" for i in range(len(names))]  # names with dots can't be handed to Python
    schema = T.StructType([T.StructField(plain[i], df.schema[i].dataType) for i in kept] + [T.StructField(f"n{i}", t) for i, t in enumerate(columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sparing(batches):
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + make(part.column(at)), schema.names)

    return df.toDF(*plain).mapInArrow(run, schema).toDF(*[names[i] for i in kept], *columns)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BATCH_BYTES; a batch without rows is one part."""
    step = max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes))
    for lo in range(0, max(1, b.num_rows), step):
        yield b.slice(lo, step)


def _ids(texts: pa.Array, vocabulary: Vocabulary) -> pa.ListArray:
    ids, at = encode_batch(texts, vocabulary)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` and the ids of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return _with_columns(docs, text_col, {ids_col: T.ArrayType(T.IntegerType())}, lambda c: [_ids(c, sent.value)])


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` and the text of each list of ids."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return _with_columns(rows, ids_col, {text_col: T.StringType()}, lambda c: [pa.array(decode_batch(c, sent.value), pa.string())])


def encode_and_decode(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with ids and the SHA-256 of the text they decode to, both ways in one step."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def make(texts: pa.Array) -> list[pa.Array]:
        ids = _ids(texts, sent.value)
        return [ids, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decode_batch(ids, sent.value)], pa.string())]

    return _with_columns(docs, text_col, {"ids": T.ArrayType(T.IntegerType()), "decoded_sha256": T.StringType()}, make)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the SHA-256 of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_decode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")
