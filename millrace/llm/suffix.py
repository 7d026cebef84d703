"""Removal of byte strings repeated across documents, by column-wise multi-document sorting.

Every 50-byte string of a text is judged by its anchor, the least hashed 24-gram inside it: all
its occurrences, in any document, share the anchor's bytes and place. So strings can be dealt
by anchor, and each deal is a collection of short pieces (an anchor with all strings around it,
at most 76 bytes). The suffixes of a collection are sorted column-wise: round j inserts the
suffix of length j of every piece into the collection's Burrows-Wheeler transform, at the place
that symbol counts give, in one sequential pass. Neighbours in the final order that share
their first 50 bytes are equal strings; their least document is what decides. Bytes decide
there, not hashes.

Only what can be shared gets that far. Texts are cut at anchors into segments of some hundred
bytes; a segment equal to one of a smaller document is repeated as a whole, and an anchor that
occurs in one kind of segment only needs no more than that. What remains are anchors found in
different segments, each once for a bundle of documents, however often the bundle repeats it.

Bundles of a few MB move as compressed arrays, and answers go back to bundles, so that no
string's occurrences in all documents ever meet in one task. A collection is bounded, so its
sequential files are arrays in memory.

Defined results: a null or empty text has no bytes; texts under 50 bytes lose none; rows with
the same doc_id don't count as smaller to each other; a null doc_id counts as larger than any
other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held, pick, reducers, stored, text_slices, trim, utf8

SPAN = 50  # bytes of a string that counts
GRAM = 24  # bytes of an anchor
#: Bytes of text in a bundle, in a block that is worked on at a time, and of all text for each part of the deal.
BUNDLE, BLOCK, PART = 4 << 20, 1 << 17, 12 << 20
#: Above so many bytes of text bundles and parts grow with the root of the table, up to MOST times, since rows that
#: move are bundles times parts.
STEADY, MOST = 1 << 30, 16
#: About so many pieces are sorted as one collection; the pieces of an anchor stay together.
COLLECTION = 5000
#: One anchor in so many ends a segment.
CUT = 16
NO_ID = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 30) - 1)
_SEGMENT = np.dtype([("h0", "<u8"), ("h1", "<u8"), ("doc", "<i8")])
_ANCHOR = np.dtype([("code", "<u4"), ("low", "<u4"), ("high", "<u2")])
_MIN = np.dtype([("h0", "<u8"), ("doc", "<i8")])
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Block:
    """Anchors and segments of some texts (or parts of one) that lie one after another.

    runs: windows lo..hi (starts of strings) whose anchor is the same; code: what its anchor is
    dealt by; segment: the run's segment. owner: which text a segment is of.
    """

    def __init__(self, parts: list[tuple[int, int, bytes]], deals: int, span: int):
        import xxhash

        self.parts = parts
        raw = b"".join([p for _, _, p in parts])
        self.buf = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in parts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        n, w = len(raw), span - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.segment = self.owner = empty
        self.code, self.digests = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
        if n < span:
            return
        h = _LETTERS[self.buf]
        for k, odd in zip((1, 2, 4, 8), _ODD):  # hashes of 2, 4, 8 and 16 bytes, and of 24 from those of 16 and 8
            eight, h = h, h[:-k] * odd + h[k:]
            h ^= h >> np.uint64(31)
        h = h[:-8] * _ODD[4] + eight[16:]
        h *= _ODD[0]
        h ^= h >> np.uint64(29)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: n - span + 1], least[w - width :])
        last = np.repeat(self.ends - span, sizes)[: n - span + 1]
        starts = np.flatnonzero(np.arange(n - span + 1) <= last)
        if not len(starts):
            return
        anchor = (least[starts] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.lo, self.hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        g = h[anchor[first]] * _ODD[1]
        g ^= g >> np.uint64(32)
        self.code = ((g >> np.uint64(34)) % np.uint64(deals) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
        text = np.searchsorted(self.ends, self.lo, side="right")
        new = ((g >> np.uint64(5)) % np.uint64(CUT) == 0) | (np.diff(text, prepend=-1) != 0)
        self.segment = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.owner = text[at]
        a, b = self.lo[at], self.hi[np.append(at[1:], len(new)) - 1] + span
        digest, view = xxhash.xxh3_128_digest, memoryview(raw)
        self.digests = np.frombuffer(b"".join([digest(view[i:j]) for i, j in zip(a.tolist(), b.tolist())]), "<u8").reshape(-1, 2)


def blocks(texts: list[bytes], deals: int, span: int) -> Iterator[Block]:
    """The texts in blocks; a text above a block's size is cut so that each string lies in one part."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - span + 1), BLOCK):
            part = t[a : a + BLOCK + span - 1] if len(t) > BLOCK + span else t
            if parts and size + len(part) > BLOCK + span:
                yield Block(parts, deals, span)
                parts, size = [], 0
            parts.append((i, a, part))
            size += len(part)
            if part is t:
                break
    if parts:
        yield Block(parts, deals, span)


def growth(docs: DataFrame) -> float:
    """By how much bundles and parts of this table are larger than those of small ones."""
    return growth_at(docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0)


def growth_at(total: int) -> float:
    """The same for a table with so many bytes of text."""
    return min(MOST, max(1.0, math.sqrt(total / STEADY)))


def bundles(docs: DataFrame, most: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents in bundles of about `most` bytes: (bundle, bytes, ids, nulls, lengths, body), the body compressed; with carry, also those columns as `rest`."""
    fields = [("bundle", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lengths", pa.binary()), ("body", pa.binary())]
    schema = pa.schema(fields + [("rest", pa.binary())] * bool(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        pack = zstandard.ZstdCompressor(level=1).compress
        ids: list = []
        texts: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            names = np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()
            out = batch(schema, [number], [size], [names], [np.array([i is None for i in ids]).tobytes()], [np.array([len(t) for t in texts], "<i8").tobytes()], [pack(b"".join(texts))], *([[_as_bytes(rest)]] * bool(carry)))
            number, size = number + 1, 0
            ids.clear()
            texts.clear()
            rest.clear()
            return out

        for b in text_slices(batches, most=most):
            at = 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), utf8(b.column(1)))):
                if size and size + len(t) > most:
                    rest.append(b.slice(at, k - at).select(range(2, b.num_columns)))
                    at = k
                    yield flush()
                ids.append(i)
                texts.append(t)
                size += len(t)
            rest.append(b.slice(at).select(range(2, b.num_columns)))
        if ids:
            yield flush()

    return pick(docs, "doc_id", "text", *carry).mapInArrow(run, "bundle long, bytes long, ids binary, nulls binary, lengths binary, body binary" + ", rest binary" * bool(carry))


def _as_bytes(some: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, some[0].schema) as w:
        for b in some:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


class Bundle:
    def __init__(self, row: dict):
        import zstandard

        self.ids = np.frombuffer(row["ids"], "<i8")
        self.nulls = np.frombuffer(row["nulls"], bool)
        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["bytes"]))
        cuts = np.cumsum(np.frombuffer(row["lengths"], "<i8")).tolist()
        self.texts = [body[a:b] for a, b in zip([0, *cuts], cuts)]

    def least_by_segment(self, found: list[Block]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct segments (first half of the digest and row of an occurrence), their least document here, and for each block the index of its segments."""
        digests = np.concatenate([b.digests for b in found])
        docs = np.concatenate([self.ids[np.array([p[0] for p in b.parts], np.int64)[b.owner]] for b in found])
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        ordered = digests[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new)) if len(order) else docs
        return ordered[new], least, np.split(which, np.cumsum([len(b.digests) for b in found])[:-1])


def _deal(deal: np.ndarray, *arrays: np.ndarray) -> dict[int, list[bytes]]:
    """For each deal, the bytes of its rows of each array."""
    order = np.argsort(deal, kind="stable")
    ordered = deal[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    return {int(deal[some[0]]): [a[some].tobytes() for a in arrays] for some in np.split(order, cuts) if len(some)}


def sketch(table: DataFrame, deals: int, span: int) -> DataFrame:
    """(deal, bundle, segments, anchors) of each bundle: its distinct segments, and its anchors with at most two of their segments."""
    schema = pa.schema([("deal", pa.int32()), ("bundle", pa.int64()), ("segments", pa.binary()), ("anchors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in batches:
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                trim()
                bundle = Bundle(row)
                found = list(blocks(bundle.texts, deals, span))
                digests, least, which = bundle.least_by_segment(found)
                segments = np.empty(len(digests), _SEGMENT)
                segments["h0"], segments["h1"], segments["doc"] = digests[:, 0], digests[:, 1], least
                code = np.concatenate([x.code for x in found])
                of = np.concatenate([w[x.segment] for w, x in zip(which, found)])
                del found
                order = np.argsort(code, kind="stable")
                code, of = code[order], of[order]
                start = np.flatnonzero(np.diff(code, prepend=code[:1] + np.uint64(1)))
                if len(code):
                    low, high = np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)
                    code = np.concatenate([code[start], code[start][low != high]])
                    of = np.concatenate([low, high[low != high]])
                anchors = np.empty(len(code), _ANCHOR)
                anchors["code"] = code & np.uint64(0xFFFFFFFF)
                anchors["low"], anchors["high"] = digests[of, 1] & np.uint64(0xFFFFFFFF), digests[of, 0] >> np.uint64(48)
                a = _deal((digests[:, 0] % np.uint64(deals)).astype(np.int64), segments)
                c = _deal((code >> np.uint64(32)).astype(np.int64), anchors)
                keys = sorted({*a, *c})
                if keys:
                    yield batch(schema, keys, [row["bundle"]] * len(keys), [a.get(k, [b""])[0] for k in keys], [c.get(k, [b""])[0] for k in keys])

    return table.mapInArrow(run, "deal int, bundle long, segments binary, anchors binary")


_ANSWER = pa.schema([("bundle", pa.int64()), ("kind", pa.int32()), ("deal", pa.int32()), ("answer", pa.binary())])
ANSWER = "bundle long, kind int, deal int, answer binary"
LEAST, SHARED, REPEATED = range(3)


def _bundle_of(blobs: list[bytes], size: int) -> np.ndarray:
    return np.repeat(np.arange(len(blobs)), [len(b) // size for b in blobs])


def _answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([batch(_ANSWER, *(list(x) for x in zip(*rows)))]) if rows else _ANSWER.empty_table()


def match(key: tuple, table: pa.Table) -> pa.Table:
    """For each bundle: segments that a smaller document has, and anchors that occur in different segments."""
    held()
    deal, names = key[0].as_py(), table.column("bundle").to_pylist()
    out = []
    blobs = table.column("segments").to_pylist()
    s, of = np.frombuffer(b"".join(blobs), _SEGMENT), _bundle_of(blobs, _SEGMENT.itemsize)
    if len(s):
        order = np.lexsort((s["h1"], s["h0"]))
        h0, h1 = s["h0"][order], s["h1"][order]
        start = np.flatnonzero(np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])]))
        least = np.repeat(np.minimum.reduceat(s["doc"][order], start), np.diff(np.append(start, len(order))))
        told = np.empty(len(s), _MIN)
        told["h0"][order], told["doc"][order] = h0, least
        for k, blob in _deal(np.where(told["doc"] < s["doc"], of, len(names)), told).items():
            if k < len(names):
                out.append((names[k], LEAST, deal, blob[0]))
    blobs = table.column("anchors").to_pylist()
    a, of = np.frombuffer(b"".join(blobs), _ANCHOR), _bundle_of(blobs, _ANCHOR.itemsize)
    if len(a):
        code = a["code"].copy()
        order = np.argsort(code)
        kind = ((a["high"].astype(np.uint64) << np.uint64(32)) | a["low"])[order]
        start = np.flatnonzero(np.diff(code[order].astype(np.int64), prepend=-1))
        mixed = np.repeat(np.minimum.reduceat(kind, start) != np.maximum.reduceat(kind, start), np.diff(np.append(start, len(order))))
        hit = order[mixed]
        for k, blob in _deal(of[hit], code[hit]).items():
            out.append((names[k], SHARED, deal, blob[0]))
    return _answers(out)


class Judged:
    """A bundle's blocks with the first answers: which segments are repeated as a whole, and the pieces that aren't settled."""

    def __init__(self, row: dict, answers: list[dict], deals: int, span: int):
        self.bundle = Bundle(row)
        self.found = list(blocks(self.bundle.texts, deals, span))
        digests, least, which = self.bundle.least_by_segment(self.found)
        told = np.frombuffer(b"".join([a["answer"] for a in answers if a["kind"] == LEAST]), _MIN)
        place = np.searchsorted(digests[:, 0], told["h0"])
        least = least.copy()
        np.minimum.at(least, place, told["doc"])
        shared = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(a["answer"], "<u4").astype(np.uint64) | np.uint64(a["deal"] << 32) for a in answers if a["kind"] == SHARED)])
        shared = np.unique(shared)
        #: by deal: piece -> its number there, and by number: its least document here
        self.numbers: dict[int, dict[bytes, int]] = {}
        self.least: dict[int, list[int]] = {}
        self.codes: dict[int, list[int]] = {}
        self.whole: list[np.ndarray] = []  # for each block, runs that are repeated as a whole
        self.open: list[np.ndarray] = []  # for each block, rows of run, deal, number and document
        for b, w in zip(self.found, which):
            docs = self.bundle.ids[np.array([p[0] for p in b.parts], np.int64)[b.owner]][b.segment] if len(b.lo) else b.lo
            whole = least[w[b.segment]] < docs
            at = np.searchsorted(shared, b.code)
            doubt = ~whole & (at < len(shared))
            doubt[doubt] = shared[at[doubt]] == b.code[doubt]
            runs = np.flatnonzero(doubt)
            raw, todo = b.buf.tobytes(), []
            for r, lo, hi, code, d in zip(runs.tolist(), b.lo[runs].tolist(), b.hi[runs].tolist(), b.code[runs].tolist(), docs[runs].tolist()):
                deal = code >> 32
                numbers, mins = self.numbers.setdefault(deal, {}), self.least.setdefault(deal, [])
                k = numbers.setdefault(raw[lo : hi + span], len(mins))
                if k == len(mins):
                    mins.append(d)
                    self.codes.setdefault(deal, []).append(code & 0xFFFFFFFF)
                elif d < mins[k]:
                    mins[k] = d
                todo.append((r, deal, k, d))
            self.whole.append(np.flatnonzero(whole))
            self.open.append(np.array(todo, np.int64).reshape(-1, 4))


_PIECES = pa.schema([("deal", pa.int32()), ("bundle", pa.int64()), ("docs", pa.binary()), ("codes", pa.binary()), ("lengths", pa.binary()), ("body", pa.binary())])


def pieces_of(left: pa.Table, right: pa.Table, deals: int, span: int) -> pa.Table:
    held()
    rows = left.to_pylist()
    if not rows:
        return _PIECES.empty_table()
    judged = Judged(rows[0], right.to_pylist(), deals, span)
    deal = sorted(judged.numbers)
    columns = [[np.array(judged.least[d], "<i8").tobytes() for d in deal], [np.array(judged.codes[d], "<u4").tobytes() for d in deal], [np.array([len(p) for p in judged.numbers[d]], np.uint16).tobytes() for d in deal], [b"".join(judged.numbers[d]) for d in deal]]
    return pa.Table.from_batches([batch(_PIECES, deal, [rows[0]["bundle"]] * len(deal), *columns)])


def column_sorted(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of the texts (first, length in buf), in order.

    The transform holds, for each suffix so far, the symbol before it (0: none). Round j puts
    in, for each text, the suffix of length j: its rank is the count of smaller symbols in the
    transform plus the count of its own first symbol before its shorter suffix. Walking the
    finished transform back from the empty suffixes gives the place of every row.
    """
    alphabet, symbols = np.unique(buf, return_inverse=True)
    if len(alphabet) > 254:  # UTF-8 has fewer
        raise ValueError("more than 254 different bytes")
    symbols = (symbols + 1).astype(np.uint8)
    live = np.flatnonzero(length)
    texts, end = live, first + length
    # round 0: the empty suffixes, in the order of the texts, take the first places
    bwt = symbols[end[live] - 1]
    rank, j = np.arange(len(live)), 0
    while len(live):
        j += 1
        n = len(bwt)
        # a counting sort of the transform counts smaller symbols, and equal ones before a row
        place = np.empty(n, np.int64)
        place[np.argsort(bwt, kind="stable")] = np.arange(n)
        # rows of symbol 0 have no longer suffix; the empty suffixes come first
        new_rank = len(texts) - np.count_nonzero(bwt == 0) + place[rank]
        order = np.argsort(new_rank)
        live, new_rank = live[order], new_rank[order]
        more = length[live] > j
        symbol = np.where(more, symbols[np.maximum(end[live] - j - 1, 0)], 0).astype(np.uint8)
        # new_rank counts in the new transform; the k-th new suffix stands before old row new_rank - k
        bwt = np.insert(bwt, new_rank - np.arange(len(live)), symbol)
        live, rank = live[more], new_rank[more]
    order = np.argsort(bwt, kind="stable")
    longer = np.empty(len(bwt), np.int64)
    longer[order] = np.arange(len(bwt)) - np.count_nonzero(bwt == 0) + len(texts)
    where = np.empty(len(bwt), np.int64)
    rows = np.arange(len(texts))
    where[rows] = end[texts]
    for j in range(1, int(length.max(initial=0)) + 1):
        go = length[texts] >= j
        texts, rows = texts[go], longer[rows[go]]
        where[rows] = end[texts] - j
    return where


def least_documents(pieces: list[bytes], least: np.ndarray, span: int) -> np.ndarray:
    """For each piece (a row) and start, the least document of all pieces that hold the string there."""
    out = np.full((len(pieces), span - GRAM + 1), NO_ID, np.int64)
    if not pieces:
        return out
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(length) - length
    where = column_sorted(buf, first, length)
    # suffixes of at least the span, with equal beginnings side by side
    piece = np.searchsorted(first, where, side="right") - 1
    long = first[piece] + length[piece] - where >= span
    where, piece = where[long], piece[long]
    grams = np.lib.stride_tricks.sliding_window_view(buf, span)
    new = np.ones(len(where), bool)
    for a in range(1, len(where), 1 << 16):
        b = min(len(where), a + (1 << 16))
        new[a:b] = (grams[where[a:b]] != grams[where[a - 1 : b - 1]]).any(axis=1)
    group = np.cumsum(new) - 1
    out[piece, where - first[piece]] = np.minimum.reduceat(least[piece], np.flatnonzero(new))[group]
    return out


def sort_pieces(key: tuple, table: pa.Table, span: int) -> pa.Table:
    """For each bundle, which strings of its pieces also start in a smaller document (a bit each).

    An anchor with one kind of piece in all bundles is settled by the piece's least document;
    the pieces of the other anchors are sorted.
    """
    held()
    deal, names = key[0].as_py(), table.column("bundle").to_pylist()
    numbers: dict[bytes, int] = {}
    least: list[int] = []
    codes: list[int] = []
    of: list[list[int]] = []
    docs = [np.frombuffer(x, "<i8") for x in table.column("docs").to_pylist()]
    for ds, own, lengths, body in zip(docs, *(table.column(n).to_pylist() for n in ("codes", "lengths", "body"))):
        cuts = np.cumsum(np.frombuffer(lengths, np.uint16), dtype=np.int64).tolist()
        mine = []
        for a, b, d, code in zip([0, *cuts], cuts, ds.tolist(), np.frombuffer(own, "<u4").tolist()):
            k = numbers.setdefault(body[a:b], len(least))
            if k == len(least):
                least.append(d)
                codes.append(code)
            elif d < least[k]:
                least[k] = d
            mine.append(k)
        of.append(mine)
    least_doc = np.array(least, np.int64)
    _, kind, kinds = np.unique(np.array(codes, np.uint32), return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    several = order[kinds[kind[order]] > 1]
    width = span - GRAM + 1
    smallest = np.repeat(least_doc[:, None], width, axis=1)
    pieces = list(numbers)
    # anchors with several kinds of pieces, in collections that start with an anchor
    cuts = np.flatnonzero(np.diff(kind[several], prepend=-1))
    cuts = cuts[np.flatnonzero(np.diff(cuts // COLLECTION, prepend=-1))]
    for some in np.split(several, cuts[1:]):
        smallest[some] = least_documents([pieces[k] for k in some.tolist()], least_doc[some], span)
    bit = np.uint64(1) << np.arange(width, dtype=np.uint64)
    out = []
    for name, mine, ds in zip(names, of, docs):
        bits = np.concatenate([np.where(smallest[mine[a : a + 8192]] < ds[a : a + 8192, None], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64) for a in range(0, len(mine), 8192)])
        out.append((name, REPEATED, deal, bits.astype("<u8").tobytes()))
    return _answers(out)


_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def coverage(row: dict, answers: list[dict], deals: int, span: int) -> tuple[Bundle, list[np.ndarray]]:
    """A bundle and, for each of its texts, which bytes go."""
    held()
    judged = Judged(row, answers, deals, span)
    bits = {a["deal"]: np.frombuffer(a["answer"], "<u8") for a in answers if a["kind"] == REPEATED}
    texts = judged.bundle.texts
    covered = [np.zeros(len(t), bool) for t in texts]
    for b, whole, todo in zip(judged.found, judged.whole, judged.open):
        change = np.zeros(len(b.buf) + 1, np.int32)
        np.add.at(change, b.lo[whole], 1)
        np.add.at(change, b.hi[whole] + span, -1)
        if len(todo):
            run, deal, number, d = todo.T
            here = np.array([judged.least[x][k] for x, k in zip(deal.tolist(), number.tolist())], np.int64)
            got = np.array([bits[x][k] for x, k in zip(deal.tolist(), number.tolist())], np.uint64)
            got[here < d] = np.uint64(0xFFFFFFFFFFFFFFFF)
            r, k = np.nonzero((got[:, None] >> np.arange(span - GRAM + 1, dtype=np.uint64)) & np.uint64(1))
            s = b.lo[run[r]] + k
            s = s[s <= b.hi[run[r]]]
            np.add.at(change, s, 1)
            np.add.at(change, s + span, -1)
        inside = np.cumsum(change[:-1]) > 0
        for (i, a, part), end in zip(b.parts, b.ends.tolist()):
            covered[i][a : a + len(part)] |= inside[end - len(part) : end]
    return judged.bundle, covered


def judge(left: pa.Table, right: pa.Table, deals: int, span: int, keep: bool) -> pa.Table:
    """The results of a bundle's documents, from its texts and all answers."""
    schema = pa.schema(_RESULT + [("kept", pa.binary())] * keep)
    rows = left.to_pylist()
    if not rows:
        return schema.empty_table()
    bundle, covered = coverage(rows[0], right.to_pylist(), deals, span)
    texts = bundle.texts
    kept = [np.frombuffer(t, np.uint8)[~c].tobytes() if c.any() else t for t, c in zip(texts, covered)]
    spans = [int(np.count_nonzero(c[1:] & ~c[:-1])) + int(c[0]) if len(c) else 0 for c in covered]
    names = [None if null else i for i, null in zip(bundle.ids.tolist(), bundle.nulls.tolist())]
    columns = [names, [len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept)], spans, [hashlib.sha256(k).hexdigest() for k in kept]]
    return pa.Table.from_batches([batch(schema, *columns, *([kept] * keep))])


def repeats_removed(docs: DataFrame, span: int = SPAN, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with keep, also the kept bytes.

    span: 32 to 80 bytes, so that the strings of an anchor fit into a word of bits.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    grown = growth(docs)
    table = stored(bundles(docs, int(BUNDLE * grown)), "bundles")
    return _with_answers(table, int(PART * grown), span, lambda a, b, deals: judge(a, b, deals, span, keep), schema)


def cleaned(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs, with all its columns, without the repeated bytes of `text`.

    A character of which only some bytes go is dropped, a null text stays null, and a document
    of which nothing but white space is left goes, if it had lost something.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    flag = "text is null"
    schema = docs.select(*others, "doc_id", "text").schema

    def finish(left: pa.Table, right: pa.Table, deals: int) -> pa.Table:
        row = left.to_pylist()[0]
        rest = pa.ipc.open_stream(row["rest"]).read_all()
        bundle, covered = coverage(row, right.to_pylist(), deals, span)
        kept = [np.frombuffer(t, np.uint8)[~c].tobytes().decode("utf-8", "ignore") for t, c in zip(bundle.texts, covered)]
        stay = [not c.any() or bool(k.strip()) for k, c in zip(kept, covered)]
        null = rest.column(flag).to_pylist()
        names = [None if n else i for i, n in zip(bundle.ids.tolist(), bundle.nulls.tolist())]
        out = rest.drop_columns([flag]).append_column("doc_id", pa.array(names, pa.int64()))
        out = out.append_column("text", pa.array([None if n else k for k, n in zip(kept, null)], pa.string()))
        return out.filter(pa.array(stay))

    grown = growth(docs)
    table = stored(bundles(docs.withColumn(flag, docs["text"].isNull()), int(BUNDLE * grown), (*others, flag)), "bundles")
    return _with_answers(table, int(PART * grown), span, finish, schema).select(*docs.columns)


def _with_answers(table: DataFrame, part: int, span: int, finish: Callable[[pa.Table, pa.Table, int], pa.Table], schema) -> DataFrame:
    if not 32 <= span <= 80:
        raise ValueError("span must be 32 to 80 bytes")
    spark = table.sparkSession
    total = table.agg(F.sum("bytes")).first()[0] or 0
    deals = max(reducers(spark), -(-total // part))
    first = stored(sketch(table, deals, span).groupBy("deal").applyInArrow(match, ANSWER), "answers")
    by_bundle = lambda x: x.groupBy("bundle")
    pieces = by_bundle(table).cogroup(by_bundle(first)).applyInArrow(lambda a, b: pieces_of(a, b, deals, span), "deal int, bundle long, docs binary, codes binary, lengths binary, body binary")
    second = stored(pieces.groupBy("deal").applyInArrow(lambda k, t: sort_pieces(k, t, span), ANSWER), "answers")
    return by_bundle(table).cogroup(by_bundle(first.union(second))).applyInArrow(lambda a, b: finish(a, b, deals), schema)
