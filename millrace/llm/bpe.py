"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

The split pattern's matches never cross a single space or line end except by taking the space
in front, so whole texts are put together from cached space-delimited words; texts with other
white space are split by the pattern directly. Words that aren't tokens themselves become
token-position rows in DuckDB; a recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of least rank, until no pair is left. Decoding joins
token-position rows with the vocabulary and aggregates the bytes in order.

A query keeps the rows of all its rounds, and a word takes about as many rounds as it has bytes, so
longer words are contracted in pieces by the same query. A row of tokens is the encoding of its
bytes if and only if every two neighbours are the encoding of theirs; so cuts between pieces are
tested pair by pair, and bytes around a failing one are contracted again, ever farther around.

Defined results: a null or empty text has no tokens; repeated rows are encoded each; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch, bytes_of, held, pick, text_slices

#: Words of more bytes than this are contracted in pieces of so many bytes.
PIECE = 64
#: Bytes on each side of a failing cut that are contracted again, at first.
REACH = 16
CACHE_WORDS = 700_000
#: Stands before a piece that no space precedes.
BARE = b"\0"
#: Marks after a Latin letter or digit and before white space, which the split pattern parts from the word, as Arrow's expressions have it.
CLOSING = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,!?%*&$#:;]+)([ \n]|\z)"
#: What a text doesn't have in which words are parted by single spaces and line ends.
UNEVEN = r"[\x00-\x09\x0B-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Pieces that are one match of the split pattern: letters of ASCII and Latin-1.
PLAIN = re.compile(rb"\0?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Bytes of new words that one recursive query takes.
QUERY_BYTES = 1_500_000

# A row's key holds the word above bit 20 and the position below.
CONTRACT = """
WITH RECURSIVE t(k, id, round) AS (
    SELECT k, id, 0 FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT a.k, m.id AS rank FROM t a JOIN t b ON b.k = a.k + 1 JOIN merges m ON m.a = a.id AND m.b = b.id
     ), best AS (
        SELECT k >> {bits} AS w, min((rank::BIGINT << {bits}) | (k & {low})) AS x FROM pairs GROUP BY ALL
     )
     SELECT CASE WHEN (t.k & {low}) > (x & {low}) THEN t.k - 1 ELSE t.k END,
            CASE WHEN (t.k & {low}) = (x & {low}) THEN (x >> {bits})::INTEGER ELSE t.id END, t.round + 1
     FROM t JOIN best ON best.w = t.k >> {bits} WHERE (t.k & {low}) <> (x & {low}) + 1)
)
SELECT k, id FROM t JOIN (SELECT k >> {bits} AS w, max(round) AS last FROM t GROUP BY ALL) f ON f.w = t.k >> {bits} AND f.last = t.round
"""
DECODE = "SELECT k >> {bits} AS w, from_hex(string_agg(hex, '' ORDER BY k)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY ALL ORDER BY w"
BITS = {"bits": 20, "low": (1 << 20) - 1}
DECODE_BITS = {"bits": 40, "low": (1 << 40) - 1}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """A vocabulary with its merge table in DuckDB, and bounded caches of what has been encoded."""

    def __init__(self, path: str, pattern: str, most: int = CACHE_WORDS):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.match = regex.compile(pattern).findall
        self.most = most
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table(dict(zip(("a", "b", "id"), (pa.array(x, pa.int32()) for x in zip(*rows)))))
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.clear()

        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.tokens: list[bytes] = [b""] * len(self.sizes)
        for t, r in self.ranks.items():
            self.sizes[r], self.tokens[r] = len(t), t

    def clear(self) -> None:
        self.stands: dict[tuple[int, int], bool] = {}
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}
        #: those known before the two above were begun anew
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}

    def _query(self, sql: str, table: pa.Table, name: str) -> pa.Table:
        self.db.register(name, table)
        got = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return got

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        which = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        got = self._query(CONTRACT.format(**BITS), pa.table({"k": (which << BITS["bits"]) + pos, "id": ids}), "start")
        keys, ids = (got.column(n).to_numpy() for n in ("k", "id"))
        order = np.argsort(keys)
        cuts = np.searchsorted(keys[order] >> BITS["bits"], np.arange(1, len(words)))
        return np.split(ids[order], cuts)

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of some words, by queries of a bounded size."""
        out: list[np.ndarray] = []
        while len(out) < len(words):
            size, to = 0, len(out)
            while to < len(words) and (to == len(out) or size + len(words[to]) <= QUERY_BYTES):
                size += len(words[to])
                to += 1
            out += self._contract(words[len(out) : to])
        return out

    def failing(self, runs: list[list[np.ndarray]]) -> list[tuple[int, int]]:
        """The cuts (word, piece after it) between neighbours that aren't the encoding of their bytes."""
        pairs = {(w, k): (int(run[k - 1][-1]), int(run[k][0])) for w, run in enumerate(runs) for k in range(1, len(run))}
        if len(self.stands) > self.most:
            self.stands.clear()
        new = [p for p in set(pairs.values()) if p not in self.stands]
        for p, ids in zip(new, self.contract([self.tokens[a] + self.tokens[b] for a, b in new])):
            self.stands[p] = ids.tolist() == list(p)
        return [cut for cut, p in pairs.items() if not self.stands[p]]

    def contract_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of any length."""
        cuts = [[w[a : a + PIECE] for a in range(0, len(w), PIECE)] for w in words]
        flat = iter(self.contract([c for cs in cuts for c in cs]))
        runs = [[next(flat) for _ in cs] for cs in cuts]
        reach = REACH
        while todo := self.failing(runs):
            jobs: list[tuple[int, int, int, int, int]] = []
            for w, k in todo:
                left, right = runs[w][k - 1], runs[w][k]
                # tokens around the cut that have `reach` bytes; what another job has taken waits for the next turn
                a = len(left) - int(np.searchsorted(np.cumsum(self.sizes[left[::-1]]), reach)) - 1
                b = int(np.searchsorted(np.cumsum(self.sizes[right]), reach)) + 1
                if not jobs or jobs[-1][0] != w or jobs[-1][1] < k - 1:
                    jobs.append((w, k, max(a, 0), min(b, len(right)), 0))
            again = self.contract([b"".join([self.tokens[t] for t in (*runs[w][k - 1][a:].tolist(), *runs[w][k][:b].tolist())]) for w, k, a, b, _ in jobs])
            for (w, k, a, b, _), ids in reversed(list(zip(jobs, again))):
                runs[w][k - 1 : k + 1] = [x for x in (runs[w][k - 1][:a], ids, runs[w][k][b:]) if len(x)]
            runs = [self._settled(run) for run in runs]
            reach *= 2
        return [np.concatenate(run) for run in runs]

    def _settled(self, run: list[np.ndarray]) -> list[np.ndarray]:
        """A word's pieces, joined where the neighbours at a cut are known to stand."""
        out = [run[0]]
        group = [run[0]]
        for x in run[1:]:
            if self.stands.get((int(group[-1][-1]), int(x[0]))):
                group.append(x)
            else:
                out[-1] = np.concatenate(group)
                out.append(x)
                group = [x]
        out[-1] = np.concatenate(group)
        return out

    def decode_tokens(self, which: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each run of tokens; which: the run of each token, in order, without gaps."""
        first = np.flatnonzero(np.diff(which, prepend=-1))
        pos = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
        got = self._query(DECODE.format(**DECODE_BITS), pa.table({"k": (which.astype(np.int64) << 40) + pos, "id": ids.astype(np.int32)}), "tokens")
        return got.column("bytes").to_pylist()

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each word, as little-endian 32-bit integers, and the bytes that they decode to."""
        encoded: list[np.ndarray | None] = [None if (r := self.ranks.get(b)) is None else np.array([r], np.int32) for b in words]
        for long, contract in ((False, self.contract), (True, self.contract_long)):
            todo = [i for i, e in enumerate(encoded) if e is None and (len(words[i]) > PIECE) == long]
            for i, ids in zip(todo, contract([words[i] for i in todo])):
                encoded[i] = ids
        if not words:
            return [], []
        flat = np.concatenate(encoded)
        ends = np.cumsum([len(e) for e in encoded])
        decoded = self.decode_tokens(np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)), flat)
        raw, cuts = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)], decoded

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces: with BARE in front as they are, else with a space in front."""
        full = [p[1:] if p[:1] == BARE else b" " + p for p in pieces]
        plain = PLAIN.fullmatch
        # most pieces are a word; what the split pattern parts is put together from its words
        parts = {p: [w.encode("utf-8") for w in self.match(f.decode("utf-8"))] for p, f in zip(pieces, full) if not plain(p)}
        words = list({f for p, f in zip(pieces, full) if p not in parts}.union(*parts.values()))
        ids, texts = (dict(zip(words, x)) for x in self.encode_words(words))
        for p, f in zip(pieces, full):
            if (ws := parts.get(p)) is None:
                self.ids[p], self.texts[p] = ids[f], texts[f]
            else:
                self.ids[p], self.texts[p] = b"".join([ids[w] for w in ws]), b"".join([texts[w] for w in ws])

    def recall(self, pieces: list[bytes]) -> None:
        """Makes sure that distinct pieces are known. Half of what the caches hold, the pieces last met, stays when they are full."""
        new = [p for p in pieces if p not in self.ids]
        if not new:
            return
        if 2 * (len(self.ids) + len(new)) > self.most:
            self.older = (self.ids, self.texts) if len(self.ids) <= self.most else ({}, {})
            self.ids, self.texts = {}, {}
            new = pieces
        ids, texts = self.older
        old = [p for p in new if p in ids]
        self.ids.update((p, ids[p]) for p in old)
        self.texts.update((p, texts[p]) for p in old)
        self._learn([p for p in new if p not in ids])

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of each text, as little-endian 32-bit integers, and the bytes that they decode to."""
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, UNEVEN)
        # pieces are the parts of a text whose tokens don't depend on what stands around them
        odd = [[BARE + w.encode("utf-8") for w in self.match(t)] for t in column.filter(uneven).to_pylist()]
        # only single spaces and line ends: a space goes with what follows it, closing marks stand alone
        bare, first, none = BARE.decode(), *(pa.scalar(x, pa.large_string()) for x in (BARE.decode(), ""))
        even = pc.replace_substring_regex(column.filter(pc.invert(uneven)), CLOSING, f"\\1 {bare}\\2\\3")
        even = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(first, even, none), "\n", f" {bare}\n {bare}"), " ")
        index = even.flatten().dictionary_encode()
        keys = bytes_of(index.dictionary)
        self.recall(list(set(keys).union(*odd)))
        each = zip(*(bytes_of(pa.array([known[k] for k in keys], pa.large_binary()).take(index.indices), even.offsets.to_numpy()) for known in (self.ids, self.texts)))
        others = iter(odd)
        for is_odd in uneven.to_pylist():
            if is_odd:
                ws = next(others)
                yield b"".join(map(self.ids.__getitem__, ws)), b"".join(map(self.texts.__getitem__, ws))
            else:
                yield next(each)


def encoded(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """Number and digest of each text's ids and digest of what they decode to; with keep, also the ids and the decoded bytes."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary()), ("decoded", pa.binary())] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"pieces of {path} {pattern}", lambda: Bpe(path, pattern))
        for b in text_slices(batches, most=8 << 20):
            both = list(bpe.encode_decode([t or "" for t in b.column(1).to_pylist()]))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [[len(i) // 4 for i, _ in both], [sha(i) for i, _ in both], [sha(d) for _, d in both]]
            yield batch(schema, b.column(0), *columns, *([[i for i, _ in both], [d for _, d in both]] * keep))

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep)
