"""Cost-balanced packing of tokenised documents into sequences of a fixed token capacity.

A document's ids are those of the word tokenizer plus an end id. Documents of at least one
capacity give whole sequences first; what remains is packed in groups of bounded size: in
descending length, each remainder goes to the sequence of lowest cost (linear plus quadratic
attention cost of what it holds) that has room, and is cut across the cheapest sequences if
none has. A group's last sequence is split into powers of two, which need no padding.

No rows move between tasks: each task packs its own documents, a bounded number of tokens at
a time, and sequence ids carry the task's partition. Defined results: a null or empty text
is the end id alone; repeated rows are packed again; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch, bytes_of, held, pick, text_slices, utf8

CAPACITY = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
CACHE_WORDS = 500_000
#: Marks between a letter and white space, as Arrow's expressions have it.
CLOSING = r"([a-z])([.,!?%*&$#:;]+)([\t-\r ])"
#: Words that are one piece to the tokenizer and that it doesn't change: small letters of ASCII and Latin-1.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: How the tokenizer's byte level writes the bytes of such words.
WRITTEN = {b: 0x100 + 33 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 0x143}
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


class WordEncoder:
    """Ids of whole texts by way of a bounded cache of words.

    The tokenizer's own splitting never joins characters across ASCII white space, and parts a
    letter from punctuation that follows it, so a text's ids are those of its words and closing
    punctuation one after another. New words of small letters, which its normalizer and splitting
    leave alone, go to its model directly; others are encoded together, parted by a special token.
    Special tokens that stand in a text are taken as the library takes them; with `literal`, as
    the characters they are.
    """

    BREAK = "<|startoftext|>"

    def __init__(self, path: str, most: int = CACHE_WORDS, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.breaking, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = literal
        self.break_id = self.breaking.token_to_id(self.BREAK)
        self.known: dict[bytes, bytes] = {}
        #: words known before `known` was begun anew
        self.older: dict[bytes, bytes] = {}
        self.most = most
        self.model = self.breaking.model

    def learn(self, words: list[bytes]) -> None:
        tokenize, plain, others = self.model.tokenize, PLAIN.fullmatch, []
        for w in words:
            if plain(w):
                self.known[w] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(w.decode("latin-1").translate(WRITTEN))])
            else:
                others.append(w)
        words = others
        odd = [w for w in words if b"<|" in w]
        words = [w for w in words if b"<|" not in w] if odd else words
        for w in odd:
            self.known[w] = np.array(self.plain.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            text = b"".join(some[:1]) + b"".join(self.BREAK.encode() + w for w in some[1:])
            ids = np.array(self.breaking.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [*(4 * np.flatnonzero(ids == self.break_id)).tolist(), 4 * len(ids)]
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                self.known[w] = raw[start:end]
                start = end + 4

    def recall(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words. Half of what the cache holds, the words last met, stays when it is full."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if not new:
            return found
        if 2 * (len(self.known) + len(new)) > self.most:
            self.known, self.older = {}, self.known if len(self.known) <= self.most else {}
            new = words
        old = list(map(self.older.get, new))
        self.known.update((w, x) for w, x in zip(new, old) if x is not None)
        self.learn([w for w, x in zip(new, old) if x is None])
        return list(map(self.known.__getitem__, words))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id."""
        # lower case only spares the cache words, and would make special tokens of other letters
        lowered = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_binary())
        parted = pc.replace_substring_regex(lowered, CLOSING, r"\1 \2\3")
        split = pc.ascii_split_whitespace(parted.view(pa.large_string()))
        index = split.flatten().dictionary_encode()
        words = bytes_of(index.dictionary)
        # white space at a text's ends gives empty words, which have no ids
        ids = pa.array(self.recall(words), pa.large_binary()).take(index.indices)
        return bytes_of(ids, split.offsets.to_numpy())


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows of (document, start, length, sequence, offset) and the number of sequences.

    Every sequence is full; the lengths of the last ones are the powers of two that make up
    the tokens left over.
    """
    whole, rest = np.divmod(lengths, capacity)
    rows = [(d, j * capacity, capacity) for d in np.flatnonzero(whole).tolist() for j in range(int(whole[d]))]
    out = [(d, s, n, k, 0) for k, (d, s, n) in enumerate(rows)]
    first, total = len(out), int(rest.sum())
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    size = np.array(room, dtype=np.int64)
    room = size.copy()
    # a short sequence starts at the cost of what it lacks, so that it is not preferred for being short
    cost = LINEAR * (capacity - size) + QUADRATIC * (capacity - size).astype(np.float64) ** 2
    order = np.argsort(-rest, kind="stable")
    for d in order[: np.count_nonzero(rest)].tolist():
        left, start = int(rest[d]), int(whole[d]) * capacity
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room)
            k = int(fits[np.argmin(cost[fits])])
            n = min(left, int(room[k]))
            out.append((d, start, n, first + k, int(size[k] - room[k])))
            room[k] -= n
            cost[k] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return np.array(out, dtype=np.int64).reshape(-1, 5), first + len(size)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence."""
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(f"words of {tokenizer}", lambda: WordEncoder(tokenizer))
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        ids: list[bytes] = []
        names: list = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, tokens
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            rows, used = pack(lengths, capacity)
            pieces = [ids[d][4 * s : 4 * (s + n)] for d, s, n in rows[:, :3].tolist()]
            columns = [[names[d] for d in rows[:, 0].tolist()], rows[:, 1], rows[:, 2], [zlib.crc32(p) for p in pieces], lengths[rows[:, 0]], rows[:, 3] + base, rows[:, 4]]
            out = batch(schema, *columns, *([pieces] * keep_ids))
            base += used
            ids.clear()
            names.clear()
            tokens = 0
            return out

        for b in text_slices(batches, most=4 << 20):
            for name, x in zip(b.column(0).to_pylist(), encode(utf8(b.column(1)))):
                ids.append(x + end)
                names.append(name)
                tokens += len(x) // 4 + 1
                if tokens >= GROUP_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids)
