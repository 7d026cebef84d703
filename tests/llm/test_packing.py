import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, got, library):
    texts = [(i, t or "") for i, t in rows]
    want = {}
    for (i, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False)):
        want.setdefault(i, []).append(np.array([*e.ids, 2], "<u4").tobytes())
    parts, fill = {}, {}
    for p in got:
        parts.setdefault(p.doc_id, []).append(p)
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(parts) == set(want)
    for i, ids in want.items():
        if len(ids) > 1:
            assert sum(p.length for p in parts[i]) == sum(len(x) // 4 for x in ids)
            continue
        at = 0
        for p in sorted(parts[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[0]) // 4
            assert p.ids_crc32 == zlib.crc32(ids[0][4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids[0])
    for ps in fill.values():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at
            at += n
        assert at <= 4096 and not at & (at - 1)


def test_edge_cases(docs_of, library):
    rows = [(1, None), (2, ""), (3, "Hello, WORLD! it's... a.b \t\x0b x"), (4, "word " * 9000), (5, "x" * 20000), (6, "<|startoftext|> a <|endoftext|>b"), (7, "é É日本 ﬁ́ \x1c  "), (8, "a,\xa0b."), (9, "same"), (9, "same"), (None, "n")]
    check(rows, packing.packed(docs_of(rows, extra=("offset", "ids")), PATH).collect(), library)
    assert packing.packed(docs_of(rows).limit(0), PATH).count() == 0


def test_special_tokens_in_texts(library):
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "don't", "A", "b.", " ", "\n", "É", "<", "endoftext", "<|endoftext", "?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    encode = packing.WordEncoder(PATH)
    for t, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    literal = Tokenizer.from_file(PATH)
    literal.encode_special_tokens = True
    encode = packing.WordEncoder(PATH, literal=True)
    for t, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == literal.encode(t, add_special_tokens=False).ids, t


def test_pack_fills_sequences_and_balances_cost():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 3000, 400)
    rows, n = packing.pack(lengths)
    fill = np.bincount(rows[:, 3], rows[:, 2], minlength=n)
    assert fill.sum() == lengths.sum() and all(x == 4096 or int(x) & (int(x) - 1) == 0 for x in fill)
    cost = np.bincount(rows[:, 3], packing.LINEAR * rows[:, 2] + packing.QUADRATIC * rows[:, 2].astype(float) ** 2, minlength=n)[fill == 4096]
    assert cost.std() < 0.25 * cost.mean()


def test_small_cache_changes_nothing(library):
    encode = packing.WordEncoder(PATH, most=20)
    texts = [f"Word{i} and, thing{i % 9}. End" for i in range(100)]
    for i in range(0, 100, 10):
        for t, ids in zip(texts[i : i + 10], encode([t.encode() for t in texts[i : i + 10]])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_whole_table(spark, sf, library):
    from millrace.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op9_packing(spark, sf).collect(), library)


def test_plain_words_and_odd_ones_match_the_library(library):
    rng = random.Random(9)
    letters = "abtheings. ,'\n\t<|>ÀàéßÿþIİſKÅ×÷´ªº́日1\x0b\x1c\x85\xa0"
    texts = ["", " ", "<|endoftext|>", "aß, àÿ. É ß÷", "A. b,, c;\x0bd.\x1ce. f."] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1000)]
    small = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if c != 0xF7]
    words = ["".join(rng.choices(small, k=rng.randrange(1, 9))) for _ in range(2000)] + small
    assert all(packing.PLAIN.fullmatch(w.encode()) for w in words)
    for t, ids in zip(texts + words, packing.WordEncoder(PATH)([t.encode() for t in texts + words])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_a_full_cache_keeps_the_words_last_met():
    encode, learned = packing.WordEncoder(PATH, most=100), []
    learn = encode.learn
    encode.learn = lambda words: (learned.extend(words), learn(words))
    for k in range(50):
        encode([f"some frequent words and rare{k}a rare{k}b".encode()])
        assert len(encode.known) + len(encode.older) <= 100
    assert sorted(w for w in learned if w in (b"some", b"frequent", b"words", b"and")) == [b"and", b"frequent", b"some", b"words"]


def test_known_words_take_less_time_than_a_plain_split():
    rng = random.Random(4)
    known = ["".join(rng.choices(["th", "in", "on", "er", "ea", "st"], k=rng.randrange(1, 6))) for _ in range(20_000)]
    texts = [" ".join(w + "." * (k % 9 == 8) for k, w in enumerate(rng.choices(known, k=400))).encode() for _ in range(1500)]
    encode = packing.WordEncoder(PATH)
    encode(texts)
    marks = re.compile(rb"(?<=[a-z])([.,!?%*&$#:;]+)(?=\s)")

    def plain(texts):
        words = [marks.sub(rb" \1", t.lower()).split() for t in texts]
        assert not set().union(*words).difference(encode.known)
        return [b"".join(map(encode.known.__getitem__, ws)) for ws in words]

    def seconds(f):
        began = time.process_time()
        f(texts)
        return time.process_time() - began

    assert encode(texts) == plain(texts)
    assert min(seconds(encode) for _ in range(3)) < 0.8 * min(seconds(plain) for _ in range(3))
