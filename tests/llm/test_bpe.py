import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def check(rows, got, library):
    texts = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_random_texts(docs_of, library):
    rng = random.Random(1)
    letters = "abcdethin é\n\t  .,'s!1ß日本 \x1c\0"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(2000)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 3000), (5003, "=" * 900 + "ab" * 900), (5004, "".join(rng.choice("etaoins") for _ in range(1500))), (5005, " don't 's it's 'S")]
    check(rows, bpe.encoded(docs_of(rows, extra=("ids", "n_tokens")), PATH, P.PATTERN).collect(), library)
    assert bpe.encoded(docs_of([(1, "x")]).limit(0), PATH, P.PATTERN).count() == 0
    assert bpe.encoded(docs_of([(1, "x"), (1, "x")]), PATH, P.PATTERN).count() == 2


def test_small_caches_change_nothing(library):
    encoder = bpe.Bpe(PATH, P.PATTERN, most=50)
    texts = [f"word{i} and wörd{i % 7}. Next" for i in range(200)]
    for i in range(0, 200, 20):
        for t, (ids, decoded) in zip(texts[i : i + 20], encoder.encode_decode(texts[i : i + 20])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and decoded == t.encode()


def test_whole_table(spark, sf, library):
    from millrace.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op3_bpe(spark, sf).collect(), library)


def test_long_words_match_the_library(library):
    rng = random.Random(5)
    encoder = bpe.Bpe(PATH, P.PATTERN)
    kinds = ["ab", "etaoins", "abcdefghijklmnopqrstuvwxyz", "日本é", "=-", "aA1", "thein"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60, 1500))) for _ in range(100)]
    texts += ["".join(rng.choice(k) for _ in range(rng.randrange(60, 2000))) for k in kinds for _ in range(20)]
    texts += [u * rng.randrange(30, 900) for u in ("a", "ab", "aab", "the", "=", "日", "zqx", "aaaaaab", "ing")]
    for t, (ids, decoded) in zip(texts, encoder.encode_decode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), t[:80]
        assert decoded == t.encode()


def test_a_million_letters_without_a_space(library):
    began = time.perf_counter()
    text = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    ((ids, decoded),) = bpe.Bpe(PATH, P.PATTERN).encode_decode([text])
    assert decoded == text.encode() and time.perf_counter() - began < 120
    # the library's time grows with the square of a word's length; a part ends alike, as its last cut shows
    part = np.frombuffer(bpe.Bpe(PATH, P.PATTERN).contract_long([text[:20_000].encode()])[0].astype("<u4").tobytes(), "<u4").tolist()
    assert part == library.encode_ordinary(text[:20_000]) and np.frombuffer(ids, "<u4")[: len(part) - 20].tolist() == part[:-20]


def test_all_kinds_of_space_and_closing_marks_match_the_library(library):
    rng = random.Random(11)
    letters = "abcE ,.!'s1²_ 日本éßÿ×÷ªΩжअ́ɐ" + " \n" * 4
    spaces = "\t\r\x0b\x0c\x1c\x1f\x85\xa0  ​   　﻿\0\x7f"
    texts = ["", " ", "\n", "a", "a.", "a. ", " a", "a.\nb", "a\n\nb", "é.,!", "_. b", "².", "Ω. x", "日. x", "a\0 b"]
    texts += ["".join(rng.choice(letters if rng.random() < 0.97 else spaces) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [f"ab.{c}cd{c}" for c in spaces]
    for t, (ids, decoded) in zip(texts, bpe.Bpe(PATH, P.PATTERN).encode_decode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and decoded == t.encode(), repr(t)


def test_full_caches_keep_the_pieces_last_met():
    encoder, learned = bpe.Bpe(PATH, P.PATTERN, most=100), []
    words = encoder.encode_words
    encoder.encode_words = lambda some: (learned.extend(some), words(some))[1]
    for k in range(50):
        assert [d for _, d in encoder.encode_decode([f"some frequent words and rare{k}a rare{k}b"])] == [b"some frequent words and rare%da rare%db" % (k, k)]
        assert len(encoder.ids) + len(encoder.older[0]) <= 100
    assert learned.count(b" frequent") == learned.count(b" words") == 1


def test_known_pieces_take_less_time_than_a_plain_split():
    rng = random.Random(4)
    known = ["".join(rng.choices(["th", "in", "on", "er", "ea", "st"], k=rng.randrange(1, 6))) for _ in range(5_000)]
    texts = [" ".join(w + "." * (k % 9 == 8) for k, w in enumerate(rng.choices(known, k=400))) for _ in range(1500)]
    encoder = bpe.Bpe(PATH, P.PATTERN)
    once = list(encoder.encode_decode(texts))
    marks = re.compile(r"(?<=[^\W_])([.,!?%*&$#:;]+)(?=[ \n]|\Z)")

    def plain(texts):
        of = {k if isinstance(k, str) else k.decode(): (k, x) for k, x in encoder.ids.items()}
        ids, decoded = {s: x for s, (_, x) in of.items()}, {s: encoder.texts[k] for s, (k, _) in of.items()}
        began = time.process_time()
        each = [("\0" + marks.sub(" \0\\1", t)).replace("\n", " \0\n \0").split(" ") for t in texts if len(t.split()) == t.count("\n") + t.count(" ") + 1]
        assert not set().union(*each).difference(ids)
        got = [(b"".join(map(ids.__getitem__, ks)), b"".join(map(decoded.__getitem__, ks))) for ks in each]
        return time.process_time() - began, got

    def own(texts):
        began = time.process_time()
        got = list(encoder.encode_decode(texts))
        return time.process_time() - began, got

    assert own(texts)[1] == plain(texts)[1] == once
    assert min(own(texts)[0] for _ in range(3)) < 0.8 * min(plain(texts)[0] for _ in range(3))
