import random
import zlib

import numpy as np
import pytest

from millrace.llm import langid


def brute_vector(text):
    """Sum over trigrams of the bound letter vectors, one trigram at a time."""
    codes, gap = [0], True
    for c in (text or "").lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    if codes[-1]:
        codes.append(0)
    out = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        out += np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
    return out


def test_vectors_match_a_slow_sum():
    texts = ["", "Hello, World 12!", "éà ñ", "日本語 text", "a", "  \n", "ABC abc", "İstanbul ß"]
    vectors, letters = langid.bundled(texts)
    for t, v, n in zip(texts, vectors, letters):
        assert np.array_equal(v, brute_vector(t)), t
        assert n == sum(c.isalpha() for c in t.lower())


def test_edge_cases(docs_of):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(20)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(20)]
    rows += [(300, None, "en"), (301, "", None), (302, "12 34 !!", "de"), (303, "the hat", None), (None, "die hunde", "de"), (303, "the hat", None), (304, "z" * 100000, None)]
    got = langid.identified_with_folds(docs_of(rows, extra=("lang_pred", "score"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[300].lang_pred == by[301].lang_pred == by[302].lang_pred == "und" and by[300].score == 0
    assert by[303].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert langid.identified_with_folds(docs_of(rows).limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified_with_folds(docs_of([(1, "abc", None)])).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from millrace.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op1_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got) > 100


def plain(rows):
    """(lang, score, two best cosines) of each text from trigrams one at a time, learned from the rows outside the held-out fold."""

    def vector(text):
        letters = [0]
        for c in f"\n{(text or '').lower()}\n"[1:]:
            code = ord(c) if c.isalpha() else 0
            if code or letters[-1]:
                letters.append(code)
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if a or b or c:
                out += np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
        return out, any(letters)

    vectors = {i: vector(t) for i, t, _ in rows}
    sums = {}
    for i, _, lang in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + vectors[i][0]
    out = {}
    for i, (v, any_letter) in vectors.items():
        cosines = {k: float(v @ p / max(1e-9, np.linalg.norm(v) * np.linalg.norm(p))) for k, p in sorted(sums.items())}
        best = max(cosines, key=cosines.get, default=None)
        out[i] = (best, min(1.0, max(0.0, cosines[best])), sorted(cosines.values())[-2:]) if any_letter and best else ("und", 0.0, [0, 1])
    return out


def test_predictions_match_a_plain_computation(spark, sf, docs_of):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    rows += [(90001, None, "en"), (90002, "12 34 !", None), (90003, "ÀÉ ß日本 x", "fr"), (90004, "a", None)]
    want = plain(rows)
    got = langid.identified_with_folds(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score, (second, first) = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-4)
        assert r.lang_pred == lang or first - second < 1e-4


def test_texts_in_unknown_languages_go(spark, docs_of):
    known = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 700").limit(300).collect()]
    cyrillic = str.maketrans({chr(97 + i): chr(0x430 + i) for i in range(26)})
    rng = random.Random(4)
    foreign = [(100_000 + i, t[:700].lower().translate(cyrillic), None) for i, t, _ in known[:100]]
    foreign += [(200_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in t[:700]), None) for i, t, _ in known[:100]]
    short = [(300_000 + i, t[:40], None) for i, t, _ in known[:100]]
    got = {r.doc_id for r in langid.in_known_languages(docs_of(known + foreign + short)).collect()}
    assert {i for i, *_ in known} <= got
    assert len({i for i, *_ in short} - got) <= 1
    assert len({i for i, *_ in foreign} & got) <= 20
