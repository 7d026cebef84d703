import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix


def brute(rows, span=50):
    least = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - span + 1):
            g = t[s : s + span]
            least[g] = min(i, least.get(g, i))
    out = []
    for (name, _), (i, t) in zip(rows, texts):
        cover = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if least[t[s : s + span]] < i:
                cover[s : s + span] = b"\1" * span
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out.append((name, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(rows, df):
    got = sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


def overlapping(rng, n, size=400, alphabet="abcdefgh é\n"):
    """Texts with copied passages of many lengths, copies, and edited copies."""
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, size)))
        for _ in range(rng.randrange(0, 4)):
            if texts and (src := rng.choice(texts)):
                a = rng.randrange(len(src))
                k = rng.randrange(len(t) + 1)
                t = t[:k] + src[a : a + rng.choice([20, 48, 49, 50, 51, 60, 120, 700])] + t[k:]
        texts.append(t)
        if texts and rng.random() < 0.2:
            texts.append(rng.choice(texts))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(docs_of, seed, monkeypatch):
    rng = random.Random(seed)
    texts = overlapping(rng, 150, 900 if seed else 200)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    check(rows, suffix.repeats_removed(docs_of(rows, extra=("bundle", "kept")).repartition(5)))


def test_edge_cases(docs_of):
    a, b = "x" * 300, "xy" * 200
    rows = [(5, a), (3, a), (None, a), (4, None), (6, ""), (7, b), (7, b), (9, "y" + b), (10, b[:50]), (11, b[:49]), (12, "é" * 60), (13, "ab" * 10 + "é" * 60)]
    check(rows, suffix.repeats_removed(docs_of(rows)))
    assert suffix.repeats_removed(docs_of([(1, "x")]).limit(0)).count() == 0
    check([(1, "short")], suffix.repeats_removed(docs_of([(1, "short")])))


def test_long_texts_are_cut_without_losing_strings(docs_of, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix, "BLOCK", 700)
    parts = [t.encode() for t in overlapping(rng, 12, 5000)]
    for block in suffix.blocks(parts, 3, 50):
        assert len(block.buf) <= 700 + 2 * 50
    seen = {i: 0 for i in range(len(parts))}
    for block in suffix.blocks(parts, 3, 50):
        for lo, hi in zip(block.lo, block.hi):
            k = int(np.searchsorted(block.ends, lo, side="right"))
            seen[block.parts[k][0]] += int(hi - lo + 1)
    assert seen == {i: max(0, len(t) - 49) for i, t in enumerate(parts)}


def test_column_sort_orders_suffixes():
    rng = random.Random(5)
    for _ in range(20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(rng.randrange(1, 60))]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        length = np.array([len(t) for t in texts])
        first = np.cumsum(length) - length
        where = suffix.column_sorted(buf, first, length)
        ends = {int(f + k): t[k:] for f, t in zip(first, texts) for k in range(len(t))}
        got = [ends[w] for w in where[len(texts) :].tolist()]  # the empty suffixes come first
        assert got == sorted(ends.values())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, suffix.repeats_removed(docs))


def test_larger_bundles_and_parts_give_the_same(docs_of, monkeypatch):
    rng = random.Random(21)
    rows = list(enumerate(overlapping(rng, 80, 500)))
    docs = docs_of(rows).repartition(3)
    assert suffix.growth(docs) == 1
    monkeypatch.setattr(suffix, "STEADY", 1000)
    assert 1 < suffix.growth(docs) <= suffix.MOST
    monkeypatch.setattr(suffix, "BUNDLE", 500)
    monkeypatch.setattr(suffix, "PART", 2000)
    check(rows, suffix.repeats_removed(docs))


def test_rows_that_move_grow_with_the_table():
    def rows(total):
        grown = suffix.growth_at(total)
        return total / (suffix.BUNDLE * grown) * total / (suffix.PART * grown)

    for total in (2 << 30, 10 << 30, 50 << 30, 200 << 30):
        assert rows(total) <= 1.01 * total / suffix.STEADY * rows(suffix.STEADY)
