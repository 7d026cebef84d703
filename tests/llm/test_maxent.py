import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import maxent


def brute(rows):
    tokens = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        tokens[i] = [*re.findall("[^\x20\x09-\x0d]+", low), None]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def check(rows, got):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_edge_cases(docs_of):
    rows = [(i, f"The cat  number{i % 5}\tsat.\n") for i in range(60)] + [(100, None), (101, ""), (102, "É É unseen " * 500), (103, "A b c\x0bd\x1ce"), (None, "the cat")]
    check(rows, maxent.scored(docs_of(rows, extra=("score", "tokens"))).collect())
    assert maxent.scored(docs_of([(1, "x")]).limit(0)).count() == 0
    only_held = [(next(i for i in range(100) if maxent.held_out(i)), "a b")]
    check(only_held, maxent.scored(docs_of(only_held)).collect())


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent.KINDS * maxent.HASHED, maxent.CLASSES)).astype(np.float32)
    features = rng.integers(0, maxent.HASHED, (50, 3))
    p = [np.exp(maxent.log_share(weights, np.zeros(maxent.CLASSES, np.float32), features, np.full(50, k))) for k in range(maxent.CLASSES)]
    assert np.allclose(np.sum(p, axis=0), 1, atol=1e-4)
    # in a class, its known words and one unseen word share everything
    sums = maxent.merged([b'{"n": [%s], "v": [%s], "most": [[7, 1, 2, 0]]}' % (b",".join([b"10"] * 640), b",".join([b"3"] * 640))])
    totals = maxent.Totals(sums)
    assert (totals.n, totals.v) == (6400, 1920) and totals.class_n.sum() == 6400 and totals.class_n[maxent.ALONE] == 153
    assert np.allclose(np.exp(totals.bias).sum(), 1) and np.allclose(np.exp(totals.bias_in).sum(axis=1), 1)


def plain_scores(rows, totals, weights):
    """Each document's score from its words, one token and one class at a time."""
    import xxhash

    def word(w):
        raw = xxhash.xxh3_128_digest(w)[:12]
        a, b = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")
        ending = int.from_bytes(w.rstrip(b".,;:!?\"'()[]*%&$#|-")[-2:], "big") * 40503 % 65521 % 40
        single = [(x, y) for _, x, y, _ in totals.alone]
        return single.index((a, b)) if (a, b) in single else 24 + ending, b % 16, (a >> 20) % 4096

    texts = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b""] for i, t in rows}
    c = Counter(w for i, ws in texts.items() if not maxent.held_out(i) for w in ws)
    known = {w: word(w) for ws in texts.values() for w in ws}
    out = {}
    for i, ws in texts.items():
        score, before = 0.0, [b"", b""]
        for w in ws:
            (k, bucket, _), (c1, _, r1), (c2, _, r2) = known[w], known[before[-1]], known[before[-2]]
            outer = [r1, 4096 + r2, 2 * 4096 + c1 * 64 + c2]
            logits = [float(totals.bias[j]) + sum(float(weights.outer[f, j]) for f in outer) for j in range(64)]
            score += logits[k] - math.log(sum(map(math.exp, logits)))
            if k < 24:
                score += math.log((c[w] + 1) / (totals.class_n[k] + totals.class_v[k] + 1))
            else:
                inner = [((f * 64 + k) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 8192 + 8192 * j for j, f in enumerate(outer)]
                logits = [float(totals.bias_in[k, j]) + sum(float(weights.inner[f, j]) for f in inner) for j in range(16)]
                score += logits[bucket] - math.log(sum(map(math.exp, logits)))
                mine = [x for x, (y, z, _) in known.items() if (y, z) == (k, bucket) and c[x]]
                score += math.log((c[w] + 1) / (sum(c[x] for x in mine) + len(mine) + 1))
            before.append(w)
        out[i] = score / math.log(10)
    return out


def test_scores_match_a_plain_computation(docs_of):
    rng = random.Random(7)
    words = ["w%d%s" % (i, rng.choice(["ing", "ed", "s,", "."])) for i in range(60)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randrange(0, 25)))) for i in range(120)] + [(500, None), (501, "never seen")]
    docs = docs_of(rows)
    _, totals, weights = maxent.learned(docs)
    assert np.abs(weights.outer).max() > 0.01 and np.abs(weights.inner).max() > 0.01
    want = plain_scores(rows, totals, weights)
    for r in maxent.scored(docs).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=2e-4)


def test_sums_in_a_tree_are_the_sums(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FAN", 3)
    rng = random.Random(9)
    rows = [(-1, d, json.dumps({"n": [rng.randrange(9) for _ in range(640)], "v": [1] * 640, "most": [[rng.randrange(99), d, k, 0] for k in range(24)]}).encode()) for d in range(40)]
    assert maxent.added_up(spark.createDataFrame(rows, "bundle long, deal int, answer binary"), 40) == maxent.merged([r[2] for r in rows])


def test_an_update_follows_the_gradient():
    rng = np.random.default_rng(5)
    features, classes, bias = rng.integers(0, 6, (40, 3)) + np.array([0, 10, 20]), rng.integers(0, 4, 40), rng.normal(size=(40, 4)).astype(np.float32)
    weights, seen = rng.normal(size=(30, 4)).astype(np.float32), np.zeros(30)
    total = lambda w: float(maxent.log_share(w, bias, features, classes).astype(np.float64).sum())
    after = weights.copy()
    maxent.descend(after, seen, bias, features, classes)
    for row in (0, 12, 25):
        n = np.count_nonzero(features == row)
        for k in range(4):
            up, down = weights.copy(), weights.copy()
            up[row, k] += 0.01
            down[row, k] -= 0.01
            slope = (total(up) - total(down)) / 0.02
            # rows of later kinds see the same slope: an update is of one point
            assert (after - weights)[row, k] == pytest.approx(slope * maxent.RATE / (n + 8) / np.sqrt(1 + n / 4096), abs=2e-3)


def test_updates_raise_the_likelihood():
    rng = np.random.default_rng(2)
    weights, seen, bias = np.zeros((maxent.KINDS * maxent.HASHED, maxent.CLASSES), np.float32), np.zeros(maxent.KINDS * maxent.HASHED), np.zeros(maxent.CLASSES, np.float32)
    features = rng.integers(0, 20, (4000, 3)) + np.array([0, maxent.HASHED, 2 * maxent.HASHED])
    classes = features[:, 0] % maxent.CLASSES
    score = lambda: maxent.log_share(weights, bias, features, classes).mean()
    before = score()
    for _ in range(30):
        maxent.descend(weights, seen, bias, features, classes)
    assert score() > before + 1


def test_model_beats_the_base_on_held_out_documents(spark):
    from millrace.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op5_maxent(spark, sf).collect()
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def bundle_of(texts):
    import zstandard

    sizes = np.array([len(t) for t in texts], "<i8")
    return {"ids": np.arange(len(texts), dtype="<i8").tobytes(), "nulls": bytes(len(texts)), "lengths": sizes.tobytes(), "bytes": int(sizes.sum()), "body": zstandard.ZstdCompressor().compress(b"".join(texts))}


def plain_words(texts):
    """Indices of all tokens, lengths, and digests and ending hashes of the distinct words, from one loop."""
    import xxhash

    index = {b"": 0}
    each = [[index.setdefault(w, len(index)) for w in t.lower().split()] + [0] for t in texts]
    digests = [xxhash.xxh3_128_digest(w) for w in index]
    endings = [int.from_bytes(w.rstrip(b".,;:!?\"'()[]*%&$#|-")[-2:], "big") * 40503 % 65521 % 40 for w in index]
    return [x for xs in each for x in xs], [len(xs) for xs in each], [int.from_bytes(d[:8], "little") for d in digests], [int.from_bytes(d[8:12], "little") for d in digests], endings


def test_words_are_those_of_a_plain_split():
    rng = random.Random(3)
    cases = [[b""], [b" "], [b"", b"", b" \t"], [bytes(range(256)), b"A.\x1c b,, ... x"], ["É \x85é\xa0ß".encode(), b"", b"a... "]]
    cases += [[bytes(rng.choices(b"aAbB.,-\x00\x1c\x85 \t\n\x0b\x0c\r\xc3\xa9", k=rng.randrange(30))) for _ in range(rng.randrange(1, 8))] for _ in range(200)]
    for texts in cases:
        w = maxent.Words(bundle_of(texts))
        assert (w.tokens.tolist(), w.lengths.tolist(), w.a.tolist(), w.b.tolist(), w.ending.tolist()) == plain_words(texts), texts


def test_words_take_less_time_than_a_plain_split():
    rng = random.Random(4)
    known = ["".join(rng.choices(["th", "in", "on", "er", "ea", "st"], k=rng.randrange(1, 6))) + rng.choice(["", ".", ","]) for _ in range(100_000)]
    texts = [" ".join(rng.choices(known, k=400)).encode() for _ in range(1500)]
    row = bundle_of(texts)

    def seconds(f, x):
        began = time.process_time()
        f(x)
        return time.process_time() - began

    assert min(seconds(maxent.Words, row) for _ in range(3)) < 0.7 * min(seconds(plain_words, texts) for _ in range(3))


def test_sums_by_row():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5000):
        rows, values = (rng.zipf(1.4, n) % 300).astype(np.int64), rng.normal(size=(n, 7)).astype(np.float32)
        row, times, sums = maxent.sums_by(rows, values)
        want = np.zeros((300, 7))
        np.add.at(want, rows, values)
        assert row.tolist() == np.unique(rows).tolist() and times.tolist() == np.bincount(rows, minlength=300)[row].tolist()
        assert np.allclose(sums, want[row], atol=1e-3)
