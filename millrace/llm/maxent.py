"""Language-model scoring by a hashed maximum-entropy model.

The probability of a token is that of its class given what stands before, times that of its
bucket in the class given the same, times the token's smoothed share of its bucket's counts.
Classes are the most frequent tokens, each alone, and hashed word endings for all others, whose
words are hashed into buckets. Both softmaxes are maximum-entropy models over hashed features: the
word before (n-gram), the word two back (skip) and the classes of both; the buckets' features also
hold the class. The weights are trained by distributed gradient updates: in each round, every task
descends on its own share of the training tokens, and the weights' changes are averaged, row by
row, by how many tokens each task had for a row. Changes move in blocks of rows and are added
up in a tree, so that what a task reads doesn't grow with the number of tasks.

Counts are exact and of all training tokens: bundles of documents send each distinct word with
its count once, dealt by the word's hash (96 bits), and get totals back, so that a frequent
word takes one row a bundle. Scores come from numpy over sparse rows in slices.

Defined results: a null or empty text is the end token alone; a null doc_id is not learned
from and counts as held out; with nothing to learn, all probabilities are those of an unseen
token; repeated rows count and are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dropped, reducers, stored
from .suffix import BUNDLE, Bundle, bundles, growth

FOLDS, HELD_OUT = 7, 2
ALONE = 24  # most frequent tokens that are classes of their own
CLASSES = 64
BUCKETS = 16  # of the words of a class
#: Rows for each kind of feature, of the classes' weights and of the buckets'.
HASHED, HASHED_IN = 4096, 8192
KINDS = 3
#: Rows of weights that move together, and tasks whose changes (or deals whose sums) are added up at a time.
ROWS, FAN = 1024, 64
ROUNDS = 3
SLICE = 16_000
RATE = 0.6
#: Logits that a step computes at a time, and occurrences up to which rows are added up together.
CACHED, FEW = 1 << 16, 12
PART = 32 << 20  # bytes of text for each deal
_WORD = np.dtype([("a", "<u8"), ("b", "<u4"), ("ending", "u1"), ("n", "<u4")])
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u4"), ("rest", "<u4")])
_IS_MARK = np.isin(np.arange(256), list(b".,;:!?\"'()[]*%&$#|-"))


def held_out(name: int | None) -> bool:
    return name is None or zlib.crc32(str(name).encode()) % FOLDS == HELD_OUT


class Words:
    """A bundle's tokens as indices into its distinct words; word 0 is the end token."""

    def __init__(self, row: dict):
        import xxhash

        bundle = Bundle(row)
        self.ids, self.nulls = bundle.ids, bundle.nulls
        self.held = np.array([held_out(None if null else i) for i, null in zip(self.ids.tolist(), self.nulls.tolist())], bool)
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(bundle.texts, pa.large_binary()).view(pa.large_string())))
        # white space at a text's ends gives empty words, which get the end token's index and go
        index = pa.chunked_array([pa.array([""], pa.large_string()), split.flatten()]).dictionary_encode().chunk(1)
        words = index.indices.to_numpy().view(np.uint32)
        kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(words > 0)])[split.offsets.to_numpy()]
        self.lengths = np.diff(kept) + 1
        self.tokens = np.insert(words[words > 0], kept[1:], 0)
        cuts, raw = np.frombuffer(index.dictionary.buffers()[1], np.int64, len(index.dictionary) + 1), index.dictionary.buffers()[2].to_pybytes()
        digest, ends = xxhash.xxh3_128_digest, cuts.tolist()
        digests = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(ends, ends[1:])]), _DIGEST)
        self.a, self.b = digests["a"].copy(), digests["b"].copy()
        self.ending = ending_of(np.frombuffer(raw + b"\0", np.uint8), cuts)


def ending_of(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each word between two cuts, the hash of its last two bytes before closing marks."""
    start, end = cuts[:-1], cuts[1:].copy()
    some = np.arange(len(end))
    while len(some := some[(end[some] > start[some]) & _IS_MARK[raw[end[some] - 1]]]):
        end[some] -= 1
    last, before = (np.where(end - start >= k, raw[np.maximum(end - k, 0)], 0).astype(np.int64) for k in (1, 2))
    return ((before << 8 | last) * 40503 % 65521 % (CLASSES - ALONE)).astype(np.uint8)


def _compressed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _read(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(x), kind)


_SENT = pa.schema([("deal", pa.int32()), ("bundle", pa.int64()), ("words", pa.binary())])
_ANSWER = pa.schema([("bundle", pa.int64()), ("deal", pa.int32()), ("answer", pa.binary())])
TOTALS = -1


def _dealt(words: Words, deals: int) -> np.ndarray:
    return (words.a % np.uint64(deals)).astype(np.int64)


def counts(table: DataFrame, deals: int) -> DataFrame:
    """(deal, bundle, words): each bundle's distinct words with their counts in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                w = Words(row)
                train = np.repeat(~w.held, w.lengths)
                out = np.empty(len(w.a), _WORD)
                out["a"], out["b"], out["ending"] = w.a, w.b, w.ending
                out["n"] = np.bincount(w.tokens[train], minlength=len(w.a))
                deal = _dealt(w, deals)
                order = np.argsort(deal, kind="stable")
                cuts = np.flatnonzero(np.diff(deal[order])) + 1
                groups = np.split(order, cuts)
                yield batch(_SENT, [int(deal[g[0]]) for g in groups], [row["bundle"]] * len(groups), [out[g].tobytes() for g in groups])

    return table.mapInArrow(run, "deal int, bundle long, words binary")


def total(key: tuple, table: pa.Table) -> pa.Table:
    """Each bundle's words' counts over all bundles; and, as bundle TOTALS, sums over this deal's words."""
    deal, names, blobs = key[0].as_py(), table.column("bundle").to_pylist(), table.column("words").to_pylist()
    w = np.frombuffer(b"".join(blobs), _WORD)
    order = np.lexsort((w["b"], w["a"]))
    a, b = w["a"][order], w["b"][order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    c = np.add.reduceat(w["n"][order].astype(np.int64), start)
    answer = np.empty(len(w), np.int64)
    answer[order] = np.repeat(c, np.diff(np.append(start, len(w))))
    first = order[start]
    ending = w["ending"][first].astype(np.int64)
    cell = ending * BUCKETS + bucket_of(w["b"][first])
    most = np.argsort(-c, kind="stable")[:ALONE]
    most = most[c[most] > 0]
    cells = (CLASSES - ALONE) * BUCKETS
    sums = {
        "n": np.bincount(cell, c, cells).astype(np.int64).tolist(), "v": np.bincount(cell, c > 0, cells).astype(np.int64).tolist(),
        "most": [[int(c[k]), int(w["a"][first[k]]), int(w["b"][first[k]]), int(ending[k])] for k in most],
    }
    cuts = np.cumsum([len(x) // _WORD.itemsize for x in blobs])[:-1]
    rows = [(n, deal, _compressed(x)) for n, x in zip(names, np.split(answer, cuts))] + [(TOTALS, deal, json.dumps(sums).encode())]
    return pa.Table.from_batches([batch(_ANSWER, *(list(x) for x in zip(*rows)))])


def bucket_of(b: np.ndarray) -> np.ndarray:
    return (b % np.uint32(BUCKETS)).astype(np.int64)


def merged(rows: list[bytes]) -> dict:
    """The sums of several deals as those of one: counts, and the most frequent tokens by count and then hash."""
    sums = [json.loads(r) for r in rows]
    zero = np.zeros((CLASSES - ALONE) * BUCKETS, np.int64)
    n, v = (np.sum([zero, *(np.array(s[k], np.int64) for s in sums)], axis=0) for k in ("n", "v"))
    most = sorted((m for s in sums for m in s["most"]), key=lambda m: (-m[0], m[1:]))[:ALONE]
    return {"n": n.tolist(), "v": v.tolist(), "most": most}


def added_up(sums: DataFrame, deals: int) -> dict:
    """merged() over all deals (deal, answer), some at a time."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch(_ANSWER, [TOTALS], [key[0].as_py()], [json.dumps(merged(t.column("answer").to_pylist())).encode()])])

    while deals > FAN:
        sums = sums.withColumn("deal", F.floor(F.col("deal") / FAN).cast("int")).groupBy("deal").applyInArrow(add, "bundle long, deal int, answer binary")
        deals = -(-deals // FAN)
    return merged([r["answer"] for r in sums.select("answer").collect()])


class Totals:
    """Counts of all training tokens: N, V, by class, and by bucket of a class."""

    def __init__(self, sums: dict):
        n, v = (np.concatenate([np.zeros((ALONE, BUCKETS), np.int64), np.array(sums[k], np.int64).reshape(-1, BUCKETS)]) for k in ("n", "v"))
        self.n, self.v = int(n.sum()), int(v.sum())
        #: the most frequent tokens, by count and then hash
        self.alone = [tuple(m) for m in sums["most"]]
        for k, (c, _, b, ending) in enumerate(self.alone):
            bucket = b % BUCKETS
            n[k, bucket], v[k, bucket] = c, 1
            n[ALONE + ending, bucket] -= c
            v[ALONE + ending, bucket] -= 1
        self.bucket_n, self.bucket_v = n, v
        self.class_n, self.class_v = n.sum(axis=1), v.sum(axis=1)
        #: what has no training tokens has the share of one unseen token
        self.bias = np.log((self.class_n + self.class_v + 1) / (self.class_n + self.class_v + 1).sum()).astype(np.float32)
        self.bias_in = np.log((n + v + 1) / (n + v + 1).sum(axis=1, keepdims=True)).astype(np.float32)
        #: a token's share of its bucket is its count and one, over this; of its class, if that is a single token
        self.unit = np.log(n + v + 1.0)
        self.unit[:ALONE] = np.log(self.class_n[:ALONE] + self.class_v[:ALONE] + 1.0)[:, None]


_READY = pa.schema([("bundle", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("held", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary()), ("rows", pa.binary()), ("classes", pa.binary()), ("buckets", pa.binary())])
READY = "bundle long, ids binary, nulls binary, held binary, lengths binary, tokens binary, counts binary, rows binary, classes binary, buckets binary"


def ready(left: pa.Table, right: pa.Table, deals: int, totals: Totals) -> pa.Table:
    """A bundle's tokens with, for each distinct word, its count, its feature row and its class."""
    rows = left.to_pylist()
    if not rows:
        return _READY.empty_table()
    w = Words(rows[0])
    deal = _dealt(w, deals)
    c = np.zeros(len(w.a), np.int64)
    for r in right.to_pylist():
        c[np.flatnonzero(deal == r["deal"])] = _read(r["answer"], "<i8")
    classes = w.ending + np.uint8(ALONE)
    for k, (_, a, b, _) in enumerate(totals.alone):
        classes[(w.a == np.uint64(a)) & (w.b == np.uint32(b))] = k
    features = ((w.a >> np.uint64(20)) % np.uint64(HASHED)).astype(np.uint16)
    out = [rows[0]["bundle"]], [w.ids.tobytes()], [w.nulls.tobytes()], [w.held.tobytes()], [w.lengths.tobytes()], [_compressed(w.tokens)], [_compressed(c)], [_compressed(features)], [_compressed(classes)], [_compressed(bucket_of(w.b).astype(np.uint8))]
    return pa.Table.from_batches([batch(_READY, *out)])


class Ready:
    def __init__(self, row: dict):
        self.ids, self.nulls, self.held = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], bool), np.frombuffer(row["held"], bool)
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        tokens = _read(row["tokens"], "<u4")
        self.counts = _read(row["counts"], "<i8")[tokens]
        rows, classes = _read(row["rows"], "<u2"), _read(row["classes"], "u1")
        first = np.cumsum(self.lengths) - self.lengths
        one = np.concatenate([np.zeros(1, np.uint32), tokens[:-1]])
        two = np.concatenate([np.zeros(2, np.uint32), tokens[:-2]])[: len(tokens)]
        two[first] = 0
        self.first, self.classes = first, classes[tokens]
        c1, c2 = classes[one].astype(np.int64), classes[two].astype(np.int64)
        #: feature rows of each token: by the word before, the word two back, and both classes
        self.features = np.stack([rows[one].astype(np.int64), HASHED + rows[two].astype(np.int64), 2 * HASHED + c1 * CLASSES + c2], axis=1)
        self.buckets = _read(row["buckets"], "u1")[tokens]


def inner_features(features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Feature rows of the buckets' weights: the outer rows hashed with the class."""
    h = (features.astype(np.uint64) * np.uint64(CLASSES) + classes[:, None].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(HASHED_IN)).astype(np.int64) + HASHED_IN * np.arange(KINDS)


def exponentials(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logit of each token's class, the exponentials of all its logits, and their sums; in blocks that fit the cache."""
    e = np.empty((len(features), weights.shape[1]), weights.dtype)
    own = np.empty(len(features), weights.dtype)
    step = max(1, CACHED // weights.shape[1])
    more = np.empty((min(step, len(e)), e.shape[1]), e.dtype)
    for a in range(0, len(e), step):
        s = slice(a, a + step)
        logits = e[s]
        weights.take(features[s, 0], axis=0, out=logits, mode="clip")  # other modes copy
        for k in range(1, features.shape[1]):
            logits += weights.take(features[s, k], axis=0, out=more[: len(logits)], mode="clip")
        logits += bias[s] if bias.ndim > 1 else bias
        np.minimum(logits, 60, out=logits)
        own[s] = logits[np.arange(len(logits)), classes[s]]
        np.exp(logits, out=logits)
    return own, e, e @ np.ones(e.shape[1], np.float32)


def log_share(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log of the probability of each token's class."""
    own, _, total = exponentials(weights, bias, features, classes)
    return own - np.log(total)


def sums_by(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each occurs, and the sum of the values that belong to it."""
    order = np.argsort(rows.astype(np.uint16) if KINDS * max(HASHED, HASHED_IN) <= 1 << 16 else rows, kind="stable")  # 16 bits are sorted by digits
    ordered, values = rows[order], values.take(order, axis=0)
    start = np.flatnonzero(np.diff(ordered, prepend=-1))
    n = np.diff(np.append(start, len(ordered)))
    sums = values.take(start, axis=0)
    # rows that occur a few times are added up all at once, one occurrence after another; others one by one
    left = np.flatnonzero((n > 1) & (n <= FEW))
    for j in range(1, FEW):
        sums[left] += values.take(start[left] + j, axis=0)
        left = left[n[left] > j + 1]
    ones = np.ones(n.max(initial=0), values.dtype)
    for k in np.flatnonzero(n > FEW).tolist():
        np.dot(ones[: n[k]], values[start[k] : start[k] + n[k]], out=sums[k])
    return ordered[start], n, sums


def descend(weights: np.ndarray, seen: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> None:
    """One gradient update from a slice of tokens, in place. A row's step shrinks with the tokens it has seen."""
    _, slope, total = exponentials(weights, bias, features, classes)
    slope /= -total[:, None]
    slope[np.arange(len(classes)), classes] += 1
    for k in range(features.shape[1]):
        row, n, sums = sums_by(features[:, k], slope)
        seen[row] += n
        step = RATE / (n + 8.0) / np.sqrt(1 + seen[row] / 4096.0)
        weights[row] += sums * step.astype(np.float32)[:, None]


class Weights:
    """Weights of classes and of buckets, and how many tokens each row has seen."""

    def __init__(self):
        self.outer, self.inner = np.zeros((KINDS * HASHED, CLASSES), np.float32), np.zeros((KINDS * HASHED_IN, BUCKETS), np.float32)
        self.seen_outer, self.seen_inner = np.zeros(KINDS * HASHED), np.zeros(KINDS * HASHED_IN)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.outer, self.seen_outer), (self.inner, self.seen_inner)]

    def descend(self, r: Ready, t: np.ndarray, totals: Totals) -> None:
        """An update from the tokens t of a bundle."""
        features, classes = r.features[t], r.classes[t]
        descend(self.outer, self.seen_outer, totals.bias, features, classes)
        inside = classes >= ALONE
        if inside.any():
            classes = classes[inside]
            descend(self.inner, self.seen_inner, totals.bias_in[classes], inner_features(features[inside], classes), r.buckets[t][inside])

    def log_probability(self, r: Ready, s: slice, totals: Totals) -> np.ndarray:
        """Of each of some tokens."""
        features, classes, buckets = r.features[s], r.classes[s], r.buckets[s]
        out = log_share(self.outer, totals.bias, features, classes) + np.log(r.counts[s] + 1.0) - totals.unit[classes, buckets]
        inside = classes >= ALONE
        c = classes[inside]
        out[inside] += log_share(self.inner, totals.bias_in[c], inner_features(features[inside], c), buckets[inside])
        return out


_CHANGE = pa.schema([("part", pa.int64()), ("level", pa.int32()), ("block", pa.int32()), ("seen", pa.binary()), ("change", pa.binary())])
CHANGE = "part long, level int, block int, seen binary, change binary"


def trained(table: DataFrame, totals: Totals, rounds: int = ROUNDS) -> Weights:
    """Weights after rounds of distributed updates; each round takes the bundles that are its turn, so that all are seen once."""
    shared = table.sparkSession.sparkContext.broadcast
    weights = Weights()
    for turn in range(rounds):
        base = shared(weights)

        def update(batches: Iterator[pa.RecordBatch], base=base) -> Iterator[pa.RecordBatch]:
            mine = None
            for b in batches:
                for row in b.to_pylist():
                    if mine is None:
                        mine = Weights()
                        mine.outer, mine.inner = base.value.outer.copy(), base.value.inner.copy()
                    r = Ready(row)
                    take = np.flatnonzero(np.repeat(~r.held, r.lengths))
                    for a in range(0, len(take), SLICE):
                        mine.descend(r, take[a : a + SLICE], totals)
            if mine is not None:
                part = TaskContext.get().partitionId() if TaskContext.get() else 0
                for level, ((now, seen), (was, _)) in enumerate(zip(mine.tables(), base.value.tables())):
                    for a in range(0, len(now), ROWS):
                        s = slice(a, a + ROWS)
                        yield batch(_CHANGE, [part], [level], [a // ROWS], [seen[s].tobytes()], [((now[s] - was[s]) * seen[s, None]).astype(np.float32).tobytes()])

        def add(key: tuple, t: pa.Table) -> pa.Table:
            part, level, block = (k.as_py() for k in key)
            seen = sum(np.frombuffer(x.as_py()) for x in t.column("seen"))
            change = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in t.column("change"))
            return pa.Table.from_batches([batch(_CHANGE, [part], [level], [block], [seen.tobytes()], [change.astype(np.float32).tobytes()])])

        turns = table.where(F.pmod(F.xxhash64("bundle"), F.lit(rounds)) == turn)
        changes, tasks = turns.mapInArrow(update, CHANGE), turns.rdd.getNumPartitions()
        while tasks > 1:
            changes = changes.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "level", "block").applyInArrow(add, CHANGE)
            tasks = -(-tasks // FAN)
        following = Weights()
        following.outer, following.inner = weights.outer.copy(), weights.inner.copy()
        for r in changes.collect():  # one row for each block
            now = following.tables()[r["level"]][0]
            seen = np.frombuffer(r["seen"])
            s = slice(r["block"] * ROWS, r["block"] * ROWS + len(seen))
            now[s] += np.frombuffer(r["change"], np.float32).reshape(len(seen), -1) / np.maximum(seen, 1)[:, None].astype(np.float32)
        weights = following
    return weights


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def learned(docs: DataFrame) -> tuple[DataFrame, Totals, Weights]:
    """The prepared bundles of all documents, and the model of the training ones."""
    spark = docs.sparkSession
    grown = growth(docs)
    table = stored(bundles(docs, int(BUNDLE * grown)), "bundles")
    size = table.agg(F.sum("bytes")).first()[0] or 0
    deals = max(reducers(spark), -(-size // int(PART * grown)))
    answers = stored(counts(table, deals).groupBy("deal").applyInArrow(total, "bundle long, deal int, answer binary"), "counts")
    totals = Totals(added_up(answers.where(F.col("bundle") == TOTALS), deals))
    own = answers.where(F.col("bundle") != TOTALS)
    prepared = stored(table.groupBy("bundle").cogroup(own.groupBy("bundle")).applyInArrow(lambda a, b: ready(a, b, deals, totals), READY), "tokens")
    dropped(table)
    dropped(answers)
    return prepared, totals, trained(prepared, totals)


def scored(docs: DataFrame) -> DataFrame:
    """Log10 probabilities of every document under the unigram base and under the model."""
    prepared, totals, weights = learned(docs)
    weights = docs.sparkSession.sparkContext.broadcast(weights)
    base_unit = math.log10(totals.n + totals.v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Ready(row)
                model = np.empty(len(r.counts))
                for a in range(0, len(model), SLICE):
                    model[a : a + SLICE] = weights.value.log_probability(r, slice(a, a + SLICE), totals)
                add = lambda x: np.add.reduceat(x, r.first)
                names = [None if null else i for i, null in zip(r.ids.tolist(), r.nulls.tolist())]
                base = add(np.log(r.counts + 1.0)) / math.log(10) - r.lengths * base_unit
                yield batch(_SCORES, names, r.held, r.lengths, add((r.counts > 0).astype(np.int64)), np.full(len(names), totals.n), base, add(model) / math.log(10))

    return prepared.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
