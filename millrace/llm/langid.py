"""Language identification by hyperdimensional profiles.

Each letter (and the gap between words) has a random vector of +1 and -1. A trigram's vector
binds its letters' vectors, shifted by their places, by multiplication; a document's vector
bundles those of all its trigrams by addition. A language's prototype bundles its documents.
The prediction is the language whose prototype has the largest cosine with the document.

Prototypes are fitted on about SAMPLE labelled documents of each language, a bound that does
not grow with the table. Defined results: `und` with score 0 if a text is null, has no letters,
or nothing was learned; of equal cosines the first language in order wins; documents without a
label or without a doc_id are never learned from; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, held, pick, text_slices

DIMENSIONS = 512
#: About so many documents of each language are learned from.
SAMPLE = 5000
FOLDS = 5
UNKNOWN = "und"
SHARDS = 8
#: Texts whose trigrams are counted at a time.
ROWS = 128
_IS_LETTER: np.ndarray | None = None
_VECTORS: dict[int, np.ndarray] = {}


def fold(folds: int = FOLDS) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    if code not in _VECTORS:
        if len(_VECTORS) > 50_000:
            _VECTORS.clear()
        _VECTORS[code] = (np.random.default_rng([17, code]).integers(0, 2, dimensions) * 2 - 1).astype(np.float32)
    return _VECTORS[code]


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts' letters in lower case, runs of anything else as one 0, and where each text's end."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    each = [np.frombuffer(f"\n{t.lower()}\n".encode("utf-32-le", "replace"), "<u4") for t in texts]
    codes = np.concatenate([*each, np.zeros(0, "<u4")])
    codes = np.where(_IS_LETTER[codes], codes, 0)
    # a gap counts only after a letter or at a text's start
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    ends = np.cumsum([len(e) for e in each])
    keep[np.append(0, ends[:-1])] = True
    return codes[keep].astype(np.int64), np.cumsum(keep)[ends - 1]


def bundled(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and its number of letters."""
    codes, ends = letters_of(texts)
    letters = np.add.reduceat((codes > 0).astype(np.int64), np.append(0, ends[:-1]))
    used, ids = np.unique(codes, return_inverse=True) if len(codes) < 4096 else _compact(codes)
    n = len(used)
    gram = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    inside = (text[:-2] == text[2:]) & ((codes[:-2] > 0) | (codes[1:-1] > 0) | (codes[2:] > 0))
    gram, text = gram[inside], text[:-2][inside]
    if n**3 <= 1 << 24:
        flag = np.zeros(n**3, bool)
        flag[gram] = True
        grams = np.flatnonzero(flag)
        place = np.empty(n**3, np.int32)
        place[grams] = np.arange(len(grams))
        which = place[gram]
    else:
        grams, which = np.unique(gram, return_inverse=True)
    base = np.stack([letter_vector(int(c), dimensions) for c in used])
    out = np.zeros((len(texts), dimensions), np.float32)
    # the bound vectors of a few thousand trigrams at a time
    for a in range(0, len(grams), 8192):
        g = grams[a : a + 8192]
        bound = np.roll(base, 2, axis=1)[g // (n * n)] * np.roll(base, 1, axis=1)[g // n % n] * base[g % n]
        some = np.flatnonzero((which >= a) & (which < a + len(g))) if len(grams) > 8192 else slice(None)
        row, column = text[some], which[some] - a
        for b in range(0, len(texts), ROWS):
            x, y = np.searchsorted(row, (b, b + ROWS))
            n_rows = min(ROWS, len(texts) - b)
            counts = np.bincount((row[x:y] - b) * len(g) + column[x:y], minlength=n_rows * len(g)).reshape(n_rows, len(g))
            out[b : b + n_rows] += counts.astype(np.float32) @ bound
    return out, letters


def _compact(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flag = np.zeros(0x110000, bool)
    flag[codes] = True
    used = np.flatnonzero(flag)
    place = np.empty(0x110000, np.int32)
    place[used] = np.arange(len(used))
    return used, place[codes].astype(np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from labelled rows (text, lang) with a doc_id to sample by."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, dimensions), np.float32)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 20) * min(1.0, sample / n)) + 1))])
    drawn = docs.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("vector", pa.binary())])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        sums: dict[str, np.ndarray] = {}
        for b in text_slices(batches, most=1 << 20):
            vectors, _ = bundled([t or "" for t in b.column(1).to_pylist()], dimensions)
            for lang, v in zip(b.column(0).to_pylist(), vectors):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SHARDS
            yield batch(schema, list(sums), [shard] * len(sums), [v.tobytes() for v in sums.values()])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()], axis=0)
        return pa.Table.from_batches([batch(schema, [key[0].as_py()], [key[1].as_py()], [total.tobytes()])])

    sums: dict[str, np.ndarray] = {}
    for r in drawn.mapInArrow(bundle, "lang string, shard int, vector binary").groupBy("lang", "shard").applyInArrow(add, "lang string, shard int, vector binary").collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["vector"], np.float64)
    names = sorted(sums)
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    prototypes = np.stack([sums[k] for k in names])
    return names, (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identified(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, n_letters) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_letters", pa.int64())])
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in text_slices(batches, most=1 << 20):
            vectors, letters = bundled([t or "" for t in b.column(1).to_pylist()], dimensions)
            if names:
                cosines = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
            else:
                best, score = np.zeros(len(letters), int), np.zeros(len(letters))
            known = (letters > 0) & bool(names)
            yield batch(schema, b.column(0), [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0), letters)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_letters long")


def identified_with_folds(docs: DataFrame) -> DataFrame:
    """Learns from documents outside the held-out fold and predicts all."""
    train = pick(docs, "doc_id", "text", "lang").where((fold() != 0) & F.col("lang").isNotNull())
    out = identified(docs, *fit(train))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "n_letters")


#: A text of n letters whose best cosine is below LEAST_SCORE - DOUBT * FEW / (n + FEW) is in none of the languages.
LEAST_SCORE, DOUBT, FEW = 0.17, 0.45, 50


def bar(letters: np.ndarray) -> np.ndarray:
    """The least cosine that a text of so many letters must have: few letters prove little, and a handful nothing."""
    return LEAST_SCORE - DOUBT * FEW / (letters + FEW)


def in_known_languages(docs: DataFrame) -> DataFrame:
    """docs without those that have no letters, or that resemble no language for their number of letters; a missing label is filled in."""
    names, prototypes = fit(pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()))
    dimensions = prototypes.shape[1]
    order = docs.columns
    text, lang = order.index("text"), order.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in text_slices(batches, most=1 << 20):
            vectors, letters = bundled([t or "" for t in b.column(text).to_pylist()], dimensions)
            cosines = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) if names else np.ones((len(letters), 1))
            stays = (letters > 0) & (cosines.max(axis=1) >= bar(letters))
            langs = b.column(lang).to_pylist()
            if names and None in langs:
                best = cosines.argmax(axis=1).tolist()
                filled = pa.array([names[k] if x is None else x for x, k in zip(langs, best)], b.schema.field(lang).type)
                b = b.set_column(lang, b.schema.field(lang), filled)
            yield b.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
