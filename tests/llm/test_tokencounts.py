import random

import numpy as np
import public_tokenizers as P
import pytest
from millrace.llm import tokencounts
from tokenizers import Tokenizer

PATH, END = P.path("word_bpe_49k.json"), 49407


def brute(ids, separator):
    out, start, n = [], 0, 0
    for k, x in enumerate(ids):
        if x == separator:
            out.append((n, start, k - start, True))
            start, n = k + 1, n + 1
    if start < len(ids):
        out.append((n, start, len(ids) - start, False))
    return out


def test_files_of_any_shape(spark, tmp_path):
    rng = random.Random(2)
    want, rows = [], []
    for f in range(6):
        ids = [rng.choice([7, 7, 1, 2, 3]) if f % 2 else rng.choice([1, 2, 3, 4] * 60 + [7]) for _ in range(rng.randrange(0, 900))]
        ids += [7] * (f == 2) + [1] * (500 * (f == 3))
        path = tmp_path / f"f{f}.bin"
        np.array(ids, "<u4").tofile(path)
        rows.append((f"file://{path}", 4 * len(ids)))
        want += [(f"file://{path}", *x) for x in brute(ids, 7)]
    files = spark.createDataFrame(rows, "file string, bytes long")
    for block_bytes in (4, 40, 404, 1 << 20):
        blocks = tokencounts.searched(files, 7, "<u4", block_bytes)
        got = sorted(tuple(r) for r in tokencounts.counted(blocks).select("file", "document", "start", "n_tokens", "closed").collect())
        assert got == sorted(want)


def test_two_levels_of_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencounts, "SPAN", 3)
    ids = [7 if random.Random(k).random() < 0.05 else 1 for k in range(500)]
    path = tmp_path / "f.bin"
    np.array(ids, "<u2").tofile(path)
    files = spark.createDataFrame([(f"file://{path}", 1000)], "file string, bytes long")
    got = sorted(tuple(r) for r in tokencounts.counted(tokencounts.searched(files, 7, "<u2", 20)).select("document", "start", "n_tokens", "closed").collect())
    assert got == sorted(brute(ids, 7))


def check(rows, got):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == want[r.doc_id]
    by_file = {}
    for r in got:
        by_file.setdefault(r.file_number, []).append((r.start, r.n_tokens))
    for parts in by_file.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n + 1


def test_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, "Hello, <|endoftext|> world"), (4, "word " * 5000), (5, "same"), (5, "same"), (None, "n")]
    check(rows, tokencounts.document_counts(docs_of(rows, extra=("file", "ids")), PATH, END, block_bytes=1000).collect())
    assert tokencounts.document_counts(docs_of(rows).limit(0), PATH, END).count() == 0


def test_whole_table(spark, sf):
    from millrace.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op2_token_counts(spark, sf).collect())


def test_ids_that_dont_fit_are_an_error():
    ids = np.array([0, 65535, 7], np.uint32)
    assert np.frombuffer(tokencounts.flat(ids, 9, "<u2"), "<u2").tolist() == ids.tolist()
    assert tokencounts.flat(ids[:0], 9, "<u2") == b""
    for bad, separator in ((np.array([65536], np.uint32), 9), (ids, 7)):
        with pytest.raises(ValueError):
            tokencounts.flat(bad, separator, "<u2")
