import re

import corpus_pipeline
import pytest
from millrace.llm.common import stored

from .test_pii import brute as pii_brute
from .test_suffix import brute as suffix_brute


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_keep_the_columns(stages):
    names = ["language", "near_duplicates", "repeated_passages", "personal_data"]
    for n in names:
        assert stages[n].columns == stages["documents"].columns and stages[n].dtypes == stages["documents"].dtypes


def test_language_drops_only_texts_without_letters(stages):
    before, after = rows(stages["documents"]), rows(stages["language"])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text)}


def test_near_duplicates(stages):
    before, after = rows(stages["language"]), rows(stages["near_duplicates"])
    sets = {i: shingles(r.text) for i, r in before.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ds in by.values() if len(ds) < 200 for a in ds for b in ds if a < b}
    like = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    gone = set(before) - set(after)
    # no document without a near copy goes
    most = {}
    for (a, b), j in like.items():
        most[a], most[b] = max(j, most.get(a, 0)), max(j, most.get(b, 0))
    assert all(most.get(i, 0) > 0.6 for i in gone)
    # exact copies never stay together, and of near copies hardly any do
    assert len({tuple(r.text.lower().split()) for r in after.values()}) == len(after)
    near = [(a, b) for (a, b), j in like.items() if j >= 0.8]
    left = [p for p in near if p[0] in after and p[1] in after]
    very = [p for p, j in like.items() if j >= 0.95]
    assert len(near) > 20 and len(left) <= 0.05 * len(near)
    assert not any(a in after and b in after for a, b in very)


def test_repeated_passages(stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["repeated_passages"])
    for i, n_bytes, n_removed, _, _ in suffix_brute([(i, r.text) for i, r in before.items()]):
        if not n_removed:
            assert after[i].text == before[i].text
        elif i in after:
            assert n_bytes - n_removed - 8 * len(before[i].text) // 50 - 8 <= len(after[i].text.encode()) <= n_bytes - n_removed
            assert after[i].n_chars == len(after[i].text)


def test_no_personal_data_is_left(stages):
    before, after = rows(stages["repeated_passages"]), rows(stages["personal_data"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not pii_brute(r.text), (i, pii_brute(r.text))
        if r.text == before[i].text:
            assert not pii_brute(before[i].text)
        assert not re.search(r"\+1 \(\d{3}\) 555-\d{4}", r.text)


def test_packing_holds_every_document_once(stages):
    docs, pieces = rows(stages["personal_data"]), stages["packing"].collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(docs)
    for ps in [*by_doc.values()]:
        at = 0
        for start, length, _ in sorted(ps):
            assert start == at
            at += length
        assert at == ps[0][2]
    for ps in by_sequence.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 4096 and not at & (at - 1)


def test_run_on_an_empty_table(spark, docs_of, tmp_path):
    docs_of([(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_rows(spark, docs_of, tmp_path):
    odd = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a b c"), (None, "d e f"), (None, "d e f"), (5, "mail a@b.co " * 400), (6, "!!!"), (7, "word " * 3000)]
    docs_of(odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == {3, None, 5, 7}
    assert sum(p.start == 0 and p.doc_id == 3 for p in got) == 1 and sum(p.start == 0 and p.doc_id is None for p in got) == 1
