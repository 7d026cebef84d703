import hashlib
import random
import unicodedata

import regex

from millrace.llm import fingerprints as fp


def canon(text):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return regex.sub(r"[\s\p{Z}\x85]+", " ", t).strip(" ")


def check(rows, got):
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    after = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    by_canon, prints = {}, {}
    for i, t in texts.items():
        by_canon.setdefault(canon(t), []).append(i)
    for i, t in texts.items():
        r = got[i]
        m = len(t) // 3
        edited = t[: len(t) - m] + texts[after[i]][:m]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r.near_edited == float(canon(edited) == canon(t))
        assert r.near_next == float(canon(texts[after[i]]) == canon(t))
        assert r.group_id == min(by_canon[canon(t)])
        assert prints.setdefault(canon(t), r.fingerprint) == r.fingerprint and len(r.fingerprint) == 32
        assert prints.setdefault(canon(edited), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_random_texts(docs_of):
    rng = random.Random(5)
    bits = ["a", "A", "é", "é", " ", "  ", "\n", " ", "ß", "SS", "𝄞", "Straße", "x" * 50]
    rows = [(7 * i - 300, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6)))) for i in range(300)] + [(9999, None)]
    check(rows, fp.edited_fingerprints(docs_of(rows, extra=("fingerprint", "canon", "edited"))).collect())


def test_edge_cases(docs_of):
    check([(5, "one")], fp.edited_fingerprints(docs_of([(5, "one")])).collect())
    assert fp.edited_fingerprints(docs_of([(5, "one")]).limit(0)).count() == 0
    got = fp.edited_fingerprints(docs_of([(1, "abc"), (1, "abc"), (2, "ABC "), (None, "abc"), (None, None)])).collect()
    assert len(got) == 5 and {r.group_id for r in got if r.doc_id} == {1}


def test_whole_table(spark, sf):
    from millrace.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op10_fingerprints(spark, sf).collect())
