import hashlib
import random
import re

from millrace.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def expected(text):
    spans = brute(text)
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return [sum(k == n for *_, k in spans) for n in BASE] + [hashlib.sha256(listed.encode()).hexdigest()]


def check(rows, got):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == expected(text), (i, text[:200], r.spans, brute(text))
        for s, _, e, k in brute(text):
            assert f"{k}:{s}:{e}" in r.spans.split(",")


def test_random_texts(docs_of):
    rng = random.Random(3)
    bits = ["a@b.co", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+1 (269) 555-3296", " ", "-", "5", "00", "x", "é", "\n", "a.b%c", "4532015112830366", "𝄞", "(", ")", "GB82 WEST 1234 5698 7654 32", "_d@e.f"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))) for i in range(1500)]
    check(rows, pii.span_digests(pii.found_spans(docs_of(rows, extra=("spans", "base_spans", "r0")))).collect())


def test_edge_cases(docs_of):
    rows = [(1, ""), (2, "1 " * 20000), (3, "a" * 3000), (4, "1.1.1.1 " * 3000), (5, "+1" * 5000), (6, "9" * 20000), (7, "a." * 3000 + "@x.y"), (8, "user@host.example")]
    check(rows, pii.span_digests(pii.found_spans(docs_of(rows))).collect())
    got = pii.span_digests(pii.found_spans(docs_of([(1, None), (2, "x"), (2, "x")]))).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2] and {r.spans for r in got} == {""}
    assert pii.span_digests(pii.found_spans(docs_of([(1, "x")]).limit(0))).count() == 0


def test_added_spans_and_masks(docs_of):
    text = "call +1 (269) 555-3296 4524132264652876 or IBAN GB82 WEST 1234 5698 7654 32, mail a@b.co from 10.0.0.1"
    good = [d for d in range(10) if luhn(f"452413226465287{d}")][0]
    text = text.replace("4524132264652876", f"452413226465287{good}")
    r = pii.span_digests(pii.found_spans(docs_of([(1, text)]))).collect()[0]
    kinds = [x.split(":")[0] for x in r.spans.split(",")]
    assert kinds == ["phone", "card", "iban", "email", "ip"] and (r.n_card, r.n_phone) == (0, 0)
    assert pii.masked(docs_of([(1, text)])).collect()[0].text == "call [PHONE] [CARD] or IBAN [IBAN], mail [EMAIL] from [IP]"
    assert pii.masked(docs_of([(1, None)])).collect()[0].text is None


def test_whole_table(spark, sf):
    from millrace.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op4_pii(spark, sf).collect())
