"""DuckDB SQL for the rows of queries, or of those of their columns that SQL can say.

op8_suffix has SQL for all its rows. Of four other operators a query of its own gives the columns
that their contracts define by rule, from the same run of the operator, beside SQL for these.
"""

from __future__ import annotations

#: The base patterns of op4, in their order.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda k: CASE WHEN k % 2 = 0 THEN reverse({_DIGITS})[k + 1]::INT ELSE (2 * reverse({_DIGITS})[k + 1]::INT) // 10 + (2 * reverse({_DIGITS})[k + 1]::INT) % 10 END)) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(hit, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE p::INT END)) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}


def _spans(order: int, kind: str) -> str:
    p = BASE_PATTERNS[kind].replace("'", "''")
    return f"""SELECT doc_id, {order} AS kind_order, '{kind}' AS kind, start, start + length(hit) AS stop FROM (
        SELECT doc_id, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL))
    ) WHERE {_VALID[kind]}"""


PII_BASE_SPANS = f"""WITH spans AS ({" UNION ALL ".join(_spans(i, k) for i, k in enumerate(BASE_PATTERNS))}),
told AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_order) AS listed FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256
FROM documents LEFT JOIN told USING (doc_id)"""

EDITED_TEXTS = """WITH rows AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
beside AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS following FROM rows)
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 3) || left(following, n // 3)) AS edited_sha256 FROM beside"""

MEDIA_PAYLOADS = """WITH rows AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
sized AS (SELECT *, greatest(192, 192 * ((n + 191) // 192)) AS size FROM rows)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(t || repeat(' ', size - n)) AS payload_sha256 FROM sized"""

#: crc32 of the doc_id's digits, bit by bit.
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, step: xor(x >> 1, (x & 1) * 3988292384))))"

UNIGRAM_SCORES = f"""WITH tokens AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out,
        unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || ['']) AS token FROM documents),
counted AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
whole AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counted)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
    round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) AS base_score
FROM tokens LEFT JOIN counted USING (token) CROSS JOIN whole GROUP BY doc_id"""

REPEATS_REMOVED = """WITH rows AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
chunks AS (SELECT doc_id, n, 1000 * k AS base, substring(h, 2000 * k + 1, 2098) AS c FROM (SELECT *, unnest(range((n + 999) // 1000)) AS k FROM rows)),
places AS (SELECT doc_id, n, base, c, unnest(range(least(1000, n - base))) AS i FROM chunks),
strings AS (SELECT doc_id, base + i AS pos, CASE WHEN base + i <= n - 50 THEN substring(c, 2 * i + 1, 100) END AS s, substring(c, 2 * i + 1, 2) AS pair FROM places),
lowest AS (SELECT s, min(doc_id) AS first FROM strings WHERE s IS NOT NULL GROUP BY s),
judged AS (SELECT doc_id, pos, pair, coalesce(max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS goes
    FROM strings LEFT JOIN lowest USING (s)),
runs AS (SELECT *, goes = 1 AND coalesce(lag(goes) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS begins FROM judged),
told AS (SELECT doc_id, count(*) FILTER (goes = 1) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(pair, '' ORDER BY pos) FILTER (goes = 0) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM rows LEFT JOIN told USING (doc_id)"""
