"""Personal data in whole texts, with DataFrame and SQL functions only.

Regular expressions propose spans, checksums and digit counts confirm them (Luhn for cards,
mod-97 for IBANs, value ranges for addresses), and context words shortly before a span raise
its score. Proposals come in two sets: the base ones, leftmost and without overlap for each
kind, dropped without a retry if they fail; and stricter shapes that also find a number whose
neighbours made the base proposal fail. Added spans that touch a base one of their kind are
left out. Positions are code points, ends exclusive.

Every pattern reads a text in linear time: runs are possessive, and a match can start only at
the start of a run (or where the match before ended). Defined results: a null text is empty
and has no spans; repeated rows are reported each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

KINDS = ("email", "ip", "card", "phone", "iban")
#: Matches are positioned in blocks of this many, so that a text with many of them takes no quadratic time.
BLOCK = 64
#: Characters before a span in which context words count.
CONTEXT = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass Luhn's check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(_digits(m)), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(m))), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an IBAN's rearranged letters and digits leave 1 when divided by 97."""
    code = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _count(m: Column, low: int, high: int) -> Column:
    return F.length(_digits(m)).between(low, high)


PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LONG_NUMBER = r"[0-9](?:[ -]?[0-9]){12}"

RULES = (
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write|from|to:|courriel|correo"),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), 0.6, r"\bip\b|address|host|server|adresse|direcci"),
    Rule("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", lambda t: t.rlike(LONG_NUMBER), luhn, 0.8, "card|visa|credit|debit|karte|carte|tarjeta"),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: _count(m, 10, 15), 0.7, "phone|call|tel|mobile|fax|number"),
    # fmt: off
    Rule("card", r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])", lambda t: t.rlike(LONG_NUMBER), luhn, 0.7, "card|visa|credit|debit|karte|carte|tarjeta", False),
    Rule("phone", r"\+[0-9]{1,3}+[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])", lambda t: F.contains(t, F.lit("+")), lambda m: _count(m, 10, 15), 0.6, "phone|call|tel|mobile|fax|number", False),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), mod97, 0.9, "iban|account|konto|compte|cuenta", False),
    # fmt: on
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, rank, end, kind, score, base), confirmed, in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(between, found, lambda p, m: F.struct(m.alias("m"), F.right(p, F.lit(CONTEXT)).alias("before"), (F.char_length(p) + F.char_length(m)).alias("step")))

    def positioned(x: Column) -> Column:
        steps = F.transform(x, lambda y: y["step"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: _total(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK))))
        return _let(F.struct(steps.alias("steps"), blocks.alias("blocks")), lambda s: F.transform(x, lambda y, i: span(s, y, i)))

    def span(s: Column, y: Column, i: Column) -> Column:
        k = F.floor(i / BLOCK).cast("int")
        end = _total(F.slice(s["blocks"], F.lit(1), k)) + _total(F.slice(s["steps"], k * BLOCK + 1, i - k * BLOCK + 1))
        near = F.lower(y["before"]).rlike(rule.context)
        return F.struct(
            (end - F.char_length(y["m"])).alias("start"), F.lit(KINDS.index(rule.kind)).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"),
            F.when(near, min(1.0, rule.score + 0.1)).otherwise(rule.score).alias("score"), F.lit(rule.base).alias("base"), rule.valid(y["m"]).alias("valid"),
        )

    whole = _let(pairs, lambda x: positioned(F.filter(x, lambda y: y["m"].isNotNull())))
    kept = F.transform(F.filter(whole, lambda z: z["valid"]), lambda z: F.struct(*[z[n].alias(n) for n in ("start", "rank", "end", "kind", "score", "base")]))
    return F.when(rule.guard(text), kept).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>>"))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`: all spans of the whole text, by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    out = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    out = out.select("doc_id", *[rule_spans(F.col("text"), r).alias(f"r{i}") for i, r in enumerate(RULES)])
    base = F.concat(*[F.col(f"r{i}") for i, r in enumerate(RULES) if r.base])
    more = F.concat(*[F.col(f"r{i}") for i, r in enumerate(RULES) if not r.base])
    out = out.select("doc_id", base.alias("base_spans"), more.alias("more_spans"))
    apart = F.filter("more_spans", lambda x: ~F.exists("base_spans", lambda y: (x["kind"] == y["kind"]) & (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return out.select("doc_id", F.array_sort(F.concat("base_spans", apart)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    out = spans.select("doc_id", "spans", base.alias("base_spans"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS[:4]), F.sha2(F.encode(_listed(F.col("base_spans")), "utf-8"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))


def masked(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with every confirmed span replaced by its kind in brackets; a null text stays null."""
    for rule in RULES:
        text = F.col(column)
        tag = F.lit(f"[{rule.kind.upper()}]")
        parts = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(F.when(m.isNotNull() & rule.valid(m), tag).otherwise(m), F.lit(""))))  # noqa: B023
        docs = docs.withColumn(column, F.when(rule.guard(text), F.array_join(parts, "")).otherwise(text))
    return docs
