"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, checksums and digit counts confirm them (Luhn for cards, mod-97 for IBANs),
and words within NEAR characters before or after a span adjust its score. The base kinds email, ip, card and phone are reported whenever they
are confirmed; iban, ssn and secret spans are added if their score reaches ADD_SCORE.

Positions come from the text itself: every match is wrapped in the character U+0001 (a U+0001 of the text
counts as U+0002, which no pattern can match either), the text is split there, and running lengths of the
pieces give code-point offsets. The patterns are linear-time forms (possessive runs, no restart inside a run)
of the documented ones; running lengths and context are taken in chunks, so very long texts with very many matches take
time in proportion. Null and empty texts have no spans; spans that start together are ordered by kind; rows are
independent, so repeated rows repeat results, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import fresh, table

ADD_SCORE = 0.6
NEAR = 48
BASE_KINDS = ("email", "ip", "card", "phone")
#: kind: (pattern, what a text must contain, score without context, words near it that raise the score)
RULES = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.7, r"\bip\b|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|bank|account"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4, r"ssn|social|security"),
    "secret": (r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])", r"[A-Fa-f0-9]{32}", 0.3, r"token|secret|passw|key"),
}


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Luhn sum of at most 19 digits, from the last digit on."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.least(F.length(digits), F.lit(19))), lambda i: (lambda d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2))(_number(F.substring(back, i, F.lit(1)))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(p: Column) -> Column:
    plain = F.regexp_replace(p, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _confirmed(kind: str, p: Column) -> Column:
    digits = F.regexp_replace(p, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(p, r"\."), lambda x: (lambda v: (F.length(v) <= 3) & (_number(v) <= 255))(F.regexp_replace(x, "^0+", "")))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return _mod97(p)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
CHUNK = 4096
GROUP = 256


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it within other functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grouped(values: Column) -> Column:
    last = F.floor((F.size(values) - 1) / GROUP).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(values, j * GROUP + 1, F.lit(GROUP)))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Before every entry of a non-empty array of integers, op over the entries in front of it, from 0 on.

    Arrays grow within groups of GROUP entries and over the groups only, so long arrays cost little.
    """

    def scan(start: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def inner(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), op))
        return _let(scan(F.lit(0), totals), lambda heads: F.flatten(F.transform(groups, lambda g, j: F.slice(scan(F.get(heads, j), g), F.lit(1), F.size(g)))))

    return _let(_grouped(values), inner)


def _chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, in which positions are found fast."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive, at most the length) of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    n = F.floor((F.greatest(end, start + 1) - 1) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, n), ""), start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind, in order."""
    pattern, trigger, plain, words = RULES[kind]
    rank = list(RULES).index(kind)
    pieces = F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01", -1)
    empty = F.array().cast(SPAN)

    def spans(pieces: Column, starts: Column, chunks: Column, size: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            at, end = F.get(starts, i), F.get(starts, i) + F.length(p)
            # both sides apart, across other matches
            left = _cut(chunks, F.greatest(at - NEAR, F.lit(0)), at)
            right = _cut(chunks, end, F.least(end + NEAR, size))
            near = F.lower(F.concat(left, F.lit("\n"), right))
            score = F.when(near.rlike(words), F.least(F.lit(1.0), F.lit(plain) + 0.35)).otherwise(F.lit(plain))
            span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
            good = (i % 2 == 1) & _confirmed(kind, p)
            return F.when(good, span)

        least = 0.0 if kind in BASE_KINDS else ADD_SCORE
        return F.filter(F.transform(pieces, one), lambda s: s.isNotNull() & (s["score"] >= least)).cast(SPAN)

    def located(pieces: Column) -> Column:
        starts = _running(F.transform(pieces, F.length), lambda a, b: a + b)
        return _let(starts, lambda at: _let(_chunks(text), lambda chunks: _let(F.length(text), lambda size: spans(pieces, at, chunks, size))))

    hit = F.contains(text, F.lit(trigger)) if trigger == "@" else text.rlike(trigger)
    return F.when(hit, _let(pieces, located)).otherwise(empty)


def _found(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str], str]:
    """docs with a column of spans for each kind and one for all, under names that docs does not use."""
    t, d, names, every = fresh(docs, "__t"), fresh(docs, "__d"), {k: fresh(docs, f"pii_{k}") for k in RULES}, fresh(docs, "pii")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    clean = docs.withColumn(t, F.when(F.contains(whole, F.lit("\x01")), F.replace(whole, F.lit("\x01"), F.lit("\x02"))).otherwise(whole))
    digits = clean.withColumn(d, F.col(t).rlike("[0-9]"))
    columns = {names[k]: F.when(F.lit(k in ("email", "secret")) | F.col(d), _spans(k, F.col(t))).otherwise(F.array().cast(SPAN)) for k in RULES}
    found = digits.withColumns(columns)
    return found.withColumn(every, F.array_sort(F.concat(*map(F.col, names.values())))).drop(t, d), names, every


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_<kind> arrays of spans and `pii`, all of them by start, then kind; spans of kinds may overlap.

    Where docs has a column of such a name, the new one gets underscores at its end.
    """
    return _found(docs, text)[0]


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (overlapping spans: the first); columns unchanged.

    n_chars, if there, becomes the length of the new text where something was replaced.
    """
    found, _, every = _found(docs, text)
    spans, new_text, whole = F.col(every), fresh(docs, "__new"), F.col(text)

    def rebuilt(reach: Column, chunks: Column) -> Column:
        """reach: for every span, the furthest end of the spans before it."""

        def one(s: Column, i: Column) -> Column:
            piece = F.concat(_cut(chunks, F.get(reach, i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))
            return F.when(s["start"] >= F.get(reach, i), piece).otherwise(F.lit(""))

        last = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(spans, one), ""), F.when(last < F.length(whole), _cut(chunks, last, F.length(whole))).otherwise(F.lit("")))

    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    new = _let(reach, lambda r: _let(_chunks(whole), lambda chunks: rebuilt(r, chunks)))
    out = found.withColumn(new_text, F.when(F.size(spans) > 0, new).otherwise(whole))
    size = {"n_chars": F.when(F.size(spans) > 0, F.length(new_text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")).alias("n_chars")} if "n_chars" in docs.columns else {}
    return out.select(*(F.col(new_text).alias(text) if c == text else size.get(c, F.col(c)) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op5: doc_id, counts of the base kinds, base_sha256, spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
