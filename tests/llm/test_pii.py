import hashlib

import regex

from tests.llm.fixtures import ODD, SMALL, docs, rows_of, small
from vectorloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    back = [int(c) for c in reversed(digits)]
    return sum(back[::2] + [sum(divmod(2 * x, 10)) for x in back[1::2]]) % 10 == 0


def good(kind, m):
    digits = regex.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in regex.finditer(p, text or "") if good(kind, m[0])]
    return sorted(found)


def expected(i, text):
    found = base(text)
    listed = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in found)
    return (i, *(sum(f[2] == k for f in found) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest())


def test_query(spark):
    got = rows_of(pii.query(spark, SMALL).drop("spans"))
    assert got == sorted((expected(r.doc_id, r.text) for r in small(spark).collect()), key=repr)


TEXTS = [
    "a@b.c x..y%@q-.d.e@f.g @h.i j@k a@b@c.d",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 00000000000000 4111  1111 1111 1111",
    "+1 (555) 123-4567 +12 +49.30.1234567890123456 ++1 555 123 4567 +1-",
    "\x014111111111111111\x01 \U0001f600 mail: x@y.zz",
    "4111111111111111" * 40,
    "a" * 5000 + "@" + "b." * 3000,
    "+1 2" + " 3" * 2000 + "@",
]


def test_patterns(spark):
    table = docs(spark, [(i, t) for i, t in enumerate(TEXTS)] + ODD)
    found = pii.find(table)
    for r in found.collect():
        spans = [(s.start, s.kind, s.end) for s in r.pii if s.kind in PATTERNS]
        assert sorted(spans) == sorted((s, kind, e) for s, _, kind, e in base(r.text)), r.text and r.text[:80]


def test_added_kinds(spark):
    texts = ["bank account DE89 3704 0044 0532 0130 00 here", "DE89 3704 0044 0532 0130 01", "social security 123-45-6789", "part 123-45-6789", "secret key " + "0123456789abcdef" * 2, "hash " + "0123456789abcdef" * 2]
    out = pii.find(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[s.kind for s in r.pii if s.kind not in PATTERNS] for r in out] == [["iban"], [], ["ssn"], [], ["secret"], []]


def test_redact(spark):
    table = docs(spark, [(1, "write to a@b.cc now"), (2, None), (3, "nothing"), (4, "x 4111 1111 1111 1111 y +1 555 123 4567")])
    out = pii.redact(table).orderBy("doc_id")
    assert out.columns == table.columns
    rows = out.collect()
    assert [r.text for r in rows] == ["write to <email> now", None, "nothing", "x <card> y <phone>"]
    assert rows[0].n_chars == len(rows[0].text) and rows[2].n_chars == 7
    assert pii.find(docs(spark, [])).collect() == []


def test_context_on_both_sides(spark):
    """Words count across other matches, and after a span; secrets have no greatest length."""
    a, b = "0123456789abcdef" * 2, "fedcba9876543210" * 12
    texts = ["SSN: 111-22-3333, 444-55-6666", "111-22-3333 is the ssn", f"{a} was the token", f"secret {b}", f"token {'x' * 60} {a}", f"{a} {'x' * 60} token"]
    out = pii.find(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[(s.kind, r.text[s.start : s.end]) for s in r.pii if s.kind in ("ssn", "secret")] for r in out] == [[("ssn", "111-22-3333"), ("ssn", "444-55-6666")], [("ssn", "111-22-3333")], [("secret", a)], [("secret", b)], [], []]


ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.8, "iban|bank|account"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social|security"),
    "secret": (r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])", 0.3, "token|secret|passw|key"),
}


def added(text):
    """The spans of the other kinds: proposals, checksum, words within 48 characters on both sides."""
    out = []
    for kind, (pattern, plain, words) in ADDED.items():
        for m in regex.finditer(pattern, text or ""):
            s, e = m.span()
            near = (text[max(0, s - 48) : s] + "\n" + text[e : e + 48]).lower()
            score = min(1.0, plain + 0.35) if regex.search(words, near) else plain
            p = m[0].replace(" ", "")
            if kind == "iban" and not (15 <= len(p) <= 34 and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1):
                continue
            if score >= 0.6:
                out.append((s, kind, e))
    return sorted(out)


def test_added_spans_against_plain(spark):
    """All spans of the other kinds, with positions, over many lengths, chunk borders and astral characters."""
    key = "0123456789abcdef" * 2
    rng = __import__("random").Random(4)
    parts = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "123-45-6789", key, key * 5, "the social number", "token", "bank account", "key", "\U0001f600\U0001f680", "filler words here", "x@y.zz", "+1 555 123 4567", "\n", "4111111111111111"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (1, 3, 10, 40, 150, 700, 3000)] + ["é" * 4090 + " ssn 123-45-6789 " + "é" * 4090 + f" {key} token"]
    found = pii.find(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert sum(len(added(t)) for t in texts) > 300
    for r in found:
        assert sorted((s.start, s.kind, s.end) for s in r.pii if s.kind in ADDED) == added(r.text)
        assert sorted((s.start, s.kind, s.end) for s in r.pii if s.kind in PATTERNS) == sorted((s, kind, e) for s, _, kind, e in base(r.text))
    for r, new in zip(found, pii.redact(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect(), strict=True):
        plain, at = "", 0
        for s, _, kind, e in sorted((s.start, s.rank, s.kind, s.end) for s in r.pii):
            if s >= at:
                plain += r.text[at:s] + f"<{kind}>"
            at = max(at, e)
        assert new.text == plain + r.text[at:]
