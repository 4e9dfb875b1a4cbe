from collections import Counter

import numpy as np
import pytest
import regex

from tests.llm.fixtures import ODD, SMALL, docs, rows_of, small
from vectorloom.llm import quality_rules as Q

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query(spark):
    out = Q.query(spark, SMALL)
    rows = out.collect()
    assert rows_of(out.select(*COLUMNS)) == sorted(((r.doc_id, *base(r.text)) for r in small(spark).collect()), key=repr)
    assert all(not r.kept for r in rows if r.base_failed)
    assert all(r.kept is not None for r in rows)


def test_odd_rows(spark):
    more = [(20, "a b c a b c a b c"), (21, "x x x x"), (22, "a b a b a"), (23, "\r\n\r\nfoo\x0bbar\x0cbaz\n foo\n\nfoo\n"), (24, "é b c d")]
    table = docs(spark, ODD + more)
    assert rows_of(Q.judge(table).select(*COLUMNS)) == sorted(((r[0], *base(r[1])) for r in ODD + more), key=repr)
    assert Q.judge(docs(spark, [])).collect() == []


def test_outliers(spark):
    """Of many alike texts of a language, one made of symbols goes and the others stay."""
    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60 + i % 25)), "en", "web") for i in range(260)]
    rows.append((999, " ".join("#$%&*" + f"<{j}>|" for j in range(80)), "en", "web"))
    out = {r.doc_id: r for r in Q.judge(docs(spark, rows)).collect()}
    assert not out[999].kept and not out[999].base_failed
    assert all(out[i].kept for i in range(260))


def test_clean_documents_stay(spark):
    """Rejections of texts that pass the base rules are rare, and no label takes part."""
    quality = {r.doc_id: r.quality for r in small(spark, "labels").collect()}
    out = [r for r in Q.query(spark, SMALL).collect() if not r.base_failed and quality.get(r.doc_id) == 1]
    assert sum(r.kept for r in out) >= 0.97 * len(out)


def chi_square_quantile(p):
    """Of six degrees of freedom, by counting down its density."""
    x = np.linspace(0, 80, 4_000_001)
    mass = np.cumsum(x**2 * np.exp(-x / 2)) * (x[1] / 16)
    return x[np.searchsorted(mass, p)]


def chi_square_8(x):
    t = np.linspace(0, x, 1_000_001)
    return float(np.sum(t**3 * np.exp(-t / 2)) * t[1] / 96)


RESOLUTION = np.diag([0.25, 0.1, 0.1, 0.06, 0.05, 0.02]) ** 2


def at_most(values, share):
    return np.quantile(values, share, axis=0, method="inverted_cdf")


def squared(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def plain_estimate(x):
    """(n, mean, covariance) of a group: every start to its third step, the least determinant to convergence, reweighted."""

    def step(mean, cov):
        d = squared(x, mean, cov)
        near = x[d <= at_most(d, 0.75)]
        return near.mean(0), np.cov(near.T, bias=True) + RESOLUTION

    low, med, high = at_most(x, [0.16, 0.5, 0.84])
    size = np.sqrt(((high - low) / 2) ** 2 + np.diag(RESOLUTION))
    z = (x - med) / size
    u = z / np.maximum(np.sqrt((z**2).sum(1)), 1e-12)[:, None]
    starts = [np.diag(((high - low) / 2) ** 2), np.cov(np.tanh(z).T, bias=True) * np.outer(size, size), 6 * (u.T @ u) / len(x) * np.outer(size, size)]
    after = [step(*step(med, c + RESOLUTION)) for c in starts]
    det = [np.linalg.slogdet(c)[1] for _, c in after]
    now = after[min(range(3), key=lambda k: (round(det[k], 9), k))]
    while True:
        then = step(*now)
        if not np.linalg.slogdet(now[1])[1] - np.linalg.slogdet(then[1])[1] > 1e-3:
            break
        now = then
    near = 0.75 / chi_square_8(chi_square_quantile(0.75))
    inside = x[squared(x, now[0], (now[1] - RESOLUTION) * near + RESOLUTION) <= chi_square_quantile(0.975)]
    return len(inside), inside.mean(0), np.cov(inside.T, bias=True) * (0.975 / chi_square_8(chi_square_quantile(0.975)))


def plain_distances(x, langs, sources):
    """Squared distances of all rows; groups lean on their language, languages on all."""
    lean = lambda own, above: [(own[0] * a + 100 * b) / (own[0] + 100) for a, b in zip(own[1:], above, strict=True)]
    every = plain_estimate(x)[1:]
    out = np.zeros(len(x))
    for lang in set(langs):
        at = np.array([a == lang for a in langs])
        of_lang = lean(plain_estimate(x[at]), every)
        for source in set(sources):
            both = at & np.array([a == source for a in sources])
            if both.any():
                mean, cov = lean(plain_estimate(x[both]), of_lang)
                out[both] = squared(x[both], mean, cov + RESOLUTION)
    return out


def test_distances_against_numpy(spark):
    """Groups of 1 to some hundred rows, null keys and repeated rows included."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        lang = ("en", "de", None)[int(rng.choice(3, p=[0.6, 0.35, 0.05]))]
        source = ("web", "book", "x", None)[int(rng.choice(4, p=[0.6, 0.3, 0.05, 0.05]))]
        words = ["".join(rng.choice(list("abcdeT#%"), rng.integers(2, 9), p=[0.2, 0.2, 0.2, 0.2, 0.1, 0.06, 0.02, 0.02])) for _ in range(rng.integers(50, 200))]
        if i % 30 == 0:
            words = [w + "##$$" for w in words]
        if i % 40 == 0:
            words[20:40] = words[:20]
        text = "".join(w + (" " if rng.random() < 0.9 else "\n") for w in words)
        rows += [(i, text, lang, source)] * (1 + (i % 90 == 0))
    rows.append((5000, " ".join(f"lone{j}" for j in range(60)), "fr", "only"))
    out = [r for r in Q.judge(docs(spark, rows)).collect() if not r.base_failed]
    assert len(out) > 850 and len({(r.lang, r.source) for r in out}) > 8

    def features(r):
        n = r.n_words
        return np.log(n), r.word_chars / n, np.sqrt(r.n_symbols / n), r.n_dup_lines / (r.n_lines + 10), r.n_repeat_words / (n + 100), r.n_upper / r.word_chars

    expected = plain_distances(np.array([features(r) for r in out]), [r.lang for r in out], [r.source for r in out])
    got = np.array([r.d2 for r in out])
    assert np.allclose(got, expected, rtol=1e-4, atol=1e-6)
    assert [r.kept for r in out] == (expected <= chi_square_quantile(0.9999)).tolist()
    assert 0 < sum(not r.kept for r in out) < 100


def test_salted_join(spark, monkeypatch):
    """More groups than are broadcast give the same result."""
    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60 + i % 25)), f"l{i % 3}", "web") for i in range(90)]
    few = {r.doc_id: r.d2 for r in Q.judge(docs(spark, rows)).collect()}
    monkeypatch.setattr(Q, "MAX_BROADCAST_GROUPS", 1)
    many = {r.doc_id: r.d2 for r in Q.judge(docs(spark, rows)).collect()}
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-9 * (1 + few[i]) for i in few)


def test_names_of_kept_columns(spark):
    """Columns may be called what the operator uses within; names of results are refused."""
    table = docs(spark, ODD).selectExpr("*", "doc_id AS g", "doc_id AS x0", "doc_id AS z1", "doc_id AS s", "doc_id AS n", "doc_id AS ld", "doc_id AS `all`")
    keep = ("doc_id", "g", "x0", "z1", "s", "n", "ld", "all", "__t", "lang")
    out = Q.judge(table, keep=keep)
    assert out.columns[: len(keep)] == list(keep)
    assert all(r.g == r.doc_id == r.x0 == r["all"] for r in out.collect())
    with pytest.raises(ValueError):
        Q.judge(docs(spark, ODD).withColumn("D2", Q.F.lit(1)), keep=("D2",))
