"""Language identification and the quality classifier, by held-out accuracy."""

import zlib
from itertools import combinations

import numpy as np
import pytest
import zstandard

from tests.llm.fixtures import ODD, docs, small
from vectorloom.llm import language_id as L
from vectorloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    out = {r.doc_id: r for r in L.query(spark, SF).collect()}
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(out) == len(truth)
    for r in truth:
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= out[r.doc_id].score <= 1
    known = [r for r in truth if r.lang and r.text and any(c.isalpha() for c in r.text) and out[r.doc_id].held_out]
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in known]) > 0.95


def test_language_of_mixtures(spark):
    """Two languages in one text are both found, whichever is predicted."""
    source = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 800")
    texts = {}
    for r in source.select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text[:800])
    a, b = sorted(texts)[:2]
    model = L.train(source)
    table = docs(spark, [(i, texts[a][i] + " " + texts[b][i]) for i in range(5)] + [(10 + i, texts[a][i]) for i in range(5)])
    out = {r.doc_id: r for r in L.identify(table, model).collect()}
    assert np.mean([out[i].n_langs >= 2 for i in range(5)]) >= 0.8
    assert np.mean([out[10 + i].n_langs == 1 for i in range(5)]) >= 0.8
    assert all(out[i].score < out[10 + i].score for i in range(5))


def test_language_odd_rows(spark):
    model = L.train(small(spark))
    rows = ODD + [(30, "12345 !!! 678"), (31, None)]
    out = L.identify(docs(spark, rows), model).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.lang_pred == "und"} >= {1, 2, 5, 30, 31}
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    assert L.identify(docs(spark, []), model).collect() == []
    assert L.train(docs(spark, []))["langs"] == []
    assert {r.lang_pred for r in L.identify(docs(spark, ODD), L.train(docs(spark, []))).collect()} == {"und"}


def test_accepted_keeps_columns(spark):
    table = small(spark)
    out = L.accepted(table)
    assert out.columns == table.columns and 0 < out.count() <= table.count()
    assert L.accepted(docs(spark, [])).collect() == []


def plain_mixture(c, p):
    """(language, number of languages) by trying every set of languages with many steps of expectation-maximisation."""
    n, best = c.sum(), None
    for m in range(1, len(p) + 1):
        for chosen in combinations(range(len(p)), m):
            q, w = p[list(chosen)], np.full(m, 1 / m)
            for _ in range(300 if m > 1 else 0):
                w = w * ((c / (w @ q)) @ q.T) / n
            value = c @ np.log(w @ q) - (m - 1) * L.PENALTY * np.log(max(2, n))
            if best is None or value > best[0] + 1e-6:
                best = value, chosen[int(w.argmax())], m
    return best[1:]


def test_mixtures_against_plain_em(spark):
    """The set of languages and the prediction, against all sets and a plain EM in double precision."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(table)
    texts = [r.text for r in table.where("length(text) > 0").orderBy("doc_id").limit(160).collect()]
    texts += [a[:k] + " " + b[:400] for a, b in zip(texts[:60], texts[60:120], strict=True) for k in (80, 400)]
    c = L.Grams().counts(texts)
    keep = np.flatnonzero(c.sum(axis=1) > 0)
    best, _, size = L.infer(c[keep], model["p"])
    plain = [plain_mixture(x.astype(np.float64), model["p"].astype(np.float64)) for x in c[keep]]
    assert {m for _, m in plain} >= {1, 2}
    assert np.mean([b == q[0] for b, q in zip(best, plain, strict=True)]) > 0.98
    assert np.mean([m == q[1] for m, q in zip(size, plain, strict=True)]) > 0.97


def test_more_languages_than_four():
    """No size of the set is ruled out."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(L.BINS, 0.01), 7).astype(np.float32) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    c = np.stack([rng.multinomial(6000, p[:m].mean(axis=0).astype(np.float64) / p[:m].mean(axis=0).sum(dtype=np.float64)) for m in (1, 2, 3, 5, 6)]).astype(np.float32)
    assert L.infer(c, p)[2].tolist() == [1, 2, 3, 5, 6]


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_long_texts_count_like_short_ones(piece, monkeypatch):
    """Pieces of long texts neither lose nor double n-grams at their edges."""
    texts = ["Ein längerer Text, mit Zahlen 12345 und  Lücken.\n\nNoch einer! " * 9, "a", "1 2 3", "x" * 200, " a" * 99, "İstanbul ı" * 20]
    whole = L.Grams().counts(texts)
    monkeypatch.setattr(L, "PIECE", piece)
    assert np.array_equal(L.Grams().counts(texts), whole)
    assert whole[0].sum() > 500 and whole[2].sum() == 0


def test_long_labelled_texts_are_learned(spark):
    """A language with long texts only is a language like others."""
    long = "le chat noir et la maison bleue avec une fenêtre ouverte sur le jardin " * 4000
    rows = [(i, long[i:], "fr") for i in range(8)] + [(100 + i, "the old dog and the new house with a window to the sea", "en") for i in range(9)]
    model = L.train(docs(spark, rows))
    assert model["langs"] == ["en", "fr"]
    assert {r.lang_pred for r in L.identify(docs(spark, rows[:8]), model).collect()} == {"fr"}


def auc(score, good):
    score, good = np.array(score), np.array(good, bool)
    return float(np.mean((score[good][:, None] > score[~good][None, :]) + 0.5 * (score[good][:, None] == score[~good][None, :])))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and out[r.doc_id].held_out]
    for r in labels:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    assert auc([out[r.doc_id].score for r in labels], [r.quality for r in labels]) > 0.8
    right = [out[r.doc_id].predicted for r in labels if r.quality == 1]
    assert np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())


def test_quality_against_plain_compression(spark):
    """Scores from nothing but two compressed sizes, by the library's own calls; the calibration is the best one."""
    table, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = Q.train(table, labels)
    tools = [zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(model[k]), write_checksum=False, write_content_size=False, write_dict_id=False) for k in ("good", "bad")]

    def difference(text):
        raw = text.encode()
        good, bad = (sum(len(t.compress(raw[i : i + Q.BLOCK])) for i in range(0, len(raw), Q.BLOCK)) for t in tools)
        return (bad - good) / (good + bad)

    texts = {r.doc_id: r.text for r in table.collect()}
    for r in Q.score(table, model).collect():
        if texts[r.doc_id]:
            z = model["w"][0] + model["w"][1] * Q.SCALE * difference(texts[r.doc_id])
            assert abs(r.score - 1 / (1 + np.exp(-z))) < 0.02, r.doc_id
    known = [r for r in Q.sample(table, labels, 4000).collect() if r.half == 1]
    c = Q.Compressors(model["good"], model["bad"])
    d, y = np.array([c.difference(r.text) for r in known]), np.array([float(r.good) for r in known])
    error = Q.probability(d, model["w"]) - y
    assert abs(error.sum()) < 1e-3 and abs((error * Q.SCALE * d).sum() + 0.3 * model["w"][1]) < 1e-3
    assert model["w"][1] > 0


def test_quality_sample_is_bounded(spark):
    """Neither many rows under a doc_id nor long texts get past the bounds, and none is left out for its length."""
    rows = [(1, f"text number {i} of one document") for i in range(400)] + [(i, "word " * 60_000) for i in (2, 3)] + [(10 + i, f"short {i}") for i in range(30)] * 2
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = Q.sample(docs(spark, rows), labels, 1000).collect()
    assert len(got) == len({(r.key, r.text) for r in got}) and {len(r.text) for r in got} >= {300_000}
    assert len({r.text for r in Q.sample(docs(spark, rows[400:]), labels, 10).collect()}) <= 10
    model = Q.train(docs(spark, rows), labels, max_docs=20, max_blocks=5)
    assert len(model["good"]) <= 5 * Q.PIECE + 4096


def test_quality_odd_rows(spark):
    model = Q.train(small(spark), small(spark, "labels"))
    out = Q.score(docs(spark, ODD), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (1, 2)} == {model["prior"]}
    none = Q.train(docs(spark, []), small(spark, "labels").where("false"))
    assert {r.score for r in Q.score(docs(spark, ODD), none).collect()} == {0.5}
    assert Q.score(docs(spark, []), model).collect() == []
