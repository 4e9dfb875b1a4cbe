"""Language identification by multilingual mixture inference.

A document's character bigrams and trigrams (lower-cased letters, one blank between words) are hashed to BINS
bins. Expectation-maximisation over the bins estimates the proportions of the learned languages in the
document; the set of languages is chosen by penalised likelihood: starting from the single best language,
sets of any size are tried, made of the languages with the largest proportions, and the one with the greatest
log-likelihood less PENALTY * log(number of n-grams) for every further language is taken. A size is skipped only if
no mixture of all languages could reach it (an upper bound from the gradient of the likelihood).

Languages are learned from a bounded sample: about per_language documents of each language by a hash of
doc_id, outside the held-out fold, picked where they lie (the shares of at most MAX_BROADCAST_LANGS
languages are broadcast, more are joined by a shuffle). Texts of any length are counted whole, in learning as in
prediction; only histograms are gathered. Predictions see texts only.

A text that is null, empty or without letters is `und` with score 0, and so is every text if nothing was
learned. The score is the share of the predicted language, times its probability against the others. Ties go to the
alphabetically first language; repeated rows repeat their result; an empty table gives an empty one. identify()
returns doc_id and its results only, so other columns cannot clash; accepted() keeps all columns.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import fraction_of, fresh, held_out, map_rows, table
from vectorloom.runtime import broadcast_if_small, cut_lineage

BINS = 8192
PENALTY = 2.0
MAX_BROADCAST_LANGS = 10_000
PIECE = 1 << 20
GROUP = 64
SMOOTH = 0.2


class Grams:
    """Histograms of hashed bigrams and trigrams, for many texts at once."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), BINS), dtype=np.float32)
        group, size = [], 0
        for i, t in enumerate(texts):
            t = (t or "").lower()
            if len(t) > PIECE:
                out[i] = self._long(f" {t} ")
                continue
            group.append((i, t))
            size += len(t)
            if size > PIECE:
                self._add(out, group)
                group, size = [], 0
        if group:
            self._add(out, group)
        return out

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    @staticmethod
    def _bins(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bins, whether they count) of the bigrams and of the trigrams of letters and blanks."""
        blank = c == 32
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] ^ (c[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))
        shift = np.uint32(32 - BINS.bit_length() + 1)
        return [((h * np.uint32(0x2C1B3C6D) >> shift).astype(np.int64), ok) for h, ok in ((two, ~(blank[:-1] & blank[1:])), (three, ~blank[1:-1]))]

    def _long(self, text: str) -> np.ndarray:
        """Histogram of one text, piece by piece; n-grams over a cut count once."""
        out, carry = np.zeros(BINS), np.zeros(0, np.uint32)
        for a in range(0, len(text), PIECE):
            b = min(len(text), a + PIECE)
            c = self._codes(text[max(0, a - 1) : b + 1])
            is_letter = self.letter[c]
            keep = is_letter.copy()
            keep[1:] |= is_letter[:-1]
            keep[:-1] |= is_letter[1:]
            own = slice(min(a, 1), min(a, 1) + b - a)
            symbols = np.r_[carry, np.where(is_letter, c, np.uint32(32))[own][keep[own]]]
            if len(symbols) > 1:
                for k, (bins, ok) in enumerate(self._bins(symbols)):
                    new = max(0, len(carry) - 1 - k)
                    out += np.bincount(bins[new:][ok[new:]], minlength=BINS)
            carry = symbols[-2:]
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, str]]) -> None:
        c = self._codes("".join(f" {t} " for _, t in group))
        rows = np.array([i for i, _ in group])
        at = np.cumsum([0] + [len(t) + 2 for _, t in group])[:-1]
        is_letter = self.letter[c]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[:-1] |= is_letter[1:]
        kept = np.flatnonzero(keep)
        c = np.where(is_letter, c, np.uint32(32))[kept]
        if len(c) < 3:
            return
        row = np.searchsorted(at, kept, side="right") - 1
        for bins, ok in self._bins(c):
            r = row[: len(bins)][ok]
            out[rows] += np.bincount(r * BINS + bins[ok], minlength=len(rows) * BINS).reshape(len(rows), BINS).astype(np.float32)


def train(docs: DataFrame, per_language: int = 300) -> dict:
    """Bin probabilities of every language with a labelled document outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(4, 2))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = broadcast_if_small(cut_lineage(sizes.select("lang", F.least(F.lit(1.0), per_language / F.col("n")).alias("share"))), MAX_BROADCAST_LANGS)
    sample = known.where(F.octet_length("text") > 0).select("lang", "text", "doc_id").join(share, "lang").where(fraction_of(F.struct("doc_id", F.octet_length("text"))) < F.col("share"))

    def make():
        grams = Grams()

        def run(batch: pa.RecordBatch) -> dict:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {}
            for i in range(0, len(langs), GROUP):
                c = grams.counts(texts[i : i + GROUP])
                for k, lang in enumerate(langs[i : i + GROUP]):
                    out[lang] = out.get(lang, 0) + c[k].astype(np.float64)
            return {"lang": list(out), "counts": list(out.values())}

        return run

    counted = map_rows(sample.select("lang", "text"), make, "lang string, counts array<double>")
    bins = counted.select("lang", F.posexplode("counts").alias("bin", "n")).where("n > 0").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = bins.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).orderBy("lang").collect()
    langs, p = [r["lang"] for r in rows], np.full((len(rows), BINS), SMOOTH)
    for k, r in enumerate(rows):
        for b, n in r["bins"]:
            p[k, b] += n
    return {"langs": langs, "p": (p / p.sum(axis=1, keepdims=True)).astype(np.float32)}


def _mix(c: np.ndarray, p: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of the rows of c after some steps of expectation-maximisation."""
    share, n = start.astype(np.float32), c.sum(axis=1, keepdims=True)
    for _ in range(steps):
        share = share * ((c / (share @ p)) @ p.T) / n
    return share, np.einsum("ij,ij->i", c, np.log(share @ p)).astype(np.float64)


def infer(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language, score and number of languages of every histogram (rows of c, none empty)."""
    langs, n = len(p), c.sum(axis=1).astype(np.float64)
    single = (c @ np.log(p).T).astype(np.float64)
    top = single.max(axis=1)
    chance = np.exp((single - top[:, None]) / np.maximum(1.0, np.sqrt(n))[:, None])
    chance /= chance.sum(axis=1, keepdims=True)
    best, size = single.argmax(axis=1), np.ones(len(c), dtype=int)
    share = np.ones(len(c))
    if langs > 1:
        start = np.full((len(c), langs), 1.0 / langs)
        mixed, full = _mix(c, p, start, 8)
        # the likelihood is concave in the proportions: no mixture gains more than the largest gradient less n
        slope = (c / (mixed @ p)) @ p.T
        most = full + slope.max(axis=1) - n + 1e-3 + 1e-5 * n
        cost = PENALTY * np.log(np.maximum(2.0, n))
        value = top.copy()
        for m in range(2, langs + 1):
            at = np.flatnonzero(most - (m - 1) * cost > value)
            if not len(at):
                break
            order = np.argsort(-mixed[at], axis=1)[:, :m]
            begin = np.zeros((len(at), langs))
            np.put_along_axis(begin, order, np.maximum(1e-3, np.take_along_axis(mixed[at], order, axis=1)), axis=1)
            got, ll = _mix(c[at], p, begin / begin.sum(axis=1, keepdims=True), 12)
            better = ll - (m - 1) * cost[at] > value[at]
            rows = at[better]
            value[rows], size[rows] = (ll - (m - 1) * cost[at])[better], m
            best[rows], share[rows] = got[better].argmax(axis=1), got[better].max(axis=1)
    odds = np.where(size == 1, chance[np.arange(len(c)), best], 1.0)
    return best, np.clip(share * odds, 0, 1), size


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, n_langs) of every row."""

    def make():
        return _predictor(model)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, lang_pred string, score double, n_langs int")


def _predictor(model: dict):
    grams = Grams()

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        pred, score, size = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int32)
        for i in range(0, len(texts), GROUP) if model["langs"] else ():
            c = grams.counts(texts[i : i + GROUP])
            at = np.flatnonzero(c.sum(axis=1) > 0)
            if len(at):
                best, s, m = infer(c[at], model["p"])
                score[i + at], size[i + at] = s, m
                for k, b in zip(at, best, strict=True):
                    pred[i + k] = model["langs"][b]
        return {"doc_id": batch.column(0), "lang_pred": pred, "score": score, "n_langs": size}

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2: doc_id, held_out, lang_pred, score (and n_langs)."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "n_langs")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is identified with a score of at least `least`; columns unchanged."""
    model, names = train(docs), docs.columns
    with_score = docs.select("*", F.col("text").cast("string").alias(fresh(docs, "__text")))
    keep = _keep_schema(with_score)

    def run(batches):
        f = _predictor(model)
        for b in batches:
            if b.num_rows:
                mini = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(b.num_columns - 1)], names=["doc_id", "text"])
                r = f(mini)
                ok = pa.array([x != "und" and s >= least for x, s in zip(r["lang_pred"], r["score"], strict=True)])
                yield pa.RecordBatch.from_arrays(list(b.columns[:-1]), schema=pa.schema(list(b.schema)[:-1])).filter(ok)

    return with_score.mapInArrow(run, keep).select(*names)


def _keep_schema(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields[:-1])
