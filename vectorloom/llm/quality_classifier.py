"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed in blocks of
BLOCK bytes with each of them (all of its blocks: the whole text); the difference of the two sizes over
their sum, and nothing else, becomes the probability of a good label through a logistic calibration.

Learning uses a bounded sample of the labelled rows: at most max_docs documents by a hash of doc_id. Half of them, by a
hash of the row, give the dictionaries, from at most max_blocks pieces of PIECE bytes a label, chosen
by a hash among all pieces of whole texts; the other half, at most max_docs rows, gives differences for the
calibration. Only these pieces and numbers come to the driver, whatever the number or the length of texts under a doc_id.

Null and empty texts score the share of good labels. Labels that disagree on a document count by their mean,
a mean of 0.5 as good; null labels are ignored. Equal texts under one doc_id are learned from once; every row is scored,
so repeated rows repeat their score, and texts of any length count whole. With too few labels of a kind, the
score is the share of good labels. Only doc_id and text are read, so other columns cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import fraction_of, held_out, map_rows, raw_texts, table
from vectorloom.runtime import cut_lineage

BLOCK = 1024
LEVEL = 3
DICT_BYTES = 262_144
PIECE = 512
SCALE = 20.0


class Compressors:
    """Sizes of texts under the dictionaries of the good and of the bad texts."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes | None) -> float:
        """Size under the bad dictionary less size under the good one, over their sum."""
        text = text or b""
        good = bad = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            good += len(self.pair[0].compress(block))
            bad += len(self.pair[1].compress(block))
        return (bad - good) / max(1, good + bad)


def design(d: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(d), SCALE * d], axis=1)


def probability(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(design(d) @ w, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    w, pen = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary of some pieces of text; their concatenation where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICT_BYTES]


def _least(df: DataFrame, by: Column, n: int) -> DataFrame:
    """At most n rows, those with the least hashes."""
    return df.orderBy(by, *df.columns).limit(n)


def sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """(key, text, good, half) of the distinct labelled texts of at most max_docs documents outside the held-out fold."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good"))
    share = min(1.0, 1.2 * max_docs / max(1, marked.count()))
    chosen = _least(marked.where(fraction_of(F.col("doc_id")) <= share), F.xxhash64("doc_id"), max_docs)
    texts = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("doc_id", "text")).dropDuplicates(["key"])
    return cut_lineage(met.select("key", F.col("text").cast("binary").alias("text"), "good", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2)).alias("half")))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_blocks: int = 8000) -> dict:
    """Dictionaries and calibration from a bounded sample of the labelled documents outside the held-out fold."""
    rows = sample(docs, labels, max_docs)
    counts = {(r["half"], r["good"]): r["count"] for r in rows.groupBy("half", "good").count().collect()}
    good, n = sum(v for (_, g), v in counts.items() if g), sum(counts.values())
    model = {"prior": (good + 1) / (n + 2), "good": b"", "bad": b"", "w": None}
    if min(counts.get((h, g), 0) for h in (0, 1) for g in (True, False)) < 3:
        return model
    last = F.floor((F.octet_length("text") - 1) / PIECE).cast("int")
    pieces = rows.where("half = 0").select("good", "key", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    pieces = pieces.select("good", "key", "i", F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    for name, side in (("good", F.col("good")), ("bad", ~F.col("good"))):
        picked = _least(pieces.where(side), F.xxhash64("key", "i"), max_blocks).collect()
        model[name] = dictionary([bytes(r["piece"]) for r in picked])

    def make():
        c = Compressors(model["good"], model["bad"])
        return lambda b: {"key": b.column(0), "d": [c.difference(t) for t in b.column(1).to_pylist()], "good": b.column(2)}

    apart = map_rows(rows.where("half = 1").select("key", "text", "good"), make, "key long, d double, good boolean")
    known = _least(apart, F.xxhash64("key"), max_docs).collect()
    model["w"] = fit_logistic(design(np.array([r["d"] for r in known])), np.array([float(r["good"]) for r in known]))
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""

    def make():
        c = Compressors(model["good"], model["bad"]) if model["w"] is not None else None

        def run(batch: pa.RecordBatch) -> dict:
            texts = raw_texts(batch.column(1))
            out = np.full(len(texts), model["prior"])
            if c is not None:
                p = probability(np.array([c.difference(t) for t in texts]), model["w"])
                out = np.where([bool(t) for t in texts], p, out)
            return {"doc_id": batch.column(0), "score": out}

        return run

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op4: doc_id, held_out, score, predicted (score >= 0.3)."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
