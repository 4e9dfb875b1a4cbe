"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked at a Hamming distance of at most two. The anchors are the code words of
C x C on the low 46 bits, where C is the perfect binary Golay code of length 23: every 23-bit block lies within
three bits of exactly one code word, so a fingerprint has one home anchor. A partner that differs by d bits in
a block lies within 3 + d bits of the home code word; each fingerprint is therefore replicated to all anchors
whose excess distances over the two blocks sum to at most two (65 on average, at any corpus size), and every
anchor compares its home fingerprints with its replicas. Only distinct fingerprints take part. An anchor with
many fingerprints is not compared pairwise: two words are within two bits exactly if a single-bit change (or
none) of both gives the same word, so equal variants are joined by sorting, in linear time.

The pipeline's near-dedup stage (keep_first) links texts by fingerprints of its own shingles in the same way, over the
same anchors. Two bits are far fewer than what a Jaccard similarity of 0.8 leaves apart, so it also links texts whose
sets of word shingles have a similarity of at least SIMILAR; components are those of both kinds of links together.
Candidates of the second kind meet in BANDS buckets of ROWS min-hashes each (a pair at exactly 0.8 shares none with
probability (1 - 0.8 ** 4) ** 28, 4 in ten million), and are verified on the sets themselves, within the bucket. A
fingerprint counts repeated shingles, a set does not: each kind finds links that the other one misses.

Nulls and empty texts have fingerprint zero and are linked like any other; rows that repeat a doc_id get one
result row each; a null doc_id never becomes a component_id unless all members have none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import fresh, map_rows, mixed, raw_texts, table
from vectorloom.plans.components import connected_components, label_components
from vectorloom.runtime import cut_lineage, shuffle_width

GOLAY = 0xAE3
BITS, RADIUS, DISTANCE = 23, 3, 2
MASK = (1 << BITS) - 1
PAIRWISE = 1500
SIMILAR, BANDS, ROWS = (4, 5), 28, 4


def shingles(text: bytes | None, shingle: int) -> list[int]:
    """Hashes of the word shingles of a text given as UTF-8 bytes; a shorter text is one shingle, an empty one none."""
    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text given as UTF-8 bytes."""
    return majority(np.array(shingles(text, shingle), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_TABLES: list = []


def _cosets() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Syndromes of all single bits; by class of weight (up to 3, 4, 5): offsets and error patterns sorted by syndrome."""
    if _TABLES:
        return _TABLES[0]
    unit = []
    for i in range(BITS):
        x = 1 << i
        for k in range(BITS - 1, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        unit.append(x)
    offsets, patterns = [], []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        e, s = [], []
        for w in weights:
            for c in combinations(range(BITS), w):
                e.append(sum(1 << i for i in c))
                s.append(int(np.bitwise_xor.reduce([unit[i] for i in c])) if c else 0)
        order = np.argsort(s, kind="stable")
        offsets.append(np.searchsorted(np.array(s)[order], np.arange(2049)))
        patterns.append(np.array(e, dtype=np.int64)[order])
    _TABLES.append((np.array(unit, dtype=np.int64), offsets, patterns))
    return _TABLES[0]


def _syndrome(x: np.ndarray) -> np.ndarray:
    unit, out = _cosets()[0], np.zeros(len(x), dtype=np.int64)
    for i in range(BITS):
        out ^= unit[i] * (x >> i & 1)
    return out


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions of all the ranges lo[i] .. hi[i]."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all anchors of the fingerprints; key is the anchor shifted by one, the last bit set at the home anchor."""
    _, offsets, patterns = _cosets()
    fps = fps.astype(np.uint64)
    block = [(fps & np.uint64(MASK)).astype(np.int64), (fps >> np.uint64(BITS) & np.uint64(MASK)).astype(np.int64)]
    near: list[dict] = []
    for x in block:
        s, found = _syndrome(x), {}
        for k in range(3):
            row, at = _ragged(offsets[k][s], offsets[k][s + 1])
            found[k] = (row, x[row] ^ patterns[k][at], np.searchsorted(row, np.arange(len(x) + 1)))
        near.append(found)
    rows, keys = [], []
    for k1, k2 in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)):
        row1, code1, _ = near[0][k1]
        _, code2, first2 = near[1][k2]
        i, at = _ragged(first2[row1], first2[row1 + 1])
        rows.append(row1[i])
        keys.append((code1[i] << BITS | code2[at]) << 1 | int(k1 == k2 == 0))
    return np.concatenate(rows), np.concatenate(keys)


def _links(fps: np.ndarray, idx: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints at one anchor (positions idx in fps)."""
    if len(idx) <= PAIRWISE:
        h = idx[home]
        d = np.bitwise_count(fps[h][:, None] ^ fps[idx][None, :])
        i, j = np.nonzero(d <= DISTANCE)
        return h[i], idx[j]
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    mine = fps[idx]
    order = [mine, *(mine ^ b for b in one)]
    who, what = np.tile(idx, 65), np.concatenate(order)
    by = np.argsort(what, kind="stable")
    same = what[by][1:] == what[by][:-1]
    return who[by][:-1][same], who[by][1:][same]


def _compare(table: pa.Table) -> pa.Table:
    key = np.concatenate([np.frombuffer(b, "<i8") for b in table["keys"].to_pylist()])
    raw = np.concatenate([np.frombuffer(b, "<u8") for b in table["fps"].to_pylist()])
    fps, at = np.unique(raw, return_inverse=True)
    order = np.argsort(key >> 1, kind="stable")
    anchor, home, at = (key >> 1)[order], (key & 1)[order].astype(bool), at[order]
    cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    size, homes = np.diff(cuts), np.add.reduceat(home.astype(np.int64), cuts[:-1])
    live = (size > 1) & (homes > 0)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    few = live & (size <= 64)
    lo, hi = cuts[:-1][few], cuts[1:][few]
    for part in np.array_split(np.arange(len(lo)), max(1, int(size[few].sum() // 200_000))):
        g, pos = _ragged(lo[part], hi[part])
        g, pos = g[home[pos]], pos[home[pos]]
        i, other = _ragged(lo[part][g], hi[part][g])
        x, y = at[pos[i]], at[other]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= DISTANCE
        a.append(x[near])
        b.append(y[near])
    for lo, hi in zip(cuts[:-1][live & ~few], cuts[1:][live & ~few], strict=True):
        x, y = _links(fps, at[lo:hi], home[lo:hi])
        a.append(x)
        b.append(y)
    root = label_components(len(fps), np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(root != np.arange(len(fps)))
    return pa.table({"src": pa.array(fps[child].view(np.int64)), "dst": pa.array(fps[root[child]].view(np.int64))})


def fingerprint_links(fps: DataFrame, parts: int | None = None) -> DataFrame:
    """(src, dst) links that span the components of the distinct fingerprints in column fp, linked within two bits."""
    parts = parts or 2 * shuffle_width(fps.sparkSession)

    def replicate():
        def run(batch: pa.RecordBatch) -> dict:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = anchors(fp)
            part = ((key >> 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            kept = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            row, key = row[order], key[order]
            return {"part": kept, "keys": [key[cuts[p] : cuts[p + 1]].tobytes() for p in kept], "fps": [fp[row[cuts[p] : cuts[p + 1]]].tobytes() for p in kept]}

        return run

    blobs = map_rows(fps.select("fp"), replicate, "part int, keys binary, fps binary")
    return blobs.groupBy("part").applyInArrow(_compare, "src long, dst long")


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, h a hash of the text; (fp, component, component_id) of every fingerprint."""

    def make():
        return lambda batch: {"doc_id": batch.column(0), "h": batch.column(2), "fp": [_signed(fingerprint(t, shingle)) for t in raw_texts(batch.column(1))]}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("h"))
    marked = cut_lineage(map_rows(rows, make, "doc_id long, h long, fp long"))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = connected_components(fingerprint_links(first))
    owned = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = owned.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked, owned.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over links."""
    marked, named = _classes(docs, doc_id, text, shingle)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op6: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_TURNS = np.random.default_rng(20).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(grams: np.ndarray) -> np.ndarray:
    """Bucket keys of a set of shingle hashes: one for each band of min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 4096):
        np.minimum(least, (grams[None, i : i + 4096] * _TURNS[:, :1] + _TURNS[:, 1:]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x100000001B3) + row)
    return key


def _buckets(table: pa.Table) -> pa.Table:
    """(bucket, node) of the buckets with several nodes; buckets of the same nodes count once."""
    key = np.concatenate([np.frombuffer(b, "<u8") for b in table["keys"].to_pylist()])
    node = np.concatenate([np.frombuffer(b, "<u8") for b in table["nodes"].to_pylist()])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node = key[new], node[new]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    name = np.add.reduceat(mixed(node ^ np.uint64(0x9E3779B97F4A7C15)), cuts[:-1])
    live = np.flatnonzero(np.diff(cuts) > 1)
    live = live[np.unique(name[live], return_index=True)[1]]
    row, at = _ragged(cuts[:-1][live], cuts[1:][live])
    return pa.table({"bucket": pa.array(name[live][row].view(np.int64)), "node": pa.array(node[at].view(np.int64))})


def _similar(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that span the components of some sets: every set not reached yet is compared with every set reached."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.r_[0, np.cumsum(size)]
    left, mark, a, b = np.arange(len(sets)), np.zeros(code.max() + 1, dtype=bool), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            may = left[SIMILAR[1] * np.minimum(size[left], size[x]) >= SIMILAR[0] * np.maximum(size[left], size[x])]
            if not len(may):
                continue
            mine = code[first[x] : first[x + 1]]
            mark[mine] = True
            row, at = _ragged(first[may], first[may + 1])
            shared = np.bincount(row[mark[code[at]]], minlength=len(may))
            mark[mine] = False
            near = may[sum(SIMILAR) * shared >= SIMILAR[0] * (size[may] + size[x])]
            a += [x] * len(near)
            b += near.tolist()
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return a, b


def _verify(table: pa.Table) -> pa.Table:
    bucket = table["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    node, grams = table["node"].to_numpy(), table["grams"].combine_chunks()
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True])
    src, dst = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        a, b = _similar([np.frombuffer(grams[int(i)].as_buffer(), "<u4") for i in at])
        src.append(node[at[a]])
        dst.append(node[at[b]])
    none = [np.empty(0, np.int64)]
    return pa.table({"src": pa.array(np.concatenate(none + src)), "dst": pa.array(np.concatenate(none + dst))})


def similar_links(marked: DataFrame, grams: DataFrame) -> DataFrame:
    """(src, dst) links that span the components of similar nodes (node, keys and node, grams; repeated rows count once)."""
    spark = marked.sparkSession
    parts, finer = 2 * shuffle_width(spark), 4 * shuffle_width(spark)

    def deal():
        def run(batch: pa.RecordBatch) -> dict | None:
            node, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
            key = np.concatenate([np.frombuffer(batch.column(1)[int(i)].as_buffer(), "<u8") for i in at])
            node = np.repeat(node, BANDS)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            kept = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            key, node = key[order], node[order]
            return {"part": kept, "keys": [key[cuts[p] : cuts[p + 1]].tobytes() for p in kept], "nodes": [node[cuts[p] : cuts[p + 1]].tobytes() for p in kept]}

        return run

    blobs = map_rows(marked.where("node <> 0").select("node", "keys"), deal, "part int, keys binary, nodes binary")
    members = cut_lineage(blobs.groupBy("part").applyInArrow(_buckets, "bucket long, node long").distinct())
    sets = grams.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))
    met = members.join(sets, "node").withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(finer)))
    return met.groupBy("part").applyInArrow(_verify, "src long, dst long")


def close_links(marked: DataFrame) -> DataFrame:
    """(src, dst) links that span the components of nodes (node, fp) whose fingerprints are within two bits."""
    pairs = cut_lineage(marked.select("node", "fp").distinct())
    owner = pairs.groupBy("fp").agg(F.min("node").alias("own"))
    same = pairs.join(owner, "fp").select(F.col("node").alias("src"), F.col("own").alias("dst")).where("src <> dst")
    src, dst = (owner.select(F.col("fp").alias(x), F.col("own").alias(f"{x}_own")) for x in ("src", "dst"))
    other = fingerprint_links(owner.select("fp")).distinct().join(src, "src").join(dst, "dst")
    return same.union(other.select("src_own", "dst_own"))


def _sets(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, node, fp, keys) and (node, grams) of every row: node is a hash of the set of shingles, 0 for the empty one.

    The sets, by far the largest, are not kept: they are made again for the texts that share a bucket.
    """

    def name(s: np.ndarray) -> int:
        return _signed(xxhash.xxh64_intdigest(s.tobytes(), 7)) if len(s) else 0

    def mark():
        def run(batch: pa.RecordBatch) -> dict:
            node, fp, keys = [], [], []
            for t in raw_texts(batch.column(1)):
                hashes = np.array(shingles(t, shingle), dtype="<u8")
                s = np.unique(hashes)
                node.append(name(s))
                fp.append(_signed(majority(hashes)))
                keys.append(bands(s).tobytes() if len(s) else b"")
            return {"doc_id": batch.column(0), "h": batch.column(2), "node": node, "fp": fp, "keys": keys}

        return run

    def gather():
        def run(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(np.array(shingles(t, shingle), dtype="<u8")) for t in raw_texts(batch.column(0))]
            return {"node": [name(s) for s in sets], "grams": [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets]}

        return run

    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(F.col("text")).alias("h"))
    marked = cut_lineage(map_rows(rows, mark, "doc_id long, h long, node long, fp long, keys binary"))
    return marked, map_rows(docs.select(text), gather, "node long, grams binary")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component of near-duplicate texts, columns unchanged: the smallest doc_id (null last), then the smallest text hash.

    Texts are linked whose fingerprints are within two bits, and texts whose sets of shingles are similar (Jaccard).
    Of rows that repeat both, the one with the smallest other columns stays.
    """
    marked, grams = _sets(docs, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h").alias("h"))
    linked = connected_components(close_links(marked).union(similar_links(marked, grams)))
    named = marked.select("node", "doc_id", "h").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min(order).alias("m"))
    d, h, r = fresh(docs, "__d"), fresh(docs, "__h"), fresh(docs, "__r")
    none = F.lit(-(1 << 63))
    chosen = best.select(F.coalesce("m.d", none).alias(d), F.col("m.h").alias(h))
    met = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), none).alias(d), F.xxhash64(F.col("text").cast("string")).alias(h)).join(chosen, [d, h], "left_semi")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    one = met.withColumn(r, F.row_number().over(Window.partitionBy(d, h).orderBy(*others, F.lit(0))))
    return one.where(F.col(r) == 1).select(*docs.columns)
