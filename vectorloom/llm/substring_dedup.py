"""Exact substring deduplication over a sparse, distributed suffix array.

A byte goes if a WINDOW-byte string that covers it also starts earlier, in a smaller (doc_id, start). Suffixes
are taken at anchors only: the GRAM-byte strings whose hash is the least of some window, which both copies of
any repeated window share. Every anchor has a context, the bytes that windows over it can reach.

1. Anchors are dealt by the hash of their GRAM bytes. Of equal contexts all but the earliest are covered
   entirely; each map task settles its own copies first, so a context that a third of all rows share sends one
   row per task. Anchors whose GRAM bytes occur in one context only are done: nothing repeats there.
2. The earliest copies of the other contexts meet again, with their bytes. Within a task their right sides are
   sorted into an enhanced suffix array; a stack scan over the common-prefix lengths gives the interval tree,
   and every interval is tested for left-extension diversity: up to the left context that all its occurrences
   share it is one group of repeats, beyond that it is split by left contexts. All occurrences of a group but
   the earliest are covered.
3. GRAM bytes with very many contexts (HOT) are settled by the hashes of their windows instead, dealt by window,
   so that no task has to hold them all.

Texts and ranges are brought together in buckets of documents. What is sent for a document is one row per
sender, with its ranges or places; a context is a row of its own. Only anchors, and windows of hot strings,
travel as one row per sender and bucket. Hashes have 64 bits.

A null text is empty. Rows that repeat doc_id and text are one document with one result each; different texts
under one doc_id are ordered by a hash, a null doc_id is the smallest. Texts below WINDOW bytes keep all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import Powers, mixed, raw_texts, table
from vectorloom.runtime import cut_lineage, shuffle_width

WINDOW, GRAM = 100, 32
LEFT = WINDOW - GRAM
HOT = 512
PIECE = 1 << 20
FLUSH = 2_000_000
NULL_ID = -(1 << 63)
FIRST, COVER, BY_WINDOW, MARK, BY_CONTEXT = range(5)

ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("t", "<u4"), ("p", "<i4"), ("k", "u1")])
WANT = np.dtype([("h", "<u8"), ("d", "<i8"), ("t", "<u4"), ("p", "<i4"), ("k", "u1")])
CONTEXT = np.dtype([("h", "<u8"), ("d", "<i8"), ("t", "<u4"), ("p", "<i4"), ("l", "u1"), ("r", "u1"), ("x", "u1", LEFT + WINDOW)])
RANGE = np.dtype([("d", "<i8"), ("t", "<u4"), ("s", "<i4"), ("e", "<i4")])
BLOBS = "bucket long, kind int, rows binary"
BLOB_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("rows", pa.binary())])


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n neighbours."""
    k = 1
    while 2 * k <= n:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


class Anchors:
    """Anchors of texts, with the hashes of their GRAM bytes and of their contexts."""

    def __init__(self):
        self.powers = Powers()

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, position, hash, context hash) of all anchors."""
        out, group, size = [], [], 0
        for i, t in enumerate(texts):
            if t is None or len(t) < WINDOW:
                continue
            for a in range(0, len(t) - WINDOW + 1, PIECE):
                lo, hi = max(0, a - WINDOW), min(len(t), a + PIECE + 3 * WINDOW)
                group.append((i, lo, t[lo:hi], lo == 0, hi == len(t)))
                size += hi - lo
                if size >= PIECE:
                    out.append(self._group(group))
                    group, size = [], 0
        if group:
            out.append(self._group(group))
        if not out:
            return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64))
        row, pos, h, c = (np.concatenate(x) for x in zip(*out, strict=True))
        if any(len(t or b"") > PIECE for t in texts):
            _, first = np.unique(np.stack([row, pos]), axis=1, return_index=True)
            row, pos, h, c = row[first], pos[first], h[first], c[first]
        return row, pos, h, c

    def _group(self, group: list) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        sizes = np.array([len(g[2]) for g in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = self.powers.prefix(data)
        n = len(data)
        at = np.arange(n - GRAM + 1)
        h = self.powers.ranges(total, at, at + GRAM)
        least = _slide(h, LEFT + 1, np.minimum)
        for e in ends:
            least[max(0, e - WINDOW + 1) : e] = 0
        edge = np.zeros(LEFT, dtype=np.uint64)
        most = _slide(np.concatenate([edge, least, edge]), LEFT + 1, np.maximum)
        j = np.flatnonzero((h == most[: len(h)]) & (h > 0))
        g = np.searchsorted(ends, j, side="right")
        whole_l, whole_r = np.array([x[3] for x in group])[g], np.array([x[4] for x in group])[g]
        keep = (j + GRAM <= ends[g]) & (whole_l | (j - LEFT >= starts[g])) & (whole_r | (j + WINDOW <= ends[g]))
        j, g = j[keep], g[keep]
        left, right = np.minimum(j - starts[g], LEFT), np.minimum(ends[g] - j, WINDOW)
        c = mixed(self.powers.ranges(total, j - left, j + right) ^ mixed((left * 128 + right + 1).astype(np.uint64)))
        return np.array([x[0] for x in group])[g], j - starts[g] + np.array([x[1] for x in group])[g], h[j], c


def _deal(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, bytes) of the rows of every bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rows) else [0]
    return [(int(bucket[a]), kind, rows[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _by_document(rows: np.ndarray, docs: int, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, bytes) of the rows of every document."""
    rows = rows[np.lexsort((rows["t"], rows["d"]))]
    if not len(rows):
        return []
    cuts = np.flatnonzero(np.r_[True, (rows["d"][1:] != rows["d"][:-1]) | (rows["t"][1:] != rows["t"][:-1]), True])
    bucket = rows["t"][cuts[:-1]].astype(np.int64) % docs
    return [(b, kind, rows[i:j].tobytes()) for b, i, j in zip(bucket.tolist(), cuts[:-1], cuts[1:], strict=True)]


def _covers(rows: np.ndarray, docs: int) -> list[tuple[int, int, bytes]]:
    """(bucket, COVER, ranges) of every document; ranges that touch become one."""
    rows = rows[np.lexsort((rows["s"], rows["t"], rows["d"]))]
    if not len(rows):
        return []
    new = np.r_[False, (rows["d"][1:] != rows["d"][:-1]) | (rows["t"][1:] != rows["t"][:-1])]
    shift = np.cumsum(new) << 34  # keeps the reach of a document below the starts of the next
    reach = np.maximum.accumulate(rows["e"] + shift)
    at = np.flatnonzero(np.r_[True, rows["s"][1:] + shift[1:] > reach[:-1] + 1])
    out = rows[at]
    out["e"] = (reach - shift)[np.r_[at[1:], len(rows)] - 1]
    return _by_document(out, docs, COVER)


def _blobs(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([list(x) for x in zip(*found, strict=True)] if found else [[], [], []], schema=BLOB_SCHEMA)


def _joined(t: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    """All rows of a kind in a table of blobs."""
    return np.frombuffer(b"".join(b for b, k in zip(t["rows"].to_pylist(), t["kind"].to_pylist(), strict=True) if k == kind), dtype)


def _spread(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % buckets


def _ranges(rows: np.ndarray) -> np.ndarray:
    """Starts of the windows over anchors, to be cut to the text later."""
    out = np.zeros(len(rows), dtype=RANGE)
    out["d"], out["t"], out["s"], out["e"] = rows["d"], rows["t"], rows["p"] - LEFT, rows["p"]
    return out


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by hash, context and place; True where a context begins; the number of contexts of each row's hash."""
    rows = rows[np.lexsort((rows["p"], rows["t"], rows["d"], rows["c"], rows["h"]))]
    new_h = np.r_[True, rows["h"][1:] != rows["h"][:-1]][: len(rows)]
    new_c = new_h | np.r_[True, rows["c"][1:] != rows["c"][:-1]][: len(rows)]
    group = np.cumsum(new_h) - 1
    return rows, new_c, np.bincount(group[new_c], minlength=group[-1] + 1 if len(rows) else 0)[group] if len(rows) else np.zeros(0, np.int64)


def _settle_locally(rows: np.ndarray, buckets: int, docs: int) -> pa.Table:
    """What a map task sends: one row for each of its contexts; the other copies are covered."""
    rows, first, contexts = _ordered(rows)
    hot = contexts > HOT
    cover, direct, rest = rows[~first], rows[first & hot], rows[first & ~hot]
    marks = direct[np.r_[True, direct["h"][1:] != direct["h"][:-1]][: len(direct)]].copy()
    direct = direct.copy()
    rest = np.concatenate([rest, marks])
    rest["k"][len(rest) - len(marks) :] = MARK
    found = _covers(_ranges(cover), docs) + _by_document(_wanted(direct, BY_WINDOW), docs, BY_WINDOW)
    return _blobs(found + _deal(rest, _spread(rest["h"], buckets), FIRST))


def _wanted(rows: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros(len(rows), dtype=WANT)
    for c in ("h", "d", "t", "p"):
        out[c] = rows[c]
    out["k"] = kind
    return out


def _by_gram(docs: int):
    """Step 1 for a bucket of GRAM hashes: blobs, by bucket of documents, of ranges and of contexts to look at."""

    def run(t: pa.Table) -> pa.Table:
        rows = _joined(t, FIRST, ANCHOR)
        marks = np.unique(rows["h"][rows["k"] == MARK])
        rows, first, contexts = _ordered(rows[rows["k"] != MARK])
        hot = np.isin(rows["h"], marks) | (contexts > 32 * HOT)
        cover, windows, context = rows[~first], rows[first & hot], rows[first & ~hot & (contexts > 1)]
        want = np.concatenate([_wanted(windows, BY_WINDOW), _wanted(context, BY_CONTEXT)])
        passed = zip(t["bucket"].to_pylist(), t["kind"].to_pylist(), t["rows"].to_pylist(), strict=True)
        found = [(b, COVER if k == COVER else BY_CONTEXT, r) for b, k, r in passed if k in (COVER, BY_WINDOW)]
        return _blobs(found + _covers(_ranges(cover), docs) + _by_document(want, docs, BY_CONTEXT))

    return run


def _places(d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and sorted keys of documents, to look rows up by (d, t)."""
    key = np.zeros(len(d), dtype=[("d", "<i8"), ("t", "<u4")])
    key["d"], key["t"] = d, t
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _documents(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return docs["d"].to_numpy(), docs["t"].to_numpy().astype(np.uint32), [x or b"" for x in docs["text"].combine_chunks().cast(pa.binary()).to_pylist()]


def _fetch(buckets: int, n_docs: int):
    """Step 2 for a bucket of documents: the bytes of the wanted contexts, and the windows of hot ones."""

    def run(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        want = _joined(blobs, BY_CONTEXT, WANT)
        if not len(want) or not docs.num_rows:
            return _blobs([])
        d, t, texts = _documents(docs)
        order, keys = _places(d, t)
        own = np.zeros(len(want), dtype=keys.dtype)
        own["d"], own["t"] = want["d"], want["t"]
        at = order[np.searchsorted(keys, own)]
        by = np.argsort(at, kind="stable")
        want, at = want[by], at[by]
        out = np.zeros(len(want), dtype=CONTEXT)
        for c in ("h", "d", "t", "p"):
            out[c] = want[c]
        powers, hashes, places = Powers(), [], []
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            text = np.frombuffer(texts[at[a]], np.uint8)
            p = want["p"][a:b].astype(np.int64)
            left, right = np.minimum(p, LEFT), np.minimum(len(text) - p, WINDOW)
            out["l"][a:b], out["r"][a:b] = left, right
            padded = np.concatenate([np.zeros(LEFT, np.uint8), text, np.zeros(WINDOW, np.uint8)])
            out["x"][a:b] = padded[p[:, None] + np.arange(LEFT + WINDOW)[None, :]]
            hot = p[want["k"][a:b] == BY_WINDOW]
            if len(hot):
                s = np.unique(hot[:, None] - np.arange(LEFT + 1)[None, :])
                s = s[(s >= 0) & (s <= len(text) - WINDOW)]
                hashes.append(powers.ranges(powers.prefix(text), s, s + WINDOW))
                places.append(np.rec.fromarrays([np.full(len(s), want["d"][a]), np.full(len(s), want["t"][a]), s, s], dtype=RANGE))
        context = out[want["k"] == BY_CONTEXT]
        found = [(b, BY_CONTEXT, c.tobytes()) for b, c in zip(_spread(context["h"], buckets).tolist(), context, strict=True)]
        if hashes:
            h, rows = np.concatenate(hashes), np.concatenate(places)
            order = np.lexsort((rows["s"], rows["t"], rows["d"], h))
            h, rows = h[order], rows[order]
            first = np.r_[True, h[1:] != h[:-1]]
            found += _covers(rows[~first], n_docs)
            keyed = np.zeros(first.sum(), dtype=WINDOWED)
            keyed["h"], keyed["row"] = h[first], rows[first]
            found += _deal(keyed, _spread(keyed["h"], buckets), BY_WINDOW)
        return _blobs(found)

    return run


WINDOWED = np.dtype([("h", "<u8"), ("row", RANGE)])


def lcp_intervals(lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Nodes (first, last, length, length of the parent) of the common-prefix interval tree, by a stack scan.

    lcp[i] is the common prefix of suffixes i and i + 1; nodes of a length below least are left out, and a
    parent's length is at least least - 1.
    """
    out, stack = [], []
    for i, v in enumerate(np.append(lcp, 0).tolist()):
        first = i
        while stack and stack[-1][1] > v:
            first, length = stack.pop()
            up = max(v, stack[-1][1] if stack else 0, least - 1)
            out.append((first, i, length, up))
        if v >= least and (not stack or stack[-1][1] < v):
            stack.append((first, v))
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def repeats(rows: np.ndarray) -> np.ndarray:
    """For contexts (dtype CONTEXT, any order): True at [row, o] if the window o bytes left of the anchor occurs earlier.

    The rows come back in the order of their places; see places_of().
    """
    m = len(rows)
    right, left = rows["x"][:, LEFT:], rows["x"][:, :LEFT][:, ::-1]
    words = np.zeros((m, 104), np.uint8)
    words[:, :WINDOW] = right
    words = words.view(">u8")
    sa = np.lexsort((rows["r"], *words.T[::-1], rows["h"]))
    same = right[sa[1:]] == right[sa[:-1]]
    lcp = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(rows["r"][sa[1:]], rows["r"][sa[:-1]]))
    lcp[rows["h"][sa[1:]] != rows["h"][sa[:-1]]] = 0
    same = left[sa[1:]] == left[sa[:-1]]
    lext = np.where(same.all(axis=1), LEFT, same.argmin(axis=1))
    lext = np.minimum(lext, np.minimum(rows["l"][sa[1:]], rows["l"][sa[:-1]]))
    nodes = lcp_intervals(lcp, GRAM)
    covered = np.zeros((m, LEFT + 1), dtype=bool)
    if not len(nodes):
        return covered
    # windows o bytes left of the anchor need WINDOW - o bytes to its right: between the parent's length and the node's
    o_lo, o_hi = WINDOW - nodes[:, 2], np.minimum(LEFT, WINDOW - nodes[:, 3] - 1)
    shared = np.array([int(lext[a:b].min()) for a, b in nodes[:, :2]])
    rank = sa  # rows are in the order of their places, so a row number is a rank
    flat = np.zeros((m, LEFT + 2), dtype=np.int16)
    one = np.flatnonzero(o_lo <= np.minimum(o_hi, shared))
    for k in one.tolist():
        a, b = nodes[k, 0], nodes[k, 1]
        members = rank[a : b + 1]
        later = members[members != members.min()]
        flat[later, o_lo[k]] += 1
        flat[later, min(o_hi[k], shared[k]) + 1] -= 1
    covered |= np.cumsum(flat, axis=1)[:, : LEFT + 1] > 0
    # left-diverse beyond what all share: split by the left context
    hashes = np.zeros((m, LEFT + 1), dtype=np.uint64)
    for i in range(LEFT):
        hashes[:, i + 1] = hashes[:, i] * np.uint64(Powers.BASE) + left[:, i] + np.uint64(1)
    begin = np.maximum(o_lo, shared + 1)
    for o in range(LEFT + 1):
        k = np.flatnonzero((begin <= o) & (o <= o_hi))
        if not len(k):
            continue
        n = nodes[k, 1] - nodes[k, 0] + 1
        node = np.repeat(np.arange(len(k)), n)
        at = rank[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(nodes[k, 0], n)]
        ok = rows["l"][at] >= o
        node, at = node[ok], at[ok]
        key = mixed(hashes[at, o] ^ mixed(node.astype(np.uint64) + np.uint64(7)))
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        covered[at[1:][key[1:] == key[:-1]], o] = True
    return covered


def _by_place(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["p"], rows["t"], rows["d"]))]


def _by_context(docs: int):
    """Step 2 for a bucket of GRAM hashes, step 3 for a bucket of window hashes: ranges by bucket of documents."""

    def run(t: pa.Table) -> pa.Table:
        found = [(b, k, r) for b, k, r in zip(t["bucket"].to_pylist(), t["kind"].to_pylist(), t["rows"].to_pylist(), strict=True) if k == COVER]
        rows = _by_place(_joined(t, BY_CONTEXT, CONTEXT))
        if len(rows):
            covered = repeats(rows)
            edges = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, lo = np.nonzero(edges == 1)
            _, hi = np.nonzero(edges == -1)
            out = np.zeros(len(i), dtype=RANGE)
            out["d"], out["t"], out["s"], out["e"] = rows["d"][i], rows["t"][i], rows["p"][i] - (hi - 1), rows["p"][i] - lo
            found += _covers(out, docs)
        windows = _joined(t, BY_WINDOW, WINDOWED)
        if len(windows):
            place = windows["row"]
            windows = windows[np.lexsort((place["s"], place["t"], place["d"], windows["h"]))]
            again = windows["row"][np.r_[False, windows["h"][1:] == windows["h"][:-1]]]
            found += _covers(again, docs)
        return _blobs(found)

    return run


RESULT = pa.schema([("d", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _remove(docs: pa.Table, blobs: pa.Table) -> pa.Table:
    """The result rows of a bucket of documents."""
    d, t, texts = _documents(docs)
    rows = _joined(blobs, COVER, RANGE)
    order, keys = _places(rows["d"], rows["t"])
    rows = rows[order]
    own = np.zeros(len(d), dtype=keys.dtype)
    own["d"], own["t"] = d, t
    lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
    out: dict[str, list] = {c: [] for c in RESULT.names}
    for i, text in enumerate(texts):
        r = rows[lo[i] : hi[i]]
        s, e = np.maximum(r["s"], 0), np.minimum(r["e"].astype(np.int64), len(text) - WINDOW)
        s, e = s[s <= e], e[s <= e] + WINDOW
        by = np.argsort(s, kind="stable")
        s, e = s[by], np.maximum.accumulate(e[by]) if len(e) else e
        new = np.r_[True, s[1:] > e[:-1]][: len(s)]
        first = s[new]
        last = e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]] if len(s) else e
        digest, at = hashlib.sha256(), 0
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        out["d"].append(int(d[i]))
        out["n_bytes"].append(len(text))
        out["n_removed"].append(int((last - first).sum()))
        out["n_spans"].append(len(first))
        out["kept_sha256"].append(digest.hexdigest())
        out["spans"].append(np.stack([first, last], axis=1).ravel().tolist())
    return pa.table(out, schema=RESULT)


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans: removed byte ranges, start and end in turn."""
    width = shuffle_width(docs.sparkSession)
    buckets, doc_buckets = buckets or 2 * width, buckets or width
    whole = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text).cast("string").alias("text"))
    marked = whole.select("d", F.xxhash64("d", "text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("t"), "text")
    placed = marked.withColumn("bucket", F.col("t") % doc_buckets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, n = Anchors(), [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                d, t = part.column(0).to_numpy(), part.column(1).to_numpy()
                row, pos, h, c = anchors.of(raw_texts(part.column(2)))
                rows = np.zeros(len(row), dtype=ANCHOR)
                rows["h"], rows["c"], rows["d"], rows["t"], rows["p"] = h, c, d[row], t[row].astype(np.uint32), pos
                held.append(rows)
                n += len(rows)
                if n > FLUSH:
                    yield from _settle_locally(np.concatenate(held), buckets, doc_buckets).to_batches()
                    held, n = [], 0
        if n:
            yield from _settle_locally(np.concatenate(held), buckets, doc_buckets).to_batches()

    anchors = marked.mapInArrow(find, BLOBS)
    settled = cut_lineage(anchors.groupBy("bucket").applyInArrow(_by_gram(doc_buckets), BLOBS))
    wanted = settled.where(F.col("kind") == BY_CONTEXT)
    fetched = placed.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_fetch(buckets, doc_buckets), BLOBS)
    ranges = fetched.groupBy("bucket").applyInArrow(_by_context(doc_buckets), BLOBS).union(settled.where(F.col("kind") == COVER))
    out = placed.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(_remove, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.select(F.nullif("d", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op3: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return duplicate_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
