"""Benchmark decontamination by template canonicalisation.

Texts become token sequences (runs of letters, digits and non-ASCII characters, lower-cased) in which numbers,
names (capitalised inside a sentence) and units (after a number) are typed placeholders. All windows of WINDOW
canonical tokens of a document are hash-joined with the windows of the benchmark items, so a re-parameterised
question meets its original. Hits of a document and an item on one diagonal are then checked for slot
consistency: over the tokens they cover, each original slot value must stand for one value of the document and
the reverse. A document is contaminated by an item if consistent hits cover at least NEED_TOKENS of the item's
tokens, or NEED_SHARE of a shorter item.

Pairs that this rule does not find are looked for in two more streams of tokens. The literal one has the
lower-cased tokens themselves, without placeholders, slot checks or a minimum of literals (lists of names,
copies in another case). The folded one has one placeholder for a number with separators or decimals and one
for a run of names, so values of another token count keep their place. In both, diagonals of an item within
DRIFT tokens are added up (inserted and left-out words); items of WINDOW to SHORT - 1 tokens are
met by windows of MIN_TOKENS there, and need WINDOW covered tokens at least. Counts are in tokens of the item.
An item whose canonical hits are enough but inconsistent is found only by NEED_TOKENS literal tokens.

The benchmark side is broadcast only behind a check of its number of tokens (MAX_BROADCAST_TOKENS); beyond it,
pairs of texts with a common window are found by a shuffle on its hash and judged by the same code. Items of fewer than WINDOW tokens match as a whole if they have
at least MIN_TOKENS; shorter ones (and null or empty texts) match nothing. Windows need MIN_LITERALS tokens
that are no placeholders. Repeated rows and items give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import Powers, fresh, map_rows, mixed, table
from vectorloom.runtime import fits

WINDOW, MIN_TOKENS, MIN_LITERALS = 8, 5, 4
NEED_TOKENS, NEED_SHARE = 20, 0.6
DRIFT, SHORT = 8, 20
MAX_BROADCAST_TOKENS = 2_000_000
MAX_BROADCAST_ITEMS = 100_000
PIECE = 1 << 20
UNITS = "mm cm m km in inch inches ft feet foot yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz ghz watt watts volt volts degree degrees".split()
NUMBER, NAME, UNIT = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7), np.uint64(0x44DB015024623547)


class Tokens:
    """Canonical and raw token hashes of texts."""

    def __init__(self):
        byte = np.arange(256)
        self.inside = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
        self.ender = np.isin(byte, list(b".!?\n:;\"")) | (byte == 0)
        self.powers = Powers()
        self.units = np.sort(self._plain(" ".join(UNITS).encode()))

    def _plain(self, low: bytes) -> np.ndarray:
        return self._cut(np.frombuffer(low, np.uint8), np.zeros(0, np.int64))[2]

    def _cut(self, low: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the tokens of lower-cased bytes; breaks: where a token cannot go on."""
        inside = self.inside[low]
        before = np.r_[False, inside[:-1]]
        before[breaks] = False
        start = np.flatnonzero(inside & ~before)
        after = np.r_[inside[1:], False]
        after[breaks[breaks > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, self.powers.ranges(self.powers.prefix(low), start, end)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, raw hash, canonical hash, whether it goes on with the slot before) of all tokens of some texts, in order."""
        rows, raws, canons, joins = [], [], [], []
        group, size = [], 0
        for i, t in enumerate(texts):
            for piece in self._pieces(t):
                group.append((i, piece))
                size += len(piece)
                if size >= PIECE:
                    self._add(group, rows, raws, canons, joins)
                    group, size = [], 0
        if group:
            self._add(group, rows, raws, canons, joins)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(raws), np.concatenate(canons), np.concatenate(joins)

    @staticmethod
    def _pieces(text: bytes):
        """The text in pieces of about PIECE bytes, cut after a line or a blank where there is one."""
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                cut = max(text.rfind(b"\n", at, end), text.rfind(b" ", at, end)) + 1
                end = cut if cut > at else end
            yield text[at:end]
            at = end

    def _add(self, group: list[tuple[int, bytes]], rows: list, raws: list, canons: list, joins: list) -> None:
        raw = b"".join(p for _, p in group)
        low = raw.decode(errors="replace").lower().encode()
        if len(low) != len(raw):
            parts = [(p, p.decode(errors="replace").lower().encode()) for _, p in group]
            low = b"".join(x if len(x) == len(p) else p.lower() for p, x in parts)
        offsets = np.cumsum([0] + [len(p) for _, p in group])
        a, b = np.frombuffer(raw, np.uint8), np.frombuffer(low, np.uint8)
        start, end, h = self._cut(b, offsets[:-1][offsets[:-1] < len(b)])
        if not len(start):
            return
        piece = np.searchsorted(offsets, start, side="right") - 1
        ends = np.r_[0, np.cumsum(self.ender[a])]
        last = np.r_[0, end[:-1]]
        first = np.r_[True, piece[1:] != piece[:-1]]
        opening = first | (ends[start] > ends[last])
        second = np.minimum(start + 1, end - 1)
        third = np.minimum(start + 2, end - 1)
        wide = a[start] >= 128
        capital = (a[start] != b[start]) | (wide & (a[second] != b[second]))
        also = np.where(wide, third, second)
        shouted = (also > start) & (a[also] != b[also])
        number = (a[start] >= 48) & (a[start] <= 57)
        canon = h.copy()
        canon[capital & ~shouted & ~opening] = NAME
        canon[number] = NUMBER
        where = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
        canon[np.r_[False, number[:-1] & ~first[1:]] & (self.units[where] == h)] = UNIT
        rows.append(np.array([i for i, _ in group])[piece])
        raws.append(h)
        canons.append(canon)
        gap = a[np.minimum(last, len(a) - 1)]
        beside = ~first & (start - last == 1)
        digits = number & np.r_[False, number[:-1]] & ((gap == 44) | (gap == 46))
        names = (canon == NAME) & np.r_[False, canon[:-1] == NAME] & (gap == 32)
        joins.append(beside & (digits | names))


class Stream:
    """Tokens to be matched: text number, key in windows, value, whether it is a slot, tokens of the text that it stands for."""

    def __init__(self, row: np.ndarray, key: np.ndarray, value: np.ndarray, slots: bool, weight: np.ndarray | None = None):
        self.row, self.key, self.value, self.literals = row, key, value, MIN_LITERALS if slots else 0
        self.slot = np.isin(key, (NUMBER, NAME, UNIT)) & slots
        self.weight = np.ones(len(row), np.int64) if weight is None else weight


def streams(row: np.ndarray, raw: np.ndarray, canon: np.ndarray, joins: np.ndarray) -> list[Stream]:
    """The canonical, the literal and the folded stream."""
    start = np.flatnonzero(~joins)
    weight = np.diff(np.r_[start, len(row)])
    place = np.arange(len(row)) - np.repeat(start, weight)
    value = np.add.reduceat(np.where(place > 0, mixed(raw + place.astype(np.uint64)), raw), start) if len(start) else raw
    return [Stream(row, canon, raw, True), Stream(row, raw, raw, False), Stream(row[start], canon[start], value, True, weight)]


def _window_hashes(canon: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(canon) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + canon[k : k + len(out)]
    return mixed(out)


def windows(of: Stream, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of n tokens within one text that have enough literal tokens."""
    row = of.row
    if len(row) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    literal = np.r_[0, np.cumsum(~of.slot)]
    ok = (row[: len(row) - n + 1] == row[n - 1 :]) & (literal[n:] - literal[:-n] >= min(n, of.literals))
    at = np.flatnonzero(ok)
    return at, _window_hashes(of.key, n)[at]


def item_windows(of: Stream, size: np.ndarray, loose: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By their length: windows that stand for items, which have size tokens of the stream each."""
    out = {}
    for n in range(MIN_TOKENS, WINDOW + 1):
        at, h = windows(of, n)
        mine = size[of.row[at]]
        short = loose & (mine >= WINDOW) & (mine < SHORT)
        keep = np.where(short, n == MIN_TOKENS, (mine == n) | ((n == WINDOW) & (mine > n)))
        if keep.any():
            out[n] = at[keep], h[keep]
    return out


def _first_of(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


class Benchmark:
    """Windows and tokens of benchmark items, ready to be met by documents."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        row, *rest = Tokens().of([t for _, t in items])
        self.size = np.diff(_first_of(row, len(items)))
        self.streams = streams(row, *rest)
        self.tables = []
        for k, of in enumerate(self.streams):
            held = {}
            for n, (at, h) in item_windows(of, np.diff(_first_of(of.row, len(items))), k > 0).items():
                order = np.argsort(h, kind="stable")
                bits = np.zeros(1 << 20, dtype=bool)
                bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                held[n] = (h[order], at[order], of.row[at[order]], bits)
            self.tables.append(held)

    def hits(self, k: int, of: Stream) -> dict[int, list[tuple[int, int, int, int]]]:
        """By text number, in stream k: (item number, token in the text, token in the item, window size), counted from their starts in the arrays."""
        out: dict[int, list] = {}
        for n, (h, at, item, bits) in self.tables[k].items():
            pos, found = windows(of, n)
            maybe = np.flatnonzero(bits[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(h, found[maybe], "left"), np.searchsorted(h, found[maybe], "right")
            for m, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for j in range(a, b):
                    out.setdefault(int(of.row[pos[m]]), []).append((int(item[j]), int(pos[m]), int(at[j]), n))
        return out


def _verdict(size: int, pairs: np.ndarray) -> tuple[int, int] | None:
    """(covered tokens, slots) if the hits of one diagonal are enough and consistent.

    pairs: (item token, raw hash in the item, raw hash in the text, is a placeholder) of all covered tokens.
    """
    covered = np.unique(pairs["at"])
    if len(covered) < min(NEED_TOKENS, int(np.ceil(NEED_SHARE * size))):
        return None
    slots = np.unique(pairs[pairs["slot"]][["item", "text"]])
    if len(np.unique(slots["item"])) != len(slots) or len(np.unique(slots["text"])) != len(slots):
        return None
    return len(covered), int(pairs["slot"].sum() and len(np.unique(pairs["at"][pairs["slot"]])))


PAIR = np.dtype([("at", "<i8"), ("item", "<u8"), ("text", "<u8"), ("slot", "?")])


def judge(hits: list[tuple[int, int, int, int]], raw: np.ndarray, bench: Benchmark) -> tuple[dict[int, tuple[int, int]], set[int]]:
    """By item number: (covered tokens, slots) of the items that contaminate a text, by its hits in the canonical stream; items with enough hits that are all inconsistent."""
    of = bench.streams[0]
    lines: dict[tuple[int, int], list] = {}
    for item, p, q, n in hits:
        lines.setdefault((item, p - q), []).append((q, n))
    best: dict[int, tuple[int, int]] = {}
    refused = set()
    for (item, shift), found in lines.items():
        at = np.unique(np.concatenate([np.arange(q, q + n) for q, n in found]))
        pairs = np.zeros(len(at), dtype=PAIR)
        pairs["at"], pairs["item"], pairs["text"], pairs["slot"] = at, of.value[at], raw[at + shift], of.slot[at]
        if got := _verdict(int(bench.size[item]), pairs):
            best[item] = max(best.get(item, (0, 0)), got)
        elif len(at) >= min(NEED_TOKENS, int(np.ceil(NEED_SHARE * bench.size[item]))):
            refused.add(item)
    return best, refused - set(best)


def judge_loosely(hits: list[tuple[int, int, int, int]], value: np.ndarray, bench: Benchmark, k: int) -> dict[int, tuple[int, int]]:
    """The same in stream k, with diagonals of an item within DRIFT tokens added up; of two for one token the longer one counts."""
    of = bench.streams[k]
    lines: dict[int, dict[int, set[int]]] = {}
    for item, p, q, n in hits:
        lines.setdefault(item, {}).setdefault(p - q, set()).update(range(q, q + n))
    best: dict[int, tuple[int, int]] = {}
    for item, found in lines.items():
        size = int(bench.size[item])
        need = min(NEED_TOKENS, int(np.ceil(NEED_SHARE * size)))
        need = max(need, WINDOW) if size >= WINDOW else need
        shifts = sorted(found)
        end = last = 0
        for i, shift in enumerate(shifts):
            while end < len(shifts) and shifts[end] <= shift + DRIFT:
                end += 1
            if i and end == last:
                continue  # a part of the group before
            last, cover = end, {}
            for d in sorted(shifts[i:end], key=lambda d: (-len(found[d]), d)):
                for q in found[d]:
                    cover.setdefault(q, d)
            at = np.array(sorted(cover))
            total, slot = int(of.weight[at].sum()), of.slot[at]
            if total < need:
                continue
            there = at + np.array([cover[q] for q in at.tolist()])
            slots = set(zip(of.value[at[slot]].tolist(), value[there[slot]].tolist(), strict=True))
            if len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}):
                best[item] = max(best.get(item, (0, 0)), (total, int(of.weight[at[slot]].sum())))
    return best


def _matcher(bench: Benchmark):
    tokens = Tokens()

    def match(texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        out: dict[int, dict[int, tuple[int, int]]] = {}
        refused: dict[int, set[int]] = {}
        for k, of in enumerate(streams(*tokens.of(texts))):
            for i, hits in bench.hits(k, of).items():
                if k == 0:
                    out[i], refused[i] = judge(hits, of.value, bench)
                    continue
                known, bad = out.setdefault(i, {}), refused.get(i, ())
                found = judge_loosely([x for x in hits if x[0] not in known], of.value, bench, k)
                known |= {m: got for m, got in found.items() if m not in bad or k == 1 and got[0] >= NEED_TOKENS}
        return {i: [(m, *got[m]) for m in sorted(got)] for i, got in out.items() if got}

    return match


def _bytes(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


STEP = 256


def _small(items: DataFrame) -> Benchmark | None:
    """The benchmark, if its size allows to send it to every task."""
    if not fits(items, MAX_BROADCAST_ITEMS) or (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > 6 * MAX_BROADCAST_TOKENS:
        return None
    rows = items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").collect()
    return Benchmark([(r[0], r[1].encode()) for r in rows])


MATCH = "doc_id long, item_id long, n_tokens int, coverage double, n_slots int"


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_tokens, coverage, n_slots) of every document and item that contaminates it."""
    bench = _small(items)
    if bench is None:
        return _by_shuffle(docs, items)

    def make():
        match = _matcher(bench)

        def run(batch: pa.RecordBatch) -> dict:
            ids, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
            out = []
            for i in range(0, len(ids), STEP):
                for k, got in sorted(match(texts[i : i + STEP]).items()):
                    out += [(ids[i + k], bench.ids[m], n, n / int(bench.size[m]), s) for m, n, s in got]
            return dict(zip(("doc_id", "item_id", "n_tokens", "coverage", "n_slots"), map(list, zip(*out, strict=True)), strict=True)) if out else None

        return run

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, MATCH)


def _window_rows(df: DataFrame, th: str, of_items: bool) -> DataFrame:
    """(th, w) of the distinct texts of df (th, text): hashes of their windows, in all streams."""

    def make():
        tokens = Tokens()

        def run(batch: pa.RecordBatch) -> dict:
            ths, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
            out = [set() for _ in ths]
            for k, of in enumerate(streams(*tokens.of(texts))):
                found = item_windows(of, np.diff(_first_of(of.row, len(texts))), k > 0) if of_items else {n: windows(of, n) for n in range(MIN_TOKENS, WINDOW + 1)}
                for n, (at, h) in found.items():
                    for i, x in zip(of.row[at].tolist(), mixed(h + np.uint64(16 * k + n)).view(np.int64).tolist(), strict=True):
                        out[i].add(x)
            return {"th": ths, "w": [sorted(x) for x in out]}

        return run

    return map_rows(df, make, "th long, w array<long>").select(F.col("th").alias(th), F.explode("w").alias("w"))


def _texts(df: DataFrame, th: str, text: str) -> DataFrame:
    """(th, text) of the distinct texts."""
    return df.where("text is not null").select(F.xxhash64(F.col("text").cast("string")).alias(th), F.col("text").cast("string").alias(text)).dropDuplicates([th])


def _verdicts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(dth, ith, n_tokens, coverage, n_slots) of distinct texts, for a benchmark of any size: pairs with a common window, judged each."""
    d, b = _texts(docs, "dth", "dtext"), _texts(items, "ith", "itext")
    pairs = _window_rows(d, "dth", False).join(_window_rows(b, "ith", True), "w").select("dth", "ith").distinct()

    def make():
        def run(batch: pa.RecordBatch) -> dict | None:
            out = []
            dths, iths, dtexts, itexts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), _bytes(batch.column(3))
            for at in range(0, len(dths), STEP):
                cut = slice(at, at + STEP)
                asked, texts, known = set(zip(dths[cut], iths[cut], strict=True)), dict(zip(dths[cut], dtexts[cut], strict=True)), dict(zip(iths[cut], itexts[cut], strict=True))
                bench, names = Benchmark(list(known.items())), list(texts)
                for i, got in _matcher(bench)(list(texts.values())).items():
                    out += [(names[i], bench.ids[m], n, n / int(bench.size[m]), s) for m, n, s in got if (names[i], bench.ids[m]) in asked]
            return dict(zip(("dth", "ith", "n_tokens", "coverage", "n_slots"), map(list, zip(*out, strict=True)), strict=True)) if out else None

        return run

    met = pairs.join(d, "dth").join(b, "ith").select("dth", "ith", "dtext", "itext")
    return map_rows(met, make, "dth long, ith long, n_tokens int, coverage double, n_slots int")


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same result for a benchmark of any size; a verdict holds for every row of its texts, whatever the ids."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("dth"))
    b = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("ith"))
    return _verdicts(docs, items).join(b, "ith").join(d, "dth").select("doc_id", "item_id", "n_tokens", "coverage", "n_slots")


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates; columns unchanged."""
    bench = _small(items)
    if bench is None:
        th = fresh(docs, "__th")
        bad = _verdicts(docs, items).select(F.col("dth").alias(th)).distinct()
        return docs.withColumn(th, F.xxhash64(F.col("text").cast("string"))).join(bad, th, "left_anti").select(*docs.columns)
    at = docs.columns.index("text")

    def run(batches):
        match = _matcher(bench)
        for b in batches:
            texts, keep = _bytes(b.column(at)), np.ones(b.num_rows, dtype=bool)
            for i in range(0, len(texts), STEP):
                for k in match(texts[i : i + STEP]):
                    keep[i + k] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the contaminations of all documents by all benchmark items."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
