"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled into three transducers. The normaliser rewrites the longest source string of its map at every
position, writes blanks as U+2581 and puts one in front. The pieces are arcs from a string of characters to a piece.
The byte fallback is an arc from a character without a piece to its bytes. Their composition with a text is a
lattice over the positions of the text; the encoding is its shortest path in the tropical semiring (weights add along
a path, the least total wins), found from left to right.

* In a unigram model a piece weighs its negated score, a fallback arc PENALTY more than the worst piece. Totals are doubles, so
  segmentations that tie there go to the one with the longest last piece.
* In a byte-pair model the states are (position, last piece), and the arc from piece a to piece b weighs zero if
  merging the characters of a b by rank leaves exactly a b, and is infinite otherwise. One path of finite weight
  leads to every position, and it is the sequence that the merges give.

Where pieces do not cross blanks (which is checked when a model is compiled), the path of a text is the
concatenation of the paths of its words: words are looked up in a bounded memo, and the paths of unknown words
are found together, position by position, over arrays. Words of more than WIDE characters are walked alone, in time
linear in their length. Byte-pair models whose ranks tie other than among runs of blanks, or rank such runs
above other pieces, have no such weights; they are merged directly.

Decoding concatenates pieces and bytes and drops the blank in front. Under the identity normaliser a text comes
back unchanged unless it contains U+2581, which the model reads as a blank; lone surrogates cannot occur in Spark
strings. Null texts have null ids, empty ones an empty list; texts of any length are encoded whole; repeated rows
repeat their result; an empty table gives an empty one; columns to keep may not be called as the results
(ValueError). Models without byte fallback, or with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, per_process, table

BLANK = "▁"
WIDE = 48
MEMO = 400_000
GROUP_CHARS = 1 << 20
CHUNK = 4096
PENALTY = 10.0
PRIME = np.uint64(0x100000001B3)
NOWHERE, BARRIER = -1, -2


def rewrite_rules(charsmap: bytes) -> dict[str, str]:
    """Source and target strings of a precompiled map: a double-array trie over bytes, then the targets."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, targets = np.frombuffer(charsmap[4 : 4 + size], "<u4"), charsmap[4 + size :]
    label, bytes_ = units & np.uint32(0x800000FF), np.arange(1, 256)
    rules, open_ = {}, [(0, b"")]
    while open_:
        node, key = open_.pop()
        unit = int(units[node])
        base = node ^ (unit >> 10 << (unit >> 9 & 1) * 8)
        if key and unit >> 8 & 1:
            at = int(units[base]) & 0x7FFFFFFF
            rules[key.decode()] = targets[at : targets.index(b"\0", at)].decode()
        child = base ^ bytes_
        found = bytes_[(label[np.minimum(child, len(units) - 1)] == bytes_) & (child < len(units))]
        open_ += [(base ^ b, key + bytes([b])) for b in found.tolist()]
    return rules


class Normaliser:
    """The first transducer: the longest rule at every position, blanks as U+2581, one in front."""

    def __init__(self, rules: dict[str, str], prefix: bool, squeeze: bool):
        self.rules, self.prefix, self.squeeze = rules, prefix, squeeze
        self.longest: dict[str, int] = {}
        for source in rules:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))
        self.starts = re.compile("[" + re.escape("".join(sorted(self.longest))) + "]") if rules else None

    def _rewritten(self, text: str) -> str:
        out, at, hit = [], 0, self.starts.search(text)
        while hit:
            i = hit.start()
            out.append(text[at:i])
            for n in range(self.longest[text[i]], 0, -1):
                if (target := self.rules.get(text[i : i + n])) is not None and i + n <= len(text):
                    out.append(target)
                    at = i + n
                    break
            else:
                out.append(text[i])
                at = i + 1
            hit = self.starts.search(text, at)
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.starts:
            text = self._rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK)


def compile_model(path: str | None = None) -> dict:
    """The transducers as plain arrays; path defaults to the installed public model."""
    import public_tokenizers as P
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = path or P.path("piece_bpe_32k.model")
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal, train = proto.normalizer_spec, proto.trainer_spec
    kinds = {p.type for p in proto.pieces}
    if train.model_type not in (1, 2) or not train.byte_fallback or train.treat_whitespace_as_suffix or not normal.escape_whitespaces or kinds & {pb.ModelProto.SentencePiece.USER_DEFINED, pb.ModelProto.SentencePiece.UNUSED}:
        raise NotImplementedError("unigram and byte-pair models with byte fallback and without user-defined or unused pieces are supported")
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    ids = range(sp.get_piece_size())
    pieces = {sp.id_to_piece(i): i for i in ids if proto.pieces[i].type == pb.ModelProto.SentencePiece.NORMAL}
    score = {p: sp.get_score(i) for p, i in pieces.items()}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    surfaces = [b""] * len(ids)
    for p, i in pieces.items():
        surfaces[i] = p.replace(BLANK, " ").encode()
    for b, i in enumerate(byte_ids):
        surfaces[i] = bytes([b])
    pairs = train.model_type == 2
    long = [p for p in pieces if len(p) > 1]
    runs = {score[p] for p in long if not p.strip(BLANK)}
    words = [score[p] for p in long if p.strip(BLANK)]
    # pieces that begin a word, or are inside one, or are blanks
    apart = not any(BLANK in p.lstrip(BLANK) or p.startswith(2 * BLANK) and p.strip(BLANK) for p in pieces)
    ranked = pairs and apart and len(words) == len(set(words)) and (not runs or not words or max(runs) < min(words))
    rules = rewrite_rules(normal.precompiled_charsmap)
    return {"score": score, "ids": pieces, "bytes": byte_ids, "surfaces": surfaces, "pairs": pairs, "apart": apart, "ranked": ranked, "rules": rules, "prefix": normal.add_dummy_prefix, "squeeze": normal.remove_extra_whitespaces, "key": hashlib.sha256(proto.SerializeToString()).hexdigest()}


def merge(chars: str, score: dict[str, float], last: list | None = None) -> list[str]:
    """Byte-pair merges of a string, best score first, leftmost of equal ones; last gets the final pair merged."""
    s = list(chars)
    while True:
        best = max(((score[a + b], -k) for k, (a, b) in enumerate(pairwise(s)) if a + b in score), default=None)
        if best is None:
            return s
        k = -best[1]
        if last is not None:
            last[:] = s[k : k + 2]
        s[k : k + 2] = [s[k] + s[k + 1]]


class Transducer:
    """Encoder and decoder of a compiled model."""

    def __init__(self, model: dict):
        self.model, self.score = model, model["score"]
        self.normalise = Normaliser(model["rules"], model["prefix"], model["squeeze"])
        chars = sorted(p for p in self.score if len(p) == 1)
        if model["ranked"]:
            order = self._ranks(chars)
        else:
            order = sorted(self.score)
            self.number = {p: k for k, p in enumerate(order)}
        n = self.n = len(order)
        #: weight of every piece in a unigram model, and of a fallback arc
        self.weight = np.array([-self.score[p] for p in order])
        self.fallback = PENALTY - min(self.score.values(), default=0.0)
        self.longest = max(map(len, order), default=1)
        hashes = np.array([self._hash(p) for p in order], dtype=np.uint64)
        by = np.argsort(hashes)
        self.piece_hash, self.piece_of = hashes[by], by
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self._low(hashes)] = True
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, PRIME)], dtype=np.uint64)
        self.out = np.array([model["ids"][p] for p in order], dtype="<i4")
        self.out_bytes = [self.out[k : k + 1].tobytes() for k in range(n)]
        self.known = set(chars)
        self.codes = np.sort(np.array([ord(c) + 1 for c in self.known], dtype=np.uint64))
        self.lines = not any("\n" in p for p in self.score)
        self.byte_out = np.array(model["bytes"], dtype="<i4")
        self.memo_key = np.full(1 << 20, -1, dtype=np.int64)
        self.memo_ok = np.zeros(1 << 20, dtype=bool)
        self.words: dict[str, bytes] = {}

    def _ranks(self, chars: list[str]) -> list[str]:
        """Pieces of a byte-pair model by rank, with the pairs that they are merged from."""
        split = {}
        for p in self.score:
            if len(p) > 1:
                pair: list[str] = []
                if merge(p, self.score, pair) == [p]:
                    split[p] = pair
        order = [*chars, *sorted(split, key=lambda p: (-self.score[p], p))]
        self.number = {p: k for k, p in enumerate(order)}
        n = len(order)
        self.left = np.array([*range(len(chars)), *(self.number[split[p][0]] for p in order[len(chars) :])])
        self.right = np.array([*range(len(chars)), *(self.number[split[p][1]] for p in order[len(chars) :])])
        keys = self.left[len(chars) :] * n + self.right[len(chars) :]
        by = np.argsort(keys)
        self.pair_key, self.pair_to = keys[by], np.arange(len(chars), n)[by]
        self.pair_bits = np.zeros(1 << 20, dtype=bool)
        self.pair_bits[self._slot(self.pair_key)] = True
        return order

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(PRIME) + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    @classmethod
    def _slot(cls, key: np.ndarray) -> np.ndarray:
        return cls._low(key.astype(np.uint64))

    def _merged(self, key: np.ndarray) -> np.ndarray:
        """The piece that a pair merges to, or n."""
        out = np.full(len(key), self.n)
        at = np.flatnonzero(self.pair_bits[self._slot(key)])
        where = np.minimum(np.searchsorted(self.pair_key, key[at]), len(self.pair_key) - 1)
        hit = self.pair_key[where] == key[at]
        out[at[hit]] = self.pair_to[where[hit]]
        return out

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where the arc from piece a to piece b has weight zero: no merge crosses their boundary."""
        ok = np.ones(len(a), dtype=bool)
        live, limit = np.arange(len(a)), np.full(len(a), self.n)
        while len(live):
            cross = self._merged(a * self.n + b) < limit
            ok[live[cross]] = False
            a, b, limit, live = a[~cross], b[~cross], limit[~cross], live[~cross]
            later = a > b
            first_a, first_b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
            stuck = (first_a == a) & (first_b == b)
            new_limit = np.where(later, a, b + 1)
            second_a, second_b = np.where(later, first_a, self.right[a]), np.where(later, self.left[b], first_b)
            end = stuck & (second_a == a) & (second_b == b)
            limit = np.where(stuck, np.where(later, b + 1, a), new_limit)
            a, b = np.where(stuck, second_a, first_a), np.where(stuck, second_b, first_b)
            a, b, limit, live = a[~end], b[~end], limit[~end], live[~end]
        return ok

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_allowed() behind a direct-mapped memo."""
        key = a * self.n + b
        slot = self._slot(key)
        hit = self.memo_key[slot] == key
        out = self.memo_ok[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = self._allowed(fresh // self.n, fresh % self.n)
            out[miss] = ok[back]
            slot = self._slot(fresh)
            self.memo_key[slot], self.memo_ok[slot] = fresh, ok
        return out

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, or NOWHERE."""
        out = np.full(len(h), NOWHERE)
        at = np.flatnonzero(self.bits[self._low(h)])
        where = np.minimum(np.searchsorted(self.piece_hash, h[at]), len(self.piece_hash) - 1)
        hit = self.piece_hash[where] == h[at]
        out[at[hit]] = self.piece_of[where[hit]]
        return out

    def _paths(self, words: list[str]) -> list[bytes]:
        """Shortest paths of many short words at once; the words are ordered by length."""
        size = np.array([len(w) for w in words])
        top, n = int(size.max()), len(words)
        chars = np.zeros((n, top), dtype=np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        rows = np.repeat(np.arange(n), size)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        chars[rows, cols] = flat + np.uint64(1)
        prefix = np.zeros((n, top + 1), dtype=np.uint64)
        for i in range(top):
            prefix[:, i + 1] = prefix[:, i] * PRIME + chars[:, i]
        state = np.full((n, top + 1), NOWHERE)
        length = np.zeros((n, top + 1), dtype=np.int64)
        cost = np.full((n, top + 1), np.inf)
        state[:, 0], cost[:, 0] = BARRIER, 0.0
        for i in range(1, top + 1):
            lo, m = int(np.searchsorted(size, i)), min(self.longest, i)
            h = prefix[lo:, i, None] - prefix[lo:, i - m : i][:, ::-1] * self.powers[1 : m + 1]
            piece = self._pieces(h.ravel())
            at = np.flatnonzero(piece >= 0)
            r, c, q = at // m, at % m, piece[at]
            total = cost[lo + r, i - 1 - c] + self._arcs(state[lo + r, i - 1 - c], q)
            # the least total of every row; of equal ones the longest piece
            order = np.lexsort((-c, total, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]][: len(order)]]
            first = first[np.isfinite(total[first])]
            state[lo + r[first], i], length[lo + r[first], i], cost[lo + r[first], i] = q[first], c[first] + 1, total[first]
            lone = lo + np.flatnonzero(~np.isin(chars[lo:, i - 1], self.codes))
            spelled = cost[lone, i - 1] + (0.0 if self.model["pairs"] else self.fallback)
            lone, spelled = lone[spelled < cost[lone, i]], spelled[spelled < cost[lone, i]]
            state[lone, i], length[lone, i], cost[lone, i] = BARRIER, 1, spelled
        # back from the ends of all words at once; words with bytes in their path are walked alone
        at, step, who, piece = size.copy(), [], [], []
        plain = ~((state[:, 1:] < 0) & (np.arange(1, top + 1)[None, :] <= size[:, None])).any(axis=1)
        slow = np.flatnonzero(~plain)
        live = np.flatnonzero(plain)
        while len(live):
            who.append(live)
            step.append(np.full(len(live), len(step)))
            piece.append(state[live, at[live]])
            at[live] -= length[live, at[live]]
            live = live[at[live] > 0]
        ids = np.zeros(0, dtype="<i4")
        if who:
            who, step, piece = np.concatenate(who), np.concatenate(step), np.concatenate(piece)
            order = np.lexsort((-step, who))
            who, ids = who[order], self.out[piece[order]]
        ends = np.searchsorted(who, np.arange(n + 1)) * 4 if len(ids) else np.zeros(n + 1, dtype=np.int64)
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in slow.tolist():
            w = words[k]
            i, path, st, ln = len(w), [], state[k], length[k]
            while i > 0:
                s = int(st[i])
                path.append(self.out_bytes[s] if s >= 0 else self._as_bytes(w[i - 1]))
                i -= int(ln[i]) if s != NOWHERE else 1
            out[k] = b"".join(reversed(path))
        return out

    def _arcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weights of the arcs from states a to pieces b."""
        if not self.model["pairs"]:
            return self.weight[b]
        out = np.where(a == BARRIER, 0.0, np.inf)
        inner = np.flatnonzero(a >= 0)
        out[inner] = np.where(self.allowed(a[inner], b[inner]), 0.0, np.inf)
        return out

    def _as_bytes(self, char: str) -> bytes:
        return self.byte_out[list(char.encode())].tobytes()

    def _walk(self, word: str) -> bytes:
        """Shortest path of one string of any length."""
        state, back, cost, number = [BARRIER], [0], [0.0], self.number
        pairs, memo, inf = self.model["pairs"], {}, float("inf")
        for i in range(1, len(word) + 1):
            found, size, best = NOWHERE, 1, inf
            for k in range(min(self.longest, i), 0, -1):
                q = number.get(word[i - k : i])
                if q is None or cost[i - k] == inf:
                    continue
                if pairs:
                    p = state[i - k]
                    key = p * self.n + q
                    if p != BARRIER and key not in memo:
                        memo[key] = bool(self.allowed(np.array([p]), np.array([q]))[0])
                    total = cost[i - k] if p == BARRIER or memo[key] else inf
                else:
                    total = cost[i - k] + float(self.weight[q])
                if total < best:
                    found, size, best = q, k, total
                    if pairs:
                        break
            if word[i - 1] not in self.known:
                total = cost[i - 1] + (0.0 if pairs else self.fallback)
                if total < best:
                    found, size, best = BARRIER, 1, total
            state.append(found)
            back.append(size)
            cost.append(best)
        path, i = [], len(word)
        while i:
            path.append(self.out_bytes[state[i]] if state[i] >= 0 else self._as_bytes(word[i - 1]))
            i -= back[i]
        return b"".join(reversed(path))

    def _direct(self, word: str) -> bytes:
        """A word that starts with a run of blanks."""
        run = len(word) - len(word.lstrip(BLANK))
        if not self.model["pairs"]:
            return self._walk(word)
        if run > 64 or len(word) - run > WIDE:
            return self._blanks(word, run)
        return b"".join(self._emit(p) for p in merge(word, self.score))

    def _blanks(self, word: str, run: int) -> bytes:
        """Long runs: blanks merge among themselves in a deterministic way, the last one may belong to the word."""
        tail = self._walk(word[run - 1 :]) if len(word) > run else b""
        alone = self.out_bytes[self.number[BLANK]]
        if len(word) > run and not tail.startswith(alone):
            return self._run(run - 1) + tail
        return self._run(run) + tail[len(alone) :]

    def _run(self, n: int) -> bytes:
        s = [BLANK] * n
        while True:
            best = max({(self.score[a + b], a + b) for a, b in set(pairwise(s)) if a + b in self.score}, default=None)
            if best is None:
                return b"".join(self._emit(p) for p in s)
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] + s[i + 1] == best[1]:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out

    def _emit(self, piece: str) -> bytes:
        i = self.model["ids"].get(piece)
        return np.array([i], dtype="<i4").tobytes() if i is not None else self._as_bytes(piece)

    def _learn(self, words: set[str]) -> None:
        """Paths of words into the memo."""
        fresh = sorted((w for w in words if w not in self.words), key=len)
        for i in range(0, len(fresh), CHUNK):
            part = fresh[i : i + CHUNK]
            short = [w for w in part if len(w) <= WIDE]
            if short:
                self.words.update(zip(short, self._paths(short), strict=True))
            for w in part[len(short) :]:
                self.words[w] = self._walk(w)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of every text as little-endian 32-bit integers."""
        out: list[bytes | None] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= GROUP_CHARS):
                size += len(texts[end] or "")
                end += 1
            out += self._encode_group(texts[at:end])
            at = end
        return out

    def _encode_group(self, texts: list[str | None]) -> list[bytes | None]:
        plain = [self.normalise(t) if t else "" for t in texts]
        if not self.model["apart"] or self.model["pairs"] and not self.model["ranked"]:
            whole = self._merged_whole if self.model["pairs"] else self._walk
            return [None if t is None else whole(s) for t, s in zip(texts, plain, strict=True)]
        # words begin at blanks; no piece holds a line break, so lines are apart as well
        cut = [[line.split(BLANK) for line in s.split("\n")] if self.lines else [s.split(BLANK)] for s in plain]
        if len(self.words) > MEMO:
            self.words = {}
        wanted: set[str] = set()
        for lines in cut:
            for parts in lines:
                wanted.add(parts[0])
                wanted.update(BLANK + w for w in parts[1:])
        self._learn(wanted - {""})
        newline, out, get = self._as_bytes("\n"), [], self.words.__getitem__
        for t, lines in zip(texts, cut, strict=True):
            if t is None:
                out.append(None)
                continue
            got = []
            for parts in lines:
                got.append(newline)
                if parts[0]:
                    got.append(get(parts[0]))
                if "" in parts[1:]:
                    run = 0
                    for w in parts[1:]:
                        run += 1
                        if w:
                            got.append(get(BLANK + w) if run == 1 else self._direct(BLANK * run + w))
                            run = 0
                    if run:
                        got.append(self._direct(BLANK * run))
                else:
                    got.extend([get(BLANK + w) for w in parts[1:]])
            out.append(b"".join(got[1:]))
        return out

    def _merged_whole(self, text: str) -> bytes:
        return b"".join(self._emit(p) for p in merge(text, self.score))

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids, without the blank in front; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.model["surfaces"].__getitem__, ids)).decode(errors="replace")
        if self.model["squeeze"]:
            return text.lstrip(" ")
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text


def transducer(model: dict) -> Transducer:
    """The transducer of a model, one for each process: later tasks of a worker find it, and the words it has seen."""
    return per_process(f"sentencepiece:{model['key']}", lambda: Transducer(model))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns in keep and ids, the encoding of text, with n_tokens and round_trip (decoding gives the text back)."""
    if clash := {c.lower() for c in keep} & {"ids", "n_tokens", "round_trip"}:
        raise ValueError(f"columns of the results cannot be kept: {sorted(clash)}")
    model = compile_model(path)
    wanted = docs.select(*keep, F.col("text").cast("string").alias("text"))
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    schema = StructType([*wanted.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])

    def run(batches):
        fst = transducer(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                coded = fst.encode(texts)
                ids = [None if c is None else np.frombuffer(c, "<i4") for c in coded]
                same = [None if c is None else fst.decode(x.tolist()) == t for c, x, t in zip(coded, ids, texts, strict=True)]
                columns = [*part.columns[:-1], pa.array(ids, type=pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], type=pa.int64()), pa.array(same, type=pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "ids", "n_tokens", "round_trip"])

    return wanted.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids."""
    model = compile_model(path)

    def make():
        fst = transducer(model)
        return lambda b: {"doc_id": b.column(0), "text": [None if x is None else fst.decode(x) for x in b.column(1).to_pylist()]}

    return map_rows(coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), text_sha256 (of the decoded text), round_trip; null text: no tokens."""
    docs = table(spark, sf_dir, "documents")
    model = compile_model()

    def make():
        fst = transducer(model)

        def run(b: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("doc_id", "n_tokens", "ids_sha256", "text_sha256", "round_trip")}
            for i in range(0, b.num_rows, 512):
                texts = b.column(1).slice(i, 512).to_pylist()
                for t, c in zip(texts, fst.encode([t or "" for t in texts]), strict=True):
                    back = fst.decode(np.frombuffer(c, "<i4").tolist())
                    out["n_tokens"].append(len(c) // 4)
                    out["ids_sha256"].append(hashlib.sha256(c).hexdigest())
                    out["text_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                    out["round_trip"].append(back == (t or ""))
            return out | {"doc_id": b.column(0)}

        return run

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean")
