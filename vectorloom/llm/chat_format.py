"""Chat formatting by token-level assembly.

Every turn becomes the segments [TURN] role [BODY] text [END]; role and text are encoded separately by a
byte-level vocabulary and the marks are reserved ids above it, so no content can ever produce a mark. A
conversation is [BOS] turns [EOS]. Offsets and loss-mask ranges are prefix sums of segment lengths. Control
strings that occur inside role or text are escaped reversibly: a backslash is doubled and a control string
gets one after its first character.

Rows are ordered by turn (null first), ties by role and then by text. A null text or role is the empty string, a null
conv_id is a conversation of its own; repeated rows are turns like others; other columns are not read; an empty table
gives an empty result. Texts are shuffled, not their ids. Conversations stream through the task that owns them, one
batch at a time, so one of any length needs bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import per_process, table

BASE = 50_256
BOS, TURN, BODY, END, EOS = range(BASE + 1, BASE + 6)
MARKS = {BOS: "<|bos|>", TURN: "<|turn|>", BODY: "<|body|>", END: "<|end|>", EOS: "<|eos|>"}
CONTROLS = [*MARKS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
FIND = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
STEP = 1024
UNDO = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Text without control strings; unescape() gives the original back."""
    return FIND.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return UNDO.sub(r"\1", text)


def encoder(path: str | None = None):
    """The byte-level vocabulary, read once a process; path defaults to the installed public tokenizer files."""
    return per_process(f"byte vocabulary {path or ''}", lambda: _encoder(path))


def _encoder(path: str | None):
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("segments", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Assembler:
    """Segments of turns as ids, with reserved ids spliced around them."""

    def __init__(self, path: str | None = None):
        self.enc = encoder(path)
        self.roles: dict[str, list[int]] = {}
        self.around = len(MARKS[TURN]) + len(MARKS[BODY]) + len(MARKS[END])

    def _role(self, escaped: str) -> list[int]:
        if escaped not in self.roles:
            if len(self.roles) > 10_000:
                self.roles = {}
            self.roles[escaped] = [TURN, *self.enc.encode_ordinary(escaped), BODY]
        return self.roles[escaped]

    def turns(self, roles: list[str | None], texts: list[str | None]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids, number of ids in front of the text, and rendered length of every turn."""
        roles, texts = [escape(x or "") for x in roles], [escape(x or "") for x in texts]
        heads = [self._role(r) for r in roles]
        ids = [[*h, *self.enc.encode_ordinary(t), END] for h, t in zip(heads, texts, strict=True)]
        chars = np.array([len(r) + len(t) + self.around for r, t in zip(roles, texts, strict=True)], dtype=np.int64)
        return ids, np.array([len(h) for h in heads], dtype=np.int64), chars


def format_conversations(turns: DataFrame, path: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """The token stream of every conversation, one row per turn, in order within each partition.

    Columns: conv_id, turn, role, first and last (position among the conversation's turns), offset (position
    of the first id in the stream, by prefix sums), ids, loss_from and loss_to (the range of ids under the
    loss mask, empty unless the role is loss_role), chars (length of the rendered form).
    """
    wanted = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                yield batch.slice(i, STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, at, conv, begun = Assembler(path), 0, None, False
        feed = pieces(batches)
        now = next(feed, None)
        while now is not None:
            then = next(feed, None)
            convs, roles = now.column(0).to_pylist(), now.column(2).to_pylist()
            ids, body, chars = make.turns(roles, now.column(3).to_pylist())
            n = len(convs)
            first = np.array([not (begun and convs[0] == conv), *(a != b for a, b in zip(convs[1:], convs, strict=False))])
            # the last turn of a piece closes its conversation unless the next piece goes on with it
            last = np.r_[first[1:], then is None or then.column(0)[0].as_py() != convs[-1]]
            for k in np.flatnonzero(first).tolist():
                ids[k] = [BOS, *ids[k]]
            for k in np.flatnonzero(last).tolist():
                ids[k].append(EOS)
            size = np.array([len(x) for x in ids], dtype=np.int64)
            # prefix sums of segment lengths, counted from the first turn of each conversation
            total = np.cumsum(size) - size
            start = np.where(first, total, -at)[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
            offset = total - start
            lead = first.astype(np.int64)
            hit = np.array([r == loss_role for r in roles])
            ends = size - 1 - last
            yield pa.RecordBatch.from_arrays(
                [now.column(0), now.column(1), now.column(2), pa.array(first), pa.array(last), pa.array(offset), pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum())))), pa.array(np.where(hit, body + lead, 0).astype(np.int32)), pa.array(np.where(hit, ends, 0).astype(np.int32)), pa.array(chars + lead * len(MARKS[BOS]) + last * len(MARKS[EOS]))],
                schema=FORMATTED,
            )
            at, conv, begun, now = int(offset[-1] + size[-1]), convs[-1], True, then

    return ordered.mapInArrow(run, "conv_id long, turn long, role string, first boolean, last boolean, offset long, ids array<int>, loss_from int, loss_to int, chars long")


FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("chars", pa.int64())])
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of what the token streams hold; formatted must come straight from format_conversations()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = size = 0
        for batch in batches:
            out = []
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            lists = col("ids")
            flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.flatnonzero(flat > BASE)
            owner = np.searchsorted(cuts, at, side="right") - 1
            code = flat[at]
            size_of = np.bincount(owner, weights=np.array([len(MARKS[c]) for c in MARKS])[code - BASE - 1], minlength=len(lists)).astype(np.int64)
            start, body, end = (at[code == c] for c in (TURN, BODY, END))
            ids = flat.tolist()
            rows = zip(*(col(c).to_pylist() for c in ("conv_id", "first", "last", "loss_from", "loss_to")), cuts[:-1].tolist(), size_of.tolist(), start.tolist(), body.tolist(), end.tolist(), strict=True)
            for conv, first, last, a, b, base, marks, s, m, e in rows:
                if first:
                    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, said = enc.decode_bytes(ids[s + 1 : m]).decode(), enc.decode_bytes(ids[m + 1 : e]).decode()
                size += marks + len(role) + len(said)
                said = unescape(said)
                turns.update(f"{unescape(role)}\n{said}\n".encode())
                n += 1
                if a < b:
                    # usually the text itself, which has been read already
                    under = said if (base + a, base + b) == (m + 1, e) else unescape(enc.decode_bytes(ids[base + a : base + b]).decode())
                    loss.update(under.encode())
                    chars += len(under)
                if last:
                    out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})
            yield pa.RecordBatch.from_pylist(out, schema=READ)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_case(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose two texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    case = turns.sparkSession.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(case)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op7: digests of all conversations and of the control case, read back from the tokens."""
    return read_back(format_conversations(with_control_case(table(spark, sf_dir, "conversations"))))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role)) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(MARKS[TURN] + MARKS[BODY] + MARKS[END])}) + {len(MARKS[BOS] + MARKS[EOS])} AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
