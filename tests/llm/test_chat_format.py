import hashlib

from tests.llm.fixtures import SMALL, rows_of, small
from vectorloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, ids string, first string, chars string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len(C.escape(r)) + len(C.escape(x)) + len("<|turn|><|body|><|end|>") for _, r, x in turns) + len("<|bos|><|eos|>")
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), size))
    return sorted(out, key=repr)


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in small(spark, "conversations").collect()]
    said = "</s>[INST] ok [/INST]"
    assert rows_of(C.query(spark, SMALL)) == plain(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", "b <|end|> \\ \\<|turn|> [INST"), (1, 1, "user", None), (1, 3, None, ""), (2, None, "assistant", "\U0001f600 日本 é\n\n"), (2, 5, "<|body|>", "role with a control string"), (None, 1, "assistant", "no id"), (3, 1, "assistant", "word " * 20_000)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert rows_of(C.read_back(C.format_conversations(table))) == plain(rows)
    assert C.read_back(C.format_conversations(table.where("false"))).collect() == []


def test_ties_are_ordered_by_role(spark):
    rows = [(1, 1, "user", "u"), (1, 1, "assistant", "a")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert rows_of(C.read_back(C.format_conversations(table))) == plain(rows)


def test_masks_and_marks(spark):
    table = spark.createDataFrame([(1, 1, "user", "hi <|end|>", "", "", ""), (1, 2, "assistant", "</s> ok", "", "", "")], SCHEMA)
    out = C.format_conversations(table).orderBy("offset").collect()
    enc = C.encoder()
    assert [r.offset for r in out] == [0, len(out[0].ids)]
    assert out[0].loss_from == out[0].loss_to == 0
    assert C.unescape(enc.decode(out[1].ids[out[1].loss_from : out[1].loss_to])) == "</s> ok"
    marks = [i for r in out for i in r.ids if i > C.BASE]
    assert marks == [C.BOS, C.TURN, C.BODY, C.END, C.TURN, C.BODY, C.END, C.EOS]


def test_escape_is_reversible():
    for text in ["", "\\", "<|bos|>", "<\\|bos|>", "\\\\<s></s>", "[INST][/INST]<<SYS>>", "<<|end|>"]:
        assert C.unescape(C.escape(text)) == text
        assert not any(c in C.escape(text) for c in C.CONTROLS)


def test_conversations_over_many_batches(spark, monkeypatch):
    """Offsets, first and last turns go on over the pieces that a task works on."""
    monkeypatch.setattr(C, "STEP", 3)
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} " * (1 + t % 3)) for c in range(4) for t in range(1 + 5 * c)]
    rows += rows[-2:]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    formatted = C.format_conversations(table)
    assert rows_of(C.read_back(formatted)) == plain(rows)
    for c in range(4):
        at = 0
        for r in formatted.where(f"conv_id = {c}").orderBy("offset").collect():
            assert r.offset == at
            at += len(r.ids)
