import hashlib

import numpy as np
import pytest

from tests.llm.fixtures import ODD, SMALL, docs, rows_of, small
from vectorloom.llm import substring_dedup as S


def plain(rows):
    """rows: (doc_id, text), doc_ids distinct; every 100-byte string is looked up in a dictionary."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    seen, out = set(), []
    for i, text in rows:
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return rows_of(df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def test_query(spark):
    assert rows_of(S.query(spark, SMALL)) == plain([(r.doc_id, r.text) for r in small(spark).collect()])


def test_odd_rows(spark):
    rows = list({r[0]: r for r in ODD}.values())
    assert result(S.duplicate_spans(docs(spark, rows))) == plain([r[:2] for r in rows])
    assert S.duplicate_spans(docs(spark, [])).collect() == []


def test_repeated_rows_have_one_result_each(spark):
    got = result(S.duplicate_spans(docs(spark, [(1, "x" * 50), (1, "x" * 50)])))
    assert len(got) == 2 and got[0] == got[1]


@pytest.mark.parametrize("case", ["shared", "periodic", "random", "prefixes"])
def test_cases(spark, case):
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)])
    prose = lambda n: " ".join(words[rng.integers(0, len(words), n)])
    if case == "shared":
        passages = [prose(60) for _ in range(6)]
        rows = [(i, " ".join([prose(20), passages[i % 6], prose(5), passages[(i * 7) % 5][: 60 + i % 90], prose(9)])) for i in range(60)]
    elif case == "periodic":
        rows = [(i, ("ab" * 400)[: 90 + 7 * i] + prose(10)) for i in range(20)] + [(50, "z" * 1000), (51, "z" * 99), (52, "z" * 100)]
    elif case == "random":
        rows = [(i, "".join("ab"[c] for c in rng.integers(0, 2, 300))) for i in range(30)]
    else:
        base = prose(80)
        rows = [(i, base[i * 5 :] + prose(3) + base[: 400 - i * 3]) for i in range(40)]
    assert result(S.duplicate_spans(docs(spark, rows))) == plain(rows)


def test_hot_grams(spark, monkeypatch):
    """A string with more contexts than a task takes goes by the hashes of its windows."""
    monkeypatch.setattr(S, "HOT", 1)
    rng = np.random.default_rng(5)
    tail = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 80))
    core = "a very common line of text that stands in a great many documents of this table"
    rows = [(i, tail() + core + tail()[: 10 + i % 30]) for i in range(50)] + [(100 + i, tail()[:20] + (core + core) + "q") for i in range(9)]
    assert result(S.duplicate_spans(docs(spark, rows))) == plain(rows)


def test_interval_tree():
    lcp = np.array([3, 5, 5, 2, 0, 4])
    got = sorted(map(tuple, S.lcp_intervals(lcp).tolist()))
    assert got == sorted([(1, 3, 5, 3), (0, 3, 3, 2), (0, 4, 2, 0), (5, 6, 4, 0)])


def test_ranges_of_a_document_travel_together():
    rng = np.random.default_rng(8)
    rows = np.zeros(3000, dtype=S.RANGE)
    rows["d"], rows["t"], rows["s"] = rng.integers(-2, 3, 3000), rng.integers(0, 9, 3000), rng.integers(-60, 20_000, 3000)
    rows["e"] = rows["s"] + rng.integers(0, 90, 3000)
    want = {}
    for d, t, s, e in rows.tolist():
        want.setdefault((d, t), set()).update(range(s, e + 1))
    sent = S._covers(rows, 4)
    assert len(sent) == len(want) and {k for _, k, _ in sent} == {S.COVER}
    for bucket, _, blob in sent:
        got = np.frombuffer(blob, S.RANGE)
        assert (got["s"][1:] > got["e"][:-1] + 1).all() and set(got["t"] % 4) == {bucket}
        assert {x for s, e in zip(got["s"].tolist(), got["e"].tolist(), strict=True) for x in range(s, e + 1)} == want[got["d"][0], got["t"][0]]
    assert S._covers(rows[:0], 4) == []
