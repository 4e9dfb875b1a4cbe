import itertools

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from tests.llm.fixtures import ODD, SMALL, docs, rows_of, small
from vectorloom.llm import simhash

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Index of the component of each fingerprint, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def expected(rows, n=3):
    fps = [plain_fingerprint(t, n) for _, t in rows]
    comp = plain_components(fps)
    ids = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        ids.setdefault(c, []).append(i)
    low = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    return sorted(((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fps, comp, strict=True)), key=repr)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert rows_of(simhash.query(spark, SMALL)) == expected(rows)


def test_odd_rows(spark):
    out = simhash.near_duplicates(docs(spark, ODD)).collect()
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out), key=repr)
    assert got == expected([r[:2] for r in ODD])


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    assert simhash.keep_first(docs(spark, [])).collect() == []


def test_keep_first(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    table = docs(spark, [(5, base), (3, base), (3, base), (9, "something quite different is written in this one"), (None, base)])
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [(a, b) for a in range(64) for b in range(a, 64)]
    chosen = [flips[i] for i in rng.integers(0, len(flips), 300)]
    other = fps ^ np.array([(1 << a) | (1 << b) for a, b in chosen], dtype=np.uint64)
    row, key = simhash.anchors(np.r_[fps, other])
    home = [set() for _ in range(600)]
    every = [set() for _ in range(600)]
    for r, k in zip(row.tolist(), key.tolist(), strict=True):
        every[r].add(k >> 1)
        if k & 1:
            home[r].add(k >> 1)
    assert all(len(h) == 1 for h in home)
    assert all(home[i] & every[300 + i] for i in range(300))


@pytest.mark.parametrize("n", [40, 4000])
def test_compare_finds_all_links(n):
    """Also at an anchor with too many fingerprints to compare pairwise."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 46, (n // 4, 3), dtype=np.uint64), axis=1) for b in base]))
    row, key = simhash.anchors(fps)
    order = np.argsort(row, kind="stable")
    t = pa.table({"part": [0], "keys": [key[order].tobytes()], "fps": [fps[row[order]].tobytes()]})
    out = simhash._compare(t)
    root = {}
    for a, b in zip(out["src"].to_pylist(), out["dst"].to_pylist(), strict=True):
        root[a & (1 << 64) - 1] = b & (1 << 64) - 1
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    lab = np.arange(len(fps))
    while True:
        new = np.array([lab[d[i] <= 2].min() for i in range(len(fps))])
        if (new == lab).all():
            break
        lab = new
    assert [int(root.get(int(f), int(f))) for f in fps] == [int(fps[i]) for i in lab]


def jaccard(a, b, n=5):
    x, y = (set(simhash.shingles(t.encode(), n)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_first_catches_one_word_edits(spark):
    """One-word edits have a similarity of 0.8 or more; a copy with many edits has less and stays."""
    rng = np.random.default_rng(3)
    texts, copies = [], []
    for n in (60, 100, 400):
        for _ in range(40):
            words = [f"w{k}" for k in rng.integers(0, 50_000, n)]
            texts.append(" ".join(words))
            words[n // 2] = "changed"
            copies.append(" ".join(words))
    far = " ".join("other" if k % 12 == 5 else w for k, w in enumerate(texts[-1].split()))
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts, copies, strict=True)) and jaccard(texts[-1], far) < 0.8
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(copies)] + [(5000, far)]
    kept = {r.doc_id for r in simhash.keep_first(docs(spark, rows)).collect()}
    assert kept == set(range(len(texts))) | {5000}


def test_keep_first_of_a_chain(spark):
    """A chain of edits is one group, whichever links it has; a large one too."""
    words = [f"c{k}" for k in range(200)]
    rows = []
    for k in range(60):
        words[3 * k] = f"new{k}"
        rows.append((100 - k, " ".join(words)))
    assert jaccard(rows[0][1], rows[-1][1]) < 0.2
    assert [r.doc_id for r in simhash.keep_first(docs(spark, rows)).collect()] == [41]


def test_keep_first_on_the_given_documents(spark):
    """The components of all pairs of similarity 0.8 or more."""
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    sets = [set(simhash.shingles((t or "").encode(), 5)) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, i), i)
    assert {r.doc_id for r in simhash.keep_first(small(spark)).collect()} == set(least.values())


def test_keep_first_links_fingerprints(spark):
    """Fingerprints of five-word shingles within two bits are links, repeated shingles count; three bits are none."""
    rng = np.random.default_rng(8)
    page = "all rights reserved by us " * 200

    def tail(k):
        return " ".join(f"t{k}x{i}" for i in rng.integers(0, 10_000, 10))

    one = [page + tail(k) for k in range(4)]
    words = [f"w{i}" for i in rng.integers(0, 50_000, 300)]
    by: dict = {}
    for k in range(4000):
        text = " ".join([*words, *(f"{c}{k}" for c in "abcdefgh"[: k % 8 + 1])] * (1 + k % 2))
        by.setdefault((simhash.fingerprint(text.encode(), 5) ^ simhash.fingerprint(" ".join(words).encode(), 5)).bit_count(), text)
    rows = [*((20 + k, t) for k, t in enumerate(one)), (30, " ".join(words)), *((40 + d, t) for d, t in sorted(by.items()))]
    fps = [plain_fingerprint(t, 5) for _, t in rows]
    assert max(jaccard(a, b) for a, b in itertools.combinations(one, 2)) < 0.8 and len(set(fps[:4])) == 1
    marked = simhash._sets(docs(spark, rows), 5)[0]
    nodes = [r.node for r in sorted(marked.collect(), key=lambda r: r.doc_id)]
    links = simhash.close_links(marked).collect()
    a, b = (np.array([nodes.index(r[i]) for r in links]) for i in (0, 1))
    assert len(set(nodes)) == len(rows) and {1, 2, 3} < set(by)
    assert simhash.label_components(len(rows), a, b).tolist() == plain_components(fps)
    assert [r.doc_id for r in simhash.keep_first(docs(spark, rows[:4])).collect()] == [20]


def test_keep_first_against_all_pairs(spark):
    """Components of both kinds of links together, by all pairs."""
    page = "terms of use apply here " * 50
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    top = max(i for i, _ in rows) + 1
    rows += [(top + i, page + " ".join(f"z{i}y{k}" for k in range(6))) for i in range(5)]
    rows += [(top + 10, rows[0][1] + " one more word or two"), (top + 11, None), (top + 12, " ")]
    fps = [plain_fingerprint(t, 5) for _, t in rows]
    sets = [set(simhash.shingles((t or "").encode(), 5)) for _, t in rows]
    a, b = zip(*((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])), strict=True)
    label = simhash.label_components(len(rows), np.array(a), np.array(b))
    least: dict = {}
    for (i, _), x in zip(rows, label.tolist(), strict=True):
        least[x] = min(least.get(x, i), i)
    assert {r.doc_id for r in simhash.keep_first(docs(spark, rows)).collect()} == set(least.values())
