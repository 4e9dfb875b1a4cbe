import re
from collections import defaultdict

from tests.llm.fixtures import ODD, SMALL, docs, rows_of, small
from vectorloom.llm import decontaminate as D


def tokens(text):
    """(raw, canonical) tokens by the documented rules, one by one."""
    out, last, before = [], 0, None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
        raw, low = m[0], m[0].lower()
        opening = not out or any(c in ".!?\n:;\"\x00" for c in text[last : m.start()])
        last = m.end()
        kind = low
        if raw[0].isupper() and not (len(raw) > 1 and raw[1].isupper()) and not opening:
            kind = "<name>"
        if raw[0] in "0123456789":
            kind = "<number>"
        elif before == "<number>" and low in D.UNITS:
            kind = "<unit>"
        before = kind
        out.append((low, kind))
    return out


def plain(doc_rows, items):
    """(doc_id, item_id, n_tokens, n_slots) by comparing every window of every pair."""
    found = []
    coded = [(i, tokens(t)) for i, t in items if t]
    for doc_id, text in doc_rows:
        d = tokens(text)
        for item_id, b in coded:
            n = D.WINDOW if len(b) >= D.WINDOW else len(b)
            if n < D.MIN_TOKENS:
                continue
            at = defaultdict(list)
            for p in range(len(d) - n + 1):
                at[tuple(k for _, k in d[p : p + n])].append(p)
            lines = defaultdict(set)
            for q in range(len(b) - n + 1):
                w = tuple(k for _, k in b[q : q + n])
                if sum(k[0] != "<" for k in w) >= min(n, D.MIN_LITERALS):
                    for p in at.get(w, ()):
                        lines[p - q].update(range(q, q + n))
            best = None
            for shift, cover in lines.items():
                slots = {(b[q][0], d[q + shift][0]) for q in cover if b[q][1][0] == "<"}
                if len(cover) >= min(D.NEED_TOKENS, -(-len(b) * 6 // 10)) and len({a for a, _ in slots}) == len(slots) == len({c for _, c in slots}):
                    got = (len(cover), sum(b[q][1][0] == "<" for q in cover))
                    best = max(best or got, got)
            if best:
                found.append((doc_id, item_id, *best))
    return sorted(found, key=repr)


def result(df):
    return rows_of(df.select("doc_id", "item_id", "n_tokens", "n_slots"))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    items = [(r.item_id, r.text) for r in small(spark, "benchmark").collect()]
    got = result(D.query(spark, SMALL))
    assert got and got == plain(rows, items)


ITEM = "A train leaves Boston at 9 am and travels 120 miles in 3 hours while Maria waits at the station, how fast does the train go on average?"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_slots(spark):
    same = ITEM.replace("Boston", "Denver").replace("120 miles", "450 miles").replace("Maria", "Peter").replace("3 hours", "5 hours")
    clash = "Each of 7 boxes holds 7 red balls and each of 9 bags holds 9 blue balls so count all the balls there"
    fine, broken = clash.replace("7", "4"), clash.replace("7 red", "5 red")
    rows = [(1, "Once upon a time. " + same + " The end."), (2, "A train leaves the station in the morning and nobody waits."), (3, fine), (4, broken)]
    items = [(10, ITEM), (11, clash), (12, None), (13, ""), (14, "too short")]
    got = result(D.contaminations(docs(spark, rows), bench(spark, items)))
    assert {(r[0], r[1]) for r in got} == {(1, 10), (3, 11)}
    assert got == plain(rows, items)


def test_both_ways_agree(spark):
    table, items = small(spark), small(spark, "benchmark")
    assert result(D._by_shuffle(table, items)) == result(D.contaminations(table, items))


def test_odd_rows(spark):
    rows = ODD + [(50, ITEM), (50, ITEM), (51, ("x " * 2000) + ITEM)]
    items = bench(spark, [(10, ITEM)])
    table = docs(spark, rows)
    assert result(D.contaminations(table, items)) == plain([r[:2] for r in rows], [(10, ITEM)])
    kept = D.uncontaminated(table, items)
    assert kept.columns == table.columns and kept.count() == len(ODD)
    assert D.contaminations(docs(spark, []), items).collect() == [] and D.contaminations(table, items.where("false")).collect() == []
    assert D.uncontaminated(table, items.where("false")).count() == len(rows)


CITIES = "Rank Vienna, Budapest, Prague, Warsaw, Berlin, Rome, Madrid, Lisbon, Paris, London, Dublin, Oslo, Helsinki by population."
GERMAN = "Welche Stadt liegt am Fluss mit der Burg auf dem Berg und dem Markt vor dem Tor am See im Land der Wiesen?"


def found(spark, rows, items):
    return {(r.doc_id, r.item_id) for r in D.contaminations(docs(spark, rows), bench(spark, items)).collect()}


def test_literal_copies(spark):
    """Lists of names have no window of enough literals; case changes what counts as a name."""
    rows = [(1, "Before. " + CITIES + " After."), (2, "so " + GERMAN.lower()), (3, GERMAN.upper()), (4, "Vienna, Budapest, Prague and Warsaw by population.")]
    assert found(spark, rows, [(10, CITIES), (11, GERMAN)]) == {(1, 10), (2, 11), (3, 11)}


def test_values_of_other_token_counts(spark):
    other = ITEM.replace("120", "1,250").replace("3 hours", "2.5 hours")
    named = ITEM.replace("Boston", "New York").replace("Maria", "Anna Maria")
    short = "please count all of the red and blue balls in the two big boxes"
    rows = [(1, other), (2, named), (3, short.replace("and blue", "and also blue")), (4, ITEM.replace("120", "1,250").replace("waits at the station, how fast", "sleeps"))]
    clash = "Each of 7 boxes holds 7 red balls and each of 9 bags holds 9 blue balls so count all the balls there"
    rows += [(6, clash.replace("7", "5.5"))]
    got = found(spark, rows, [(10, ITEM), (11, short), (12, clash)])
    assert got - {(4, 10)} == {(1, 10), (2, 10), (3, 11), (6, 12)}


def test_both_ways_on_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, ITEM), (None, "clean words that hold nothing of the kind"), (7, ITEM), (7, ITEM), (7, "another clean text under the same id"), (8, CITIES), (9, None)]
    table, items = docs(spark, rows), bench(spark, [(10, ITEM), (10, ITEM), (None, CITIES), (11, None)])
    here, kept = result(D.contaminations(table, items)), rows_of(D.uncontaminated(table, items))
    monkeypatch.setattr(D, "MAX_BROADCAST_ITEMS", 0)
    assert result(D.contaminations(table, items)) == here and len(here) == 7
    assert rows_of(D.uncontaminated(table, items)) == kept and len(kept) == 3
