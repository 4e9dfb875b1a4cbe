import random
import re

import duckdb
import pytest

from tests.llm.fixtures import ODD, SMALL, docs
from vectorloom.llm import license_scan as L


def plain(text):
    text = text or ""
    gap = r"\n[\x20\t\r]*\n"
    units = text.split("\n") + [p for p in re.split(gap, text) if "\n" in p] + ([text] if re.search(gap, text) else [])
    out = []
    for u in units:
        b = set(L.bigrams(u))
        for name, template in L.TEMPLATES:
            t = set(L.bigrams(template))
            if b and (score := 2 * len(b & t) / (len(b) + len(t))) >= L.THRESHOLD:
                out.append((round(score, 9), name))
    return sorted(out)


CASES = [L._MIT, L._MIT.upper(), "intro\n\n" + L._MIT + "\n" + L._MIT2 + "\n\n" + L._MIT3, "Licensed under CC BY-NC 4.0.", "Released under the  MIT  licence", L._GPL.format(v=3), L._GPL.format(v=2).replace("free", "costly"), "\n \n", "the MIT"]


def test_against_all_templates(spark):
    rows = list(enumerate(CASES, 100)) + ODD
    out = L.matches(docs(spark, rows)).collect()
    for r in out:
        assert sorted((round(x.score, 9), x.license) for x in r.licenses) == plain(r.text), r.text and r.text[:60]
    assert L.matches(docs(spark, [])).collect() == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = sorted(map(tuple, L.query(spark, SMALL).collect()), key=repr)
    assert got == sorted(con.execute(L.SQL).fetchall(), key=repr)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 5, 7, 60])
def test_bounds(n):
    lo, hi = L.bounds(n)
    dice = lambda m: 2 * min(n, m) / (n + m)
    ok = [m for m in range(1, 4 * n + 5) if dice(m) >= L.THRESHOLD - 1e-12]
    assert lo <= ok[0] and hi >= ok[-1]


def test_clashing_columns(spark):
    table = docs(spark, [(1, L._MIT), (2, None)]).selectExpr("*", "doc_id AS __b", "'mine' AS licenses")
    out = L.matches(table).orderBy("doc_id").collect()
    assert [(r["__b"], r.licenses) for r in out] == [(1, "mine"), (2, "mine")]
    assert [x.license for x in out[0]["licenses_"]] == ["MIT"] and out[1]["licenses_"] == []


def test_whole_licences_from_a_folder(spark, tmp_path):
    """Templates of whole texts: a copy with a few words changed is found, another text is not."""
    words = [f"clause{random.Random(i).randrange(500)}" for i in range(3000)]
    (tmp_path / "Long-1.0.txt").write_text(" ".join(words))
    (tmp_path / "Other 2.txt").write_text(" ".join(reversed(words)))
    templates = L.read_templates(spark, f"file://{tmp_path}/*.txt")
    assert [name for name, _ in templates] == ["Long-1.0", "Other 2"]
    copy = " ".join("changed" if i % 40 == 0 else w for i, w in enumerate(words))
    out = L.matches(docs(spark, [(1, copy), (2, " ".join(words[:1000]))]), templates=templates).orderBy("doc_id").collect()
    assert [[x.license for x in r.licenses] for r in out] == [["Long-1.0"], []]
