import corpus_pipeline as P
from tests.llm.fixtures import SMALL, docs, small
from tests.llm.test_decontaminate import plain as contaminated
from vectorloom.llm import language_id, pii, sentencepiece_fst
from vectorloom.llm.simhash import shingles


def first_of_similar(rows):
    """The smallest doc_id of every component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [set(shingles(t.encode(), 5)) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(r[0] for r, x in zip(rows, label, strict=True) if x == k) for k in set(label)}


def test_stages(spark):
    """Each stage's result from its own input, by brute force where there is one."""
    table = small(spark)
    a = P.identify_languages(spark, table, SMALL).collect()
    scored = {r.doc_id: r for r in language_id.identify(table, language_id.train(table)).collect()}
    assert {r.doc_id for r in a} == {i for i, r in scored.items() if r.lang_pred != "und" and r.score >= 0.5}

    one = spark.createDataFrame(a, table.schema)
    b = P.drop_near_duplicates(spark, one, SMALL).collect()
    assert {r.doc_id for r in b} == first_of_similar([(r.doc_id, r.text) for r in a])

    two = spark.createDataFrame(b, table.schema)
    c = P.drop_contaminated(spark, two, SMALL).collect()
    items = [(r.item_id, r.text) for r in small(spark, "benchmark").collect()]
    assert {r.doc_id for r in c} == {r.doc_id for r in b} - {r[0] for r in contaminated([(r.doc_id, r.text) for r in b], items)}

    three = spark.createDataFrame(c, table.schema)
    d = P.redact_personal_data(spark, three, SMALL)
    assert d.columns == table.columns and d.count() == len(c)
    assert all(not [s for s in r.pii if s.kind in pii.BASE_KINDS] for r in pii.find(d).collect())

    e = P.tokenize(spark, d, SMALL).collect()
    assert {r.doc_id for r in e} == {r.doc_id for r in c} and all(r.round_trip for r in e)
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(spark.createDataFrame(e)).collect()}
    assert back == {r.doc_id: r.text for r in d.collect()}
    got = P.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, r.ids) for r in e)


def test_odd_tables(spark, tmp_path):
    """An empty table and rows of nulls go through all stages."""
    for name, rows in (("none", []), ("null", [(1, None), (None, None), (2, "")])):
        folder = f"file://{tmp_path}/{name}"
        docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
        small(spark, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
        assert P.run(spark, folder).collect() == []
