"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from helpers import LOWER

import corpus_pipeline
from arbiter.llm.catalog import ORACLE, QUERIES
from arbiter.sources.tables import load

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda f: sorted(map(str, f[cols].to_numpy().tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_every_document_is_answered(spark, name):
    got, n = QUERIES[name](spark, SF), load(spark, SF, "documents").count()
    if name.startswith("op5"):
        assert {"doc_id", "other_id", "start_word", "end_word"} <= set(got.columns)
    else:
        assert got.select("doc_id").distinct().count() == got.count() == n


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version on its own input."""
    from arbiter.llm import credentials, factorization, pieces
    from arbiter.llm.tables import materialize
    from test_credentials import naive
    from test_decontaminate import plain as contaminated
    from test_jaccard_join import plain as near

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    docs = load(spark, SF, "documents")
    inputs = [docs]
    for _, f in corpus_pipeline.STAGES:
        inputs.append(materialize(f(spark, inputs[-1], SF)))
    for d in inputs[:-1]:
        assert d.columns == docs.columns
    rows = [[tuple(r) for r in d.collect()] for d in inputs[:-1]]
    ids = [{r[0] for r in x} for x in rows]
    model = factorization.train(docs, load(spark, SF, "labels"))
    assert ids[1] == {r.doc_id for r in factorization.scores(docs, model).collect() if r.predicted}
    assert ids[2] == {d for d, _, c in map(eval, near(rows[1])) if d == c}
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    assert ids[3] == {d for d, _, hit, _ in map(eval, contaminated(rows[2], items)) if not hit}
    assert ids[4] == ids[3]
    before, automata = {r[0]: r[1] for r in rows[3]}, credentials.learn(inputs[3])
    for r in rows[4]:
        assert not naive(r[1]) and (r[1] == before[r[0]] or credentials.all_spans(before[r[0]], automata)[1])
    v = pieces.vocabulary(pieces.default_path())
    for r in inputs[5].collect():
        text = next(x[1] for x in rows[4] if x[0] == r.doc_id)
        assert r.ids == [*v.library.encode(text), v.end]
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, inputs[5].collect()))
    assert LOWER


def test_pipeline_on_odd_input(spark, tmp_path):
    from helpers import clashing, frame, messy
    sf = str(tmp_path)
    clashing(spark, messy()).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame(spark, [(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = load(spark, sf, "documents")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns
        docs = docs.sparkSession.createDataFrame(out.collect(), docs.schema)
    n = docs.count()
    assert n >= 8 and corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n
