import corpus_pipeline
from ledgerloom.llm import langid, mixing
from ledgerloom.llm.queries import ORACLES, QUERIES

from .helpers import SMALL, documents, duck, rows_of, small
from .test_decontaminate import brute as brute_hits
from .test_forest import brute as brute_classes

NAMES = ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_each_stage_against_brute_force(spark):
    docs = small(spark, "documents")
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def after(name, docs):
        out = stage[name](spark, docs, SMALL)
        assert out.columns == columns
        rows = [tuple(r) for r in out.collect()]
        return rows, spark.createDataFrame(rows, docs.schema)

    rows, docs1 = after("language_id", docs)
    sure = {r["doc_id"] for r in langid.identify(docs).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert sorted(r[0] for r in rows) == sorted(sure)
    text = [(r[0], r[1]) for r in rows]
    rows, docs2 = after("ngram_jaccard_join", docs1)
    _, classes = brute_classes(text)
    assert sorted(r[0] for r in rows) == sorted({c for c in classes})
    items = [(r["item_id"], r["text"]) for r in small(spark, "benchmark").collect()]
    clean = [h[0] for h in brute_hits([(r[0], r[1]) for r in rows], items) if not h[-1]]
    rows, docs3 = after("benchmark_decontamination", docs2)
    assert sorted(r[0] for r in rows) == sorted(clean)
    _, want = rows_of(duck(documents=docs3.toPandas()).execute(mixing.oracle(corpus_pipeline.MIX)))
    rows, docs4 = after("source_mixing", docs3)
    assert sorted(r[0] for r in rows) == sorted(r["doc_id"] for r in want if r["n_copies"])
    last = stage["sharding"](spark, docs4, SMALL).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r[0] for r in rows)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["size"]) for r in whole) == sorted((r["doc_id"], r["size"]) for r in last)


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
