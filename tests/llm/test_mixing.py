from pyspark.sql import functions as F

from ledgerloom.llm import mixing

from .helpers import documents, duck, prose, same_rows, small


def test_small_table_in_sql(spark):
    whole = mixing.Mix(max_epochs=1, budget_permille=None)
    for mix in (mixing.Mix(), whole, mixing.Mix(max_epochs=1, budget_permille=900), mixing.Mix(budget_permille=2500, max_epochs=4, seed=3)):
        same_rows(mixing.mix_documents(small(spark, "documents"), mix), duck().execute(mixing.oracle(mix)))


def test_largest_budget_at_target_shares(spark):
    docs = documents(spark, rows_for([("src0", "en", 60), ("src1", "en", 400), ("src2", "de", 90), ("src2", "en", 300), ("src3", "en", 500)]))
    got = mixing.mix_documents(docs, mixing.Mix(max_epochs=1, budget_permille=None))
    used = {r[0]: r[1] for r in got.groupBy("domain").agg(F.sum(F.col("n_copies") * F.col("n_tokens"))).collect()}
    total = sum(used.values())
    assert used["dom0"] == got.where("domain = 'dom0'").agg(F.sum("n_tokens")).first()[0]  # the scarce domain is taken whole
    assert all(abs(used[d] / total - share) < 0.02 for d, share in {"dom0": 0.4, "dom1": 0.3, "dom2": 0.2, "dom3": 0.1}.items())


def rows_for(counts):
    out, n = [], 0
    for source, lang, k in counts:
        for _ in range(k):
            out.append((n, prose(n, 10 + n % 7), lang, source))
            n += 1
    return out


def test_shortage_goes_to_siblings_first(spark):
    rows = rows_for([("src0", "en", 4), ("src4", "en", 200), ("src1", "en", 200)])
    mix = mixing.Mix(max_epochs=1, budget_permille=500)
    leaf = {r["source"]: r for r in mixing.plan(documents(spark, rows), mix).collect()}
    total = sum(r["supply"] for r in leaf.values())
    assert leaf["src0"]["budget"] == leaf["src0"]["supply"]  # short: it gives all it has
    family = leaf["src0"]["budget"] + leaf["src4"]["budget"]
    assert abs(family - total // 2 * 40 // 70) <= 3  # the sibling takes the rest, the other domain nothing
    assert sum(r["budget"] for r in leaf.values()) <= total // 2


def test_budgets_and_epochs(spark):
    docs = documents(spark, rows_for([("src0", "en", 30), ("src0", "de", 30), ("src2", "fr", 300)]))
    mix = mixing.Mix(max_epochs=3, budget_permille=1000)
    got = mixing.mix_documents(docs, mix)
    used = got.groupBy("domain", "lang", "source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("n"), F.max("leaf_budget").alias("b"), F.max("n_copies").alias("m"))
    for r in used.collect():
        assert r["b"] - 17 < r["n"] <= r["b"] and r["m"] <= 3
    kept = mixing.keep_mixture(docs, mix).groupBy("doc_id").count()
    assert {r[0]: r[1] for r in kept.collect()} == {r["doc_id"]: r["n_copies"] for r in got.collect() if r["n_copies"]}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "src1"), (3, "a b", None, "web"), (None, "c d e", "en", None), (4, "x " * 50_000, "en", "src1"), (4, "y", "en", "src1"), (4, "y", "en", "src1")]
    docs = documents(spark, rows, clash=True)
    got = mixing.mix_documents(docs)
    assert got.count() == len(rows) and got.where("n_tokens = 0 and n_copies > 0").isEmpty()
    assert mixing.keep_mixture(docs, mixing.Mix(max_epochs=1)).columns == docs.columns
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    assert mixing.keep_mixture(documents(spark, [])).count() == 0
