import collections

import corpus_pipeline as P
from ledgerspark.llm import decontamination, mixing
from ledgerspark.session import materialise
from tests.llm.frames import DOCS, no_docs

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order_and_keep_the_columns(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left[name] = docs.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "decontamination":
            assert decontamination.scan(docs, benchmark).where("n_hit > 0").count() == 0
            clean = decontamination.scan(before, benchmark).where("n_hit = 0").select("doc_id")
            assert clean.join(docs, "doc_id", "left_anti").count() == 0
        if name == "mixing":
            plan = {r.doc_id: r.taken // r.size for r in mixing.mix(before, cut="document").collect() if r.size and r.taken}
            assert plan == {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    index = P.STAGES[-1][1](spark, docs, SF)
    firsts = collections.Counter(r.doc_id for r in index.where("part = 0").collect())
    assert firsts == collections.Counter(r.doc_id for r in docs.collect())


def test_run_and_empty_table(spark):
    assert P.run(spark, SF).count() > 0
    docs = materialise(no_docs(spark).select(*[c.split()[0] for c in DOCS.split(", ")]), "none")
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0
