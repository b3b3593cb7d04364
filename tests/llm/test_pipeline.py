"""The pipeline on a small folder, stage by stage, against brute force on what each stage was given."""

import corpus_pipeline as P
import test_decontaminate as contamination
import test_jaccard as jaccard
import test_line_dedup as lines
import test_packing as packing

from pitlake.functions.landing import shared_folder
from pitlake.llm import toxicity


def test_stages(spark):
    folder = f"{shared_folder(spark)}/corpus"
    docs, items = contamination.data(5)
    docs = [(i * 2, t) for i, t in docs if i is not None and t] + [(1001 + 2 * i, t) for i, t in jaccard.corpus(3, 60)]
    docs = [(i, t) for i, t in {i: t for i, t in docs}.items()]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert sorted(r.doc_id for r in P.toxic_out(spark, given, folder).collect()) == sorted(i for i, _ in docs)  # no labels, no verdicts
    rows = P.lines_once(spark, given, folder)
    assert rows.dtypes == given.dtypes
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == [(i, t) for i, _, _, t in lines.brute(docs, 50)]
    assert all(r.n_chars == len(r.text) for r in rows.collect())
    rows = P.near_copies(spark, given, folder)
    assert rows.dtypes == given.dtypes
    assert sorted(r.doc_id for r in rows.collect()) == [i for i, _, c, _ in jaccard.brute(docs) if i == c]
    rows = P.contaminated_out(spark, given, folder)
    assert rows.dtypes == given.dtypes
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r[0] for r in contamination.brute(docs, items) if not r[4])
    packing.check(P.packed(spark, given, folder).collect(), docs, 2048)
    left = {i: t for i, _, _, t in lines.brute(docs, 50)}
    left = {i: left[i] for i, _, c, _ in jaccard.brute(sorted(left.items())) if i == c}
    bad = {r[0] for r in contamination.brute(sorted(left.items()), items) if r[4]}
    packing.check(P.run(spark, folder).collect(), [(i, t) for i, t in left.items() if i not in bad], 2048)


def test_rejected_documents_go(spark):
    docs = spark.createDataFrame([(i, "vile rotten fool " * 5 if i % 3 == 0 else f"calm water number {i}") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert {i for i, v in verdict.items() if v} == {i for i in range(90) if i % 3 == 0}
    assert sorted(r.doc_id for r in toxicity.clean(docs, labels).collect()) == [i for i in range(90) if i % 3]
