"""The stages of the corpus pipeline on a small table, each against what it has to keep."""

import collections
import random

import corpus_pipeline
import pytest
from test_llm_operators import DOCS, base_spans, corpus, jaccard_by_hand, tokens_of

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, top = random.Random(3), tmp_path_factory.mktemp("tables")
    labels = [(i, int(rng.random() < 0.3)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(top / "labels.parquet"))
    rows = [*corpus(), (900, "mail me at someone@example.org or +1 619 555 0053 " + " ".join(f"w{i}" for i in range(20)), "en", "a", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(top / "documents.parquet"))
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    kept = STAGES["toxicity"](spark, docs, str(folder))
    assert kept.columns == list(corpus_pipeline.COLUMNS) and set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))

    single = STAGES["near_duplicates"](spark, docs, str(folder))
    rows = [tuple(r) for r in docs.collect()]
    classes = {c for _, n, c in jaccard_by_hand(rows) if n}
    assert single.columns == docs.columns and single.count() == len(classes) + sum(not tokens_of(r[1]) for r in rows)

    clean = STAGES["personal_data"](spark, docs, str(folder)).collect()
    assert len(clean) == len(rows) and not any(base_spans(r["text"]) for r in clean)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)

    mixed = STAGES["mixing"](spark, docs, str(folder)).collect()
    texts = collections.Counter((r[0], r[1]) for r in rows)
    assert all(n <= 2 * texts[k] for k, n in collections.Counter((r["doc_id"], r["text"]) for r in mixed).items())

    packed = STAGES["packing"](spark, docs, str(folder)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}
    assert max(collections.Counter(r["sequence_id"] for r in packed).values()) <= corpus_pipeline.MOST_DOCS


def test_whole_and_empty(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert got and all(0 < r["length"] <= 2048 for r in got)
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
