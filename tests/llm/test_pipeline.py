"""The pipeline on small tables, stage by stage against plain versions."""

import pytest

import corpus_pipeline
from lodestone.llm import pii

from .cases import DOCS, documents, frame
from .test_operators import bag, jaccard_truth, leaks_truth, rules_truth

BENCH = "item_id bigint, text string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = documents(9) + [(300 + k, " ".join(f"w{j % (60 + k)}###" for j in range(80 + k)), "en", "s1", 0) for k in range(30)]
    text = next(r[1] for r in rows if r[1] and 60 < len(r[1].split()) < 200)
    bench = [(1, " ".join(text.split()[:12])), (2, " ".join(text.split()[10:24])), (3, None)]
    labels = [(r[0], int("###" not in (r[1] or "")), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, BENCH).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, bench


def test_stages(spark, tables):
    d, rows, bench = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_leaks", "personal_data", "mix"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = stage["quality"](spark, docs, d)
    assert good.columns == docs.columns and not any("###w" in (r.text or "").replace(" ", "") for r in good.collect())

    kept = stage["near_duplicates"](spark, docs, d)
    classes = {t[4] for t in jaccard_truth(rows)}
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert not bag(map(tuple, kept.collect())) - bag(rows)

    left = stage["benchmark_leaks"](spark, docs, d)
    bad = sum(t[5] for t in leaks_truth(rows, bench))
    assert bad and left.count() == len(rows) - bad

    plain = stage["personal_data"](spark, docs, d).collect()
    assert bag(map(tuple, plain)) == bag((i, None if t is None else pii.redacted(t, pii.find_spans(t)), a, s, n if t is None else len(pii.redacted(t, pii.find_spans(t)))) for i, t, a, s, n in rows)

    taken = stage["mix"](spark, docs, d).collect()
    assert taken and all(r.taken == r.copies * rules_truth(next(t for i, t, *_ in rows if i == r.doc_id))[0] for r in taken if r.doc_id not in (None, 5))


def test_run(spark, tables):
    d, rows, _ = tables
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "source", "size", "target", "copies", "taken"] and 0 < out.count() <= len(rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    for name, f in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[3:]:
        assert f(spark, empty, "").count() == 0, name
    assert frame(spark).count()
