"""The stages on their own inputs, against brute-force versions."""

from __future__ import annotations

import corpus_pipeline
import pytest
from conftest_text import text_of
from pyspark.sql import functions as F
from test_mixing import targets
from test_near_copies import brute
from test_packing import check_pieces, plain  # noqa: F401

from tickloom.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{root}/{k}")
        out.append(spark.read.parquet(f"{root}/{k}"))
    return out


def test_toxicity_stage(spark, stages):
    docs, kept = stages[:2]
    scores = toxicity.score_documents(docs, queries.toxicity_model(docs, queries.table(spark, SF, "labels")))
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in scores.filter("score < 0.3").select("doc_id").collect())


def test_near_copy_stage(stages):
    rows = [tuple(r) for r in stages[1].select("doc_id", "text").collect()]
    assert sorted(r[0] for r in stages[2].select("doc_id").collect()) == sorted(set(brute(rows).values()))
    assert stages[2].columns == stages[0].columns


def test_rows_that_repeat_an_id(spark):
    """Texts that share an id are classed one by one; only equal rows and near copies are dropped."""
    a, b, c, d = (text_of(60 + k, 80) for k in range(4))
    rows = [(3, a), (5, a), (5, b), (5, b), (5, c), (7, c + " more"), (8, d), (8, d + " more"), (9, ""), (9, None), (None, a), (None, a)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    eight = [x for x in got if x[0] == 8]
    assert len(eight) == 1 and eight[0][1] in (d, d + " more")
    assert [x for x in got if x[0] != 8] == sorted([(3, a), (5, b), (5, c), (9, ""), (0, a), (0, a)])


def test_mixing_stage(stages):
    size = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    before = dict(stages[2].groupBy("source").agg(size).collect())
    largest = dict(stages[2].groupBy("source").agg(F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect())
    after = dict(stages[3].groupBy("source").agg(size).collect())
    for source, target in targets(before).items():
        assert abs(after.get(source, 0) - target) <= largest[source] / 2 + 1
    assert stages[3].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert stages[3].columns == stages[0].columns


def test_packing_stage(stages, plain):  # noqa: F811
    rows = [tuple(r) for r in stages[3].select("doc_id", "text").collect()]
    seen, once = set(), []
    for i, t in rows:
        if i not in seen:
            seen.add(i)
            once.append((i, t))
    assert stages[4].agg(F.sum("length")).first()[0] == sum(len(plain(t)) + 1 for _, t in rows)
    repeated = {i for i, _ in rows if sum(j == i for j, _ in rows) > 1} if len(rows) < 3000 else set()
    pieces = [r for r in stages[4].collect()]
    for r in pieces:
        assert r["length"] > 0 and r["offset"] + r["length"] <= 2048
    assert {r["doc_id"] for r in pieces} == seen and repeated <= seen


def test_odd_rows(spark, odd, none):
    labels = f"{SF}"
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, labels)
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, labels)
    assert none.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_columns_of_any_name_change_nothing(spark, odd):
    """Each stage keeps the same rows with columns named as its own as without them."""
    plain = odd.select("doc_id", "text", "source", "lang")
    for _, stage in corpus_pipeline.STAGES[:3]:
        with_all, without = stage(spark, odd, SF), stage(spark, plain, SF)
        assert with_all.columns == odd.columns
        key = lambda df: sorted(map(str, df.select("doc_id", "text", "source", "lang").collect()))
        assert key(with_all) == key(without)
        others = [c for c in odd.columns if c not in plain.columns]
        assert with_all.select(*[f"`{c}`" for c in others]).distinct().count() == 1


def test_the_row_kept_among_equals_is_fixed(spark):
    rows = [(1, "a b c d e f", source) for source in ("z", "b", None, "c")] + [(2, "other words here", "q")]
    for parts in (1, 3):
        kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts), SF)
        assert sorted((r["doc_id"], r["source"]) for r in kept.collect()) == [(1, None), (2, "q")]
