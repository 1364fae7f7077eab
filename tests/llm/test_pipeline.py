"""The pipeline's stages, one after another, on the small tables."""

import os

import pytest

import corpus_pipeline
from pneumaspark.llm import quality
from pneumaspark.session import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def prose(seed: int, n: int = 120) -> str:
    letters = lambda v: "".join("abcdefghij"[int(d)] for d in str(v))  # noqa: E731  (digits would be variable fields)
    return " ".join(f"w{letters((seed * 7919 + k * k * 31 + k) % 997)}s{letters(seed)}" for k in range(n))


CLASHING = "doc_id long, text string, _key string, key int, n_lines int, _drop int, drop int, real int, h int, item int, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small documents with odd rows and clashing columns, and a benchmark."""
    texts = [prose(i) for i in range(12)]
    texts += [prose(3) + " tail", prose(4), None, "", " \t\r\n", "short", " ".join(["again and"] * 80)]
    texts += [prose(20) + "\n" + prose(50, 15), prose(21) + "\r\n" + prose(50, 15), prose(22) + " " + prose(60, 30)]
    rows = [(i, t, "k", 1, 2, 3, 4, 5, 6, 7, len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, prose(30), "k", 1, 2, 3, 4, 5, 6, 7, 0), rows[0], (None, prose(31), "k", 1, 2, 3, 4, 5, 6, 7, 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, CLASHING).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", prose(60, 30)), ("b2", None), ("b3", "x y")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], CLASHING).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    return folder


def test_stages_with_odd_rows_and_clashing_columns(spark, tables):
    docs, kept = table(spark, tables, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = materialize(stage(spark, docs, tables))
        assert new.columns == docs.columns
        assert {(r._key, r.key, r.n_lines, r._drop, r.drop, r.real, r.h, r.item) for r in new.collect()} == {("k", 1, 2, 3, 4, 5, 6, 7)}
        kept.append([(r.doc_id, r.text) for r in new.collect()])
        docs = new
    by_quality, by_lines, by_copies, by_benchmark = kept
    rows = [(r.doc_id, r.text) for r in table(spark, tables, "documents").collect()]
    good = dict(zip([t for _, t in rows], quality.measure([(t or "").encode() for _, t in rows])["kept"]))
    assert sorted(by_quality, key=str) == sorted([r for r in rows if good[r[1]]], key=str)
    assert len(by_quality) == len(rows) - 5
    # the passage of two documents stays in the first alone
    assert sum(prose(50, 15) in t for _, t in by_quality) == 2 and sum(prose(50, 15) in t for _, t in by_lines) == 1
    # so does a text of one line, of which nothing is left in the second
    assert {i for i, _ in by_quality} - {i for i, _ in by_lines} == {13} and len(by_lines) == len(by_quality) - 1
    assert set(by_lines) - set(by_copies) == {(12, prose(3) + " tail")} and set(by_copies) <= set(by_lines)
    assert set(by_copies) - set(by_benchmark) == {(21, prose(22) + " " + prose(60, 30))}
    packed = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in by_benchmark}


def test_stages_of_empty_tables(spark, tables):
    docs = table(spark, f"{tables}/none", "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{tables}/none").count() == 0
