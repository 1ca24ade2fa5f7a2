"""Every operator and stage on nulls, empty and long texts, repeated rows, ties, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    decontamination, jaccard_join, language, line_dedup, packing, personal_data, quality, substring_dedup, token_files,
    warc,
)
from plumbline.llm.common import import_path, scratch

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TWICE = "\n".join(f"line {i} with several words in it" for i in range(40))
ROWS = [
    (1, TWICE, "en", "a", 1), (1, TWICE, "en", "a", 1), (1, "other text for the same id", "en", "a", 1),
    (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 4), (5, LONG, "en", "b", len(LONG)),
    (None, "no id but words enough to count as a text", "en", "b", 3), (6, TWICE, "en", "b", 1),
    (None, None, None, None, None), (7, "émile Ärger ñandú #*$ 😀 end", "fr", "c", 20), (8, "single", "en", "c", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("row", "h", "node", "kept_text", "n_words", "spans", "base", "found", "starts", "label", "piece", "ids", "uid")
LABELS = [(1, 1, 0), (2, 0, 0), (5, 0, 1), (None, 1, 0), (99, None, 0)]
BENCH = [(1, "several words in it line 3 with several words in it line 4"), (2, None), (None, "single"), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    import_path(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit(i).alias(x) for i, x in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tables(spark, docs, labels, bench):
    return {
        "token_files": token_files.token_table(spark, docs), "packing": packing.packed_documents(docs),
        "lines": line_dedup.line_table(docs), "jaccard": jaccard_join.component_table(docs),
        "personal": personal_data.personal_data_table(docs), "quality": quality.quality_table(docs, labels),
        "repeats": substring_dedup.repeat_table(docs), "bench": decontamination.contamination_table(docs, bench),
        "language": language.language_table(docs),
    }


def test_odd_rows_and_clashing_names(spark, docs, clashing, labels, bench):
    plain = tables(spark, docs, labels, bench)
    extra = tables(spark, clashing, labels, bench)
    for name, df in plain.items():
        got = rows(df.drop("sequence_id", "offset"))
        assert got == rows(extra[name].drop("sequence_id", "offset")), name
        assert len(got) >= len(ROWS) and (name in ("packing",) or len(got) == len(ROWS)), name


def test_empty_tables(spark, docs, labels, bench):
    none = docs.limit(0)
    for name, df in tables(spark, none, labels.limit(0), bench.limit(0)).items():
        assert df.count() == 0, name
    assert not [r for r in decontamination.contamination_table(docs, bench.limit(0)).collect() if r["contaminated"]]
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_table(docs, labels.limit(0)).collect())


def test_repeated_rows_share_verdicts(spark, docs, labels, bench):
    got = {name: [tuple(r) for r in df.where("doc_id = 1").collect()]
           for name, df in tables(spark, docs, labels, bench).items() if name not in ("token_files", "packing")}
    for name, found in got.items():
        assert len(found) == 3 and len(set(found)) <= 2, name
    lines = {(r["doc_id"], r["n_lines"]): r["n_removed_lines"] for r in line_dedup.line_table(docs).collect()}
    assert lines[(1, 40)] == 0 and lines[(6, 40)] > 30  # the same document twice is its own first occurrence
    links = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.component_table(docs).collect()}
    assert [v for (d, n), v in links.items() if d == 6] == [1]
    assert links[(3, 0)] == 3 and links[(None, 0)] is None


def test_pages(spark):
    import_path(spark)
    big = "<p>" + "x" * 200 + "</p>"
    pages = spark.createDataFrame(
        [(3, "u3", big), (1, "u1\r\nx: y", big), (1, None, big), (2, "u2", "small"), (9, "u9", "small"), (4, None, None),
         (5, "u5", ""), (None, "u", big), (7, "u7", "é" * 60), (8, "u8", "é" * 60)], "page_id long, url string, html string")
    pages = pages.withColumn("payload", F.lit("clash")).withColumn("record_type", F.lit(1))
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"])
           for r in warc.revisit_table(spark, pages).collect()}
    assert got == {(3, 207): ("revisit", 1), (1, 207): ("response", None), (2, 5): ("response", None),
                   (9, 5): ("response", None), (4, 0): ("response", None), (5, 0): ("response", None),
                   (None, 207): ("response", None), (7, 120): ("response", None), (8, 120): ("revisit", 7)}
    assert warc.revisit_table(spark, pages).count() == 10
    assert warc.revisit_table(spark, pages.limit(0)).count() == 0
    found = language.page_language_table(pages).collect()
    assert len(found) == 10 and {r["language"] for r in found} == {"und"}


def test_stages_on_odd_rows(spark, docs, clashing, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, clashing, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = scratch(spark, name)
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == start.columns and now.dtypes == start.dtypes, name
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}
        if start is not docs.limit(0) and packed:
            kept = [(r["doc_id"], r["text"]) for r in now.collect()]
            assert (5, LONG) in kept and sum(t == TWICE for _, t in kept) <= 1
            assert all(r["n_chars"] == len(r["text"]) for r in now.where("doc_id = 6").collect())
