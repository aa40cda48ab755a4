"""Plans are what they should be: pruned scans, filters at the scan, no cartesian product, no more shuffles than needed."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillstrata.model import SCHEMA
from quillstrata.operators import bm25, changes, fusion, keyword, symbols, vector
from quillstrata.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def shuffles(df) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", plan(df), re.M))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A chunk table as it lies on disk, in several files."""
    path = str(tmp_path_factory.mktemp("t") / "chunks")
    rows = [("i%d" % k, "r%d" % (k % 3), f"f{k % 9}.py", "f.py", ".py", "python", "function", f"A.s{k}", "", "", "", "red green", k, k + 3, k, [1.0, 0.5]) for k in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_symbol_search_reads_no_text_and_no_vector(stored):
    text = plan(symbols.list_symbols(stored, "A", repo="r1"))
    schema = re.search(r"ReadSchema: (.*)", text)[1]
    assert "vector" not in schema and " text" not in schema and "text:" not in schema
    assert re.search(r"PushedFilters: .*EqualTo\(repo,r1\)", text) and "StringContains(symbol_name,A)" in text
    assert shuffles(symbols.list_symbols(stored, "A", repo="r1")) == 0


def test_keyword_lines_do_not_shuffle_and_filter_at_the_scan(stored):
    df = keyword.keyword_lines(stored.select("repo", "file", "text"), "red", repo="r1")
    assert shuffles(df) == 0 and "StringContains(text,red)" in plan(df)
    assert "TakeOrderedAndProject" in plan(keyword.keyword_search(stored, "red", 5))


def test_full_text_search_shuffles_one_row(stored):
    df = bm25.bm25(stored.select("id", "text"), "red blue").orderBy(F.desc("score"), "id").limit(5)
    text = plan(df)
    assert shuffles(df) == 1 and "SinglePartition" in text  # the row of sums
    assert "TakeOrderedAndProject" in text and "ArrowEvalPython" not in text and "vector" not in text
    assert shuffles(bm25.postings(stored)) == 1  # by term and chunk
    assert shuffles(bm25.phrase_positions(stored, ["red", "green"])) == 0


def test_vector_search_takes_the_top_without_a_sort(stored):
    df = vector.vector_search(stored, [1.0, 0.0], 5)
    assert shuffles(df) == 0 and "TakeOrderedAndProject" in plan(df)


def test_lines_meet_chunks_in_an_equi_join(stored):
    hits = keyword.keyword_lines(stored.select("repo", "file", "text"), "red")
    text = plan(fusion.lines_to_chunks(hits, stored))
    assert re.search("(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) LeftOuter", text)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_fusion_is_one_aggregation(stored):
    legs = [fusion.ranked(stored.withColumn("k", F.col("start_line")), leg, [F.col("k")], 30) for leg in ("fts", "symbol")]
    fused = fusion.fuse(legs, fusion.WEIGHTS["mixed"])
    assert "CartesianProduct" not in plan(fused) and "Join" not in plan(fused)


def test_upsert_reads_only_keys_of_the_new_rows_twice(stored):
    text = plan(changes.upsert(stored, stored.limit(10), "id"))
    assert "LeftAnti" in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in ("vector_cells",)])
def test_no_query_has_a_cartesian_product(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    # the only nested loops are those with a broadcast row of sums
    assert text.count("BroadcastNestedLoopJoin") == 0 or name.startswith(("bm25", "hybrid", "rrf", "fusion", "rerank"))


def test_postings_are_listed_without_an_aggregation_of_tokens(stored):
    text = plan(bm25.postings(stored, "repo"))
    assert "Aggregate" not in text and "Generate" not in text and "MapInArrow" in text


def test_terms_are_counted_without_lists_of_tokens_in_the_shuffle(spark, sf_dir):
    text = plan(catalogue.QUERIES["postings_terms"](spark, sf_dir))
    assert "collect_list" not in text and "posexplode" not in text and "HashAggregate" in text
