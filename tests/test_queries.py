"""Every registered catalogue query against its SQL twin; those without one must run and keep their schema."""

import re

import pytest

from mediarill.plans.catalog_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, same_rows, run_sql):
    same_rows(QUERIES[name](spark, sf), run_sql(ORACLES[name], sf))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plain_prompts(text: str) -> tuple[str | None, str | None]:
    """Prompt and negative prompt of a settings text, its settings cut off."""
    head = re.split(r"\bSteps:\s*\d", text, maxsplit=1)[0].rstrip(" \n,")
    prompt, _, negative = head.partition("Negative prompt:")
    return prompt.strip()[:2000] or None, negative.strip()[:1000] or None


def test_prompts_of_several_lines(spark, tmp_path):
    texts = ["a cat\non a mat\nNegative prompt: dog,\nblurry", "one line", "first\n\n  last  ", "word\n" * 700, "head\nmore\nSteps: 9, Model: m1", "\nlate"]
    docs = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(k, t, f"src{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(docs)
    found = {r["doc_id"]: r["settings"] for r in QUERIES["f23_parse_infotext"](spark, f"file://{tmp_path}").collect()}
    graphs = {r["doc_id"]: r["prompt"] for r in QUERIES["f24_parse_node_graph"](spark, f"file://{tmp_path}").collect()}
    for k, t in enumerate(texts):
        assert (found[k].get("prompt"), found[k].get("negative_prompt")) == plain_prompts(t)
        assert (found[k]["steps"], found[k]["sampler"], found[k]["hires_size"]) == (str(k), "Euler, a", "1024x1536")
        assert graphs[k] == t.strip()[:2000]
