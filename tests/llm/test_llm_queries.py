"""Queries of the text operators: those with SQL against it, all of them over whole tables."""

import pytest
from compare import open_tables, spark_table, sql_table

from surveyloom.llm.queries import ENTRIES

FOLDER = "/root/testdata/sf0.001"
# The table a query covers and its key, where that is not documents.
TABLES = {"op10_html_text": ("pages", "page_id"), "op8_site_lines": ("pages", "page_id"),
          "op12_conversation_repair": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_query_equals_its_sql(spark, name):
    assert spark_table(ENTRIES[name].run(spark, FOLDER)) == sql_table(open_tables(FOLDER), ENTRIES[name].sql)


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - {"op11_hard_negatives"}))  # a row per anchor and positive
def test_query_covers_its_table(spark, name):
    found = ENTRIES[name].run(spark, FOLDER)
    table, key = TABLES.get(name, ("documents", "doc_id"))
    wanted = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in found.select(key).collect()} == wanted
