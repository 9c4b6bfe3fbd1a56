"""Queries of lint detectors where words have letters outside of ASCII: RE2's words are ASCII, whatever the engine."""

import os

import pytest

import __spark_entry__ as entry

TEXTS = [
    "una acción y y y fin", "é a b c d", "a b c dé", "é a b c", "a b c d", "xa b c d e", "é<bé>", "<é>", "<ſ>", "<KK x", "<aſ", "<ı>", "<İ>", "ſtyle=x", "STYLE=", "boſrder=", "plain", "",
    None, "a b c d́ ó y y y y,", "日本 a b c d語", "x" * 40 + "\n ón y y y " + "z" * 40, "ó" + "a " * 30_000 + "b",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("words"))
    rows = [(k, x, "es" if k % 2 else "de", f"s{k % 3}") for k, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, x) for k, x, *_ in rows], "page_id long, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["lint_summary", "lint_findings", "lint_pages", "lint_totals", "report_pieces", "resumed_run"])
def test_words_are_ascii(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(folder, t)}.parquet/*.parquet')")
    got = entry.queries()[name](spark, folder)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in got.columns]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    sql = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
    assert len(rows) == len(sql) and not (set(rows) ^ set(sql)), sorted(set(rows) ^ set(sql), key=repr)[:6]
