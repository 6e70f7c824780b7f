"""Small shared helpers of the llm tests."""

import duckdb

ROOT = "/root/testdata"


def documents(sf):
    """(doc_id, text) rows of a documents table."""
    return duckdb.sql(f"select doc_id, text from '{ROOT}/{sf}/documents.parquet' "
                      "order by doc_id").fetchall()


def make_docs(spark, rows):
    """A documents table with the generator's columns."""
    return spark.createDataFrame(
        [(d, t, "en", "s", len(t or "")) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
