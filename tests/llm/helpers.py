"""Small document tables for the operators' edge cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, start=0):
    rows = [(start + i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, an additional column."""
    rows = [
        (None, "a row without an id", "en", "s1", 19, 1),
        (1, None, None, None, None, 2),
        (2, "", "en", "s1", 0, 3),
        (3, "word " * 30_000, "en", "s2", 150_000, 4),
        (4, "x" * 120_000, "en", "s2", 120_000, 5),
        (5, "same row", "en", None, 8, 6),
        (5, "same row", "en", None, 8, 6),
        (6, " \n\t\n ", "fr", "s3", 5, 7),
    ]
    return spark.createDataFrame(rows, DOCS + ", size long")


def brute(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
