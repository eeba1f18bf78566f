import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long, seen string"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (id, text[, source]) rows, with columns whose names clash with those that operators use."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, 8, None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and blank texts, a very long one, repeated rows, ties."""
    long = " ".join(f"word{i % 5000}x" for i in range(120_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "a b c d e f"), (None, None), (6, long), (7, "ünïcödé Ünïcödé 漢字 🙂 text here now")]
