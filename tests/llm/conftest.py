import pytest

pytest.importorskip("plumbline.llm")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and white texts, repeated rows, a long text, clashing extra columns."""
    rows = [(1, "a b c d e f g", 5), (1, "a b c d e f g", 5), (2, None, None), (3, "", 1), (4, " \t\n", 1), (None, "orphan text here", 2), (None, None, None), (5, "word " * 30_000, 3), (6, "A B C D E F G", 4), (7, "ü" * 700, 9)]
    return spark.createDataFrame([(i, t, s, s, "x", "y", 0) for i, t, s in rows], "doc_id long, text string, score int, node int, key string, ids string, held_out int")
