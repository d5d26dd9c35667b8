import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, a repeated row, repeated ids, one long text, columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and then it slept", "a", "en", 1),
        (1, "the cat sat on the mat and then it slept", "a", "en", 1),
        (2, "", "a", None, 2),
        (3, None, None, "en", None),
        (None, "a text without an id", "b", "en", 4),
        (4, " \t\n ", "b", "de", 5),
        (5, "Ünïcode 世界 " * 40, "b", "de", 6),
        (6, "word " * 30_000, None, "fr", 7),
        (7, "x", "c", "fr", 8),
        (7, "another text of the same id", "c", "fr", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long").withColumnsRenamed({}).selectExpr("*", "size as n", "size as id", "text as key", "size as position", "source as v", "size as taken", "text as line", "size as component_id", "size as _gone", "size as _mix_at", "text as _mix_copy", "text as _mix_key", "size as at", "size as row", "text as rest", "size as `a.b`", "map('k', size) as kept")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
