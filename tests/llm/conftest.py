import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    from regstat.deploy import ship_package

    ship_package(spark)
    long_text = "lorem ipsum dolor sit amet " * 4000
    rows = [(1, "one two three four five six", "en", "a", 1), (2, None, None, None, None),
            (3, "", "en", "a", 0), (4, "  \n\t ", "en", "a", 5), (5, long_text, "en", "a", 9),
            (6, "One TWO three four five six", "en", "b", 1), (6, "One TWO three four five six", "en", "b", 1),
            (None, "no id here at all", "en", "c", 4), (7, "Ünïcödé 日本語 ’s  double  space\u00a0x", "de", "a", 3),
            (8, "a", "en", "a", 1), (9, "one two three four five six", "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
