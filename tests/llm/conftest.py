import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, host string, fp string, node long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in all columns, empty, tiny and long texts, repeated rows, shared ids, and columns that clash with inner names."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    para = " ".join(f"passage{i}" for i in range(60))
    texts = {1: "Hello world, it's  a test <|endoftext|> über 漢字 \U0001f600", 2: "", 3: None, 4: "   \n\t ", 5: long, 6: para, 7: "start " + para + " end", 8: para + "\nother line", 9: "a" * 350, 10: "one two", 11: para}
    rows = [(k, t, None, f"s{k % 2}", None, 1, None, "x", 2) for k, t in texts.items()]
    rows += [(11, para, "en", None, 5, None, "h", None, None), (1, "another text under a used id", "en", "s1", 3, 1, "h", "f", 1), (None, "no id at all, " + para, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
