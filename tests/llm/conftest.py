import pytest

from strandline.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, row string, key string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, repeated rows, characters of several bytes."""
    passage = "A passage of some length that turns up in more than one document, word for word, and is long enough to count as repeated here; " * 2
    words = " ".join(f"word{i}" for i in range(120))
    return [
        (1, "Hello world, it's  a\n\n test.\tTabs and é", "en"), (2, None, None), (3, "", "en"), (None, "no id", "en"),
        (5, words, "en"), (6, words, "en"), (6, words, "en"), (7, words + " more", "de"), (8, "aaaa" * 200, "en"),
        (9, "x" + passage + "y" * 50, "en"), (10, "ü" + passage + " z" * 300, "en"), (11, "日本語 " * 90 + "▁ <|endoftext|> <0x0A>", "ja"),
        (12, " lead and trail ", "en"), (13, "\n \n\t", "en"), (14, "To To To To " * 200, "en"), (15, "&&& ### " * 100, "en"), (16, "long" * 30_000, "en"),
    ]


@pytest.fixture(scope="session")
def odd(llm, odd_texts):
    """The same as documents, with columns whose names the operators use themselves."""
    return llm.createDataFrame([(i, t, g, "r", "k", len(t or "")) for i, t, g in odd_texts], SCHEMA)


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], SCHEMA)
