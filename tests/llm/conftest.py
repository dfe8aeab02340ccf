import pytest

#: Ids that are missing, repeated or tied; texts that are null, empty, blank, short, long, repeated or not Latin.
LONG = "\n".join(f"Line {i} of a long text has its own words, number {i * 7919 % 1000}, and ends here." for i in range(3000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThis is a second line of it.\nAnd a third.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog.\nThis is a second line of it.\nAnd a third.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog.\nThis is a second line of it.\nAnd a third.", "en", "a"),
    (None, "No id here, but a text.", None, None),
    (None, None, None, None),
    (5, None, "en", "b"),
    (6, "", "de", "b"),
    (7, " \n\t\r\n ", "de", None),
    (8, "Übergröße ДОМ 東京 naïve 😀 é <|endoftext|> \x00 \x0b\x1c", "xx", "c"),
    (9, LONG, "en", "c"),
    (10, "word", "en", "\U0001f600"),
]
EXTRA = ["id", "t", "v", "c", "w", "h", "fp", "n", "size", "lines", "list", "start", "kept", "n_tokens", "chunk", "prefix"]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with columns whose names operators use inside."""
    rows = [(*r, len(r[1] or ""), *[i] * len(EXTRA)) for i, r in enumerate(ROWS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample():
    """A small folder of the shared tables."""
    return "/root/testdata/sf0.001"
