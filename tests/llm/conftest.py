import pytest

LONG = "the cat sat on the mat and looked at the dog " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here today", "en", "a", 5),
    (2, "the quick BROWN fox jumps over the lazy dog and runs away from here today", "en", "b", 5),
    (2, "the quick BROWN fox jumps over the lazy dog and runs away from here today", "en", "b", 5),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n\r ", "en", None, 0),
    (6, "word", "de", "c", 1),
    (7, "WORD", "de", "c", 1),
    (8, LONG, "en", "a", 9),
    (9, LONG + "end", "en", "a", 9),
    (None, "no id here but some words of text", "en", "a", 1),
    (None, None, "fr", None, 1),
    (10, "<|endoftext|> a</s>[INST] & <b> | $ 12 éà 日本 \U0001f600  x\n\nx\nx", "fr", "\U0001f600", 2),
    (11, "1 2 3 ... !!", "fr", "b", 3),
    (12, "one two three four five six seven eight nine ten eleven twelve", "en", "b", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and columns whose names the operators might use themselves."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.selectExpr("*", "'x' as score", "1 as size", "'k' as kept", "0 as a", "0 as id", "'r' as row", "2 as copies", "'d' as digest", "7 as key", "8 as label", "9 as _id", "9 as _kept", "9 as _row", "9 as _class", "9 as mark", "9 as salt", "9 as class")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def twins():
    """Two words whose bytes are the Thue-Morse sequence and its complement: sums over powers of an odd number agree on them."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
