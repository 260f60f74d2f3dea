import pytest

from voxlab.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size long, spans string, row_key string, _id long"


def rows_of(pairs):
    """Rows (doc_id, text, lang, source) with extra columns whose names the operators use themselves."""
    return [(i, t, la, s, len(t) if t is not None else None, 0.5, "x", 7, "y", "z", 3) for i, t, la, s in pairs]


@pytest.fixture(scope="session")
def frame(spark):
    ship_package(spark)

    def make(pairs):
        return spark.createDataFrame(rows_of(pairs), SCHEMA)
    return make


LONG = "the long text goes on and on with words of every kind " * 4000

ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "one two", "en", "b"),
    (5, "Zażółć gęślą jaźń 😀 mail me at a.b@c.org or +1 (212) 555-0100", "pl", None), (6, LONG, "en", "b"), (7, "one two three four five", None, "c"),
    (7, "one two three four five six", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)
