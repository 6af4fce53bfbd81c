import pytest

#: Names that the operators use inside, and some of their results.
CLASHING = "key size u w n fp part bucket batch base wider score copies row rho bin digit rank vec"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING.split())


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text[, source]) rows to a table with further columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1]) if r[1] is not None else None, *CLASHING.split()) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


PROSE = "the mill by the river and the house of stone stand in the valley with the old bridge "


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows, and a row without an id."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, PROSE * 8), (5, PROSE * 8), (6, PROSE * 8), (7, "one"), (8, "one two three four"), (9, None, None), (None, PROSE * 8), (10, "\U0001f600 éè á " * 30)]
