import pytest

#: Columns that have the names of ours.
EXTRA = "size long, n long, score double, shard int, slot int, kept_text string, n_lines long, key string, rank int"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents of (doc_id, text[, source[, lang]]) with further columns whose names clash."""

    def build(rows):
        full = [(i, t, lang[0] if (lang := rest[1:2]) else "en", rest[0] if rest else "s0", None if t is None else len(t), 1, 2, 3.0, 4, 5, "x", 6, "k", 7) for i, t, *rest in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return build


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "same text here\nsame text here"), (6, "same text here\nsame text here"), (6, "same text here\nsame text here"), (7, "é ünï 漢字 text"), (None, "a row without an id")]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(EDGES)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
