import pytest

#: Columns of documents plus some whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, size long, digest string, fp long, h long, position long, pattern int, kept boolean"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text, source)."""
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "d", 4, 5, 6, 7, True) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, copies and shared ids."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return make_docs(
        [
            (1, None, "a"), (2, "", "a"), (3, "one", None), (4, "two words", ""), (5, long, "a"), (6, long + " end", "b"), (7, "the cat sat on the mat today", "b"),
            (7, "the cat sat on the mat today", "b"), (8, "the  cat sat\non the mat today", "b"), (None, "the cat sat on the mat today", "c"), (None, None, None), (9, "x" * 70_000, "c"),
            (10, "日本語 é 🙂 \x00 tab\tend", "a"), (11, " \t\n", "a"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
