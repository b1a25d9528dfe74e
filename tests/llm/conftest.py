import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, with further columns whose names clash with those that operators use inside."""

    def make(rows, **more):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1, "x", 0, -2, "y") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size int, k int, `group` string")

    return make
