"""A fixture of the tests beside."""
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """A documents table from (doc_id, text) pairs, over a few partitions."""

    def build(rows, parts=3):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(parts)
    return build
