import pytest


@pytest.fixture
def docs_of(spark):
    """A documents-like table of texts; ids count from 0."""

    def make(texts, extra=False):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        if extra:
            for name in ("id", "shard", "pos", "key", "line", "fp", "term", "size", "component", "_gone"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
