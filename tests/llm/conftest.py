import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(rows): a table like documents from (doc_id, text[, source[, lang]])."""

    def make(rows):
        full = [(i, t, *(list(rest[1:2]) or ["en"]), *(list(rest[:1]) or ["s"]), len(t or "")) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture
def tables(tmp_path):
    """tables(name=DataFrame): a folder of Parquet tables."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
