import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, with an extra column of a clashing name."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", None if t is None else len(t), i) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")

    return make


@pytest.fixture(scope="session")
def saved(tmp_path_factory):
    """Writes tables by name into a folder and returns its path."""

    def make(**tables):
        d = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return make
