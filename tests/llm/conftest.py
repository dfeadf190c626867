import pytest


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder with the hard rows as tables ``documents`` and ``conversations``."""
    import cases

    base = tmp_path_factory.mktemp("small")
    cases.table(spark).write.parquet(str(base / "documents.parquet"))
    return str(base)
