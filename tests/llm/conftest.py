import pytest

from helpers import write_tables


@pytest.fixture(scope="session")
def llm_tables(spark, tmp_path_factory):
    """Small tables with nulls, empty texts, ties and repeated rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    write_tables(spark, folder)
    return folder
