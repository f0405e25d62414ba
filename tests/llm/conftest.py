import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table; rows are (doc_id, text[, lang[, source]])."""

    def build(rows, extra="", more=()):
        full = [(*row, *(None,) * (4 - len(row)), None if row[1] is None else len(row[1]), *more) for row in rows]
        return spark.createDataFrame(full, COLUMNS + extra)

    return build
