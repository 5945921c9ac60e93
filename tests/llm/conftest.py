import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_data import DOCUMENTS, messy_documents  # noqa: E402


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Write tables to a new folder and give its path."""

    def run(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return run


@pytest.fixture(scope="session")
def messy(write):
    return write(documents=(messy_documents(), DOCUMENTS))


@pytest.fixture(scope="session")
def no_documents(write):
    return write(
        documents=([], DOCUMENTS),
        labels=([], "doc_id long, quality int, toxic int"),
        pages=([], "page_id long, url string, html string"),
        embeddings=([], "vec_id long, embedding array<float>, label int"),
    )
