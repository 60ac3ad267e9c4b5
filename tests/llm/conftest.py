import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    from gradeframe.llm.queries import reachable

    reachable(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with extra columns whose names clash."""

    def make(rows, parts=3):
        data = [(i, t, "en", None, 1, True, 0.5) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_tokens long, kept boolean, score double").repartition(parts)

    return make
