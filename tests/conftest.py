import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from linewise.session import build_session
    s = build_session("local[4]", 4, app="linewise-tests")
    yield s


def files_df(spark, rows, project="p"):
    """rows: list of (path, content) -> canonical files frame."""
    from pyspark.sql import functions as F

    from linewise.sources.corpus import finish_files
    raw = spark.createDataFrame([(project, p, c) for p, c in rows], "project string, path string, content string")
    raw = raw.withColumn("mtime", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return finish_files(raw)
