import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Synthetic credentials, assembled at run time (never stored as literals).
FAKE_AWS = "AKIA" + "QZ7X4NPLMR3TVK9D"
FAKE_STRIPE = "sk_" + "live_" + "51H8xQpKj2mNvRt7bZaYcXwEr"
FAKE_GH = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
FAKE_DSN = "postgresql://admin:" + "hunter2ZxQ" + "@db.shop.test:5432/prod"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codeaudit.session import get_spark
    s = get_spark(app="codeaudit-tests", master="local[4]", shuffle_partitions=4,
                  extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def make_files(spark):
    """files table from (path, content[, tracked]) tuples in one repo 'r'."""
    from pyspark.sql import functions as F

    from codeaudit.sources.tables import file_columns

    def build(rows, repo="r"):
        norm = [(repo, r[0], r[1], r[2] if len(r) > 2 else True) for r in rows]
        df = spark.createDataFrame(norm, "repo_id string, path string, content string, tracked boolean")
        f = file_columns(df.select("repo_id", "path", "content")).drop("tracked")
        return f.join(df.select("repo_id", "path", "tracked"), ["repo_id", "path"]).select(
            "repo_id", "path", "name", "dir", "ext", "size", "tracked", "content").withColumn(
            "size", F.col("size"))
    return build


def ids(df):
    return {r["id"] for r in df.select("id").collect()}
