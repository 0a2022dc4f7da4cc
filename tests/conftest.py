import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from locale_lake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # tiny inputs: compiling generated code would take longer than running it
    session = local_session(
        4,
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.sql.codegen.wholeStage": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def compiled(spark):
    """The session as it runs in production, with whole-stage code generation."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
