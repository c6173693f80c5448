import glob
import os

import duckdb
import pytest
from helpers import SF
from quillmere.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    s = session(4, **{"spark.sql.warehouse.dir": str(root / "warehouse"), "spark.checkpoint.dir": f"file://{root}/shared", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c
