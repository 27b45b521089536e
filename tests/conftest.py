import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskflow.session import get_spark
    s = get_spark("local[4]", 4, app="riskflow-tests", extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskflow-test-ckpt-"),
        "spark.driver.memory": "4g",
    })
    yield s
    s.stop()


@pytest.fixture(scope="session")
def txn_schema():
    return ("txn_id long, card long, channel string, amount double, t long, addr int, "
            "p_email string, r_email string, is_fraud int, score double, D1 long")
