import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("runlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g")
         # tests only: the cluster names its shared folder; here none is set
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="runlens-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def write_jsonl(tmp_path):
    """Write dict rows as NDJSON files: write_jsonl({"a.jsonl": [rows]}) -> dir."""
    import json

    def _write(files: dict, sub: str = "results"):
        d = tmp_path / sub
        d.mkdir(exist_ok=True)
        for name, rows in files.items():
            with open(d / name, "w") as f:
                for r in rows:
                    f.write(r if isinstance(r, str) else json.dumps(r))
                    f.write("\n")
        return str(d)
    return _write
