import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from repoatlas import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from repoatlas.session import get_spark
spark = get_spark("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print("ROWS", entry.queries()["knn_topk"](spark, "/root/testdata/sf0.001").count())
print("FOLDER", spark.sparkContext.getCheckpointDir())
"""


def test_workers_have_the_package_wherever_a_job_starts(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    said = dict(line.split(" ", 1) for line in done.stdout.splitlines() if " " in line)
    assert int(said["ROWS"]) > 0, done.stderr[-2000:]
    # What was written on the way is deleted at the end.
    assert not os.path.exists(said["FOLDER"].removeprefix("file:"))


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(
        getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda key: None), master="spark://host:7077"
    )
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.use_checkpoint_folder(spark)


def test_tables_are_pruned_when_read_again(spark):
    table = session.cut_lineage(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    plan = table.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan
    assert table.agg({"twice": "sum"}).first()[0] == 90
