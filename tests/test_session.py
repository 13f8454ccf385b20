"""The work folder where Spark's defaults name none, and tables that are deleted by their owners."""

import os
import subprocess
import sys
import time

from planwright.session import bucketed, clear_work, discard, folder_of, materialize

BARE = """
from planwright.session import build_session, clear_work, discard, materialize, work_dir
spark = build_session("bare", master="local[1]", shuffle_partitions=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept, gone = materialize(spark.range(3), "kept"), materialize(spark.range(4), "gone")
assert kept.count() == 3 and gone.count() == 4 and work_dir(spark) == work_dir(spark)
discard(gone)
print("left", clear_work(spark))
"""


def test_work_folder_without_defaults(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", BARE], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0 and "left 1" in done.stdout, done.stderr[-2000:]


def test_tables_go_with_their_catalogue_entries(spark):
    clear_work(spark)
    plain, table = materialize(spark.range(5), "plain"), bucketed(spark.range(6), 2, "id", "by-id")
    assert plain.count() == 5 and table.count() == 6 and folder_of(spark.range(1)) is None
    named = [t.name for t in spark.catalog.listTables() if t.name.startswith("by_id")]
    discard(table)
    assert len(named) == 1 and named[0] not in [t.name for t in spark.catalog.listTables()]
    assert clear_work(spark) == 1 and clear_work(spark) == 0


def test_writing_a_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key)
    materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    bucketed(spark.range(1000), 3, "id", "dealt")
    for _ in range(100):  # they go in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == setting
    clear_work(spark)
