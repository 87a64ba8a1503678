"""Sessions without a configured shared folder, and written tables that go with the session."""
import os
import subprocess
import sys

from modelwatch import session as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import os, sys
sys.path.insert(0, sys.argv[1])
from modelwatch.session import checkpoint_dir, get_session, materialize
from modelwatch.operators import metrics as M
spark = get_session(master="local[2]", shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = checkpoint_dir(spark)
assert folder == checkpoint_dir(spark)
df = spark.createDataFrame([(i % 2, i / 10) for i in range(10)], "y_true int, y_score double")
assert materialize(df).count() == 10 and M.auroc(df).count() == 1
left = folder.replace("file:", "")
assert os.listdir(left + "/modelwatch-scratch")
spark.stop()
print("folder", left)
"""


def test_without_a_configured_folder(tmp_path):
    """An empty configuration folder: our own folder is made, used, and emptied at the end."""
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", CODE, ROOT], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    folder = out.stdout.split("folder ")[1].strip()
    scratch = os.path.join(folder, "modelwatch-scratch")
    assert not os.path.exists(scratch) or not os.listdir(scratch)


def test_written_tables(spark):
    df = spark.range(5).selectExpr("id", "cast(null as string) s", "id / 2 x")
    t = S.write_scratch(df, "t")
    assert t.schema.names == ["id", "s", "x"] and t.count() == 5 and "/modelwatch-scratch/t-" in t._scratch
    S.drop_scratch(t)
    assert not os.path.exists(t._scratch.replace("file:", ""))
    S.drop_scratch(df)                                  # nothing was written for it
