"""The package reaches Python workers that share no path with the driver."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys
sys.path.insert(0, {repo!r})
from ringfold.session import session
from ringfold.llm import entry
spark = session("local[2]", 2, **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {folder!r}}})
spark.sparkContext.setLogLevel("OFF")

def where(batches):
    import pyarrow as pa
    import ringfold.llm
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([ringfold.llm.__file__])], names=["file"])

rows = entry.op2_language_id(spark, {sf!r}).count()
files = {{r.file for r in spark.range(4).mapInArrow(where, "file string").collect()}}
print("FOUND", rows, *files)
"""


def test_workers_get_the_package_as_a_zip(tmp_path, sf):
    code = CODE.format(repo=REPO, folder=str(tmp_path / "checkpoints"), sf=sf)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    found = next((x for x in out.stdout.splitlines() if x.startswith("FOUND")), out.stderr[-2000:])
    assert found.split()[1] == "200" and all("ringfold.zip" in f for f in found.split()[2:]), found
