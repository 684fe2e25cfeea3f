"""Python operators run where the workers can't import the package."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from tallyfield.session import build_session
from tallyfield.plans import reference
spark = build_session("local[2]", "foreign", **{{"spark.ui.showConsoleProgress": "false"}})
print("rows", reference.connected_transcriptions(spark, {folder!r}).count(), reference.polygon_consensus(spark, {folder!r}).count())
"""


def test_kernels_travel_to_workers_elsewhere(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    code = CODE.format(root=root, folder="/root/testdata/sf0.001")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
