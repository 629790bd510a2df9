"""The entry module without the training-data subpackage."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [("corpus_pipeline.py",), ()])
def test_entry_imports_without_the_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "pulsegrid", tmp_path / "pulsegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [x for x in q if x[:2] == 'op' or x == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, check=True).stdout
    from pulsegrid.plans.reports import REPORTS
    assert int(out.split()[0]) == len(REPORTS)
    assert not [x for x in out.split("[", 1)[1].strip("]\n ").split(",") if x.strip().strip("'").startswith(("op1_", "op2_", "pipeline"))]


def test_upload_texts_stay_in_place(spark):
    """Whatever Spark expects of their sizes, the incidents go to the texts: none is moved to its org's task."""
    from pulsegrid.plans.reports import REPORTS
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = REPORTS["upload_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
