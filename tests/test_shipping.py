"""Executors get the package: a query with Python workers runs from another folder."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        f"spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\n"
        "from tessera.plans.registry import QUERIES\n"
        f"assert QUERIES['relation_rings'](spark, {str(SF)!r}).count() > 0\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
