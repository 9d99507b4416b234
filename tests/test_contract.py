"""The driver's entry points, with and without the numbered operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("secondcart.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = set(entry.queries())
assert "cohort_funnel" in names and "pipeline" not in names
assert not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) <= names
assert not any(m.startswith("secondcart.llm") for m in sys.modules)
"""


def test_everything_else_works_without_the_numbered_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_a_rewritten_folder_is_read_again(spark, folder, tmp_path):
    from secondcart.plans import queries

    for name in ("orders", "customer", "nation", "lineitem", "part", "documents", "labels"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    before = queries.cohort_funnel(spark, str(tmp_path)).first()["n_customers"]
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_custkey % 2 = 0")
    orders.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    after = queries.cohort_funnel(spark, str(tmp_path)).first()["n_customers"]
    assert 0 < after < before
