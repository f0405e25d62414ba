import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_import_the_shipped_package(tmp_path):
    """Driver in another folder, package only on its own path."""
    (tmp_path / "AA_1.csv").write_text("Symbol,Shares\nAAA,1\n")
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from lotframe.session import ship_package
        from lotframe.sources.grid import read_grid
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        ship_package(spark)
        print("rows", read_grid(spark, [{str(tmp_path / "AA_1.csv")!r}]).count())
    """))
    env = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
