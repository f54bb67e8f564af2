import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_import_the_package_from_anywhere(tmp_path):
    """The driver alone knows where the package is; Python workers get it shipped."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from acrely.session import local_session, prepare
        spark = local_session(2, memory="1g")
        prepare(spark)
        from acrely.operators import isolation
        rows = spark.range(200).selectExpr("cast(id as double) as a", "cast(id % 7 as double) as b")
        assert isolation.fit(rows, ["a", "b"], trees=3, sample=16).score(rows).count() == 200
        print("fine")
        """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
