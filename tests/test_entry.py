import subprocess
import sys

from tests.conftest import ROOT


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark, tmp_path):
    import __spark_entry__

    rows = [(1, "One two three. Four five.", "en", "a", 25), (2, "Six. Seven eight.", "en", "b", 17), (3, "Nein.", "de", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r["quality"]: r for r in __spark_entry__.queries()["flagship_style_by_quality"](spark, str(tmp_path)).collect()}
    assert out[1]["n"] == 1 and out[1]["sl_mean"] == 2.5 and out[0]["sl_mean"] == 1.5
