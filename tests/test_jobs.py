"""The command-line jobs, end to end."""

import json

from doorflux import __main__ as jobs
from workloads import fixtures as fx


def test_load_and_dashboard(spark, sf_dir, tmp_path, capsys):
    feeds = {
        "dbo.store": fx.raw_stores(spark, sf_dir),
        "dbo.num_crowd": fx.raw_traffic(spark, sf_dir),
        "dbo.ErrLog": fx.dirty_errors(spark, sf_dir),
    }
    root = str(tmp_path / "warehouse")
    sources = []
    for name, feed in feeds.items():
        feed.write.parquet(str(tmp_path / name))
        sources += ["--source", f"{name}={tmp_path / name}"]
    (tmp_path / "rules.json").write_text('{"error_rows": 7}')
    rules = ["--rules", str(tmp_path / "rules.json")]
    spark.sql(f"CREATE DATABASE jobs LOCATION '{tmp_path}/jobs'")
    assert jobs.main(["load", "--warehouse", root, "--database", "jobs", *rules, *sources]) == 0
    assert [r.status for r in spark.read.json(f"{root}/last_run").collect()] == ["succeeded"] * 3
    assert spark.table("jobs.v_traffic_normalized").count() == 1000
    (tmp_path / "low.json").write_text('{"outlier_threshold": 5}')
    jobs.main(["view", "--warehouse", root, "--database", "jobs", "--rules", str(tmp_path / "low.json")])
    assert spark.table("jobs.v_traffic_normalized").selectExpr("max(in_count)").first()[0] <= 5
    assert spark.sql("SELECT jobs.cap_outlier(7), jobs.cap_outlier(3)").first()[:] == (0, 3)
    spark.sql("DROP DATABASE jobs CASCADE")
    jobs.main(["stores", "--warehouse", root, "--out", str(tmp_path / "stores")])
    assert spark.read.json(str(tmp_path / "stores")).count() > 1
    out = tmp_path / "out"
    jobs.main([
        "dashboard", "--warehouse", root, "--out", str(out),
        "--period", "month", "--start", "2024-01-05", "--end", "2024-01-19", *rules,
    ])
    assert spark.read.json(str(out / "sections/section=error_logs")).count() == 7
    preset = ["--period", "default", "--as-of", "2024-01-19", "--out", str(tmp_path / "preset")]
    jobs.main(["dashboard", "--warehouse", root, *preset])
    assert (tmp_path / "preset/bao_cao_default_2024-01-01_2024-01-19.csv").is_dir()
    [metrics] = (out / "sections" / "section=metrics").glob("*.json")
    body = json.loads(json.loads(metrics.read_text())["body"])
    assert body["total_in"] > 0 and body["peak_time"].count("/") == 1
    assert list(out.glob("bao_cao_month_2024-01-05_2024-01-19.csv/*.csv"))
    jobs.main(["compact", "--warehouse", root])
    # a table that fails is told by the exit code
    assert jobs.main(["load", "--warehouse", root, "--out", str(tmp_path / "run"), *sources[:4]]) == 1
    landing = str(tmp_path / "landing")
    feeds["dbo.num_crowd"].write.parquet(landing)
    streaming = ["--table", "dbo.num_crowd", "--landing", landing, "--checkpoint", str(tmp_path / "checkpoint")]
    assert jobs.main(["stream", "--warehouse", str(tmp_path / "streamed"), "--distinct-within", "1 day", *streaming]) == 0
    assert "arrived" in capsys.readouterr().out
