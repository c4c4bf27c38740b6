import json

from corpusloom import cli
from corpusloom.functions import sql
from corpusloom.sources import sinks
from corpusloom.streaming.listener import MetricsListener


def test_sql_names(spark):
    sql.register(spark)
    row = spark.sql("select normalize_url('Example.com/a/') n, root_domain('http://a.b.co.uk') r, is_safe_egress_url('http://10.0.0.1/') s, extract_page('<title>t</title>', null).title t").first()
    assert tuple(row) == ("https://example.com/a", "b.co.uk", False, "t")
    page = """'<a href="/x">1</a><a href="y">2</a>'"""
    assert [tuple(r) for r in spark.sql(f"select * from extract_links({page}, 'https://a.com/b/')").collect()] == [(0, "https://a.com/x"), (1, "https://a.com/b/y")]


def test_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    cli.main(["--store", store, "crawl", "--urls", "example.com", "http://10.0.0.1", "--label", "first", "--max-depth", "2", "--max-content", "5MB"])
    job = capsys.readouterr().out.strip().splitlines()[-1]
    config = json.loads(sinks.read_table(spark, f"{store}/jobs").first().config)
    assert (config["id"], config["seeds"], config["max_content_size"]) == (job, ["https://example.com"], 5 << 20)
    assert sinks.read_table(spark, f"{store}/tasks").count() == 1
    cli.main(["--store", store, "status", "--job", job])
    assert "first" in capsys.readouterr().out
    (tmp_path / "t.csv").write_text(",track,track\ntrack_id,title,license\n2,T1,Creative Commons Attribution\n5,T2,none\n")
    for expected in ("1", "0"):
        cli.main(["--store", store, "harvest", "fma", str(tmp_path / "t.csv"), "--mirror", "https://m"])
        assert capsys.readouterr().out.strip().splitlines()[-1] == expected
    cli.main(["--store", store, "tracks-export", "--source", "fma", "--output", str(tmp_path), "--include-incomplete"])
    assert json.loads((tmp_path / "summary.json").read_text())["tracks_exported"] == 1


def test_listener(spark):
    class Progress:
        timestamp, numInputRows, batchDuration, stateOperators, name, id, runId, observedMetrics = "2024-01-01T00:00:00.000Z", 5, 7, [], "q", "1", "r", {}

    class Event:
        progress = Progress

    listener = MetricsListener("worker")
    listener.onQueryProgress(Event)
    assert {r.metric: r.value for r in listener.frame(spark).collect()} == {"q_rows_total": 5.0, "q_batch_duration_ms": 7.0, "q_state_rows": 0.0}
