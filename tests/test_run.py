from siltlog.__main__ import main
from siltlog.plans import reports
from siltlog.plans import store as store_
from siltlog.plans.run import Config, read_ledger, run


def _line(ip, url="/", http=200):
    return f'{ip} site.com - [20/Feb/2015:05:57:23 +0000] "GET {url} HTTP/1.1" {http} 10 "-" "ua"\n'


def test_runs_add_up(spark, tmp_path, capsys):
    logs, store, rules = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "rules")
    logs.mkdir()
    (logs / "access.log").write_text(_line("1.1.1.1") + _line("2.2.2.2", "/a") + _line("2.2.2.2", "/b.png") + _line("3.3.3.3", "/c", 404))
    out = run(spark, Config(str(logs), store, rules, exclude=[404], secondary=True))
    assert sorted((r.ip, r.url) for r in out["entries"].collect()) == [("1.1.1.1", "/"), ("2.2.2.2", "/a")] and out["rejected"].count() == 0
    (logs / "access.log.2").write_text(_line("2.2.2.2", "/wp-admin/") + _line("4.4.4.4"))
    out = run(spark, Config(str(logs), store, rules, exclude=[404], secondary=True, timestamps=True, save=str(tmp_path / "blocked")))
    assert sorted(r.ip for r in out["entries"].collect()) == ["1.1.1.1", "4.4.4.4"]
    assert [r.ip for r in out["new_blocked"].collect()] == ["2.2.2.2"] == [r.value for r in spark.read.text(str(tmp_path / "blocked")).collect()]
    assert out["files"].count() == 1 and sorted(r.records for r in read_ledger(spark, store).collect()) == [1, 2]
    for name, report in reports.REPORTS.items():  # the store that runs leave is what reports read
        assert report(store_.read(spark, store), reports.Settings(host="site")).count() >= 0, name
    assert [r.N for r in reports.q14(store_.read(spark, store), reports.Settings()).collect()] == [2]
    assert spark.read.parquet(f"{store}/entries").count() == 2  # stored rows of 2.2.2.2 are gone
    (tmp_path / "known").write_text("4.4.4.4\n")
    main(["-e", "404", "-y", "-d", rules, "-f", str(tmp_path / "known"), store, str(logs)])
    assert "2 blocked; 1 entries stored" in capsys.readouterr().out


def test_all_new_blocked(spark, tmp_path):
    logs, store, rules = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "rules")
    logs.mkdir()
    ips = [f"7.{k // 250}.{k % 250}.9" for k in range(1500)]
    (logs / "access.log").write_text("".join(_line(i, "/wp-admin/") for i in ips[:1200]))
    assert sorted(r.ip for r in run(spark, Config(str(logs), store, rules))["new_blocked"].collect()) == sorted(ips[:1200])
    (logs / "access.log.2").write_text("".join(_line(i, "/wp-admin/") for i in ips))
    assert sorted(r.ip for r in run(spark, Config(str(logs), store, rules, timestamps=True))["new_blocked"].collect()) == sorted(ips[1200:])
