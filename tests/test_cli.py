import json

from runsieve.__main__ import main


def test_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "s")
    for n, part in enumerate(('<failure message="timed out"/>', "")):
        (tmp_path / f"r{n}.xml").write_text(f'<testsuite name="s"><testcase classname="a.b" name="t">{part}</testcase></testsuite>')
        main(["--store", store, "ingest", str(tmp_path / f"r{n}.xml"), "--sha", "c1", "--run-id", f"r{n}", "--started-at", f"2024-01-01T0{n}:00:00Z"])
    capsys.readouterr()
    main(["--store", store, "triage", "--format", "json"])
    found = json.loads(capsys.readouterr().out)["detections"]
    assert [(d["display_name"], d["verdict"], d["cause"]) for d in found] == [("a/b::t", "flaky", "TIMING_DEPENDENCY")]
    main(["--store", store, "detect"])
    assert "flaky" in capsys.readouterr().out
    main(["--store", store, "policy", "--root", str(tmp_path), "--apply"])
    assert "insufficient_observations" in capsys.readouterr().out
    main(["--store", store, "stats", "--prometheus"])
    assert "runsieve_classifications 1\n" in capsys.readouterr().out


def test_eval(spark, tmp_path, capsys):
    shapes = [("INFRA_FLAKE", "no space left on device"), ("UNKNOWN", "odd"), ("REAL_REGRESSION", "deadline exceeded")]
    rows = [{"id": str(k), "label": c, "failure_message": m, "adversarial": k == 1} for k, (c, m) in enumerate(shapes)]
    (tmp_path / "c.json").write_text(json.dumps({"corpus_version": "1", "examples": rows}))
    main(["eval", str(tmp_path / "c.json")])
    out = capsys.readouterr().out
    assert "| accuracy | 66.7% |" in out and "| dangerous error rate | 100.0% |" in out
