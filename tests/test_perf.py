"""The measuring tool on small folders."""

from __future__ import annotations

import csv
import json
import os
import sys

from graftline import perf

CODE = "def f(a):\n    b = a + 1\n    for i in range(b):\n        print(i)\n    return b\n"


def folder(tmp_path):
    (tmp_path / "src" / "vendor").mkdir(parents=True)
    (tmp_path / "src" / ".git").mkdir()
    for name in ("a.py", "b.PY", "notes.txt", "vendor/c.py", ".git/d.py", "docs.md"):
        (tmp_path / "src" / name).write_text(CODE)
    return tmp_path / "src"


def test_census_and_config(tmp_path):
    root = folder(tmp_path)
    assert perf.census(root, []) == (3, 15)
    conf = tmp_path / "repos.toml"
    conf.write_text(f'[defaults]\ntimeout = 5\nodd = 1\n[[repos]]\nname = "one"\npath = "{root}"\nignore_dirs = ["x"]\nodd = 2\n[[repos]]\nname = "off"\nenabled = false\n')
    defaults, repos = perf.load(conf)
    assert defaults.timeout == 5 and [r.name for r in repos] == ["one", "off"] and repos[0].root(defaults) == root
    assert perf.main([str(conf), "--dry-run", "--output-dir", str(tmp_path / "out")]) == 0
    rows = list(csv.DictReader(open(tmp_path / "out" / "results.csv")))
    assert [(r["name"], r["src_files"], r["results"]) for r in rows] == [("one", "3", "-1")]
    assert json.loads((tmp_path / "out" / "results.json").read_text())[0]["src_lines"] == 15


def test_stages_and_results(tmp_path):
    log = "WARN x\nparse: 12 in 1.5 s\nverify: 2 in 0.3 s\nother: 9 in 1.0 s\n"
    assert perf.stages(log) == ({"parse": 12, "verify": 2}, {"parse": 1.5, "verify": 0.3})
    good = tmp_path / "a.sarif"
    good.write_text(json.dumps({"runs": [{"results": [1, 2]}, {}]}))
    assert perf.sarif_results(good) == 2 and perf.sarif_results(tmp_path / "none") == -1
    assert perf.resident_mb(os.getpid()) > 10


def test_time_limit_and_clone(tmp_path, monkeypatch):
    root = folder(tmp_path)
    slow = tmp_path / "slow"
    slow.write_text("#!/bin/sh\nsleep 60\n")
    slow.chmod(0o755)
    monkeypatch.setattr(sys, "executable", str(slow))
    got = perf.run(perf.Repository("one", path=str(root)), perf.Defaults(timeout=0.5, interval=0.1), tmp_path / "out")
    assert got.timed_out and got.results == -1 and got.rss_samples and got.row()["n_parse"] == -1
    try:
        perf.clone(perf.Repository("two"), tmp_path / "none")
        raise AssertionError
    except ValueError as e:
        assert "url" in str(e)
    perf.clone(perf.Repository("one"), root)
