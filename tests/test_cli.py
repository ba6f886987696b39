"""The command line over a small tree."""

import io
import json

import pytest

from strataflow.__main__ import run


def test_commands(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/go.mod").write_text("module m\n")
    (tmp_path / "src/a.go").write_text("package m\n\nfunc Start() { Stop() }\n\nfunc Stop() {}\n")

    def call(*arguments):
        out = io.StringIO()
        return run(spark, ["--store", f"file://{tmp_path}/store", *arguments], out), out.getvalue()

    assert call("inspect", "Stop")[0] == 2
    assert json.loads(call("index", f"file://{tmp_path}/src")[1]) == {"graphVersion": 1}
    code, text = call("query", "who calls Stop?")
    answer = json.loads(text)
    assert code == 0 and answer["graphVersion"] == 1 and answer["result"]["evidence"][0]["edges"] == [["go:function:a.go#Start", "go:function:a.go#Stop", "go:calls"]]
    assert json.loads(call("path", "a.go::Start", "a.go::Stop")[1])["result"]["path"] == [["go:function:a.go#Start", "go:function:a.go#Stop", "go:calls"]]
    assert call("path", "a.go::Stop", "a.go::Start")[0] == 1
    assert "go:function:a.go#Start" in call("--text", "query", "a.go::Start", "--depth", "1")[1]
    code, text = call("inspect", "a.go::Stop")
    assert code == 0 and {e["relation"] for e in json.loads(text)["result"]["edges"]} == {"defines", "go:calls"}
    assert call("export", f"file://{tmp_path}/out", "--kind", "go:function")[0] == 0 and spark.read.parquet(f"file://{tmp_path}/out/nodes").count() == 2
    with pytest.raises(SystemExit):
        call("nonsense")
