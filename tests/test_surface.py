"""Sinks, command line and streaming."""

import io
import json

import pytest

from lodestone import cli, corpus, sinks
from lodestone.facts import finding
from lodestone.streaming.sources import write_scans

MAZE = "def maze(a, b, c):\n" + "".join(f"{'    ' * k}if a > {k}:\n" for k in range(1, 7)) + "    " * 7 + "return b and c or a\n"


@pytest.fixture
def findings(spark):
    rows = [("unused-function", "/r/a.py", 3, 5, "low", "function `f|g` is never used", "f"), ("unused-file", "/r/c.py", None, None, "medium", "file `c` is never imported or run", None)]
    return finding(spark.createDataFrame(rows, "rule string, path string, line int, column int, confidence string, message string, symbol string"))


def test_sinks(findings):
    assert sinks.human(findings, "dead-code", 2) == "/r/a.py:3:5  function `f|g` is never used\n/r/c.py  file `c` is never imported or run\n\n2 finding(s) in 2 files.\n"
    assert sinks.human(findings.limit(0), "deps", 2) == "No dependency problems found in 2 files.\n"
    doc = json.loads(sinks.to_json(findings, "dead-code", {"files_scanned": 2}))
    assert doc["summary"] == {"files_scanned": 2, "findings": 2} and doc["findings"][0]["symbol"] == "f" and "line" not in doc["findings"][1]
    run = json.loads(sinks.sarif(findings, "/r"))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["note", "warning"] and len(run["tool"]["driver"]["rules"]) == 14
    assert run["results"][0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.py", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 3, "startColumn": 5}}
    assert [r.value for r in sinks.annotations(findings, "/r").collect()] == ["::notice file=a.py,line=3,col=5,title=lodestone unused-function::function `f|g` is never used", "::warning file=c.py,title=lodestone unused-file::file `c` is never imported or run"]
    assert "| `unused-function` | `a.py:3` | function `f\\|g` is never used | low |" in sinks.markdown(findings, 2, "/r", marker=True)
    assert sinks.snapshot(findings, {"files_scanned": 2}, "/r").splitlines()[:3] == ["files_scanned=2", "--", "unused-file\tmedium\tc.py\t-\tfile `c` is never imported or run"]


def test_command_line(spark, tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "x"\n[tool.lodestone]\nexclude = ["old"]\n')
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "b.py").write_text(MAZE)
    (tmp_path / "m.py").write_text(MAZE)
    out = io.StringIO()
    assert cli.main(["health", str(tmp_path)], spark, out) == 1
    text = out.getvalue()
    assert f"{tmp_path}/m.py:1:5  function `maze` has cyclomatic complexity 9 and cognitive complexity 23 over 8 lines" in text
    assert "1 hotspot(s)." in text and "across 1 files" in text
    assert cli.main(["boundaries", str(tmp_path)], spark, out) == 2
    (tmp_path / "pyproject.toml").write_text("[tool.lodestone]\nnonsense = 1\n")
    assert cli.main(["health", str(tmp_path)], spark, out) == 2


def test_corpus(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.py").write_text(MAZE)
    args = (spark, "p", str(tmp_path / "p"), str(tmp_path / "kept"), ("health",))
    corpus.update(*args)
    assert corpus.check(*args) == {}
    kept = tmp_path / "kept" / "p" / "health.txt"
    kept.write_text(kept.read_text().replace("maze", "haze"))
    assert "-complex-function" in corpus.check(*args)["health"]
    (tmp_path / "p" / "m.py").write_text(MAZE + "x = 1\n")
    with pytest.raises(ValueError):
        corpus.check(*args)


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text(MAZE)
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "check"))
    write_scans(*args).awaitTermination(60)
    (src / "b.py").write_text("def broken(:\n")
    write_scans(*args).awaitTermination(60)
    rows = {r.rel_path: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r.resolution for k, r in rows.items()} == {"a.py": "semantic", "b.py": "unparsed"} and rows["a.py"].metrics[0].cyclomatic == 9
