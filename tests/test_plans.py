import json

import pytest

from modweave.plans import model as M


def plan():
    return M.plan_of_edits("edit", {"/a.ts": ("one\n", "two\nthree\n"), "/same.ts": ("x", "x")})


def test_round_trip(tmp_path, spark):
    path = str(tmp_path / "plan.json")
    M.write_plan(plan(), path)
    assert M.read_plan(path) == plan().__class__(**{**vars(plan()), "timestamp": M.read_plan(path).timestamp})
    rows = M.changes(M.plans(spark, path)).collect()
    assert [(r["type"], r["path"]) for r in rows] == [("modify-file", "/a.ts")]


@pytest.mark.parametrize("raw", [[], {}, {"version": 1}, {"version": "1", "command": "c", "timestamp": "t", "checksums": {}, "changes": [{"type": "odd", "path": "p"}]}, {"version": "1", "command": "c", "timestamp": "t", "checksums": {}, "changes": [{"type": "create-file", "path": "p"}]}])
def test_malformed_plans(raw):
    with pytest.raises(M.PlanError):
        M.checked(raw)


def test_execute_and_undo():
    files = M.Memory({"/a.ts": "one\n", "/gone.ts": "bye"})
    p = plan()
    p.changes += [M.Change("create-file", "/new.ts", "n"), M.Change("delete-file", "/gone.ts")]
    back = M.execute(p, files)
    assert files == {"/a.ts": "two\nthree\n", "/new.ts": "n"}
    M.undo(back, files)
    assert files == {"/a.ts": "one\n", "/gone.ts": "bye"}


def test_checks():
    with pytest.raises(M.PlanError, match="missing"):
        M.execute(plan(), M.Memory(), force=True)
    with pytest.raises(M.PlanError, match="changed"):
        M.execute(plan(), M.Memory({"/a.ts": "other"}))
    files = M.Memory({"/a.ts": "other"})
    M.execute(plan(), files, force=True)
    assert files["/a.ts"] == "two\nthree\n"


def test_apply_verifies_and_archives(tmp_path):
    file, path = tmp_path / "a.ts", tmp_path / "plan.json"
    file.write_text("one\n")
    M.write_plan(M.plan_of_edits("edit", {str(file): ("one\n", "two\n")}), str(path))
    with pytest.raises(M.PlanError, match="undone"):
        M.apply(str(path), verify="false")
    assert file.read_text() == "one\n"
    to = M.apply(str(path), verify="true")
    assert file.read_text() == "two\n"
    assert not path.exists()
    assert json.load(open(to))["command"] == "edit"


def test_differences_and_statistics(spark):
    changed = spark.createDataFrame([("modify-file", "/a.ts", "two\nthree\n"), ("create-file", "/n.ts", "n\n"), ("delete-file", "/d.ts", None)], "type string, path string, content string")
    files = spark.createDataFrame([("/a.ts", "one\n"), ("/d.ts", "x")], "path string, content string")
    d = {r["path"]: r["diff"] for r in M.diffs(changed, files).collect()}
    assert "-one\n+two\n+three\n" in d["/a.ts"]
    assert d["/n.ts"].startswith("--- /dev/null\n+++ /n.ts")
    assert {r["path"]: (r["lines"], r["delta"]) for r in M.stats(changed, files).collect()} == {"/a.ts": (3, 1), "/n.ts": (2, 2), "/d.ts": (0, -1)}
    planned = spark.createDataFrame([("/a.ts", M.text_checksum("one\n")), ("/d.ts", "0"), ("/m.ts", "0")], "path string, expected string")
    assert dict(tuple(r) for r in M.validate_checksums(planned, files).collect()) == {"/a.ts": "same", "/d.ts": "changed", "/m.ts": "missing"}
