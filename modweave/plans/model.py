"""Change plans: their form, checks, differences and execution.

A plan is a small document of one repository: its checks and statistics are joins over the files
it names, and its execution writes those files from the driver.
"""

from __future__ import annotations

import datetime
import difflib
import hashlib
import json
import os
import re
import subprocess
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from modweave.functions.text import checksum, line_count
from modweave.sources.schemas import PLAN

VERSION = "1.0.0"
KINDS = ("create-file", "modify-file", "delete-file")


class PlanError(ValueError):
    """A plan is malformed, or does not fit the files."""


@dataclass
class Change:
    type: str
    path: str
    content: str | None = None
    originalChecksum: str | None = None  # noqa: N815  the stored name


@dataclass
class Plan:
    command: str
    changes: list[Change]
    checksums: dict[str, str] = field(default_factory=dict)
    sourceFiles: list[str] = field(default_factory=list)  # noqa: N815
    targetFiles: list[str] = field(default_factory=list)  # noqa: N815
    undo: list[Change] = field(default_factory=list)
    version: str = VERSION
    timestamp: str = ""


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def text_checksum(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def write_plan(plan: Plan, path: str) -> None:
    with open(path, "w") as f:
        json.dump(asdict(plan) | {"timestamp": plan.timestamp or now()}, f, indent=2)


def read_plan(path: str) -> Plan:
    with open(path) as f:
        return checked(json.load(f))


def checked(raw: object) -> Plan:
    """A plan from parsed JSON, or an error that names what is wrong."""
    if not isinstance(raw, dict):
        raise PlanError("a plan must be an object")
    for name, kind in (("version", str), ("command", str), ("timestamp", str), ("checksums", dict), ("changes", list)):
        if not isinstance(raw.get(name), kind):
            raise PlanError(f"a plan needs {name} of type {kind.__name__}")
    read = lambda rows: [Change(c["type"], c["path"], c.get("content"), c.get("originalChecksum")) for c in rows]
    for c in [*raw["changes"], *(raw.get("undo") or [])]:
        if not isinstance(c, dict) or c.get("type") not in KINDS or not isinstance(c.get("path"), str):
            raise PlanError(f"not a change: {c!r}")
        if c["type"] != "delete-file" and not isinstance(c.get("content"), str):
            raise PlanError(f"{c['type']} of {c['path']} needs content")
    return Plan(raw["command"], read(raw["changes"]), raw["checksums"], raw.get("sourceFiles") or [], raw.get("targetFiles") or [], read(raw.get("undo") or []), raw["version"], raw["timestamp"])


def plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan files as rows."""
    return spark.read.schema(PLAN).json(path, multiLine=True)


def changes(plan: DataFrame) -> DataFrame:
    """(command, type, path, content, originalChecksum) of plan rows."""
    return plan.select("command", F.explode("changes").alias("c")).select("command", "c.*")


def validate_checksums(planned: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of planned files (path, expected): same, changed, or missing from ``files`` (path, content)."""
    found = files.select("path", checksum("content").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("expected"), "same").otherwise("changed")
    return planned.join(found, "path", "left").select("path", state.alias("state"))


def check_files(plan: Plan, read, force: bool = False) -> None:
    """Raise if a file of the plan is missing, or (unless forced) has changed. ``read`` gives a text or None."""
    for path, expected in plan.checksums.items():
        text = read(path)
        if text is None:
            raise PlanError(f"{path} is missing")
        if not force and text_checksum(text) != expected:
            raise PlanError(f"{path} has changed since the plan was made")


class Disk:
    """Files of a folder tree."""

    def read(self, path: str) -> str | None:
        try:
            with open(path, newline="") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, path: str, text: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", newline="") as f:
            f.write(text)

    def delete(self, path: str) -> None:
        os.remove(path)


class Memory(dict):
    """Files as a dictionary, for tests and previews."""

    def read(self, path: str) -> str | None:
        return self.get(path)

    def write(self, path: str, text: str) -> None:
        self[path] = text

    def delete(self, path: str) -> None:
        del self[path]


def execute(plan: Plan, files, force: bool = False) -> list[Change]:
    """Check all, then apply the changes; returns the changes that undo them, last first."""
    check_files(plan, files.read, force)
    for c in plan.changes:
        there = files.read(c.path) is not None
        if c.type == "create-file" and there and not force:
            raise PlanError(f"{c.path} exists already")
        if c.type != "create-file" and not there:
            raise PlanError(f"{c.path} is missing")
    back: list[Change] = []
    for c in plan.changes:
        old = files.read(c.path)
        back.insert(0, Change("delete-file", c.path) if old is None else Change("create-file" if c.type == "delete-file" else "modify-file", c.path, old))
        if c.type == "delete-file":
            files.delete(c.path)
        else:
            files.write(c.path, c.content or "")
    return back


def undo(steps: list[Change], files) -> None:
    """Apply undo steps in order; a file that is gone already may be deleted again."""
    for c in steps:
        if c.type != "delete-file":
            files.write(c.path, c.content or "")
        elif files.read(c.path) is not None:
            files.delete(c.path)


def archived_name(path: str, stamp: str) -> str:
    return re.sub(r"\.json$", "", path) + f".applied-{re.sub('[:.]', '_', stamp)}.json"


def apply(path: str, files=None, force: bool = False, verify: str | None = None) -> str:
    """Read, check, execute and verify a plan file; undone if the command fails, else archived. Returns the new name."""
    plan, files = read_plan(path), files or Disk()
    back = execute(plan, files, force)
    if verify and subprocess.run(verify, shell=True, check=False).returncode != 0:  # noqa: S602  the user's own command
        undo(plan.undo or back, files)
        raise PlanError(f"verification failed and the changes were undone: {verify}")
    os.rename(path, to := archived_name(path, now()))
    return to


def unified(path: str, old: str | None, new: str | None) -> str:
    """Unified difference of a file; none means it is not there."""
    a, b = (x.splitlines(keepends=True) if x else [] for x in (old, new))
    return "".join(line if line.endswith("\n") else line + "\n" for line in difflib.unified_diff(a, b, path if old is not None else "/dev/null", path if new is not None else "/dev/null"))


def diffs(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, type, diff) of changes against files (path, content); texts stay on the executors."""
    import pandas as pd

    def run(frames):
        for f in frames:
            out = [unified(p, None if pd.isna(o) else o, None if t == "delete-file" else n) for p, t, o, n in zip(f["path"], f["type"], f["old"], f["content"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "type": f["type"], "diff": out})

    joined = changed.join(files.select("path", F.col("content").alias("old")), "path", "left").select("path", "type", "old", "content")
    return joined.mapInPandas(run, "path string, type string, diff string")


def stats(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, type, lines, delta): lines after the change and how many more than before."""
    old = files.select("path", line_count("content").alias("before"))
    after = F.when(F.col("type") == "delete-file", 0).otherwise(line_count("content"))
    return changed.join(old, "path", "left").select("path", "type", after.alias("lines"), (after - F.coalesce("before", F.lit(0))).alias("delta"))


def display(plan: Plan) -> str:
    """The plan's changes by kind."""
    out = [f"{plan.command} ({plan.timestamp})"]
    for kind in KINDS:
        if own := sorted(c.path for c in plan.changes if c.type == kind):
            out += [f"{kind}: {len(own)}", *(f"  {p}" for p in own)]
    return "\n".join(out)


def plan_of_edits(command: str, edits: dict[str, tuple[str, str]]) -> Plan:
    """A plan that changes texts: path -> (old, new); equal ones are left out."""
    edits = {p: e for p, e in sorted(edits.items()) if e[0] != e[1]}
    sums = {p: text_checksum(old) for p, (old, _) in edits.items()}
    return Plan(command, [Change("modify-file", p, new, sums[p]) for p, (_, new) in edits.items()], sums, list(edits), list(edits), [Change("modify-file", p, old) for p, (old, _) in edits.items()], timestamp=now())
