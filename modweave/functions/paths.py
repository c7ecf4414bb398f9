"""Path functions: on columns where a join or filter needs them, in Python for small results."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column, functions as F

#: Repository paths are absolute POSIX paths.


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def normalised(path: Column | str) -> Column:
    """``.``, ``..`` and doubled slashes removed from an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def ancestors(path: Column | str) -> Column:
    """All folders of an absolute path, the root first."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def strip_extension(path: Column | str) -> Column:
    return F.regexp_replace(path, r"\.(ts|mts|vue)$", "")


def joined(folder: Column, relative: Column) -> Column:
    return normalised(F.concat_ws("/", folder, relative))


def relative_import(source: str, target: str) -> str:
    """Specifier of ``target`` as written in ``source``: relative, with a leading dot, without ``.ts``."""
    spec = posixpath.relpath(target, posixpath.dirname(source))
    spec = spec[:-3] if spec.endswith(".ts") else spec
    return spec if spec.startswith(".") else f"./{spec}"


def rebased(spec: str, old_file: str, new_file: str) -> str:
    """A relative specifier of ``old_file`` as it reads in ``new_file``; others stay."""
    if not spec.startswith("."):
        return spec
    target = posixpath.normpath(posixpath.join(posixpath.dirname(old_file), spec))
    out = posixpath.relpath(target, posixpath.dirname(new_file))
    return out if out.startswith(".") else f"./{out}"


def absolute(path: str, cwd: str | None = None) -> str:
    return posixpath.normpath(posixpath.join(cwd or os.getcwd(), path))


def display(path: str, cwd: str) -> str:
    """Relative if that is shorter and does not climb more than two folders."""
    out = posixpath.relpath(path, cwd)
    return out if len(out) < len(path) and not out.startswith("../../..") else path


def existing(path: str, label: str = "path") -> str:
    """The absolute path, or an error that names what was missing."""
    full = absolute(path)
    if not os.path.exists(full):
        raise FileNotFoundError(f"{label} does not exist: {full}")
    return full


def middle_cut(text: str, width: int) -> str:
    """A text of at most ``width`` characters, with dots for its middle."""
    if len(text) <= width:
        return text
    left = (width - 3) // 2
    return text[:left] + "..." + text[len(text) - (width - 3 - left) :]
