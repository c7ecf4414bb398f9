"""Text functions on columns: scripts in markup, markers, checksums, lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def script_of(html: Column | str) -> Column:
    """Text between the first ``<script ...>`` and the next ``</script>``; empty if there is none, null if it is not closed."""
    code = F.col(html) if isinstance(html, str) else html
    at = F.locate("<script", code)
    rest = F.substring(code, at, F.length(code))
    inner = F.substring(rest, F.locate(">", rest) + 1, F.length(rest))
    end = F.locate("</script>", inner)
    return F.when(at == 0, "").when((F.locate(">", rest) > 0) & (end > 0), F.substring(inner, F.lit(1), end - 1))


def checked_script(html: Column | str) -> Column:
    """:func:`script_of`, which fails if the tag is not closed, or if the script put back would differ (it begins with a line end then)."""
    code = F.col(html) if isinstance(html, str) else html
    script = script_of(code)
    safe = (F.locate("<script", code) == 0) | script.startswith("\n")
    return F.when(script.isNull(), F.raise_error(F.lit("script tag not closed"))).when(~safe, F.raise_error(F.lit("script cannot be put back unchanged"))).otherwise(script)


def with_script(html: Column | str, script: Column | str) -> Column:
    """The markup with its script replaced; a line end goes before a script that has none."""
    code = F.col(html) if isinstance(html, str) else html
    new = F.col(script) if isinstance(script, str) else script
    new = F.when(new.startswith("\n"), new).otherwise(F.concat(F.lit("\n"), new))
    at = F.locate("<script", code)
    begin = at + F.locate(">", F.substring(code, at, F.length(code)))
    old = F.length(script_of(code))
    return F.when((at == 0) & (F.trim(new) == ""), code).when(at == 0, F.raise_error(F.lit("no script tag"))).otherwise(F.concat(F.substring(code, F.lit(1), begin - 1), new, F.substring(code, begin + old, F.length(code))))


def source_text(path: Column | str, content: Column | str) -> Column:
    """What is parsed of a file: the script of a ``.vue`` file, else all of it."""
    p, c = (F.col(x) if isinstance(x, str) else x for x in (path, content))
    return F.when(p.endswith(".vue"), script_of(c)).otherwise(c)


def is_generated(text: Column | str) -> Column:
    """Whether a comment holds the marker of generated files."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(r"(?s)/\*(?:(?!\*/).)*@generated|//[^\n]*@generated")


def is_public(comment: Column | str) -> Column:
    c = F.col(comment) if isinstance(comment, str) else comment
    return c.contains("@public")


def checksum(text: Column | str) -> Column:
    """Lower-case hex of SHA-256 over UTF-8."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def line_count(text: Column | str) -> Column:
    return F.size(F.split(text, "\n", -1))


def fewer_blank_lines(text: Column | str) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def rounded_half_up(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c + 0.5).cast("long")


def iso_time(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def signature_list(names: Column | str, most: int = 3) -> Column:
    """Names joined by commas, the rest beyond ``most`` as a number."""
    c = F.col(names) if isinstance(names, str) else names
    first = F.array_join(F.slice(c, 1, most), ", ")
    return F.when(F.size(c) > most, F.concat(first, F.lit(", +"), (F.size(c) - most).cast("string"), F.lit(" more"))).otherwise(first)


def named_key(name: Column | str, alias: Column | str) -> Column:
    """``name as alias``, or the name alone."""
    return F.concat_ws(" as ", name, alias)


def mixed_color(low: tuple[int, int, int], high: tuple[int, int, int], share: Column | str) -> Column:
    """Hex colour between two, at a share that is held within 0 and 1."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(share) if isinstance(share, str) else share))
    part = lambda a, b: F.lpad(F.lower(F.hex(F.floor(a + (b - a) * s + 0.5).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), *(part(a, b) for a, b in zip(low, high, strict=True)))


def dot_quoted(text: Column | str) -> Column:
    """A text as a quoted DOT identifier."""
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def pattern_quoted(text: Column | str) -> Column:
    """A text as a regular expression for itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")
