"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of base spans are always reported. Every candidate value is hashed and counted over
the distinct owners and repositories that hold it: values of many owners, or of many repositories
of whatever owners, are copied examples; the others look live. The method adds spans of kind
``owned``: long mixed strings outside the base spans that are not copied.

A text is scanned once, into the lengths of its matches and of what lies between them. Offsets,
overlaps and verdicts are window functions, aggregates and joins over these matches, so the work
is linear in the number of secrets of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from modweave.runtime import cut, saved

#: Values held by at least so many distinct owners are copied examples.
COPIED_OWNERS = 3
#: So are values in at least so many distinct repositories, be it of one owner or of unknown ones.
COPIED_REPOS = 20


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The kinds of spans, in the order of their listing, and their patterns.
KINDS = ["assign", "access", "hex", "owned"]
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = f"({'|'.join(map(_any_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, CANDIDATE], strict=True))

#: Values with over a thousandth of all matches, but no fewer than this, meet their verdicts by broadcast; it changes the plan only.
HOT_VALUES = 1000
_OWNED = KINDS.index("owned")


def _hits(kind: str, text: Column, matches: Column) -> Column:
    """The matches of a kind, which lie between the pieces of the split text: lengths, whether each counts, and the hash of its value."""
    pattern = PATTERNS[kind]
    value = (lambda m: F.regexp_extract(m, ASSIGN, 2)) if kind == "assign" else (lambda m: m)
    good = {"assign": lambda m: F.length(value(m)) >= 8, "owned": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")}.get(kind, lambda m: F.lit(True))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("p"), matches.alias("m"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.length(x["p"]).alias("skip"), F.length(x["m"]).alias("len"), good(x["m"]).alias("good"), F.xxhash64(value(x["m"])).alias("hash"))

    return F.when(F.size(matches) > 0, F.transform(pairs, one)).otherwise(F.array().cast("array<struct<kind:int,pos:int,skip:int,len:int,good:boolean,hash:bigint>>"))


def scan(read: DataFrame) -> DataFrame:
    """``read``, whose column ``_text`` is the text, with ``_hits``: the matches of all kinds. A null text has none."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lower = F.lower(text)
    may = {"assign": lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api"), "access": text.contains("AKIA")}
    none = F.array().cast("array<string>")
    all_of = {k: F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS}
    found = read.select("*", *((F.when(may[k], all_of[k]).otherwise(none) if k in may else all_of[k]).alias(f"_m_{k}") for k in KINDS))
    return found.select(*read.columns, F.concat(*(_hits(k, text, F.col(f"_m_{k}")) for k in KINDS)).alias("_hits"))


def spans_of(scanned: DataFrame) -> DataFrame:
    """A row per span of rows (_row, _owner, _repo, _hits): start, end, kind and hash; candidates that touch a base span are left out."""
    each = scanned.select("_row", "_owner", "_repo", F.explode("_hits").alias("h")).select("_row", "_owner", "_repo", "h.*").repartition("_row")
    ends = F.sum(F.col("skip") + F.col("len")).over(Window.partitionBy("_row", "kind").orderBy("pos"))
    placed = each.withColumn("end", ends.cast("long")).withColumn("start", F.col("end") - F.col("len")).filter("good")
    by = Window.partitionBy("_row").orderBy("start", "kind")
    base = F.col("kind") < _OWNED
    before = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return placed.withColumn("apart", base | ~touched).filter("apart").select("_row", "_owner", "_repo", "start", "end", "kind", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n, n_owners, n_repos) from rows (hash, owner, repo): distinct before grouping, so a value in most rows stays small.

    A null owner or repository is one of its own. Repeated rows add to n only. Empty input gives no rows.
    """
    read = spans.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    rows = read.groupBy("hash").agg(F.count("*").alias("n"))
    owners = read.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = read.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return rows.join(owners, "hash").join(repos, "hash")


def _judged(scanned: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """The spans that are reported, with whether their values are copied."""
    spans = cut(spans_of(scanned))
    counted = cut(ownership(spans.select("hash", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"))).select("hash", "n", ((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)).alias("copied")))
    common = F.col("n") > max(HOT_VALUES, spans.count() // 1000)
    hot, rare = F.broadcast(counted.filter(common).drop("n")), counted.filter(~common).drop("n")
    told = spans.join(hot, "hash").unionByName(spans.join(hot, "hash", "left_anti").join(rare, "hash"))
    return told.filter((F.col("kind") < _OWNED) | ~F.col("copied"))


def _read(docs: DataFrame, kept, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Only columns of our own, so that no name of the input can clash."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(kept.alias("_kept"), blank(owner_col).alias("_owner"), blank(repo_col).alias("_repo"), F.col(text_col).alias("_text"))


def _shown(spans: Column) -> Column:
    """kind:start:end of sorted (start, kind, end), comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """A row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, and ``found`` (the spans).

    ``found`` has start, kind (position in ``KINDS``), end (exclusive, code points), hash and
    copied, by start and kind. A null or empty text has no spans. A null owner or repository counts
    as one of its own. Repeated rows, null ids among them, give repeated results. The work for a
    long text is linear in its length and its secrets. Other columns, whatever their names, are
    not read; empty input gives no rows.
    """
    read = _read(docs, F.col(id_col), text_col, owner_col, repo_col)
    scanned = cut(scan(read).select(F.monotonically_increasing_id().alias("_row"), "_kept", "_owner", "_repo", "_hits"))
    spans = _judged(scanned, copied_owners, copied_repos).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "copied"))).alias("found"))
    all_rows = scanned.select("_row", "_kept").join(spans, "_row", "left")
    rows = all_rows.select("_kept", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:bigint,copied:boolean>>")).alias("found"))
    count = lambda test, name: F.size(F.filter("found", test)).cast("long").alias(name)
    of = lambda k: count(lambda s: s["kind"] == KINDS.index(k), f"n_{k}")
    base = F.filter("found", lambda s: s["kind"] < _OWNED)
    return rows.select(F.col("_kept").alias(id_col), of("assign"), of("access"), of("hex"), F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"), count(lambda s: s["copied"], "n_copied"), count(lambda s: ~s["copied"], "n_live"), "found")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = "[SECRET]", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """``docs`` with every span of :func:`find` replaced by ``mask``; overlapping spans become one.

    Base spans are masked whether copied or not: a copied key may still be a leaked one. Columns
    keep their names, order and values, whatever the names are. The scan is written once to the
    shared folder; rows without matches pass straight through, the others meet their spans by row.
    Null and empty texts stay as they are, repeated rows are redacted alike, empty input gives no
    rows. In a long text with many spans each span costs a walk over the text.
    """
    read = _read(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text_col, owner_col, repo_col)
    scanned = saved(scan(read).select(F.monotonically_increasing_id().alias("_row"), "_kept", "_owner", "_repo", "_hits"))
    judged = _judged(scanned.select("_row", "_owner", "_repo", "_hits"), copied_owners, copied_repos).select("_row", "start", "end")
    by = Window.partitionBy("_row").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = judged.withColumn("fresh", (~F.coalesce(reach >= F.col("start"), F.lit(False))).cast("int")).withColumn("island", F.sum("fresh").over(by))
    islands = islands.groupBy("_row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gaps = islands.withColumn("at", F.coalesce(F.lag("end").over(Window.partitionBy("_row").orderBy("start")), F.lit(0)))
    spans = gaps.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "at", "end"))).alias("found"))
    some = F.size("_hits") > 0
    held = scanned.filter(some).select("_row", "_kept").join(spans, "_row", "left")
    text = F.col("_kept")[text_col]
    piece = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    between = F.transform("found", lambda s: piece(s["at"], s["start"] - s["at"]))
    masked = F.array_join(F.concat(between, F.array(piece(F.array_max(F.transform("found", lambda s: s["end"])), F.length(text)))), mask)
    fresh = F.when(F.col("found").isNull(), text).otherwise(masked)
    out = lambda rows, value: rows.select(*((value if c == text_col else F.col("_kept")[c]).alias(c) for c in docs.columns))
    return out(scanned.filter(~some), text).unionByName(out(held, fresh))
