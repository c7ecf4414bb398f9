"""Substring deduplication by hashing lines and sentences.

A text is cut into pieces at line and sentence ends. A unit is a run of neighbouring pieces, just
long enough to count: one begins at every piece, and one more ends the text, so a repeated passage
is found wherever it begins, in short lines, inside longer lines or across them. Units are
normalised (case of A-Z, white space) and hashed to 128 bits. Digests are grouped over the whole
corpus; the occurrence that ranks first, by document id and then offset, stays, and the others are
cut out of their texts, with their offsets in the original text retained. Half the digest of every
unit is counted first, so whole units are shuffled once, and only those that may repeat are kept; a
digest's group is a count and a minimum, never a list.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from modweave.runtime import cut

#: Digests of at most so many occurrences are never treated as common; what is common changes the plan, not the result.
HOT_UNITS, SALTS = 200, 64
#: A unit has at least so many words, or so many bytes besides white space (for text without spaces).
MIN_WORDS, MIN_BYTES = 20, 200
#: Characters that end a piece.
BREAKS = ".!?。！？\n"


def pieces_pattern(breaks: str) -> str:
    """Regular expression (also for SQL) whose matches, one after the other, are the text."""
    return f"[^{breaks}]*[{breaks}]+|[^{breaks}]+"


def units(text: str, pattern: re.Pattern, min_words: int, min_bytes: int) -> list[tuple[int, int, int]]:
    """(start, end, 128-bit digest) of the units of a text, in code points."""
    spans, words = [], []
    for m in pattern.finditer(text):
        if own := m.group().encode("utf-8", "surrogatepass").lower().split():
            spans.append(m.span())
            words.append(own)
    n, many, size = len(words), [0], [0]
    for own in words:
        many.append(many[-1] + len(own))
        size.append(size[-1] + sum(map(len, own)))
    counts = lambda i, j: many[j] - many[i] >= min_words or size[j] - size[i] >= min_bytes
    found, j, last = [], 0, 0
    for i in range(n):
        if counts(i, n):
            j, last = max(j, i + 1), i
            while not counts(i, j):
                j += 1
            found.append((i, j))
    if found and found[-1][1] < n:
        found.append((last, n))  # the shortest that ends the text
    joined = [b" ".join(own) for own in words]
    return [(spans[i][0], spans[j - 1][1], xxhash.xxh3_128_intdigest(b" ".join(joined[i:j]))) for i, j in found]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the disjoint ``spans``."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join(kept) + text[at:]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", breaks: str = BREAKS, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """id, text (without repeated units), removed (array of start and end in the original), n_removed, n_chars_removed.

    One row per row of ``docs``. ``removed`` has the unions of the repeated units; a unit that
    overlaps its own first occurrence loses only what lies beyond it. ``breaks`` are the characters
    that end a piece: a line end alone gives units of whole lines. A null text stays null; empty
    texts and those with no unit (shorter than ``min_words`` words and ``min_bytes`` bytes) stay as
    they are. Of ties between equal units the least (id, hash of the text, offset) stays; a null id
    ranks first. Rows that repeat id and text are one document, whose rows stay alike. Long texts
    are split in one pass. Empty input gives no rows; other columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_of"), F.col(text_col).alias("_text"))
    source = pieces_pattern(breaks)

    def split(batches):
        pattern = re.compile(source)
        for batch in batches:
            rows, spans, digests = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = units(text, pattern, min_words, min_bytes)
                rows.extend([k] * len(own))
                spans.extend(a << 32 | b for a, b, _ in own)
                digests.append(b"".join(d.to_bytes(16, "little") for _, _, d in own))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(spans, pa.int64())], names=["low", "high", "_id", "_of", "_span"])

    # a span is its start and end in one number: a unit is five numbers
    found = base.filter("_text IS NOT NULL").mapInArrow(split, f"low long, high long, _id {kind}, _of long, _span long")
    # half a digest tells which units may repeat; only those meet by their whole digests
    twice = cut(found.groupBy("low").agg(F.count("*").alias("n")).filter("n > 1"))
    # halves of over a thousandth of these units are at most a thousand: their units are salted
    common = F.col("n") > max(HOT_UNITS, (twice.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(twice.filter(common).select("low", F.lit(True).alias("hot")))
    salted = lambda salt: F.xxhash64(F.col("low"), salt)
    salt = F.pmod(F.xxhash64("_id", "_of", "_span"), F.lit(SALTS).cast("long"))
    spread = twice.filter(common).select("low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    wanted = twice.filter(~common).select(salted(F.lit(-1).cast("long")).alias("key")).unionByName(spread.select(salted(F.col("salt")).alias("key"))).distinct()
    keyed = found.join(hot, "low", "left").withColumn("key", salted(F.when(F.col("hot"), salt).otherwise(F.lit(-1).cast("long"))))
    met = cut(keyed.join(wanted, "key", "left_semi").select("low", "high", "_id", "_of", "_span"))
    first = cut(met.groupBy("low", "high").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_of", "_span")).alias("first")).filter("n > 1"))
    often = F.col("n") > max(HOT_UNITS, met.count() // 1000)
    told = lambda rows, own: rows.join(own.drop("n"), ["low", "high"])
    most = F.broadcast(first.filter(often))
    met = told(met, most).unionByName(told(met.join(most.select("low", "high"), ["low", "high"], "left_anti"), first.filter(~often)))
    end = lambda c: c.bitwiseAND(0xFFFFFFFF)
    again = met.filter(~F.struct("_id", "_of", "_span").eqNullSafe(F.col("first"))).select("_id", "_of", F.shiftright("_span", 32).alias("start"), end(F.col("_span")).alias("end"), "first")
    beside = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_of") == F.col("first._of"))
    again = again.withColumn("start", F.when(beside, F.greatest("start", end(F.col("first._span")))).otherwise(F.col("start"))).filter("start < end")
    spans = again.groupBy("_id", "_of").agg(F.collect_set(F.struct("start", "end")).alias("removed"))
    b, s = base.alias("b"), spans.alias("s")
    joined = b.join(s, F.col("b._id").eqNullSafe(F.col("s._id")) & (F.col("b._of") == F.col("s._of")), "left").select("b._id", "_text", F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"))

    def clean(batches):
        for batch in batches:
            spans = [union([(x["start"], x["end"]) for x in own]) for own in batch.column(2).to_pylist()]
            texts = [remove(t, own) if own else t for t, own in zip(batch.column(1).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], batch.schema.field(2).type)], names=[id_col, "text", "removed"])

    out = joined.mapInArrow(clean, f"`{id_col}` {kind}, text string, removed array<struct<start:bigint,end:bigint>>")
    return out.select("*", F.size("removed").cast("long").alias("n_removed"), F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_chars_removed"))
