"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within ``radius / 2`` of both, and a
shared variant proves the distance. Every distinct fingerprint therefore emits all variants in
its half ball. A variant is routed by its leading bits, so the shuffle carries a fingerprint once
per reachable prefix (1 + b + b(b-1)/2 of them) and the task that owns the prefix enumerates the
variants itself. Where a prefix receives more variants than a task should hold, what was sent to
it is dealt on by four more bits, again only to the prefixes that a variant can reach, so no
variant is made twice. Equal fingerprints are merged first, so a large group of copies costs one
fingerprint.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from modweave.operators.components import connected_components
from modweave.runtime import cut, give_back, join_counted

SEED = 42
#: Fingerprints whose variants a task enumerates; prefixes that receive more are dealt on.
PER_TASK = 1024
#: Prefixes grow no longer than this: the fingerprints below one are then few enough by their number of bits.
MOST_BITS = 44
#: Fingerprints, roots and crowded prefixes are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def simhash(data: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of the word shingles of a text; no words give zero."""
    words = (data or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= width:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id_col, fp): a row per row of ``docs``; a null or empty text has fingerprint zero.

    Words are runs of anything but ASCII white space, letters A-Z are lower-cased. Repeated rows
    and null ids are kept as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            fps = np.array([simhash(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])
        give_back()

    return docs.select(id_col, F.col(text_col).cast("binary").alias("data")).mapInArrow(score, f"`{id_col}` {kind}, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with up to ``radius`` ones."""
    return np.array([sum(1 << p for p in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up


def _collide(fps: np.ndarray, base: np.ndarray, left: np.ndarray, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of fingerprints that share a variant; ``base`` is one with the prefix, and ``left`` bits may differ below it."""
    kinds, own = np.unique(fps, return_inverse=True)
    variants, owners = [], []
    for d in np.unique(left):
        at = np.flatnonzero(left == d)
        masks = _masks(64 - prefix_bits, int(d))
        variants.append((base[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own[at].astype(np.int32), len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    a, b = o[same], o[same + 1]  # a chain through the members of a variant: as good as all their pairs
    pairs = np.unique(np.minimum(a, b).astype(np.int64) * len(kinds) + np.maximum(a, b))
    a, b = pairs // len(kinds), pairs % len(kinds)
    near = np.bitwise_count(kinds[a] ^ kinds[b]) <= radius
    label = _roots(len(kinds), a[near], b[near])
    member = np.flatnonzero(label != np.arange(len(kinds)))
    return kinds[member], kinds[label[member]]


def _flipped(rows: DataFrame, bits: int, masks: list[int]) -> DataFrame:
    """Rows (fp, base, left, p) dealt on by ``bits`` more bits: to every prefix that a variant can reach."""
    moved = rows.withColumn("moved", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).filter(F.bit_count("moved") <= F.col("left"))
    at = F.lit(64 - bits) - F.col("p")
    return moved.select("fp", F.col("base").bitwiseXOR(F.call_function("shiftleft", "moved", at)).alias("base"), (F.col("left") - F.bit_count("moved")).alias("left"), (F.col("p") + bits).alias("p"))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst): links that join every pair of the distinct ``fp`` within ``radius`` bits (even).

    Not all such pairs are listed, but they have the same connected components. Null fingerprints
    have no links. Empty input gives none.
    """
    half = radius // 2
    bits = min(20, max(8, (max(1, fps.count()) // PER_TASK).bit_length()))
    start = fps.filter("fp IS NOT NULL").select("fp", F.col("fp").alias("base"), F.lit(half).alias("left"), F.lit(0).alias("p"))
    sent = _flipped(start, bits, [int(m) for m in _masks(bits, half)])
    bucket = F.call_function("shiftrightunsigned", F.col("base"), F.lit(64) - F.col("p"))
    variants = lambda p, left: sum(math.comb(64 - p, k) for k in range(left + 1))
    most, done, p = PER_TASK * variants(bits, half), [], bits
    while p < MOST_BITS:
        cost = F.element_at(F.array(*(F.lit(variants(p, k)).cast("long") for k in range(half + 1))), F.col("left") + 1)
        crowd = cut(sent.groupBy(bucket.alias("bucket")).agg(F.sum(cost).alias("cost")).filter(F.col("cost") > 2 * most).select("bucket"))
        n = crowd.count()
        if not n:
            break
        crowd = F.broadcast(crowd) if n <= BROADCAST_ROWS else crowd
        placed = sent.withColumn("bucket", bucket)
        done.append(placed.join(crowd, "bucket", "left_anti").drop("bucket"))
        sent = cut(_flipped(placed.join(crowd, "bucket", "left_semi").drop("bucket"), 4, [int(m) for m in _masks(4, half)]))
        p += 4
    for rows in done:
        sent = sent.unionByName(rows)

    def collide(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fp, base = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "base"))
        member, root = _collide(fp, base, frame["left"].to_numpy(), int(key[0]), radius)
        return pd.DataFrame({"src": member.view(np.int64), "dst": root.view(np.int64)})

    return sent.withColumn("bucket", bucket).groupBy("p", "bucket").applyInPandas(collide, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id reachable over fingerprints at ``radius`` or fewer differing
    bits. Texts that are null, empty or without words have fingerprint zero and are linked like
    any other. Repeated rows give repeated results; a null id never becomes a component's id
    unless all ids of the component are null. Long texts are hashed in one pass, some shingles at a
    time. Empty input gives no rows. Other columns, whatever their names, are not read.
    """
    scored = cut(fingerprints(docs, id_col, text_col, width))
    first = cut(scored.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")))
    found = connected_components(links(first.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    linked = cut(first.join(found, "fp"))  # most fingerprints are alone, and need no second join
    named = cut(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    of = join_counted(linked.select("fp", "root", F.col("n").alias("rows")), named, "root").select("fp", "component_id", F.col("rows").alias("n"))
    alone = first.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "n")
    return join_counted(scored, cut(of.unionByName(alone)), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
