"""Quality by perplexity under an interpolated modified Kneser-Ney model of word bigrams.

The model is trained on all trusted text, a model for each language. Words (and signs) are hashed
to ``WORDS`` ids, and the model is exact over these ids. Bigram counts grow with the corpus and are
sharded by a hash of the bigram; what is kept for each word (its unigram probability, and the total
and the weight left by discounts where it is a context) has a fixed size for a language and travels
with the tasks.

Documents are read once. A block of documents sends each shard one sorted, packed array of its
(bigram, document, count); the shard joins it to the counts and answers with a partial sum of log
probabilities for each document; the sums of a block's shards are its documents' perplexities. No
text is shuffled. Shards have copies by the bytes of the input, so a task's share does not grow.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from modweave.runtime import cut

#: Ids of words; 0 stands before the first word of a text.
WORD_BITS = 18
WORDS = 1 << WORD_BITS
BLOCK_BYTES, BLOCK_DOCS = 16_000_000, 1 << 16
#: A bigram's shard is the exclusive or of the low bits of its words, so hot words are spread over all shards.
SHARD_BITS = 6
SHARDS = 1 << SHARD_BITS
#: Bytes of text whose bigrams meet in one task, and arrays of counts that a task merges.
TASK_BYTES, MERGED = 256_000_000, 32
#: Trusted ids are broadcast up to this many rows, and joined by a shuffle beyond; the result is the same.
BROADCAST_IDS = 500_000
_INNER = np.uint64(2 * WORD_BITS - SHARD_BITS)
#: Letters of scripts without spaces are words of their own, and so are runs of signs.
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+|[^\w\s]+|_")


class _Ids(dict):
    """Id of a word; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        at = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % (WORDS - 1) + 1
        return at


_ids = _Ids()


def word_ids(text: str) -> np.ndarray:
    """Ids of the words of a text."""
    words = _TOKEN.findall(text.lower())
    return np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))


def joined(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of bigrams: the shard, then the first word, then what the shard does not tell of the second."""
    low = np.uint64(SHARDS - 1)
    return ((before ^ words) & low) << _INNER | before << np.uint64(WORD_BITS - SHARD_BITS) | words >> np.uint64(SHARD_BITS)


def taken_apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second words of keys."""
    before = keys >> np.uint64(WORD_BITS - SHARD_BITS) & np.uint64(WORDS - 1)
    high = keys & np.uint64((1 << WORD_BITS - SHARD_BITS) - 1)
    return before.astype(np.int64), (high << np.uint64(SHARD_BITS) | (keys >> _INNER ^ before) & np.uint64(SHARDS - 1)).astype(np.int64)


def bigrams(text: str) -> np.ndarray:
    """The key of the bigram of every word with the one before it."""
    ids = word_ids(text)
    return joined(np.concatenate([np.zeros(1, np.uint64), ids[:-1]]), ids) if len(ids) else ids


def shard_ends(keys: np.ndarray) -> np.ndarray:
    """Where each shard begins in sorted keys, and the end."""
    return np.searchsorted(keys >> _INNER, np.arange(SHARDS + 1, dtype=np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, byte by byte of their numbers, compressed."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out.append(np.array([len(a), width], "<u8").tobytes() + np.ascontiguousarray(planes.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u8", 2, at).tolist()
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(planes.reshape(-1).view("<u8").astype(np.uint64))
        at += 16 + n * width
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which pack well; their running sums are the keys."""
    return np.diff(keys, prepend=np.uint64(0))


def docs_of(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Documents of sorted (key, document) as their steps within a key, or back (:func:`whole_docs`)."""
    same = np.concatenate([[False], keys[1:] == keys[:-1]])
    return np.where(same, docs - np.concatenate([[np.uint64(0)], docs[:-1]]), docs)


def whole_docs(moved: np.ndarray, stepped: np.ndarray) -> np.ndarray:
    """Documents from the steps of keys and of documents."""
    first = np.concatenate([[True], moved[1:] != 0]) if len(moved) else np.zeros(0, bool)
    total, at = np.cumsum(stepped, dtype=np.uint64), np.flatnonzero(first)
    return total - np.repeat(total[at] - stepped[at], np.diff(at, append=len(stepped)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts from the numbers of grams seen once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]


class Words:
    """What a language's model keeps for each word id, from sums over all bigrams."""

    def __init__(self, before: np.ndarray, total: np.ndarray, kinds: np.ndarray, often: np.ndarray):
        """Distinct words before each id; occurrences as a context; its bigrams seen once, twice and more (3 rows); bigrams seen 1 to 4 times."""
        self.cuts = discounts(often)
        low = discounts(count_of_counts(before[before > 0]))
        seen, all_before = np.minimum(before, 3), max(1.0, float(before.sum()))
        take = np.concatenate([[0.0], low])[seen.astype(np.int64)]
        left = np.minimum(take, before).sum() / all_before if before.any() else 1.0
        self.unigram = (np.maximum(before - take, 0) / all_before + left / WORDS).astype(np.float32)
        self.total = total.astype(np.float32)
        self.left = np.where(total > 0, self.cuts @ kinds / np.maximum(total, 1), 1.0).astype(np.float32)

    def log_probabilities(self, asked: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log2 p of the second word of each asked bigram; ``keys`` (sorted) with ``counts`` hold those of its shard."""
        context, word = taken_apart(asked)
        own = np.zeros(len(asked))
        if len(keys):
            k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            c = np.where(keys[k] == asked, counts[k], 0).astype(np.float64)
            own = np.maximum(c - np.concatenate([[0.0], self.cuts])[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(self.total[context], 1)
        return np.log2(own + self.left[context] * self.unigram[word])


def _blocks(batches):
    """(block, lang, ids, texts): rows of one language, of bounded size, numbered within the partition."""
    first, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        by: dict[str, list[int]] = {}
        langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for k, lang in enumerate(langs):
            by.setdefault(lang, []).append(k)
        for lang, own in by.items():
            k = 0
            while k < len(own):
                e, size = k, 0
                while e < len(own) and (e == k or size + len(texts[own[e]]) <= BLOCK_BYTES and e - k < BLOCK_DOCS):
                    size += len(texts[own[e]])
                    e += 1
                yield first + made, lang, batch.column(0).take(pa.array(own[k:e])), [texts[i] for i in own[k:e]]
                made, k = made + 1, e


def _counts(batches):
    """(lang, shard, data): distinct bigrams of a block and their counts."""
    for _, lang, _, texts in _blocks(batches):
        keys, n = np.unique(np.concatenate([bigrams(t) for t in texts]), return_counts=True)
        ends = shard_ends(keys)
        packed = [(s, pack(steps(keys[a:b]), n[a:b])) for s, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(packed), pa.string()), pa.array([s for s, _ in packed], pa.int32()), pa.array([d for _, d in packed], pa.binary())], names=["lang", "shard", "data"])


def _requests(batches):
    """A row for each shard of a block: (bigram, document, count); the first has the ids and numbers of words too."""
    for block, lang, ids, texts in _blocks(batches):
        each = [bigrams(t) for t in texts]
        sizes = np.array([len(x) for x in each], np.uint64)
        keys = np.concatenate(each)
        pairs = keys << np.uint64(16) | np.repeat(np.arange(len(each), dtype=np.uint64), sizes.astype(np.int64))
        pairs, n = np.unique(pairs, return_counts=True)
        keys, near = pairs >> np.uint64(16), pairs & np.uint64(0xFFFF)
        ends = shard_ends(keys)
        rows = [(s, pack(steps(keys[a:b]), docs_of(keys[a:b], near[a:b]), n[a:b])) for s, (a, b) in enumerate(zip(ends, ends[1:])) if a < b or not s]
        first = [k == 0 for k in range(len(rows))]
        listed = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([lang] * len(rows), pa.string()), pa.array([s for s, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary()), pa.array([pack(sizes) if f else None for f in first], pa.binary()), listed], names=["block", "lang", "shard", "data", "sizes", "ids"])


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack(d) for d in frame["data"]]
    keys, n = merged(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "shard": frame["shard"].iloc[:1], "data": [pack(steps(keys), n)]})


def _sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums for each word over the bigrams of some shards."""
    total = None
    for data in frame["data"]:
        k, n = unpack(data)
        keys = np.cumsum(k, dtype=np.uint64)
        context, word = taken_apart(keys)
        kinds = [np.bincount(context[n == c if c < 3 else n >= 3], minlength=WORDS) for c in (1, 2, 3)]
        own = np.stack([np.bincount(word, minlength=WORDS), np.bincount(context, n, WORDS), *kinds]).astype(np.uint64)
        often = count_of_counts(n).astype(np.uint64)
        total = (own, often) if total is None else (total[0] + own, total[1] + often)
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "data": [pack(*total[0], total[1])]})


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack(d) for d in frame["data"]]
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "data": [pack(*(sum(x[1:], x[0]) for x in zip(*parts, strict=True)))]})


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, perplexity, n_words) of every row: 2 to the mean bits of a word under its language's model.

    ``trusted`` has the ids of the trusted documents. A null language is a language of its own.
    The perplexity is null for texts that are null or without words, and for languages without
    trusted text. Repeated rows give repeated results (and train as often as they are there); null
    ids are kept and never trusted. Long texts are blocks of their own. Empty input gives no rows;
    other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("data"))
    copies = (rows.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0) // (SHARDS * TASK_BYTES) + 1
    known = trusted.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    counts = rows.join(known, "_id", "left_semi").select("_id", "lang", "data").mapInArrow(_counts, "lang string, shard int, data binary")
    groups = copies  # a shard's arrays are merged a few at a time, in as many rounds as that takes
    while groups > 1:
        counts = counts.groupBy("lang", "shard", F.pmod(F.xxhash64("data"), F.lit(groups))).applyInPandas(_merge, "lang string, shard int, data binary")
        groups //= MERGED
    counts = cut(counts.groupBy("lang", "shard").applyInPandas(_merge, "lang string, shard int, data binary"))
    some = counts.groupBy("lang", F.floor(F.col("shard") / 8)).applyInPandas(_sums, "lang string, data binary")
    found = some.groupBy("lang").applyInPandas(_added, "lang string, data binary").collect()  # a fixed size for each language
    model = {}
    for r in found:
        before, total, *kinds, often = unpack(r["data"])
        model[r["lang"]] = Words(before, total, np.stack(kinds), often)
    shared = spark.sparkContext.broadcast(model)

    def answer(key: tuple, counted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        lang = key[0]
        out = {"block": asked["block"], "lang": asked["lang"], "sizes": asked["sizes"], "ids": asked["ids"]}
        if lang not in shared.value or not len(asked):
            return pd.DataFrame(out | {"docs": [b""] * len(asked), "bits": [b""] * len(asked)})
        keys, n = unpack(counted["data"].iloc[0]) if len(counted) else (np.zeros(0, np.uint64),) * 2
        keys = np.cumsum(keys, dtype=np.uint64)
        near, sums = [], []
        for data in asked["data"]:
            moved, near_docs, times = unpack(data)
            doc = whole_docs(moved, near_docs)
            bits = shared.value[lang].log_probabilities(np.cumsum(moved, dtype=np.uint64), keys, n) * times
            total = np.bincount(doc.astype(np.int64), -bits)
            at = np.flatnonzero(total)
            near.append(pack(steps(at.astype(np.uint64))))
            sums.append(total[at].astype(np.float32).tobytes())
        return pd.DataFrame(out | {"docs": near, "bits": sums})

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame[frame["sizes"].notna()].iloc[0]
        sizes = unpack(first["sizes"])[0].astype(np.float64)
        bits = np.zeros(len(sizes))
        for near, own in zip(frame["docs"], frame["bits"], strict=True):
            if near:
                bits[np.cumsum(unpack(near)[0], dtype=np.uint64).astype(np.int64)] += np.frombuffer(own, np.float32)
        known = first["lang"] in shared.value
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where((sizes > 0) & known, np.exp2(np.minimum(bits / sizes, 1000)), np.nan)
        return pd.DataFrame({"_id": pd.Series(list(first["ids"]), dtype=object), "lang": first["lang"], "perplexity": value, "n_words": sizes.astype(np.int64)})

    copy = F.pmod(F.xxhash64("block"), F.lit(copies))
    asked = rows.mapInArrow(_requests, f"block long, lang string, shard int, data binary, sizes binary, ids array<{kind}>").withColumn("copy", copy)
    sharded = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"))
    answers = sharded.groupBy("lang", "shard", "copy").cogroup(asked.groupBy("lang", "shard", "copy")).applyInPandas(answer, f"block long, lang string, sizes binary, ids array<{kind}>, docs binary, bits binary")
    scored = answers.groupBy("block").applyInPandas(score, f"_id {kind}, lang string, perplexity double, n_words long")
    return scored.select(F.col("_id").alias(id_col), "lang", F.nanvl("perplexity", F.lit(None)).alias("perplexity"), "n_words")


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99) -> DataFrame:
    """(id, lang, perplexity, threshold, kept) of every row.

    A fifth of the trusted documents, by a hash of the id, trains no model: the threshold of a
    language is the given quantile of their perplexities. Documents above it, and those without
    words, are not kept; a tie with the threshold is. Languages without trusted text have a null
    threshold, and their documents are kept: there is no evidence against them. Otherwise as
    :func:`perplexities`, for null, empty, long and repeated rows, empty input and other columns.
    """
    spared = F.pmod(F.xxhash64(F.lit("calibration"), id_col), F.lit(5)) == 0
    scored = cut(perplexities(docs, trusted.filter(~spared), id_col, text_col, lang_col))
    known = trusted.select(id_col).filter(spared & F.col(id_col).isNotNull()).distinct()
    limits = cut(scored.join(known, id_col, "left_semi").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_IDS else limits  # a row for each language
    return scored.join(limits, "lang", "left").select(id_col, F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "perplexity", "threshold", ((F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))
