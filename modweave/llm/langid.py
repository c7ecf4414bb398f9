"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree (orders 0 to 3). A symbol is coded in the
longest kept context that has seen it, after paying the escape probability of each longer one
(method C), with the symbols of the longer contexts excluded. The statistics are frozen after
training, so the code length of every (context, byte) pair is a constant: the trees are compiled
into one table of code lengths, and a text is scored by two look-ups for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from modweave.llm.bytegrams import ORDER, PAD, codes
from modweave.runtime import give_back

#: Training takes about so many documents of each language, picked by a hash of their id.
SAMPLE_PER_LANG = 1500
#: The compiled table has at most so many (state, byte) cells of 4 bytes for each language, however many there are.
CELLS = 3_000_000
#: Contexts seen less often than this in every language, by order, are pruned: the next shorter one codes for them.
LEAST_SEEN = (0, 1, 8, 32)
STEP = 1_000_000


class Model:
    """Compiled context trees: ``langs``, byte classes, state of each 3-byte context, code lengths in bits."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: for each language the 4-byte grams (first byte highest) and their counts."""
        self.langs = langs
        seen = np.zeros(256, bool)
        seen[list(PAD)] = True
        for found, _ in grams.values():
            for k in (0, 8, 16, 24):
                seen[np.unique((found >> k) & 255)] = True
        self.classes = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.uint8 if seen.sum() < 255 else np.int32)
        self.size = a = int(seen.sum()) + 1
        other = max(1, 256 - int(seen.sum()))
        symbols, counts = {}, {}
        for lang in langs:
            found, n = grams[lang]
            c = self.classes.astype(np.int64)
            symbols[lang] = ((c[(found >> 24) & 255] * a + c[(found >> 16) & 255]) * a + c[(found >> 8) & 255], c[found & 255])
            counts[lang] = n.astype(np.float64)
        room, kept = max(1, CELLS // a), {0: np.zeros(1, np.int64)}
        for order in range(1, ORDER + 1):
            best = np.zeros(0)
            context = np.zeros(0, np.int64)
            for lang in langs:
                x, at = np.unique(symbols[lang][0] % a**order, return_inverse=True)
                n = np.bincount(at, counts[lang])
                context, best = np.concatenate([context, x]), np.concatenate([best, n])
            x, at = np.unique(context, return_inverse=True)
            most = np.zeros(len(x))
            np.maximum.at(most, at, best)
            ok = np.flatnonzero(most >= LEAST_SEEN[order])
            ok = ok[np.argsort(-most[ok], kind="stable")][: max(0, room - sum(map(len, kept.values())))]
            kept[order] = np.sort(x[ok])
        first = np.cumsum([0] + [len(kept[k]) for k in range(ORDER + 1)])
        self.state = np.zeros(a**ORDER, np.int32)
        parent = {0: np.zeros(1, np.int64)}
        for order in range(1, ORDER + 1):
            x = kept[order]
            parent[order] = self.state[x % a ** (order - 1)].astype(np.int64) if order > 1 else np.zeros(len(x), np.int64)
            view = self.state.reshape(a ** (ORDER - order), a**order)
            view[:, x] = first[order] + np.arange(len(x), dtype=np.int32)
        self.bits = np.zeros((int(first[-1]), a, len(langs)), np.float32)
        flat = np.full(a, 1 / 256)
        flat[-1] = 1 / 256 if seen.sum() < 256 else 1e-12
        for j, lang in enumerate(langs):
            prob = np.zeros((int(first[-1]), a))
            for order in range(ORDER + 1):
                x, (context, symbol) = kept[order], symbols[lang]
                context = context % a**order
                at = np.searchsorted(x, context)
                ok = (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == context) if len(x) else np.zeros(len(context), bool)
                c = np.bincount(at[ok] * a + symbol[ok], counts[lang][ok], len(x) * a).reshape(len(x), a)
                n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                below = prob[parent[order]] if order else flat[None, :]
                weight = np.ones(a)
                weight[-1] = other  # the last class stands for that many bytes
                left = np.where(c > 0, 0, below * weight).sum(1, keepdims=True)
                escaped = np.where(left > 0, below / np.maximum(left, 1e-300), 1 / 256)
                with np.errstate(invalid="ignore", divide="ignore"):
                    own = np.where(c > 0, c / (n + d), d / (n + d) * escaped)
                prob[first[order] : first[order + 1]] = np.where(n > 0, own, below)
            self.bits[:, :, j] = -np.log2(np.maximum(prob, 1e-30))
        self.bits = self.bits.reshape(int(first[-1]) * a, len(langs))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out, a = np.zeros((len(texts), len(self.langs))), self.size
        k = 0
        while k < len(texts):
            e, n = k, 0
            while e < len(texts) and (e == k or n + len(texts[e]) <= STEP):
                n += len(texts[e])
                e += 1
            ends = np.cumsum([len(t) + ORDER for t in texts[k:e]])
            starts = np.concatenate([[0], ends[:-1]])
            data = self.classes[np.frombuffer(PAD + PAD.join(texts[k:e]), np.uint8)].astype(np.int32)
            context = (data[:-3] * a + data[1:-2]) * a + data[2:-1]
            for at in range(0, len(context), STEP):  # a single text may be longer than a step
                cell = self.state[context[at : at + STEP]].astype(np.int64) * a + data[at + 3 : at + 3 + STEP]
                lo, hi = at, at + len(cell)
                own = np.flatnonzero((starts < hi) & (ends > lo))
                # the three steps that read padding as symbols belong to no text
                edge = np.stack([np.clip(starts[own], lo, hi), np.clip(ends[own] - ORDER, lo, hi)], 1) - lo
                rows = np.zeros((len(cell) + 1, len(self.langs)), np.float32)
                np.take(self.bits, cell, axis=0, out=rows[:-1], mode="clip")  # all cells are in range; only then no buffer is taken
                sums = np.add.reduceat(rows, edge.ravel(), axis=0, dtype=np.float64)[::2]
                out[k + own] += np.where((edge[:, 1] > edge[:, 0])[:, None], sums, 0)
            k = e
        return out


def _grams(batches):
    """(lang, gram, n): 4-byte grams of texts with a padded start, counted for each batch."""
    give_back()
    for batch in batches:
        yield from _counted(batch)
        give_back()


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        by.setdefault(lang, []).append(text)
    for lang, texts in by.items():
        x, n = np.unique(codes(texts)[0], return_counts=True)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(x), pa.string()), "gram": pa.array(x.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _judge(model: Model, texts: pa.Array) -> pa.StructArray:
    """(lang_pred, score, bits_per_byte) of each text; some texts at a time are taken out of the batch."""
    out = {"lang_pred": np.full(len(texts), "und", object), "score": np.zeros(len(texts)), "bits_per_byte": np.full(len(texts), np.nan)}
    told = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)) if model.langs else np.zeros(0, np.int64)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)[told]
    group = np.cumsum(sizes) // STEP
    for at, n in ((told[group == g], sizes[group == g]) for g in np.unique(group)):
        bits = model.code_lengths(texts.take(pa.array(at)).to_pylist())
        best = bits.argmin(1)
        out["lang_pred"][at] = np.array(model.langs, object)[best]
        out["score"][at] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        out["bits_per_byte"][at] = bits.min(1) / np.maximum(1, n)
    return pa.StructArray.from_arrays([pa.array(out["lang_pred"], pa.string()), pa.array(out["score"]), pa.array(out["bits_per_byte"], from_pandas=True)], names=list(out))


def _judged(model: Model, batches: Iterator[pa.Array]) -> Iterator[pa.StructArray]:
    """``_judge`` of each batch, in a worker that keeps nothing else meanwhile."""
    give_back()
    for texts in batches:
        yield _judge(model, texts)
        give_back()


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on rows with text and language, about ``per_lang`` of each language.

    The sample is picked by a hash of the id, so repeated rows come together. Rows with a null
    text or language are not used, empty texts teach nothing; no rows give a model without
    languages. Other columns, whatever their names, are not read.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1 << 20)).alias("pick")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {})
    part = F.create_map(*(x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1 << 20, (per_lang << 20) // n)))))
    found = rows.filter(F.col("pick") < part[F.col("lang")]).select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = {lang: (x["gram"].to_numpy(np.int64), x["n"].to_numpy(np.int64)) for lang, x in found.sort_values(["lang", "gram"]).groupby("lang")}
    return Model(sorted(grams), grams)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (posterior of the best language) and bits_per_byte.

    Only the text is read. lang_pred is ``und``, with score 0 and null bits_per_byte, where the text
    is null or has no letter, and everywhere if the model has no languages; the first language in
    alphabetical order wins a tie. Repeated rows get the same; long texts are scored in steps; empty
    input gives no rows. Columns of ``docs`` with these names are replaced, all others are kept.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _judged(shared.value, texts)

    udf = F.arrow_udf(score, "lang_pred string, score double, bits_per_byte double")
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col).cast("binary"))
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_kept"), udf(text).alias("_lid"))
    return told.select(*(F.col("_kept")[c].alias(c) for c in names), F.col("_lid.lang_pred").alias("lang_pred"), F.col("_lid.score").alias("score"), F.col("_lid.bits_per_byte").alias("bits_per_byte"))
