"""Tokenise documents and pack them into sequences of bounded length, balanced by attention cost.

Every task packs its own partition, buffer by buffer, so nothing is shuffled and a lost task can
be run again alone. The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n
* n``; documents go in descending order to the sequence of lowest cost that still has room. What
fits nowhere whole is cut to fill the gaps, so all sequences but a task's last few are full; those
take lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import array
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from itertools import chain, compress, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from modweave.runtime import give_back, kept

#: Entries of an encoder's two caches, beyond which only those used most are kept.
CACHE_CHUNKS, CACHE_PARTS = 500_000, 500_000
#: Bytes of text that are looked up at once.
GROUP_BYTES = 1 << 20
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 1_000_000

_OTHER = re.compile(r"[^\n!-~¡-ÿ]")


def _parts_pattern() -> re.Pattern[str]:
    """The tokenizer's split for Latin-1 text, and line feeds."""
    letters, digits = ("".join(c for c in map(chr, range(256)) if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+|\n")


_PARTS = _parts_pattern()


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of byte-level BPE: visible Latin-1 bytes stay, others follow from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Table:
    """Token ids of strings, each computed once and kept while it is used.

    ``learn`` takes new strings and returns all their ids, and where each string's ids stop.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self._keep([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _keep(self, keys: list[str], ids: np.ndarray, stops: np.ndarray, uses: np.ndarray) -> None:
        self.rows = defaultdict(count(len(keys)).__next__, zip(keys, range(len(keys)), strict=True))  # a new string gets the next number
        self.ids, self.starts, self.uses = array.array("I", ids.tobytes()), array.array("q", [0]), uses
        self.starts.frombytes(stops.tobytes())

    def _trim(self) -> None:
        """Keep at most the half that is used most, if there are too many."""
        if len(self.rows) != len(self.uses):  # a task failed before the ids were there
            self.clear()
        if len(self.rows) > self.most or len(self.ids) > 16 * self.most:
            good = self.uses > np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]
            self._keep(list(compress(self.rows, good.tolist())), *self.take(np.flatnonzero(good)), self.uses[good] // 2)
            if len(self.ids) > 8 * self.most:
                self.clear()

    def find(self, keys: Collection[str]) -> np.ndarray:
        """The rows of strings, for ``take``; they hold until the next call."""
        self._trim()
        known = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        if fresh := list(islice(reversed(self.rows), len(self.rows) - known)):
            ids, stops = self.learn(fresh[::-1])
            self.starts.frombytes((stops + len(self.ids)).tobytes())
            self.ids.frombytes(ids.tobytes())
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        self.uses += np.bincount(rows, minlength=len(self.uses))
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows, and where each row's ids stop."""
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        first = starts[rows]
        size = starts[rows + 1] - first
        stops = np.cumsum(size)
        return ids[np.repeat(first - stops + size, size) + np.arange(size.sum())], stops


class Encoder:
    """Token ids by a tokenizer file, with the ids of each run without ASCII white space cached.

    The tokenizer never joins text across white space, so a document's ids are those of its
    runs. Runs of Latin-1 letters and signs are split and given to the BPE model directly; any
    others go through the whole tokenizer. Texts are looked up in groups, each different run once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        del self.letters[ord("\n")]  # ends a run or a part here
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks, self.parts = Table(self._learn_chunks, CACHE_CHUNKS), Table(self._learn_parts, CACHE_PARTS)

    def _learn_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = "\n".join("" if p == "\n" else p for p in parts).encode().decode("latin-1").translate(self.letters)
        found = [[t.id for t in self.model.tokenize(line)] for line in lines.split("\n")]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(ids) for ids in found])

    def _learn_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text, whole = "\n".join(chunks), {}
        if _OTHER.search(text) or any(s in text for s in self.special):
            whole = {k: self.tokenizer.encode(c, add_special_tokens=False).ids for k, c in enumerate(chunks) if _OTHER.search(c) or any(s in c for s in self.special)}
            text = "\n".join("" if k in whole else c for k, c in enumerate(chunks))
        parts = _PARTS.findall(text.lower() + "\n")
        ids, stops = self.parts.take(self.parts.find(parts))
        stops = stops[[k for k, part in enumerate(parts) if part == "\n"]]
        if whole:
            size = np.zeros(len(chunks), np.int64)
            size[list(whole)] = [len(w) for w in whole.values()]
            ids = np.insert(ids, np.repeat(stops, size), np.fromiter(chain.from_iterable(whole.values()), np.uint32))
            stops = stops + np.cumsum(size)
        return ids, stops

    def encode(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """ids of each text and the id ``end``."""
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(size, GROUP_BYTES + (size[at - 1] if at else 0), "right")))
            runs = pc.ascii_split_whitespace(texts.slice(at, stop - at).cast(pa.string()))
            words = runs.flatten().dictionary_encode()
            rows = self.chunks.find(words.dictionary.to_numpy(zero_copy_only=False))
            ids, stops = self.chunks.take(rows[words.indices.to_numpy()])
            bounds = np.concatenate([[0], stops])[np.cumsum([0, *runs.value_lengths().to_numpy()])]
            for a, b in pairwise(bounds.tolist()):
                yield np.append(ids[a:b], np.uint32(end))
            at = stop


_encoders: dict[str, Encoder] = kept()


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def rest() -> None:
    """Return freed memory; encoders stay."""
    give_back(_encoders)


Piece = tuple[int, int, int]  # document, start, length


def assign(pieces: list[Piece], size: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of ``size`` tokens, and the pieces (fewer than ``size`` tokens) that remain."""
    done: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, start, n in pieces:
        while n >= size:
            done.append([(doc, start, size)])
            start, n = start + size, n - size
        if n:
            rest.append((doc, start, n))
    rest.sort(key=lambda p: -p[2])
    bins = sum(p[2] for p in rest) // size
    if not bins:
        return done, rest
    room, cost = np.full(bins, size, np.int64), np.zeros(bins)
    filled: list[list[Piece]] = [[] for _ in range(bins)]
    homeless = []
    for p in rest:
        open_cost = np.where(room >= p[2], cost, np.inf)
        at = int(open_cost.argmin())
        if open_cost[at] == np.inf:
            homeless.append(p)
            continue
        filled[at].append(p)
        room[at] -= p[2]
        cost[at] += linear * p[2] + quadratic * p[2] * p[2]
    gaps = [k for k in np.argsort(-room, kind="stable").tolist() if room[k]]
    left = []
    for doc, start, n in homeless:
        while n and gaps:
            k = gaps[0]
            take = min(n, int(room[k]))
            filled[k].append((doc, start, take))
            room[k] -= take
            start, n = start + take, n - take
            if not room[k]:
                gaps.pop(0)
        if n:
            left.append((doc, start, n))
    return done + filled, left


def finish(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two (under ``size``) for the last pieces of a task."""
    total, at, done = sum(p[2] for p in pieces), 0, []
    queue = list(pieces)
    for bit in range(size.bit_length(), -1, -1):
        if total >> bit & 1:
            want, now = 1 << bit, []
            while want:
                doc, start, n = queue[at]
                take = min(n, want)
                now.append((doc, start, take))
                want -= take
                queue[at] = (doc, start + take, n - take)
                at += take == n
            done.append(now)
    return done


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost (and ids).

    A null text counts as empty and has the one token ``end_id``. Repeated rows are packed each for
    itself; null ids are kept. Cost is the estimate for the whole sequence. Sequence ids are unique,
    and the same whenever the same partitions are read. Empty input gives no rows; other columns
    are not read. The tokenizer file must be readable at its path on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double" + (", ids array<int>" if with_ids else "")

    def run(batches):
        enc = encoder(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, np.ndarray]] = {}
        waiting: list[Piece] = []
        made = n_docs = tokens = 0

        def rows(sequences):
            nonlocal made
            out: list[list] = [[] for _ in range(8 + with_ids)]
            for pieces in sequences:
                at, cost = 0, sum(n + n * n / 2048 for _, _, n in pieces)
                for doc, start, n in pieces:
                    name, ids = held[doc]
                    own = ids[start : start + n]
                    for column, value in zip(out, (name, start, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), first + made, at, cost, *([own.astype(np.int32)] if with_ids else [])), strict=True):
                        column.append(value)
                    at += n
                made += 1
            arrays = [pa.array(out[0], id_type), *(pa.array(c, pa.int64()) for c in out[1:7]), pa.array(out[7], pa.float64()), *([pa.array(out[8], pa.list_(pa.int32()))] if with_ids else [])]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", *(["ids"] if with_ids else [])])

        id_type = None
        for batch in batches:
            id_type, names = batch.schema.field(0).type, batch.column(0).to_pylist()
            for name, ids in zip(names, enc.encode(batch.column(1), end_id), strict=True):
                held[n_docs] = (name, ids)
                waiting.append((n_docs, 0, len(ids)))
                n_docs, tokens = n_docs + 1, tokens + len(ids)
                if tokens >= BUFFER_TOKENS:
                    sequences, waiting = assign(waiting, size)
                    yield rows(sequences)
                    held = {d: held[d] for d, _, _ in waiting}
                    tokens = sum(n for _, _, n in waiting)
            rest()
        if waiting:
            sequences, waiting = assign(waiting, size)
            yield rows(sequences + finish(waiting, size))
        held.clear()
        rest()

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")).mapInArrow(run, fields)
