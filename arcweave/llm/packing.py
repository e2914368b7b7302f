"""Packing documents into sequences by patterns fitted to the length histogram.

1. Documents become token ids; only those longer than ``size`` are cut, into
   pieces of ``size`` tokens.
2. The histogram of piece lengths has at most ``size`` bars, whatever the
   corpus.  On the driver, patterns of one to three lengths that fill a
   sequence exactly are enumerated, non-negative least squares by active sets
   fits how often each repeats, counts are rounded by largest remainder, and
   what is left is packed best-fit, longest first, over the histogram.  The
   plan says, for each length, which ranks go to which sequences and where.
3. Every piece finds its rank among those of its length and looks its place up
   in the plan.  Ranks are counted in salted groups, as many as a length's own
   count asks for, so a length that a third of all pieces share is dealt over
   many tasks and a rare one makes no groups.

Defined results: a null or empty text is the closing id alone; a null doc_id
passes through; repeated rows are packed each; no rows give no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm.common import give_back, slices
from arcweave.plans.materialize import materialize

SIZE = 2048
#: Words whose ids a worker remembers.
REMEMBERED = 300_000
#: Pieces of one length that are ranked in one group, about: a 4096th of all, within these bounds.
LEAST_GROUP, GROUP = 1000, 50_000
#: Texts of these characters are split at white space word by word; others go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, never joins across white space and ends words
    with a mark, so plain texts are encoded word by word from a bounded memory
    of words; merges run over bytes, the mark being the zero byte, which plain
    texts never hold.  Any other text is given to the tokenizer itself.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a vocabulary with word ends is needed")
        of = _byte_of_char()
        ranks = {}
        for token, i in model["vocab"].items():
            if not token.startswith("<|"):
                core, end = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
                ranks[bytes(of[c] for c in core) + end] = i
        merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._whole = Tokenizer.from_file(path)

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if word.isalpha():
                    ids = array("I", merge(word + "\0")).tobytes()
                else:
                    ids = b"".join(array("I", merge(p + "\0")).tobytes() for p in _PARTS.findall(word))
                if len(self) < remembered:
                    self[word] = ids
                return ids

        self._words = Words()
        give_back()

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self._words.__getitem__, text.lower().split()))
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, tokenizer: str, size: int = SIZE, close: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32.

    ``with_ids`` adds the ids themselves.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def work(batches):
        encode, end = encoder(tokenizer), array("I", [close]).tobytes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            ids = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = encode(text or "") + end
                n = len(got) // 4
                for piece, start in enumerate(range(0, n, size)):
                    part = got[4 * start : 4 * (start + size)]
                    for column, x in zip(out, (doc_id, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)]
            if with_ids:
                columns.append(pa.array(ids, type=pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths, falling, that sum to ``size``; zeros fill rows of fewer. Bounded by size squared / 12."""
    have = np.zeros(size + 1, dtype=bool)
    have[present] = True
    have[0] = True
    rows = []
    for a in range(size, 0, -1):
        if not have[a]:
            continue
        left = size - a
        b = np.arange((left + 1) // 2, min(a, left) + 1)
        c = left - b
        ok = have[b] & have[c]
        if ok.any():
            rows.append(np.stack((np.full(ok.sum(), a), b[ok], c[ok]), axis=1))
    return np.concatenate(rows) if rows else np.empty((0, 3), dtype=int)


#: Patterns looked at when new ones enter the fit, those of the steepest descent.
PRICED = 20_000


def fit_counts(found: np.ndarray, histogram: np.ndarray, rounds: int = 60, gain: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Indices and repeat counts x > 0 of the patterns that minimise |A x - h| over x >= 0, by active sets.

    Patterns of the steepest descent that share no length enter together; the
    least squares of all that are in are solved exactly, and patterns leave
    while one of them would be negative.  A pattern enters only where it falls
    out of the others' span, so at most as many as there are lengths stay: the
    counts are few and large enough to be rounded.  The fit ends where no
    pattern descends, where the misfit is below what rounding adds anyway, or
    where two rounds bring less than ``gain``.
    """
    size = len(histogram) - 1
    rows = np.flatnonzero(histogram[1:]) + 1
    at = np.zeros(size + 1, dtype=int)
    at[rows] = np.arange(len(rows))
    h = np.zeros(size + 1)
    h[rows] = histogram[rows]
    noise = 0.5 * np.sqrt(len(rows))

    def solve(used):
        a = np.zeros((len(rows), len(used)), dtype=np.float32)  # small whole numbers are exact
        for column in found[used].T:
            held = np.flatnonzero(column)
            np.add.at(a, (at[column[held]], held), 1)
        normal = (a.T @ a).astype(float)
        normal[np.diag_indices_from(normal)] += 1e-8
        x = np.linalg.solve(normal, a.T @ h[rows])
        left = np.zeros(size + 1)
        left[rows] = h[rows] - a @ x
        return x, left

    used, x, left = np.zeros(0, dtype=int), np.zeros(0), h
    best = (np.linalg.norm(h), used, x)
    stale = 0
    for _ in range(rounds):
        slope = left[found].sum(axis=1)
        slope[used] = 0
        top = slope.max(initial=0.0)
        if top <= 1e-9 * h.max(initial=0.0) or best[0] <= noise or stale == 2:
            break
        steep = np.flatnonzero(slope > 0.05 * top)
        if len(steep) > PRICED:
            steep = steep[np.argpartition(-slope[steep], PRICED)[:PRICED]]
        steep = steep[np.argsort(-slope[steep], kind="stable")]
        entering = []
        while len(steep):
            entering.append(steep[0])
            steep = steep[~np.isin(found[steep], found[steep[0]][found[steep[0]] > 0]).any(axis=1)]
        used = np.concatenate((used, np.array(entering)))
        x, left = solve(used)
        while (x <= 0).any():
            used = used[x > 0]
            x, left = solve(used)
        misfit = np.linalg.norm(left)
        stale = 0 if misfit < (1 - gain) * best[0] else stale + 1
        if misfit < best[0]:
            best = (misfit, used, x)
    return best[1], best[2]


def fit(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeat counts) of a length histogram; full pieces are patterns of their own."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = left[size] = 0
    found = patterns(np.flatnonzero(left), size)
    used, x = fit_counts(found, left)
    return found[used], x


def whole_counts(found: np.ndarray, x: np.ndarray, histogram: np.ndarray, remainders: bool = True) -> np.ndarray:
    """Counts rounded down, then up by largest remainder, as far as the histogram holds the pieces."""
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(x), dtype=np.int64)
    needs = [Counter(int(v) for v in row if v) for row in found]

    def take(i: int, n: int) -> None:
        n = min(n, *(int(left[v]) // k for v, k in needs[i].items()))
        if n > 0:
            out[i] += n
            for v, k in needs[i].items():
                left[v] -= n * k

    down = np.floor(x + 1e-9).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        take(i, int(down[i]))
    if remainders:
        for i in np.argsort(down - x, kind="stable"):
            if x[i] > down[i]:
                take(i, 1)
    return out


class Plan:
    """Where each rank of each length goes: runs (length, first rank, count, copies, sequence, offset).

    In a run, the i-th rank (from 0) is copy ``i % copies`` in sequence
    ``sequence + i // copies``, at ``offset + (i % copies) * length``.
    """

    def __init__(self, histogram: np.ndarray, found: np.ndarray | None = None, counts: np.ndarray | None = None):
        size = len(histogram) - 1
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        self._used = np.zeros(size + 1, dtype=np.int64)
        self._runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.patterned = 0
        for row, n in zip(found if found is not None else (), counts if counts is not None else (), strict=True):
            if n < 1:
                continue
            offset = 0
            for v in (int(v) for v in row if v):
                self._take(v, int(n), 1, self.sequences, offset)
                left[v] -= n
                offset += v
                self.patterned += int(n)
            self.sequences += int(n)
        self._best_fit(left, size)
        runs = np.array(sorted(self._runs), dtype=np.int64).reshape(-1, 6)
        self.runs = runs
        self._key = runs[:, 0] * (1 << 48) + runs[:, 1]

    @classmethod
    def best(cls, histogram: np.ndarray) -> Plan:
        """The plan of the fitted patterns.

        Rounding up takes more pieces by patterns than rounding down; where
        that, or any pattern at all, would cost a sequence, it is not done.
        """
        found, x = fit(histogram)
        tried = [whole_counts(found, x, histogram), whole_counts(found, x, histogram, remainders=False), np.zeros(len(x), dtype=np.int64)]
        return min((cls(histogram, found, n) for n in tried), key=lambda p: p.sequences)

    def _take(self, length: int, n: int, copies: int, sequence: int, offset: int) -> None:
        self._runs.append((length, int(self._used[length]), n, copies, sequence, offset))
        self._used[length] += n

    def _best_fit(self, left: np.ndarray, size: int) -> None:
        groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many alike)
        rooms: list[int] = []
        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if not groups.setdefault(room, []):
                    insort(rooms, room)
                groups[room].append((first, n))

        for v in range(size, 0, -1):
            n = int(left[v])
            while n:
                i = bisect_left(rooms, v)
                if i < len(rooms):
                    room = rooms[i]
                    first, alike = groups[room].pop()
                    if not groups[room]:
                        rooms.pop(i)
                else:
                    room, first, alike = size, self.sequences, -(-n // (size // v))
                    self.sequences += alike
                copies = room // v
                full = min(alike, n // copies)
                if full:
                    self._take(v, full * copies, copies, first, size - room)
                    put(room - copies * v, first, full)
                    n -= full * copies
                rest = min(n, copies) if full < alike else 0
                if rest:
                    self._take(v, rest, rest, first + full, size - room)
                    put(room - rest * v, first + full, 1)
                    n -= rest
                put(room, first + full + (rest > 0), alike - full - (rest > 0))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks (from 0)."""
        at = np.searchsorted(self._key, length * (1 << 48) + rank, side="right") - 1
        run = self.runs[at]
        i = rank - run[:, 1]
        return run[:, 4] + i // run[:, 3], run[:, 5] + i % run[:, 3] * length


def ranked(pieces: DataFrame, histogram: np.ndarray) -> DataFrame:
    """``pieces`` with their rank (from 0) among those of their length."""
    group = max(LEAST_GROUP, min(GROUP, int(histogram.sum()) // 4096))
    dealt = [(v, -(-int(n) // group)) for v, n in enumerate(histogram) if n]
    salts = F.broadcast(pieces.sparkSession.createDataFrame(dealt, "length long, salts int"))  # at most ``size`` rows
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("salts")
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    before = counts.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return (
        salted.withColumn("rn", F.row_number().over(w))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("rn") - 1)
        .drop("salt", "rn", "before")
    )


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32)."""
    pieces = materialize(pieces, "pieces")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[row["length"]] = row["count"]
    plan = Plan.best(histogram)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 5))
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    return ranked(pieces, histogram).select(*names[:5], "rank").mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, close: int = 0) -> DataFrame:
    """Tokenize and pack every row of ``docs`` (doc_id, text)."""
    return pack(tokenize(docs, tokenizer, size, close), size)
