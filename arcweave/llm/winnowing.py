"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of each window of ``w``
hashes the least is chosen, the rightmost one on ties, and kept with its
position.  Any passage of at least ``w + k - 1`` code points that two texts
share has a hash chosen in both; runs shorter than ``k`` are never matched.

Defined results: a null text counts as empty; a text shorter than ``k`` is one
run; an empty text has no hashes, and two fingerprints without hashes are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import slices

K, W = 24, 40
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Hashes computed at a time, so that long texts need bounded memory.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


class _Tables:
    n = 0


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _Tables.n:
        size = max(4096, 1 << (n - 1).bit_length())
        _Tables.up, _Tables.down, _Tables.n = _powers(_BASE, size), _powers(_INVERSE, size), size
    return _Tables.up, _Tables.down


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` codes, equal for equal runs."""
    n = len(codes) - k + 1
    up, down = _tables(len(codes))
    # sums of code[i] / base^i: the difference of two, times base^start, depends on the run alone
    sums = np.empty(len(codes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least_rightmost(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` hashes the place of the least, rightmost on ties."""
    n = len(h) - w + 1
    value, place, span = h, np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        m = len(value) - step
        right = value[step:] <= value[:m]
        place = np.where(right, place[step:], place[:m])
        value = np.minimum(value[step:], value[:m])
        span += step
    return place[:n]


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from a text, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(codes))
    hashes, places = [], []
    last = -1
    total = len(codes) - k + 1
    for at in range(0, max(1, total - w + 1), CHUNK):  # windows that begin at [at, at + CHUNK)
        h = rolling(codes[at : at + CHUNK + w + k - 2], k)
        p = _least_rightmost(h, min(w, len(h)))
        p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        p = p[p + at > last]
        hashes.append(h[p])
        places.append(p + at)
        last = int(places[-1][-1]) if len(p) else last
    return np.concatenate(hashes), np.concatenate(places)


def digest(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """A fixed-length name of a fingerprint: hashes and positions."""
    h = hashlib.blake2b(chosen[0].astype("<u8").tobytes(), digest_size=16)
    h.update(chosen[1].astype("<i8").tobytes())
    return h.hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes, positions) for every row of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [winnow(t or "", k, w) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([h.view(np.int64) for h, _ in got], type=pa.list_(pa.int64())),
                    pa.array([p for _, p in got], type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "hashes", "positions"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, hashes array<long>, positions array<long>")


def splits(docs: DataFrame, parts: int) -> list[int]:
    """Ids that part the rows into about ``parts`` ranges (at most that many, whatever the corpus)."""
    if parts < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


#: Bins by which the range of an id is looked up.
BINS = 1 << 14


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` (ascending) lie below ``key``: a table by the key's high bits, then the few cuts in its bin."""
    if not cuts:
        return F.lit(0)
    shift = 0
    while (cuts[-1] >> shift) - (cuts[0] >> shift) >= BINS:
        shift += 1
    first = cuts[0] >> shift
    inside = np.bincount([(c >> shift) - first for c in cuts])
    below = np.cumsum(inside) - inside
    held = F.least(F.greatest(F.shiftright(key, shift), F.lit(first)), F.lit(first + len(inside) - 1))
    at = (held - F.lit(first)).cast("int") + 1
    array = lambda values: F.array(*[F.lit(int(v)) for v in values])
    start, n = F.element_at(array(below), at), F.element_at(array(inside), at)
    held = F.slice(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), start + 1, n)
    return start + F.size(F.filter(held, lambda c: c < key))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of doc_id, each followed by the first row of the next range.

    Rows: part, doc_id, text, extra.  ``extra`` marks the copy of the row that
    follows the range (after the last range: the first row of all).  Only the
    boundaries, one id per range, pass through the driver.
    """
    cuts = splits(docs, parts)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # a null doc_id comes first
    part = range_of(key, cuts)
    rows = docs.select(part.alias("part"), "doc_id", "text", key.alias("key"))
    # the rows that may begin a range: those of its smallest key (repeated ids: the smallest text)
    firsts = {r["part"]: r["key"] for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect()}
    order = sorted(firsts)
    if not order:
        return rows.select("part", "doc_id", "text", "key", F.lit(0).alias("extra"))
    before = {p: order[i - 1] for i, p in enumerate(order)}
    lead = rows.where(F.col("key").isin([int(k) for k in firsts.values()]))
    back = F.create_map(*[F.lit(int(x)) for p in order for x in (p, before[p])])
    lead = lead.groupBy("part", "doc_id", "key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(
        F.element_at(back, F.col("part")).alias("part"), "doc_id", "text", "key", F.lit(1).alias("extra")
    )
    return rows.select("part", "doc_id", "text", "key", F.lit(0).alias("extra")).unionByName(lead)


def compare_with_edits(docs: DataFrame, k: int = K, w: int = W, parts: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text and the next document.

    The edited text has its last quarter (floor) of code points replaced by as
    many first ones of the next document in ascending doc_id, or all it has;
    after the last document comes the first.  Rows of one doc_id follow one
    another by text.  A corpus of one row is its own next.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = with_next(docs.select("doc_id", "text"), parts)
    ordered = placed.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions(
        "part", "extra", "key", F.coalesce("text", F.lit(""))
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, doc_id, text, chosen, set
        out: list[tuple] = []
        for batch in slices(batches):
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for part, doc_id, text, extra in zip(*cols, strict=True):
                text = text or ""
                same = held and held[2] == text
                chosen = held[3] if same else winnow(text, k, w)
                hashes = held[4] if same else np.unique(chosen[0])
                if held and held[0] == part:
                    cut = len(held[2]) // 4
                    edited = held[2][: len(held[2]) - cut] + text[:cut]
                    changed = winnow(edited, k, w)
                    out.append((
                        held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(held[3]),
                        digest(changed), likeness(held[4], np.unique(changed[0])), likeness(held[4], hashes),
                    ))
                held = None if extra else (part, doc_id, text, chosen, hashes)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=arrow)
                out = []

    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
    return ordered.select("part", "doc_id", "text", "extra").mapInArrow(work, schema)
