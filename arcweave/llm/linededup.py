"""Line dedup with sharded minimal perfect hashes.

1. Every document gives its distinct line keys (128-bit hashes of the keys
   long enough); partial aggregates count documents and keep the largest
   doc_id, so a line in every document is summed before it is shuffled.
2. Keys that enough documents hold are dealt to shards by hash.  Each shard is
   a minimal perfect hash (levels of bit arrays with ranks) into compact
   arrays: a 64-bit fingerprint that rejects strangers, the count, and the
   largest doc_id.  Keys too rare to decide anything are left out: a stranger
   and a rare key both mean "keep".
3. Documents are read again and probe the arrays, shard by shard for a batch
   of documents; lines are never joined or shuffled as text.  While all shards
   fit in a worker's share of memory, documents probe where they are.  Beyond
   that their line hashes travel to the shards, salted so that one line may be
   in any number of documents, each task streams them past one shard at a time,
   and only the places of dropped lines come back.  Both ways give the same rows.

Defined results: a null or empty text is one empty line; a null doc_id counts
as the smallest; rows that repeat a doc_id count as documents of their own,
and all rows of the largest doc_id keep the line.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import code_points, map_rows, slices, texts
from arcweave.llm.files import filesystem
from arcweave.plans.materialize import materialize, new_path

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard, about; bytes of shards that a worker keeps; bytes that a key takes, about.
SHARD_KEYS, CACHE_BYTES, KEY_BYTES = 500_000, 128 << 20, 28
#: Tasks over which the hashes that visit one shard are spread.
SALTS = 16
NULL_ID = -(1 << 63)
_GOLDEN = 0x9E3779B97F4A7C15


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + b * np.uint64((_GOLDEN * (2 * level + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class PerfectHash:
    """A minimal perfect hash over pairs of 64-bit words: each pair has a slot of its own in [0, n)."""

    GAMMA = 1.6
    LEVELS = 40

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self._ranks, first = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self._ranks.append(first + np.cumsum(ones) - ones)
            first += int(ones.sum())
        self.n = first

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, sizes = [], []
        for level in range(cls.LEVELS):
            if not len(a):
                break
            m = max(64, int(cls.GAMMA * len(a)))
            at = (_mix(a, b, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            words = np.zeros(-(-m // 64), dtype=np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(words)
            sizes.append(m)
            a, b = a[~alone], b[~alone]
        if len(a):
            raise ValueError("keys repeat")
        return cls(levels, sizes)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1 or any slot for a pair that was not built in."""
        out = np.full(len(a), -1, dtype=np.int64)
        open_ = np.arange(len(a))
        for level, (words, m) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(open_):
                break
            at = (_mix(a[open_], b[open_], level) % np.uint64(m)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self._ranks[level][at[hit] >> 6] + below
            open_ = open_[~hit]
        return out


class Shard:
    """Fingerprints, counts and largest ids of one shard's keys, by slot."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.index, self.prints, self.counts, self.last = index, prints, counts, last
        self.nbytes = sum(x.nbytes for x in (prints, counts, last, *index.levels, *index._ranks))

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        index = PerfectHash.build(a, b)
        order = np.argsort(index.slots(a, b))
        return cls(index, b[order], counts[order], last[order])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, last=self.last, sizes=np.array(self.index.sizes, dtype=np.int64),
                 **{f"l{i}": x for i, x in enumerate(self.index.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data))
        sizes = x["sizes"].tolist()
        return cls(PerfectHash([x[f"l{i}"] for i in range(len(sizes))], sizes), x["prints"], x["counts"], x["last"])

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each key; count 0 for strangers."""
        slot = self.index.slots(a, b)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == b[known]
        counts = np.zeros(len(a), dtype=np.int64)
        last = np.full(len(a), NULL_ID, dtype=np.int64)
        counts[known] = self.counts[slot[known]]
        last[known] = self.last[slot[known]]
        return counts, last


def _hash(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, n, last): documents and largest doc_id of every distinct line key that is long enough."""

    def rows(got, n):
        seen: dict[int, list[int]] = {}
        for doc_id, text in zip(got["doc_id"], got["text"], strict=True):
            doc_id = NULL_ID if doc_id is None else doc_id
            keys = {k for k in map(line_key, text.split(b"\n")) if len(k) >= min_chars and code_points(k) >= min_chars}
            for h in map(_hash, keys):
                held = seen.get(h)
                if held is None:
                    seen[h] = [1, doc_id]
                else:
                    held[0] += 1
                    held[1] = max(held[1], doc_id)
        raw = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in seen), dtype="<i8").reshape(-1, 2)
        return {"a": raw[:, 0], "b": raw[:, 1], "n": [v[0] for v in seen.values()], "last": [v[1] for v in seen.values()]}

    return (
        map_rows(docs.select("doc_id", "text"), "a long, b long, n long, last long", rows)
        .groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    )


def build_index(counts: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, int]:
    """Write the shards of keys that ``min_docs`` documents hold; (folder, number of shards, number of keys)."""
    spark = counts.sparkSession
    kept = materialize(counts.where(F.col("n") >= min_docs), "lines")
    keys = kept.count()
    shards = max(1, -(-keys // shard_keys))
    folder = new_path(spark, "line-index")

    def build(key, got):
        a, b, n, last = (got.column(c).to_numpy() for c in ("a", "b", "n", "last"))
        shard = Shard.build(a.view(np.uint64), b.view(np.uint64), n, last)
        return pa.table({"data": pa.array([shard.dump()], type=pa.binary()), "shard": pa.array([key[0].as_py()], type=pa.int64())})

    (
        kept.withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("long"))
        .groupBy("shard").applyInArrow(build, "data binary, shard long")
        .write.partitionBy("shard").parquet(folder)
    )
    return folder, shards, keys


class Index:
    """Shards read from the shared folder, as many as ``limit`` bytes hold."""

    def __init__(self, folder: str, shards: int, limit: int = CACHE_BYTES):
        self.shards, self._limit, self._bytes = shards, limit, 0
        self._fs, self._root = filesystem(folder)
        self._held: OrderedDict[int, Shard | None] = OrderedDict()

    def _shard(self, k: int) -> Shard | None:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        if k in self._held:
            self._held.move_to_end(k)
            return self._held[k]
        found = self._fs.get_file_info(pafs.FileSelector(f"{self._root}/shard={k}", allow_not_found=True))
        files = [f.path for f in found if f.path.endswith(".parquet")]
        shard = None
        if files:
            with self._fs.open_input_file(files[0]) as f:
                shard = Shard.load(pq.ParquetFile(f).read(columns=["data"]).column("data")[0].as_py())
            self._bytes += shard.nbytes
        self._held[k] = shard
        while self._bytes > self._limit and len(self._held) > 1:
            _, old = self._held.popitem(last=False)
            self._bytes -= old.nbytes if old else 0
        return shard

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(a), dtype=np.int64)
        last = np.full(len(a), NULL_ID, dtype=np.int64)
        shard = a.view(np.int64) % self.shards
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts):
            if len(part) and (s := self._shard(int(shard[part[0]]))):
                counts[part], last[part] = s.probe(a[part], b[part])
        return counts, last


def _long_lines(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(place, hash) of the lines whose keys are long enough."""
    out = []
    for j, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and code_points(key) >= min_chars:
                out.append((j, _hash(key).to_bytes(16, "little")))
    return out


def _visit(carried: DataFrame, folder: str, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """As probing in place, for an index of any size: line hashes go to the shards, places of dropped lines come back.

    Rows that repeat a doc_id and a text share their fate, so both name a row.
    """
    named = carried.select("doc", "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text"), "id": F.coalesce("doc_id", F.lit(NULL_ID))}
    )

    def hashes(got, n):
        rows = [(i, t, u, j, h) for i, t, u, x in zip(got["id"], got["t"], got["u"], got["text"], strict=True) for j, h in _long_lines(x, min_chars)]
        ids, t, u, at, h = zip(*rows, strict=True) if rows else ((),) * 5
        raw = np.frombuffer(b"".join(h), dtype="<i8").reshape(-1, 2)
        return {"id": ids, "t": t, "u": u, "at": at, "a": raw[:, 0], "b": raw[:, 1]}

    lines = map_rows(named.select("id", "t", "u", "text"), "id long, t long, u long, at int, a long, b long", hashes).distinct()
    shard = F.pmod("a", F.lit(shards))
    tasks = max(1, min(shards * SALTS, int(carried.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = lines.repartition(tasks, shard, F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions(shard)

    def probe(batches):
        index = Index(folder, shards, limit=1)  # hashes come by shard: one at a time
        for batch in batches:
            ids, a, b = (np.asarray(batch.column(i)) for i in (0, 4, 5))
            counts, last = index.probe(a.view(np.uint64), b.view(np.uint64))
            gone = pa.array((counts >= min_docs) & (ids != last))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(gone) for i in range(4)], names=["id", "t", "u", "at"])

    gone = dealt.mapInArrow(probe, "id long, t long, u long, at int").groupBy("id", "t", "u").agg(F.collect_set("at").alias("gone"))
    split = F.split("text", "\n")
    dropped = F.coalesce("gone", F.array().cast("array<int>"))
    return (
        named.join(gone, ["id", "t", "u"], "left")
        .withColumn("lines", split).withColumn("gone", dropped)
        .withColumn("kept", F.filter("lines", lambda x, i: ~F.array_contains(F.col("gone"), i)))
        .select(
            "doc", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: list[str] | None = None, cache_bytes: int = CACHE_BYTES, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """doc (a struct of the columns ``keep``, default doc_id), text without frequent lines, n_lines, n_dropped."""
    folder, shards, keys = build_index(line_counts(docs, min_chars), min_docs, shard_keys)
    carried = docs.select(F.struct(*(keep or ["doc_id"])).alias("doc"), "doc_id", "text")
    if keys * KEY_BYTES > cache_bytes:
        return _visit(carried, folder, shards, min_chars, min_docs)
    schema = f"doc {carried.schema['doc'].dataType.simpleString()}, text string, n_lines long, n_dropped long"

    def work(batches):
        index = None
        for batch in slices(batches):
            index = index or Index(folder, shards)
            whole = texts(batch.column(2))
            split = [t.split(b"\n") for t in whole]
            owner, where, hashes = [], [], []
            for i, text in enumerate(whole):
                for j, h in _long_lines(text, min_chars):
                    owner.append(i)
                    where.append(j)
                    hashes.append(h)
            dropped: dict[int, set[int]] = {}
            if hashes:
                raw = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)
                counts, last = index.probe(np.ascontiguousarray(raw[:, 0]), np.ascontiguousarray(raw[:, 1]))
                doc = np.array([NULL_ID if x is None else x for x in batch.column(1).to_pylist()], dtype=np.int64)[owner]
                for k in np.flatnonzero((counts >= min_docs) & (doc != last)):
                    dropped.setdefault(owner[k], set()).add(where[k])
            for i, gone in dropped.items():
                split[i] = [x for j, x in enumerate(split[i]) if j not in gone]
            n_dropped = [len(dropped.get(i, ())) for i in range(len(split))]
            n_lines = [len(x) + d for x, d in zip(split, n_dropped, strict=True)]
            text = pa.array([b"\n".join(x) for x in split], type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["doc", "text", "n_lines", "n_dropped"],
            )

    return carried.mapInArrow(work, schema)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text``; all columns stay, an ``n_chars`` is counted anew."""
    out = dedup_lines(docs, min_chars, min_docs, [c for c in docs.columns if c != "text"])
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def digest_rows(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of what :func:`dedup_lines` returns."""
    return deduped.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
