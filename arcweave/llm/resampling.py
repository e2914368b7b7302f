"""Importance resampling towards a target distribution.

Texts are bags of hashed features: all runs of one to three words, in
``BUCKETS`` buckets by CRC-32.  A bucket's gain is the log ratio of its smoothed
shares in the target and in the whole; a document's weight sums the gains of
its features, and a draw without replacement is the largest of weight plus
Gumbel noise from a hash of the document's number.

1. Every task counts its features in one array of ``BUCKETS`` longs; the sums
   of these arrays, a fixed size, meet on the driver and become the gains.
2. The gains are an array within the tasks: a document's weight is one lookup a
   feature and a sum.
3. The k-th best key (score from above, then doc_id from below) is found by
   radix selection: its 128 bits are taken in digits of 16 bits from the top;
   each round counts the next digit of the rows that agree with the digits
   found, at most 65,536 counts whatever the input, and stops as soon as a
   whole digit is taken.
4. Only rows from that key on are range-sorted; ranks are offsets of the ranges
   plus places within them.

Rows that agree in all columns are ranked as one with a count, so a row that
repeats without end meets in one task as one row.

Defined results: null and blank texts have no features and weight 0.  Rows with
a null doc_id have no noise: score and rank are null and they don't count among
the candidates.  Repeated rows are candidates each; of equal keys any are drawn,
as many as belong.  No candidates, or a share that rounds to none, draw nothing;
an empty target gives gains of the smoothing alone.  Texts of any length are
taken whole; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm.common import map_rows, slices, texts
from arcweave.plans.materialize import materialize, stat

BUCKETS, MOST_WORDS = 10_000, 3
#: Bits of a digit of the radix selection.
DIGIT = 16
#: Lower-cased letters, digits and bytes beyond ASCII; all else parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words of a text and the buckets of its features."""
    words = text.translate(_WORDS).split()
    runs = list(map(crc32, words))
    found, more = [runs], [b" " + w for w in words]
    for length in range(1, MOST_WORDS):
        # a checksum goes on from that of the run without its last word
        runs = list(map(crc32, more[length:], runs))
        found.append(runs)
    return len(words), np.concatenate([np.array(r, dtype=np.uint32) for r in found]) % BUCKETS


def bucket_counts(texts_of: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows of ``texts_of`` (text)."""

    def work(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches):
            for t in texts(batch.column(0)):
                total += np.bincount(features(t)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts_of.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw by a hash of the document's number, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text)."""

    def rows(got, n):
        found = [features(t) for t in got["text"]]
        return {
            "doc_id": got["doc_id"],
            "n_words": [w for w, _ in found],
            "n_features": [len(f) for _, f in found],
            "weight": [int(gains[f].sum()) for _, f in found],
        }

    weighed = map_rows(docs.select("doc_id", "text"), "doc_id long, n_words long, n_features long, weight long", rows)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _digits(score: Column, doc_id: Column) -> list[Column]:
    """The key as unsigned digits from the top: higher scores are larger, then smaller doc_ids."""
    top = F.lit(-(1 << 63)).cast("long")
    halves = (score.bitwiseXOR(top), F.bitwise_not(doc_id.bitwiseXOR(top)))
    return [F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << DIGIT) - 1)) for x in halves for s in range(64 - DIGIT, -1, -DIGIT)]


def kth_key(keys: DataFrame, k: int) -> list[int]:
    """Leading digits such that exactly ``k`` of the rows (score, doc_id) lie at or above them, but for equal rows at the k-th.

    ``k`` is at least 1 and at most the number of rows.
    """
    digits, found, left = _digits(F.col("score"), F.col("doc_id")), [], k
    for digit in digits:
        same = keys
        for d, v in zip(digits, found, strict=False):
            same = same.where(d == v)
        counts = sorted(((r["digit"], r["n"]) for r in same.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for value, n in counts:
            if n >= left:
                break
            left -= n
        found.append(value)
        if n == left:
            break
    return found


def at_or_above(found: list[int]) -> Column:
    """Whether a row's key is at or above the digits of :func:`kth_key`."""
    out = F.lit(True)
    for d, v in reversed(list(zip(_digits(F.col("score"), F.col("doc_id")), found, strict=False))):
        out = (d > v) | ((d == v) & out)
    return out


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with their rank by key, null beyond ``k``; equal rows take neighbouring ranks."""
    columns = rows.columns
    order = [F.desc("score"), F.asc("doc_id"), *[F.asc(c) for c in columns if c not in ("score", "doc_id")]]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    placed = materialize(counted.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}  # one row a range
    before, at = [], 0
    for p in range(max(sums, default=0) + 1):
        before.append(at)
        at += sums.get(p, 0)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.get(F.array(*map(F.lit, before)), F.col("_part")).cast("long") + F.sum("_n").over(w)
    ranks = placed.withColumn("_last", last).withColumn("rank", F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))))
    return ranks.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank of the drawn ``percent`` of the candidates, else null.

    Candidates are the rows with a doc_id and at least ``least_words`` words;
    ``target`` (text) holds the texts whose distribution is wanted.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    scored = materialize(weigh(docs, gains, seed), "scored", n=F.count_if(able))
    k = percent * stat(scored, "n") // 100
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.withColumn("rank", F.lit(None).cast("long"))
    if not k:
        return rest.select(*out, "rank")
    drawn = able & at_or_above(kth_key(scored.where(able), k))
    return ranked(scored.where(drawn).select(*out), k).union(rest.where(~drawn).select(*out, "rank"))
