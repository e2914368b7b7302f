"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at most three bits apart are linked; a component is named by its
smallest doc_id.  Three bits are one and a half on each side, so:

1. Every distinct fingerprint emits its ball of radius 1 (65 variants).  Two
   that share a variant are at most two bits apart, and all that are at most
   two bits apart share one: each variant's members link to their smallest.
   A variant has at most 65 members, whatever the input holds.
2. A pair three bits apart differs in at least one of ``BLOCKS`` bit blocks.
   With that block left out the two are at most two bits apart, so their balls
   of radius 1 over the remaining bits meet.  Only fingerprints that so meet
   one of another component are kept as candidates; a group already joined by
   step 1 drops out, however large.
3. Candidates verify exactly: of two fingerprints three bits apart one has an
   even number of bits, one an odd.  Even ones emit their ball of radius 2,
   odd ones of radius 1.  Members of a variant's bucket of which one lies
   within radius 1 are all at most three bits from it, so they link to it;
   other buckets link nothing.

No pair of a group is ever listed: every step gives links to one member per
bucket, and the components of these links are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm.common import map_rows, slices, texts
from arcweave.operators.components import component_links
from arcweave.plans.materialize import materialize

#: Bit blocks of which one is left out in the search for pairs three bits apart.
BLOCKS = 3
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = 3, seed: int = 42, hashed: Callable | None = None) -> int:
    """The 64-bit fingerprint of a text over its word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    hashed = hashed or partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter(map(hashed, grams), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp is the fingerprint as a signed long."""

    def rows(got, n):
        fps = np.array([fingerprint(t, width, seed) for t in got["text"]], dtype=np.uint64)
        return {"doc_id": got["doc_id"], "fp": fps.view(np.int64)}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", rows)


def _flip(fp: Column, bits: list[int]) -> Column:
    """Array of ``fp`` and of it with each one of ``bits`` changed."""
    masks = F.array(*[F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in bits)])
    return F.transform(masks, lambda m: fp.bitwiseXOR(m))


def _star(members: DataFrame, key: str) -> DataFrame:
    """Links from each member of a bucket to its smallest near one (near: within radius 1)."""
    w = Window.partitionBy(key)
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(w)
    return members.select("fp", hub.alias("hub")).where("hub IS NOT NULL AND hub <> fp").distinct()


def near_links(nodes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(fp, component) of every fingerprint of ``nodes`` (fp, distinct) that has a link."""
    ball = nodes.select("fp", F.explode(_flip(F.col("fp"), list(range(64)))).alias("v"), F.lit(True).alias("near"))
    close = materialize(_star(ball, "v"), "close")
    first = component_links(close, "fp", "hub")
    joined = materialize(
        nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp")),
        "first",
    )
    variants = []
    for b in range(blocks):
        lo, hi = 64 * b // blocks, 64 * (b + 1) // blocks
        rest = [i for i in range(64) if not lo <= i < hi]
        mask = sum(1 << i for i in rest)
        mask -= (1 << 64) if mask >> 63 else 0
        kept = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        # the block's own bits are free: they tell the blocks apart
        tag = (b + 1) << lo
        tag -= (1 << 64) if tag >> 63 else 0
        variants.append(_flip(kept.bitwiseOR(F.lit(tag).cast("long")), rest))
    spread = joined.select("fp", "comp", F.explode(F.concat(*variants)).alias("v"))
    # a bucket holds at most 2 ** 21 values of the free block for each of 44 variants; the sort of a window may spill
    w = Window.partitionBy("v")
    met = materialize(
        spread.select("fp", (F.min("comp").over(w) < F.max("comp").over(w)).alias("meets")).where("meets").select("fp").distinct(),
        "candidates",
    )
    odd = F.bit_count("fp") % 2 == 1
    one = _flip(F.col("fp"), list(range(64)))
    pairs = F.expr(
        "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), "
        "j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    )
    two = F.when(odd, F.array().cast("array<bigint>")).otherwise(pairs)
    balls = met.select("fp", F.explode(F.concat(
        F.transform(one, lambda v: F.struct(v.alias("v"), F.lit(True).alias("near"))),
        F.transform(two, lambda v: F.struct(v.alias("v"), F.lit(False).alias("near"))),
    )).alias("x")).select("fp", "x.v", "x.near")
    far = _star(balls, "v")
    return component_links(close.select("fp", "hub").union(far.select("fp", "hub")), "fp", "hub")


def components(prints: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(fp, c, component_id): the smallest fingerprint and doc_id of the component of each fingerprint of (doc_id, fp)."""
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    linked = near_links(least.select("fp"), blocks)
    placed = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("c")
    )
    placed = materialize(placed, "placed")
    return placed.join(placed.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "c", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text).

    A null or blank text has fingerprint zero and links like any other; rows
    with a null doc_id keep it and take part; a component all of whose doc_ids
    are null has a null component_id.
    """
    prints = materialize(fingerprints(docs, width, seed), "prints")
    return prints.join(components(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest doc_id, with all its columns.

    Of rows that repeat that doc_id the one with the smallest text stays; a
    component without any doc_id keeps the row with the smallest text.

    Who goes is decided by doc_ids and fingerprints alone; the texts meet only
    the list of those, so a large group of copies never moves.  Fingerprints are
    taken twice, which is cheaper than keeping the texts.
    """
    prints = materialize(fingerprints(docs, width, seed), "prints")
    found = materialize(components(prints), "components")
    rows = prints.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(found, "fp")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    held = materialize(rows.withColumn("first", first), "held")
    several = held.where("first").groupBy("c").agg(F.sum("n").alias("rows")).where("rows > 1").select("c")
    tied = materialize(held.where("first").join(several, "c").select("doc_id", "fp", "c"), "tied")
    going = materialize(held.where("NOT first").select("doc_id", "fp").union(tied.select("doc_id", "fp")), "going")
    at = docs.columns.index("text")

    def work(batches):
        for batch in slices(batches):
            whole = batch.column(0)
            fps = np.array([fingerprint(t, width, seed) for t in texts(whole.field(at))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([whole, pa.array(fps.view(np.int64))], names=["doc", "fp"])

    packed = docs.select(F.struct(*docs.columns).alias("doc")).mapInArrow(work, f"doc {docs.schema.simpleString()}, fp long")

    def same(other: DataFrame) -> list[Column]:
        return [packed["fp"] == other["fp"], packed["doc.doc_id"].eqNullSafe(other["doc_id"])]

    kept = packed.join(going, same(going), "left_anti").select("doc")
    if not tied.isEmpty():
        # the least text is a partial aggregate: however many rows repeat an id, a task hands on one
        least = packed.join(tied, same(tied)).groupBy("c").agg(F.min_by("doc", F.coalesce("doc.text", F.lit(""))).alias("doc"))
        kept = kept.union(least.select("doc"))
    return kept.select("doc.*")
