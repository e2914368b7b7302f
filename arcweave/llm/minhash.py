"""MinHash near-duplicates: universal hash minima, banding, verification, components.

A document is its set of distinct word shingles.  Two are linked where the sets
share at least ``percent`` of their union; a component is named by its smallest
doc_id.

1. Equal sets are one: a set is known by a 128-bit digest, and of its copies
   only one signature goes on, so groups of exact copies never meet again.
2. A signature has ``BANDS * ROWS`` minima of universal hash functions
   (a * x + b mod 2 ** 64, upper half, a odd).  Sets that agree on all minima
   of a band share its bucket.  A pair at 0.8 shares none of the buckets with
   probability (1 - 0.8 ** 5) ** 40 = 1.3e-7; more similar pairs with less.
3. Members of a bucket are compared with a hub instead of with each other: the
   one that meets most others over all bands (the original of edited copies,
   whose edits differ).  Links to hubs join components.
4. Pairs that share a hub and are of different components are left.  One of the
   two, x, isn't linked to the hub h.  With X the shingles in which x and h
   differ (either way), x and y differ in the shingles in which X and Y do, so
   how much of X and Y must be common follows from the sizes: at least one
   shingle and, if neither is linked to h, over (100 - percent) / (100 + percent)
   of h.  The shingles of X are put in order, the rarest about the hub first;
   sets that have t in common meet in one that t - 1 or more follow on either
   side (prefix filtering).  So only the first of each go into an index, and a
   meeting counts if enough follow.  This is exact: no link is given up for a
   group's size.  What half of a large group has (or lacks) comes last and is
   hardly indexed, so few of its pairs are listed.  A pair must agree on as many
   minima as a linked pair does but for a chance of 1e-11 (signature
   verification) and is then confirmed on the full sets.
5. Components are those of the confirmed links by alternating large-star and
   small-star.

Scale: what is shuffled per distinct set are its signature once and 20 bytes a
band twice; full sets are taken only of documents that share a bucket.  Hot
buckets are pre-aggregated (counts, hubs), and joins are equi-joins that
adaptive execution can split.  The
driver sees loop statistics only.

Defined results: null and blank texts have an empty set, link with nothing and
are components of their own.  A text with fewer words than a shingle is one
shingle.  Rows with a null doc_id keep it and take part; a component without
any doc_id has a null component_id.  Repeated rows are judged each.  Texts of
any length are taken whole.  An empty table gives no rows; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm.common import map_rows, slices, texts
from arcweave.operators.components import component_links
from arcweave.plans.materialize import discard, materialize, stat

#: Minima a band, and bands.
ROWS, BANDS = 5, 40
#: Shingles whose hashes exist at a time.
CHUNK = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of 64-bit hashes."""
    z = a * _ODD ^ ((b << np.uint64(31)) | (b >> np.uint64(33))) * _OTHER
    z ^= z >> np.uint64(29)
    z *= _OTHER
    return z ^ (z >> np.uint64(32))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    if not span:
        return h
    out = h[: len(h) - span + 1]
    for j in range(1, span):
        out = _mixed(out, h[j : len(h) - span + 1 + j])
    return np.unique(out)


def _functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def signatures(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """One row of minima for each set, none of them empty."""
    a, b = _functions(seed)
    out = np.empty((len(sets), len(a)), dtype=np.uint32)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= CHUNK:
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(len(a)):
            out[at:to, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), starts)
        at = to
    return out


def sketches(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, d, n, sig) of every row: digest and size of its set, and its minima (null: empty set)."""

    def rows(got, n):
        sets = [shingle_set(t, width) for t in got["text"]]
        signed = iter(signatures([s for s in sets if len(s)], seed))
        return {
            "doc_id": got["doc_id"],
            "d": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "n": [len(s) for s in sets],
            "sig": [next(signed).tobytes() if len(s) else None for s in sets],
        }

    return map_rows(docs.select("doc_id", "text"), "doc_id long, d binary, n long, sig binary", rows)


def _bands(sets: DataFrame) -> DataFrame:
    """(key, id, n): the buckets of each set of ``sets`` (id, n, sig)."""

    def rows(got, n):
        sig = np.frombuffer(b"".join(got["sig"]), dtype=np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
        for r in range(ROWS):
            key = _mixed(key, sig[:, :, r])
        return {"id": got["id"], "n": got["n"], "keys": list(key.view(np.int64))}

    keyed = map_rows(sets.select("id", "n", "sig"), "id long, n long, keys array<long>", rows, raw=("sig",))
    return keyed.select(F.explode("keys").alias("key"), "id", "n")


def _buckets(sets: DataFrame) -> DataFrame:
    """(key, id, n, met) of buckets with several members; met counts what a set meets over all of its buckets."""
    every = _bands(sets)
    several = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialize(every.join(several, "key"), "shared")
    met = shared.groupBy("id").agg(F.sum("c").alias("met"))
    out = materialize(shared.join(met, "id").select("key", "id", "n", "met"), "buckets")
    discard(shared)
    return out


def _full_sets(docs: DataFrame, sets: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, sig, words): minima and whole hashed sets of ``ids``, the sets taken from the texts again."""
    wanted = materialize(sets.join(ids, "id", "left_semi").select("id", "d", "least", "sig"), "wanted")
    first = wanted.select("least").distinct()
    read = docs.select("doc_id", "text").join(first, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")

    def rows(got, n):
        held = [shingle_set(t, width).tobytes() for t in got["text"]]
        return {"d": [hashlib.blake2b(s, digest_size=16).digest() for s in held], "words": held}

    taken = map_rows(read.select("text"), "d binary, words binary", rows)
    # ids may repeat with other texts, and rows may repeat: one set for each digest that is wanted
    once = taken.join(wanted.select("d"), "d", "left_semi").groupBy("d").agg(F.first("words").alias("words"))
    out = materialize(once.join(wanted, "d").select("id", "sig", "words"), "full")
    discard(wanted)
    return out


def _agree(sig: bytes, other: bytes, percent: int) -> bool:
    """Whether minima agree as often as those of a linked pair do, but for a chance of 1e-11."""
    share, k = percent / 100, ROWS * BANDS
    return np.count_nonzero(np.frombuffer(sig, np.uint32) == np.frombuffer(other, np.uint32)) >= k * share - 7 * math.sqrt(k * share * (1 - share))


def _enough(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _with_sets(pairs: DataFrame, full: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with minima s, t and sets x, y of the ids in columns ``a`` and ``b``."""
    left, right = (full.select(F.col("id").alias(i), F.col("sig").alias(s), F.col("words").alias(w)) for i, s, w in ((a, "s", "x"), (b, "t", "y")))
    return pairs.join(left, a).join(right, b).select(a, b, "s", "t", "x", "y")


def _against_hubs(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(id, hub, n, linked, apart) of ``pairs`` (id, hub): a set's size, and the shingles in which it and its hub differ.

    Shingles that the set lacks have their bits turned.
    """
    names = ["id", "hub", "n", "linked", "apart"]

    def work(batches):
        for batch in slices(batches):
            n, linked, apart = [], [], []
            for s, t, x, y in zip(*(texts(batch.column(i)) for i in range(2, 6)), strict=True):
                p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                own = np.setdiff1d(p, q, assume_unique=True)
                both = len(p) - len(own)
                n.append(len(p))
                linked.append(_agree(s, t, percent) and _enough(both, len(p), len(q), percent))
                apart.append(np.concatenate((own, ~np.setdiff1d(q, p, assume_unique=True))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(apart, pa.binary())], names=names)

    return _with_sets(pairs, full, "id", "hub").mapInArrow(work, "id long, hub long, n long, linked boolean, apart binary")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose minima agree often enough and whose sets share at least ``percent`` of their union."""

    def work(batches):
        for batch in slices(batches):
            keep = []
            for s, t, x, y in zip(*(texts(batch.column(i)) for i in range(2, 6)), strict=True):
                p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                keep.append(_agree(s, t, percent) and _enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return _with_sets(pairs, full, "a", "b").mapInArrow(work, "a long, b long")


def _elements(todo: DataFrame) -> DataFrame:
    """(hub, id, e): a row for each shingle in which a member of ``todo`` and its hub differ."""

    def work(batches):
        for batch in slices(batches):
            held = [np.frombuffer(w, np.int64) for w in texts(batch.column(2))]
            if held:
                sizes = [len(h) for h in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in (0, 1)] + [pa.array(np.concatenate(held))], names=["hub", "id", "e"])

    return todo.select("hub", "id", "apart").mapInArrow(work, "hub long, id long, e long")


def _open_pairs(todo: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that could still be linked, by how they differ from a common hub.

    x and y, which differ from the hub in d and d2 shingles, are linked if they
    differ in at most (100 - percent) / (100 + percent) of their sizes' sum, so
    if (excess + excess2) / (2 * (100 + percent)) of those shingles are common.
    """
    per = 100 + percent
    members = todo.withColumn("d", (F.length("apart") / 8).cast("long")).withColumn("excess", per * F.col("d") - (100 - percent) * F.col("n"))
    least = members.groupBy("hub").agg(F.min("excess").alias("any"), F.min(F.when(F.col("asks"), F.col("excess"))).alias("asking"))
    # a partner is within 100 / percent of the size and differs in (100 - percent) / percent of it at most
    alone = F.ceil(F.col("d") - (100 - percent) * F.col("n") / percent)

    def first(other: str) -> Column:
        """How many shingles must be looked at to meet any partner whose excess is at least ``other``."""
        return F.col("d") + 1 - F.greatest(F.lit(1), alone, F.ceil((F.col("excess") + F.col(other)) / (2 * per)))

    # one that doesn't ask meets those that do; one that asks meets all
    upto = F.when(F.col("asks"), first("any")).otherwise(first("asking"))
    members = members.join(least, "hub").select("hub", "id", "n", "d", "excess", "comp", "asks", upto.alias("upto"))
    every = _elements(todo)
    common = every.groupBy("hub", "e").agg(F.count("*").alias("c"))
    # the place counts all shingles; those of one member alone meet nothing
    rarest = Window.partitionBy("hub", "id").orderBy("c", "e")
    placed = every.join(common, ["hub", "e"]).withColumn("at", F.row_number().over(rarest)).where("c > 1").drop("c")
    index = materialize(placed.join(members.where("upto > 0"), ["hub", "id"]).where("at <= upto").drop("upto"), "index")
    other = {"id": "other", "n": "m", "d": "d2", "excess": "excess2", "comp": "comp2", "at": "at2"}
    asking = index.where("asks").select("hub", "e", *[F.col(k).alias(v) for k, v in other.items()])
    apart = (F.col("comp") != F.col("comp2")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    follow = 1 + F.least(F.col("d") - F.col("at"), F.col("d2") - F.col("at2"))
    met = index.join(asking, ["hub", "e"]).where(apart & (2 * per * follow >= F.col("excess") + F.col("excess2")))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_links(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of every id of ``sets`` (id, d, least, n, sig) that has a link."""
    members = _buckets(sets)
    full = _full_sets(docs, sets, members.select("id").distinct(), width)
    hubs = members.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("i"))).alias("x")).select("key", (-F.col("x.i")).alias("hub"))
    pairs = members.join(hubs, "key").where("id <> hub").select("id", "hub").distinct()
    against = materialize(_against_hubs(pairs, full, percent), "against")
    discard(members)
    links = against.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    comps = materialize(component_links(links, "a", "b"), "comps")
    of = lambda k: comps.select(F.col("node").alias(k), F.col("component").alias(f"{k}_comp"))
    placed = against.join(of("id"), "id", "left").join(of("hub"), "hub", "left").select(
        "hub", "id", "n", "apart", F.coalesce("id_comp", "id").alias("comp"),
        (F.coalesce("id_comp", "id") != F.coalesce("hub_comp", "hub")).alias("asks"),
    )
    placed = materialize(placed, "placed", n=F.count_if("asks"))
    discard(against)
    if not stat(placed, "n"):
        return comps
    todo = materialize(placed.join(placed.where("asks").select("hub").distinct(), "hub", "left_semi"), "todo")
    pairs = materialize(_open_pairs(todo, percent), "open", n=F.count("*"))
    if stat(pairs, "n"):
        some = full.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
        found = materialize(confirmed(pairs, some, percent), "found", n=F.count("*"))
        if stat(found, "n"):
            first = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = materialize(component_links(first.union(found), "a", "b"), "comps")
    return comps


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text); kept: the component bears its id."""
    prints = materialize(sketches(docs, width, seed), "sketches")
    sets = prints.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    linked = near_links(docs, sets, width, percent)
    placed = sets.select("id", "d", "least").join(linked.withColumnRenamed("node", "id"), "id", "left")
    placed = materialize(placed.select("d", "least", F.coalesce("component", "id").alias("c")), "placed")
    named = placed.join(placed.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("d", "component_id")
    out = prints.select("doc_id", "d", "n").join(named, "d", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
