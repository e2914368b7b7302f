"""Collocations by pivot partitioning: phrases are mined where their rarest word lives.

1. Every task counts the words of each language; sums give exact word counts.
   Words found ``least`` times or more are hashed into an array of ``SLOTS``
   counts (the largest of a slot's words), a fixed size whatever the vocabulary.
2. Texts are rewritten: pieces are cut at words whose slot is empty, which no
   phrase wanted can hold.  The order of words is by (slot's count, hash), so
   the pivot of a phrase, its rarest word, needs no dictionary.  Around every
   word a fragment goes up to three words to each side, as far as no word is
   rarer; to the left it also stops before the same word, so that a phrase is
   owned by the first place of its pivot and counted once wherever it stands.
   Fragments for two words go first; longer ones are then cut at pairs of words
   that aren't frequent, by flags in an array of fixed size again.
3. Fragments are dealt by (lang, pivot).  All places of a phrase meet there, so
   phrases are counted and rare ones dropped in that very task, without another
   shuffle.  A slot that is wrong (two words or pairs in one) costs longer
   fragments and changes no count.
4. Frequent phrases, 1 to 4 words, are scored by joins of phrases with their
   parts and contained ones dropped by an aggregate over longer ones.

Skew: a word's fragments hold only words that are at least as common, so those
of the commonest are few and repeat; beyond that a pivot's fragments are spread
over as many keys as its share of the words asks for, and those phrases are
summed again.  The best of a language are found in two steps over salted keys.
A task's tables of counts are emptied at ``HELD`` entries.

Defined results: a null lang is ``und``; null and empty texts hold nothing;
repeated rows count each; words and texts may be of any length.  An empty table
gives no rows.  Columns besides lang and text are not read.  Sums and products
are decimals where they may pass 64 bits.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm.common import slices, texts
from arcweave.plans.materialize import materialize

#: Words of the longest phrase.
LONGEST = 4
#: Slots of hashed word counts that every task holds (8 bytes each).
SLOTS = 1 << 20
#: Slots, as a power of two, of flags of frequent pairs of words that every task holds (a byte each).
PAIR_BITS = 23
#: Entries of a task's table of counts, and of its memory of words.
HELD = 1 << 17
#: A pivot is spread where it has more than one in so many words.
SPREAD = 512
#: Keys over which the best of one language are first chosen.
SALTS = 64
#: Ends of pieces; no word holds them. Texts are split with all of them as one kind.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _ENDS else c for c in range(256))
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _ENDS else c for c in range(256))
#: Stands between pieces in a list of words.
END = b"."


def marked_words(text: bytes) -> list[bytes]:
    """The words of a text, with ``END`` where a piece ends."""
    return text.translate(_PIECES).replace(b"\n", b" . ").split()


def _langs(column: pa.Array) -> list[str]:
    return ["und" if x is None else x for x in column.to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): how often each word of each language stands in ``docs`` (lang, text)."""

    def flush(held: dict[str, Counter]):
        for lang, counts in held.items():
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts.values(), pa.int64())], names=["lang", "phrase", "c"])
        held.clear()

    def work(batches):
        held: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, t in zip(_langs(batch.column(0)), texts(batch.column(1)), strict=True):
                held.setdefault(lang, Counter()).update(t.translate(_WORDS).split())
            if sum(map(len, held.values())) >= HELD:
                yield from flush(held)
        yield from flush(held)

    counts = docs.select("lang", "text").mapInArrow(work, "lang string, phrase string, c long")
    return counts.groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


def word_slots(frequent: DataFrame) -> np.ndarray:
    """The largest count of the words of ``frequent`` (lang, phrase, f) in each slot."""

    def work(batches):
        for batch in slices(batches):
            slots = [xxhash.xxh64_intdigest(w, _seed(k)) % SLOTS for k, w in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), batch.column(2)], names=["slot", "f"])

    most = frequent.select("lang", "phrase", "f").mapInArrow(work, "slot long, f long").groupBy("slot").agg(F.max("f").alias("f"))
    found = most.toArrow()  # at most SLOTS rows
    out = np.zeros(SLOTS, dtype=np.int64)
    out[found["slot"].to_numpy()] = found["f"].to_numpy()
    return out


class _Order(dict):
    """Words of one language to their place in the order, 0 where no phrase can hold them; forgets all when full."""

    def __init__(self, lang: str, slots: memoryview):
        super().__init__()
        self.seed, self.slots = _seed(lang), slots

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        f = 0 if word == END else self.slots[h % SLOTS]
        self[word] = out = (min(f, (1 << 38) - 1) << 24 | (h >> 40) | 1) if f else 0
        return out


def _pair_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The slot of each pair of neighbouring words by their orders."""
    mixed = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.view(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def pair_flags(pairs: DataFrame, slots: np.ndarray) -> np.ndarray:
    """Slots that some frequent phrase of two words of ``pairs`` (lang, phrase) has."""

    def work(batches):
        orders: dict[str, _Order] = {}
        for batch in slices(batches):
            langs, phrases = batch.column(0).to_pylist(), [p.split(b" ") for p in texts(batch.column(1))]
            placed = [[orders.setdefault(k, _Order(k, memoryview(slots)))[p[i]] for k, p in zip(langs, phrases, strict=True)] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(_pair_slots(*(np.array(x, dtype=np.int64) for x in placed)))], names=["slot"])

    found = pairs.select("lang", "phrase").mapInArrow(work, "slot long").distinct().toArrow()  # at most 2 ** PAIR_BITS rows
    out = np.zeros(1 << PAIR_BITS, dtype=np.bool_)
    out[found["slot"].to_numpy()] = True
    return out


def _reach(o: np.ndarray, longest: int, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and to the right belong to each word's fragment."""
    pad = np.zeros(longest, dtype=o.dtype)
    wide = np.concatenate([pad, o, pad])
    near = np.ones(len(wide) - 1, dtype=np.bool_) if flags is None else flags[_pair_slots(wide[:-1], wide[1:])]
    left, right = np.zeros((2, len(o)), dtype=np.int64)
    goes_left = goes_right = o > 0
    for j in range(1, longest):
        at, n = longest, len(o)
        goes_left = goes_left & (wide[at - j : at - j + n] > o) & near[at - j : at - j + n]
        goes_right = goes_right & (wide[at + j : at + j + n] >= o) & near[at + j - 1 : at + j - 1 + n]
        left += goes_left
        right += goes_right
    return left, right


def fragments(docs: DataFrame, slots: np.ndarray, total: int, flags: np.ndarray | None = None) -> DataFrame:
    """(lang, pivot, hot, at, more, words, c): the fragments of ``docs`` (lang, text) by their pivot's key, with the numbers of words before and after it.

    They are for phrases of two words, or with the ``flags`` of those for longer ones.
    """
    longest, fewest = (2, 2) if flags is None else (LONGEST, 3)
    names = ["lang", "pivot", "hot", "at", "more", "words", "c"]

    def work(batches):
        counts = memoryview(slots)
        orders: dict[str, _Order] = {}
        held: dict[tuple[str, int, int, int], Counter] = {}

        def rows(lang, pivot, hot, at, more, words, c):
            n = len(words)
            wide = lambda x, kind: pa.array(np.full(n, x, kind) if np.isscalar(x) else x.astype(kind))
            text = pa.array(words, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), wide(pivot, np.int64), wide(hot, np.bool_), wide(at, np.int32), wide(more, np.int32), text, wide(c, np.int64)], names=names)

        def spread_out():
            # the commonest pivots: their fragments repeat, and go to as many keys as their share asks for
            for (lang, o, left, right), found in held.items():
                keys = list(found)
                salts = np.fromiter(map(xxhash.xxh32_intdigest, keys), np.int64, len(keys)) % min(SPREAD, 1 + (o >> 24) * SPREAD // max(1, total))
                yield rows(lang, o + (salts << 40), True, left, right, keys, np.fromiter(found.values(), np.int64, len(keys)))
            held.clear()

        for batch in slices(batches):
            found: dict[str, list[bytes]] = {}
            for lang, t in zip(_langs(batch.column(0)), texts(batch.column(1)), strict=True):
                words = found.setdefault(lang, [])
                words += marked_words(t)
                words.append(END)
            for lang, words in found.items():
                if lang not in orders:
                    if len(orders) >= SALTS:
                        orders.clear()
                    orders[lang] = _Order(lang, counts)
                o = np.fromiter(map(orders[lang].__getitem__, words), np.int64, len(words))
                left, right = _reach(o, longest, flags)
                at = np.flatnonzero(left + right >= fewest - 1)
                cut = [b" ".join(words[i:j]) for i, j in zip((at - left[at]).tolist(), (at + right[at] + 1).tolist(), strict=True)]
                hot = (o[at] >> 24) * SPREAD >= total
                for i in np.flatnonzero(hot).tolist():
                    k = int(at[i])
                    held.setdefault((lang, int(o[k]), int(left[k]), int(right[k])), Counter())[cut[i]] += 1
                cool = np.flatnonzero(~hot)
                k = at[cool]
                yield rows(lang, o[k], False, left[k], right[k], [cut[i] for i in cool.tolist()], 1)
            if sum(map(len, held.values())) >= HELD:
                yield from spread_out()
        yield from spread_out()

    return docs.select("lang", "text").mapInArrow(work, "lang string, pivot long, hot boolean, at int, more int, words string, c long")


def _phrases(fewest: int, longest: int) -> Column:
    """The phrases of a fragment ``words`` that hold its pivot, which has ``at`` words before it and ``more`` after; one start and one end each."""
    found = []
    for before in range(longest):
        for after in range(longest - before):
            if before + after + 1 >= fewest:
                cut = F.expr(f"substring_index(substring_index(words, ' ', at + {after + 1}), ' ', -{before + after + 1})")
                found.append(F.when((F.col("at") >= before) & (F.col("more") >= after), cut))
    return F.array_compact(F.array(*found))


def _mined(found: DataFrame, fewest: int, longest: int, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of fragments that are found ``least`` times; counted where their pivot's fragments meet."""
    dealt = found.repartition("lang", "pivot").select("lang", "pivot", "hot", F.explode(_phrases(fewest, longest)).alias("phrase"), "c")
    mined = dealt.groupBy("lang", "pivot", "hot", "phrase").agg(F.sum("c").alias("f")).where(F.col("hot") | (F.col("f") >= least))
    return mined.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f): phrases of 1 to ``LONGEST`` words found ``least`` times; ``words`` are :func:`word_counts`."""
    frequent = words.where(F.col("f") >= least).select("lang", "phrase", "f")
    total = int(words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first()["n"])
    slots = word_slots(frequent)
    pairs = materialize(_mined(fragments(docs, slots, total), 2, 2, least), "pairs")
    longer = _mined(fragments(docs, slots, total, pair_flags(pairs, slots)), 3, LONGEST, least)
    return frequent.union(pairs).union(longer)


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def score_phrases(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of each phrase of two words or more of ``phrases`` (lang, phrase, f), by its lowest cut."""
    several = phrases.withColumn("w", F.split("phrase", " ", -1)).where("size(w) > 1").withColumnRenamed("f", "a")
    cuts = several.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("last"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("last"), F.col("f").alias("r"))
    scored = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "last"])
        .withColumn("n2", F.lit(2_000_000).cast("decimal(7,0)") * _exact("a"))
        .withColumn("d", (_exact("l") + _exact("r")).cast("decimal(21,0)"))
        .withColumn("score", F.expr("n2 div d"))
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "x.k", "x.a", "x.l", "x.r", "x.score")


def drop_contained(candidates: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """``candidates`` without those that stand in a longer phrase at least ``percent`` as frequent."""
    longer = phrases.withColumn("w", F.split("phrase", " ", -1)).where("size(w) > 2")
    inner = F.expr(
        "flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), s -> array_join(slice(w, s, n), ' '))))"
    )
    most = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    covered = 100 * _exact("within") >= percent * _exact("a")
    return kept.where(F.col("within").isNull() | ~covered).drop("within")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of ``docs`` (lang, text).

    a, l and r count the phrase and the parts of its lowest-scoring cut, n all
    words of the language; score is 2,000,000 a / (l + r), rounded down.
    """
    words = materialize(word_counts(docs), "words")
    phrases = materialize(frequent_phrases(docs, words, least), "phrases")
    kept = drop_contained(score_phrases(phrases), phrases, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= best)
    ranks = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranks.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
