"""MinHash, resampling and collocations against brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA, docs_of, pairs, real_docs

from arcweave.llm import collocations, minhash, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_words(draw, n, vocabulary=2000):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def edited(draw, words, changes):
    out = list(words)
    for i in draw.sample(range(len(out)), changes):
        out[i] = f"z{draw.randrange(10**6)}"
    return out


# ---------------------------------------------------------------- 11 minhash


def brute_sets(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    span = min(width, len(words))
    return frozenset(tuple(words[i : i + span]) for i in range(len(words) - span + 1)) if span else frozenset()


def brute_near(rows, width=2, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs of different sets."""
    sets = [brute_sets(t, width) for _, t in rows]
    root = {s: s for s in set(sets) if s}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    kinds = sorted(root, key=len)
    for i, s in enumerate(kinds):
        for t in kinds[i + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                root[find(s)] = find(t)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            c = find(s)
            least[c] = min(least.get(c, i), i)
    return [(i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def check_near(spark, rows, width=2, extra=False):
    df = docs_of(spark, rows, extra)
    got = [tuple(r) for r in minhash.near_duplicates(df, width).collect()]
    want = brute_near(rows, width)
    assert order([g[:3] for g in got]) == order(want)
    assert all(g[3] == (g[0] == g[2]) for g in got)
    return got


def test_minhash_odd_rows_and_copies(spark):
    draw = random.Random(5)
    base = some_words(draw, 120)
    rows = ODD + [(20 + i, " ".join(base)) for i in range(30)]
    rows += [(60, " ".join(base).upper()), (61, "ONE"), (62, "a b c d e f g h i j k"), (63, "a b c d e f g h i j"), (None, " ".join(base))]
    check_near(spark, rows, extra=True)
    check_near(spark, rows, width=5)
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_minhash_star_of_copies_that_link_only_through_their_original(spark):
    draw = random.Random(6)
    base = some_words(draw, 200, 10**6)
    rows = [(100 + i, " ".join(edited(draw, base, 9))) for i in range(60)] + [(500, " ".join(base))]
    sets = [brute_sets(t, 2) for _, t in rows]
    apart = sum(100 * len(sets[0] & s) < 80 * len(sets[0] | s) for s in sets[1:-1])
    assert apart == 59  # the first copy links with no other copy
    got = check_near(spark, rows)
    assert {g[2] for g in got} == {100}


def test_minhash_lists_no_pairs_of_a_group_that_shares_a_passage(spark, monkeypatch):
    """Copies just below the threshold that share a passage beside their original's words: only near pairs are confirmed."""
    draw = random.Random(8)
    base, passage, rows = some_words(draw, 200, 10**6), some_words(draw, 9, 10**6), []
    for i in range(40):
        copy = edited(draw, base, 12) + passage
        rows += [(2 * i, " ".join(copy)), (2 * i + 1, " ".join(edited(draw, copy, 2)))][: 1 + (i < 5)]
    rows += [(500 + i, " ".join(edited(draw, base, 2))) for i in range(5)]
    tried, whole = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *a: tried.append(pairs.count()) or whole(pairs, *a))
    got = check_near(spark, rows)
    assert sum(g[2] == 2 * i for g in got for i in range(5) if g[0] == 2 * i + 1) == 5
    assert 1 <= sum(tried) <= 2 * len(rows)  # over 900 pairs share the passage


def test_minhash_chains_and_near_misses(spark):
    draw = random.Random(7)
    rows, at = [], 0
    for chain in range(4):
        words = some_words(draw, 150, 10**6)
        for _ in range(12):
            rows.append((at, " ".join(words)))
            at += 1
            words = edited(draw, words, 5 + 3 * chain)  # later chains fall below the threshold
    check_near(spark, rows)


def test_minhash_at_the_threshold(spark):
    def text(k, n):
        return " ".join(f"t{k}x{i}" for i in range(n))

    # 9 shingles of which 8 are shared by the longer one's 10: 8 / 10 and 9 / 12
    rows = [(1, text(1, 9)), (2, text(1, 11)), (3, text(2, 10)), (4, text(2, 13)), (5, text(3, 41)), (6, text(3, 51)), (7, text(3, 65))]
    got = {g[0]: g[2] for g in check_near(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3 if 100 * 9 >= 80 * 12 else 4, 5: 5, 6: 5, 7: 7}


# ---------------------------------------------------------------- 12 resampling


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [crc32(r.encode()) % 10000 for r in runs]


def brute_resample(rows, targets, percent=5, least=20, seed=42):
    found = [brute_features(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in targets for b in brute_features(x)[1])
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10000)]
    out, able = [], []
    for (i, _), (n, f) in zip(rows, found, strict=True):
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                able.append((-score, i))
        out.append((i, len(f), weight, score))
    able.sort()
    return out, able[: percent * len(able) // 100]


def check_resample(spark, rows, targets, percent):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(targets)], "item_id long, text string")
    got = [tuple(r) for r in resampling.resample(docs_of(spark, rows, True), target, percent).collect()]
    want, drawn = brute_resample(rows, targets, percent)
    assert order([g[:4] for g in got]) == order(want)
    assert [(-g[3], g[0], g[4]) for g in sorted((g for g in got if g[4] is not None), key=lambda g: g[4])] == [(s, i, k + 1) for k, (s, i) in enumerate(drawn)]


@pytest.mark.parametrize("percent", [0, 1, 50, 100])
def test_resample_equals_brute_force(spark, percent):
    draw = random.Random(8)
    rows = ODD + [(100 + i, " ".join(some_words(draw, draw.randrange(60), 50))) for i in range(60)]
    rows += [(900, " ".join(some_words(draw, 40)))] * 25 + [(None, "a b " * 20), (-5, "minus " * 30)]
    check_resample(spark, rows, [" ".join(some_words(draw, 50, 30)) for _ in range(5)] + [None, ""], percent)


def test_resample_without_rows_or_target(spark):
    check_resample(spark, [(i, "one two three " * 9) for i in range(30)], [], 20)
    check_resample(spark, [], ["a b c"], 50)


def test_kth_key_is_exact(spark):
    draw = random.Random(9)
    keys = [(draw.choice([-(2**62), -1, 0, 1, 7, 2**62]), draw.choice([-3, -1, 0, 5, 2**61])) for _ in range(200)]
    df = spark.createDataFrame(keys, "score long, doc_id long")
    ranked = sorted(keys, key=lambda k: (-k[0], k[1]))
    for k in (1, 2, 50, 199, 200):
        got = sorted((tuple(r) for r in df.where(resampling.at_or_above(resampling.kth_key(df, k))).collect()), key=lambda k: (-k[0], k[1]))
        ties = sum(x == ranked[k - 1] for x in ranked[k:])
        assert got[:k] == ranked[:k] and len(got) <= k + ties


# ---------------------------------------------------------------- 13 collocations


def brute_collocations(rows, least, percent, best):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * within[p] < percent * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(found)[:best])]
    return sorted(out)


def check_collocations(spark, rows, least=3, percent=80, best=2000):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], SCHEMA)
    df = df.withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).withColumn("pivot", F.lit(2))
    assert sorted(tuple(r) for r in collocations.collocations(df, least, percent, best).collect()) == brute_collocations(rows, least, percent, best)


def test_collocations_equal_brute_force(spark):
    draw = random.Random(10)
    rows = [(draw.choice(["en", "de", None]), " ".join(draw.choice(["a", "a", "A", "b", "c", "dé", "e,", "f. ", "\t", "東京", "\x00"]) for _ in range(draw.randrange(80)))) for _ in range(40)]
    rows += [("en", None), (None, ""), ("fr", "one two " * 50), ("fr", "one two " * 50), ("x", "solo"), ("long", "p q r s t " * 3000)]
    check_collocations(spark, rows)
    check_collocations(spark, rows, least=2, percent=50, best=5)


def test_collocations_of_repeated_words_and_no_rows(spark):
    check_collocations(spark, [("en", "the the the the the the. the the"), ("en", "of the of the of")], least=1)
    check_collocations(spark, [])


def test_collocations_of_documents(spark, sf):
    rows = [(r["lang"], r["text"]) for r in real_docs(spark, sf).collect()]
    check_collocations(spark, rows, least=8)


def test_resample_and_minhash_of_documents(spark, sf):
    rows = pairs(real_docs(spark, sf))
    check_near(spark, rows)
    check_resample(spark, rows, [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 5)
