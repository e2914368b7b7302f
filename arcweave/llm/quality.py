"""Quality rules under weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's counts.
Rules may be sharp and err: they are not asked to agree.  Documents with the
same votes are one pattern; the number of patterns is at most 3 to the number
of rules, whatever the corpus holds, so all documents are counted exactly and
the counts fit on the driver.  Expectation-maximisation over the counts
estimates each rule's accuracy on either class and the share of good
documents, without bounds on any of them; starting values tell the classes
apart.  A document is kept where its posterior probability of being good
reaches ``threshold``.  Given the class, votes are taken as independent, so
rules that see the same thing (repeats and duplicate lines) are not both asked.

Base checks (too short, too repetitive) reject beside the posterior; the model
is fitted to the documents that pass them.

Defined results: a null or empty text has no words, so it fails the base
checks; a null doc_id passes through; repeated rows are judged each; with no
documents that pass the base checks the starting values stand.  A very long
text is one row like any other; its counts take memory in proportion to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import CONTINUATION, SPACE, map_rows, slices, texts
from arcweave.plans.materialize import materialize

SYMBOLS = b"#*$%&|<>"
_NOT_WORD = CONTINUATION + SPACE
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123)) + bytes(range(0xC0, 256))
_NOT_LETTER = bytes(c for c in range(256) if c not in _LETTERS and c not in SPACE)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    ids: dict[tuple, int] = {}
    number = [ids.setdefault(x, len(ids)) for x in windows]
    if len(ids) == n:
        return 0
    number = np.array(number)
    twice = np.bincount(number)[number] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[:n] += twice
    cover[width : width + n] -= twice
    return int((np.cumsum(cover[:-1]) > 0).sum())


#: Last characters of a line that ends a sentence or begins a list (fixed values).
LINE_ENDS = b".!?\":"


def counts(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_letters, n_ends, n_bare, n_distinct, n_ended.

    Letters are ASCII ones and all code points beyond; bare words have none;
    ended lines end with one of ``LINE_ENDS``.
    """
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_WORD)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        len(text) - len(text.translate(None, _LETTERS)),
        text.count(b".") + text.count(b"!") + text.count(b"?"),
        len(words) - len(text.translate(None, _NOT_LETTER).split()),
        len(set(words)),
        sum(x.rstrip()[-1:] in LINE_ENDS for x in lines),
    )


_COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_ends", "n_bare", "n_distinct", "n_ended",
]


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every row of ``docs`` (doc_id, text)."""

    def rows(got, n):
        out = list(zip(*map(counts, got["text"]), strict=True)) or [()] * len(_COUNTS)
        return {"doc_id": got["doc_id"]} | dict(zip(_COUNTS, out, strict=True))

    return map_rows(docs.select("doc_id", "text"), "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS), rows)


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else good where ``good`` holds, else silent (SQL over the counts)."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


RULES = (
    Rule("length", "n_words < 100", "n_words >= 150"),
    Rule("word_length", "10 * word_chars < 45 * n_words OR 10 * word_chars > 62 * n_words", "10 * word_chars BETWEEN 47 * n_words AND 58 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("letters", "100 * n_letters < 94 * word_chars", "100 * n_letters >= 96 * word_chars"),
    Rule("bare_words", "20 * n_bare > n_words", "100 * n_bare <= n_words"),
    Rule("vocabulary", "100 * n_distinct < 68 * n_words", "100 * n_distinct >= 75 * n_words"),
    Rule("line_ends", "10 * n_ended < 9 * n_lines", "100 * n_ended >= 98 * n_lines"),
    Rule("sentences", "n_words > 16 * n_ends OR n_words < 8 * n_ends", "n_words BETWEEN 9 * n_ends AND 15 * n_ends"),
    Rule("capitals", "100 * n_capitals > 3 * n_letters OR 1000 * n_capitals < 8 * n_letters", "1000 * n_capitals BETWEEN 10 * n_letters AND 25 * n_letters"),
    Rule("dup_lines", "10 * n_dup_lines > n_lines", "n_dup_lines = 0"),
)

#: Documents that fail these checks are rejected whatever the votes.
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass
class VoteModel:
    """What expectation-maximisation found."""

    prior: float
    good: np.ndarray  # by rule: probability of a good vote on a good document, given a vote
    bad: np.ndarray  # by rule: probability of a bad vote on a bad document, given a vote

    def log_odds(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of good before any vote, and what each rule's good and bad vote add."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        start, up, down = self.log_odds()
        return 1 / (1 + np.exp(-np.clip(start + (votes == 1) @ up + (votes == -1) @ down, -700, 700)))


#: Starting values, which are also the means of weak priors: share of good documents, accuracy on good and on bad ones.
START = (0.8, 0.9, 0.5)
#: Weight of those priors, in documents.
PRIOR_WEIGHT = 2.0


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 2000, tolerance: float = 1e-12) -> VoteModel:
    """Fit accuracies to vote patterns (rows) that occur ``weight`` times.

    Nothing is clipped: a rule that errs on most good documents is learned as
    such.  The priors weigh ``PRIOR_WEIGHT`` documents in all.  Rounds end
    where the log likelihood no longer rises.
    """
    m = votes.shape[1]
    model = VoteModel(START[0], np.full(m, START[1]), np.full(m, START[2]))
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    cast = up + down
    last = -np.inf
    for _ in range(rounds):
        p = model.posterior(votes)
        if_good = np.log(model.prior) + up @ np.log(model.good) + down @ np.log(1 - model.good)
        if_bad = np.log(1 - model.prior) + up @ np.log(1 - model.bad) + down @ np.log(model.bad)
        now = float(weight @ np.logaddexp(if_good, if_bad))
        if now - last <= tolerance * abs(now):
            break
        last = now
        g, b = weight * p, weight * (1 - p)
        model = VoteModel(
            float((g.sum() + PRIOR_WEIGHT * START[0]) / (weight.sum() + PRIOR_WEIGHT)),
            (g @ up + PRIOR_WEIGHT * START[1]) / (g @ cast + PRIOR_WEIGHT),
            (b @ down + PRIOR_WEIGHT * START[2]) / (b @ cast + PRIOR_WEIGHT),
        )
    return model


def _votes(rules: tuple[Rule, ...]) -> Column:
    return F.concat_ws("", *[F.when(r.vote() < 0, "-").when(r.vote() > 0, "+").otherwise("0") for r in rules])


def learn(seen: DataFrame, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """The model of all vote patterns of ``seen`` (votes and counts), documents that fail the base checks aside."""
    table = seen.where(f"NOT ({FAILED})").groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(rules) rows
    n = {r["votes"]: r["n"] for r in table}
    keys = sorted(n)
    v = np.array([[{"-": -1, "0": 0, "+": 1}[c] for c in k] for k in keys], dtype=int).reshape(len(keys), len(rules))
    return fit(v, np.array([n[k] for k in keys], dtype=float))


def _decide(seen: DataFrame, rules: tuple[Rule, ...], model: VoteModel, threshold: float) -> DataFrame:
    start, up, down = model.log_odds()
    odds = F.lit(start)
    for rule, u, d in zip(rules, up.tolist(), down.tolist(), strict=True):
        odds = odds + F.expr(f"CASE WHEN {rule.bad} THEN {d!r}D WHEN {rule.good} THEN {u!r}D ELSE 0D END")
    p = 1 / (1 + F.exp(-odds))
    return seen.withColumns({"p_good": p, "base_failed": F.expr(FAILED)}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, posterior ``p_good`` and ``kept`` for every row of ``docs``."""
    seen = materialize(measure(docs).withColumn("votes", _votes(rules)), "votes")
    return _decide(seen, rules, learn(seen, rules), threshold)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    Counts are taken twice, once to learn and once to decide, which is cheaper
    than shuffling the texts to meet them.
    """
    model = learn(measure(docs).withColumn("votes", _votes(rules)), rules)
    fields = ", ".join(f"{c} long" for c in _COUNTS)
    doc = f"doc {docs.schema.simpleString()}"
    at = docs.columns.index("text")

    def work(batches):
        for batch in slices(batches):
            whole = batch.column(0)
            out = list(zip(*map(counts, texts(whole.field(at))), strict=True)) or [()] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([whole, *(pa.array(x, type=pa.int64()) for x in out)], names=["doc", *_COUNTS])

    seen = docs.select(F.struct(*docs.columns).alias("doc")).mapInArrow(work, f"{doc}, {fields}")
    return _decide(seen, rules, model, threshold).where("kept").select("doc.*")
