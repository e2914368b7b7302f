"""Personal data by generators, boosted trees and calibrated thresholds.

Base kinds have fixed patterns and checks.  Beside them, high-recall
generators propose spans that may overlap; features of a span's format and of
the characters around it go through boosted trees, and spans above the
threshold of their kind are redacted.  Overlaps are settled greedily within
each chain of overlapping spans: base spans stay, then the most probable span
that overlaps none chosen before, and so on.

The trees are fitted on ``EXAMPLES`` made-up lines from a seeded generator
(half calibrates the thresholds), through the very expressions that score the
corpus.  On the corpus, everything is built-in functions: a pattern's matches
are marked with a character no pattern knows, the text is split at the marks,
and lengths add up to code-point positions.

All patterns are linear in the text: possessive repeats, and starts only where
a run begins or the last match ended, which finds the same leftmost matches.
Positions are running totals in blocks, so the cost of a text's matches stays
near their number, however many they are.

Defined results: a null or empty text has no spans; a null doc_id passes
through; repeated rows are searched each; a very long text is searched whole;
no rows give no rows.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.boosting import Boosted, boost

MARK, OTHER = "\x01", "\x02"
#: Characters around a span that features look at.
LEFT, RIGHT = 24, 6
EXAMPLES = 4500
#: The share of true spans among those above a threshold, on the calibration half.
PRECISION = 0.98

#: Base kinds in their order: the pattern, equal in its leftmost matches to the plain one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Words that announce a secret, and the letters that may follow them in a name before it is assigned.
KEYWORDS, NAME_TAIL = "passw(?:or)?d|passwd|passphrase|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential", 20
_CAPITALISED = r"\p{Lu}[\p{Ll}'-]++(?: \p{Lu}[\p{Ll}'-]++)?"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Way|Square"
#: Generators of high recall: kind, what stands before the span, the span.
GENERATORS = [
    # an IBAN has at most 34 characters, in groups of four or none
    ("iban", "", r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{10,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("number", "", r"(?<![0-9+.])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{2,4}(?![0-9])"),
    ("secret", "", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{14,}+"),
    ("secret", "", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)?"),
    ("secret", rf"(?i:{KEYWORDS})[A-Za-z0-9_-]{{0,{NAME_TAIL}}}[\"']?[ \t]*+(?::|=>?)[ \t]*+[\"']?", r"[^\s\"'<>,;]{6,}+"),
    ("ssn", "", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("name", "", rf"(?<![\p{{L}}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? {_CAPITALISED}"),
    ("name", r"(?:[Mm]y name is|[Nn]ame:|[Jj]e m'appelle|[Ii]ch heiße|[Mm]e llamo) ", _CAPITALISED),
    ("address", "", rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}},? (?:\p{{Lu}}\p{{Ll}}++ ){{1,3}}(?:{_STREETS})(?![\p{{L}}])|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place) (?:de |du |des |la |le |l')*\p{{Lu}}\p{{Ll}}++"
        r"|\p{Lu}\p{Ll}*(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?(?![\p{L}0-9]))"),
]
#: Kinds that the method adds, in their order.
EXTRA = sorted({kind for kind, _, _ in GENERATORS})
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` (at least one) pass the check sum."""
    r = F.reverse(_digits(s))

    def term(i: Column) -> Column:
        x = F.substr(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(s)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _iban_holds(s: Column) -> Column:
    """Whether the letters and digits of ``s`` pass the IBAN check sum."""
    bare = F.upper(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), step) == 1


def _pieces(text: Column, pattern: str, before: str = "") -> Column:
    """The text cut at a pattern's matches: those have even places (from 1). What ``before`` matches is not cut off."""
    return F.split(F.regexp_replace(text, f"({before})({pattern})", f"$1{MARK}$2{MARK}"), MARK)


#: Array elements that are summed up in one go.
BLOCK = 128


def running(column: str, value: str, merge: str, least: int = 1) -> Column:
    """Running totals over the array ``column``: of ``value`` (SQL over x), joined by ``merge`` (SQL over a and b), from 0.

    An array of fewer than ``least`` elements gives none.  Blocks first, then within each: a fold copies what it holds at every
    element, so none may hold all.
    """
    blocks = f"transform(sequence(0, (size({column}) - 1) div {BLOCK}), j -> transform(slice({column}, j * {BLOCK} + 1, {BLOCK}), x -> {value}))"
    begin = "CAST(array() AS array<int>) AS out"

    def join(a: str, b: str) -> str:
        return merge.replace("{a}", a).replace("{b}", b)

    starts = (
        f"aggregate({blocks}, struct(0 AS at, {begin}), (s, v) -> "
        f"struct({join('s.at', 'aggregate(v, 0, (a, b) -> ' + join('a', 'b') + ')')} AS at, concat(s.out, array(s.at)) AS out), s -> s.out)"
    )
    inner = f"aggregate(v, struct(t AS at, {begin}), (s, y) -> struct({join('s.at', 'y')} AS at, concat(s.out, array({join('s.at', 'y')})) AS out), s -> s.out)"
    return F.expr(f"IF(size({column}) < {least}, CAST(array() AS array<int>), flatten(zip_with({blocks}, {starts}, (v, t) -> {inner})))")


def _spans(name: str, kind: str, rank: int) -> Column:
    """Array of (kind, rank, start, end, s, left, right) of the matches among the pieces ``cut_name``, which end at ``ends_name``."""
    cut, ends = f"cut_{name}", f"ends_{name}"
    return F.expr(f"""transform(filter(sequence(1, greatest(size({ends}), 1)), i -> i % 2 = 0), i -> struct('{kind}' AS kind, {rank} AS rank,
      element_at({ends}, i - 1) AS start, element_at({ends}, i) AS end, element_at({cut}, i) AS s,
      right(element_at({cut}, i - 1), {LEFT}) AS left, left(element_at({cut}, i + 1), {RIGHT}) AS right))""")


def _count(s: Column, pattern: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))


def features(kind: Column, s: Column, left: Column, right: Column) -> dict[str, Column]:
    """Numbers about a span's format and context."""
    near = F.lower(left)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    out = {f"is_{k}": flag(kind == k) for k in EXTRA}
    out |= {
        "length": F.length(s),
        "digits": _count(s, "[0-9]"),
        "upper": _count(s, "[A-Z]"),
        "lower": _count(s, "[a-z]"),
        "seps": _count(s, "[ ./()_-]"),
        "slashes": _count(s, "/"),
        "spaces": _count(s, " "),
        "dots": _count(s, "[.]"),
        "marks": _count(s, "[^A-Za-z0-9 ]"),
        "changes": _count(F.regexp_replace(s, "[A-Za-z][0-9]|[0-9][A-Za-z]", "~"), "~"),
        "zero_start": flag(s.startswith("0") | s.startswith("000")),
        "year": flag(s.rlike(r"^(?:19|20)[0-9]{2}[-/. ]") | s.rlike(r"[-/. ](?:19|20)[0-9]{2}$")),
        "country": flag(s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$")),
        "iban_holds": F.when(s.rlike(r"^[A-Za-z]{2}[0-9]{2}[A-Za-z0-9 ]{10,38}$"), _iban_holds(s)).otherwise(False).cast("double"),
        "hex": flag(s.rlike(r"^[0-9a-f]+$")),
        "say_phone": flag(near.rlike(r"phone|tel\b|tel[.:]|call|fax|mobil|contact")),
        "say_id": flag(near.rlike(r"ssn|social|tax|passport|licen[cs]e")),
        "say_key": flag(near.rlike(r"key|token|secret|passw|pwd|auth|credential")),
        "say_bank": flag(near.rlike(r"iban|account|bank|konto")),
        "say_other": flag(near.rlike(r"order|isbn|version|page|date|article|model|part|serial|commit|sku|ref\b|id\b")),
        "assigned": flag(near.rlike(r"[=:]>?\s*[\"']?$")),
        "set_equal": flag(near.rlike(r"=[\"']?$")),
        "say_name": flag(near.rlike(r"name|appelle|heiße|llamo")),
        "glued": flag(left.rlike(r"[A-Za-z0-9]$") | right.rlike(r"^[A-Za-z0-9]")),
    }
    return {k: v.cast("double") for k, v in out.items()}


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Made-up spans: kind, span, left, right, and whether it is personal or secret."""
    r = random.Random(seed)

    def d(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def pick(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    upper, lower, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    plain = ["and the other ", "we saw that ", "it was near ", "le mot et ", "und dann ", "para ver ", "", "end. ", "of (", "see "]
    short = ["correct", "horse", "battery", "staple", "monkey", "dragon", "sunny", "winter", "coffee", "orange", "let", "me", "in", "blue", "star"]

    def words(*extra: str) -> str:
        return r.choice(["", *plain]) + r.choice([*extra])

    def names() -> str:
        return r.choice(["password", "passwd", "secret", "token", "api_key", "aws_secret_access_key", "auth_token", "credential", "PWD", "client-secret"])

    def iban() -> str:
        body = pick(upper, r.choice([0, 4])) + d(r.randrange(12, 20))
        country = pick(upper, 2)
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        whole = f"{country}{98 - number % 97:02d}{body}"
        return r.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    def person() -> str:
        return " ".join(pick(upper, 1) + pick(lower, r.randrange(2, 8)) for _ in range(r.choice([1, 2])))

    def mixed(a: int, b: int) -> str:
        return pick(upper + lower + "0123456789/+", r.randrange(a, b)) + d(1)

    made = [
        lambda: ("ssn", f"{r.randrange(1, 900):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}", words("", "SSN ", "ssn: ", "social security "), 1),
        lambda: ("ssn", f"{d(3)}-{d(2)}-{d(4)}", words("part ", "order ", "serial no. ", "model ", "sku: "), 0),
        lambda: ("number", r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}"]), words("", "phone ", "Tel. ", "call ", "fax: "), 1),
        lambda: ("number", r.choice([f"{r.randrange(1900, 2030)}-{d(3)}-{d(2)}", f"{d(2)}/{d(3)}/{d(4)}", f"{d(4)} {d(4)} {d(2)}", f"{d(3)} {d(3)} {d(3)}"]), words("", "order ", "date ", "page ", "article "), 0),
        lambda: ("number", f"{d(3)}-{d(4)}-{d(3)}", words("ISBN ", "version ", "part ", "ref "), 0),
        lambda: ("iban", iban(), words("", "IBAN ", "account ", "bank: "), 1),
        lambda: ("iban", f"{pick(lower, 2)}{d(2)}{pick(lower + '0123456789', r.randrange(10, 24))}", words("", "id ", "commit ", "model "), 0),
        lambda: ("iban", f"{pick(upper, 2)}{d(2)} {d(4)} {pick(upper, 4)} {d(4)}", words("", "part ", "serial ", "order "), 0),
        lambda: ("secret", f"AKIA{pick(upper + '234567', 15)}{d(1)}", words("", "key ", "= "), 1),
        lambda: ("secret", pick(hexa, r.randrange(16, 48)) + d(1), words('password=', 'token = "', "secret: ", "api_key=", "auth: "), 1),
        lambda: ("secret", r.choice(["sk-", "ghp_", "key-", "xox-"]) + pick(upper + lower + "0123456789", r.randrange(20, 40)) + d(1), words("", "token ", "key="), 1),
        lambda: ("secret", pick(upper + lower + "0123456789", r.randrange(18, 40)) + d(2), words("token: ", "secret=", "password ", "credential "), 1),
        lambda: ("secret", ".".join("eyJ" * (i < 2) + pick(upper + lower + "0123456789", r.randrange(12, 40)) for i in range(r.choice([2, 3]))), words("", "token ", "Bearer ", "jwt="), 1),
        lambda: ("secret", mixed(20, 45), words("") + names() + r.choice(["=", " = ", ": ", "='", ': "']), 1),
        lambda: ("secret", "".join(r.choice(short) for _ in range(r.randrange(3, 6))) + r.choice(["", d(2)]), words("") + names() + r.choice(["=", " = ", ": "]), 1),
        lambda: ("secret", pick(lower, r.randrange(5, 9)) + d(r.randrange(1, 4)) + r.choice(["", "!", "#", "$"]), words("") + names() + r.choice(["=", ": ", ' = "']), 1),
        lambda: ("secret", pick(lower, r.randrange(6, 12)), words("") + names() + r.choice(["=", '="']), 1),
        lambda: ("secret", pick(lower, r.randrange(6, 12)) + r.choice(["", ".", ")"]), words("the ", "a ") + r.choice(["token", "secret", "auth", "password", "keys to the secret"]) + r.choice([": ", " : "]), 0),
        lambda: ("secret", iban().replace(" ", ""), words("", "IBAN ", "account ", "bank: "), 0),
        lambda: ("secret", d(r.randrange(14, 24)), words("", "order ", "id ", "serial "), 0),
        lambda: ("secret", "-".join(pick(lower, r.randrange(3, 8)) for _ in range(r.randrange(2, 6))) + "-" + d(r.randrange(1, 5)), words("", "see ", "page ", "article "), 0),
        lambda: ("secret", pick(lower, r.randrange(12, 22)) + d(r.randrange(1, 4)), words("", "model ", "id "), 0),
        lambda: ("secret", f"{r.randrange(1900, 2030)}-{d(2)}-{d(2)}-{pick(lower, 6)}", words("", "date ", "version "), 0),
        lambda: ("secret", pick(hexa, 40), words("commit ", "version ", "ref "), 0),
        lambda: ("name", r.choice(["Mr", "Mrs.", "Dr. ", "Herr", "Frau", "Prof."]).strip() + " " + person(), words("", "by ", "with ", "Dear "), 1),
        lambda: ("name", person(), words("") + r.choice(["My name is ", "Name: ", "Je m'appelle ", "me llamo "]), 1),
        lambda: ("name", person(), words("file ", "column ", "variable ", "product ") + "name: ", 0),
        lambda: ("address", f"{r.randrange(1, 9999)} {person()} {r.choice(['Street', 'Ave', 'Road', 'Lane', 'Blvd'])}", words("", "at ", "lives at ", "ship to "), 1),
        lambda: ("address", r.choice([f"{pick(upper, 1)}{pick(lower, 6)}straße {d(2)}", f"{r.randrange(1, 200)} rue de {person().split()[0]}"]), words("", "at ", "in der ", "habite "), 1),
        lambda: ("address", f"{r.randrange(1, 99)} {person()} Way", words("there are ", "of the ", "page ", "version "), 0),
    ]
    out = []
    for i in range(n):
        kind, s, left, good = made[i % len(made)]()
        out.append((kind, s, left[-LEFT:], r.choice([" ", ".", ", ", '"', "\n", ""]), good))
    r.shuffle(out)
    return out


@cache
def _fitted(app: str, n: int, precision: float) -> tuple[Boosted, tuple[tuple[str, float], ...]]:
    spark = SparkSession.getActiveSession()
    made = examples(n)
    rows = spark.createDataFrame(made, "kind string, s string, left string, right string, good int")
    columns = features(*[F.col(c) for c in ("kind", "s", "left", "right")])
    got = rows.select("kind", "good", *[v.alias(k) for k, v in columns.items()]).collect()
    names = tuple(columns)
    x = np.array([[g[k] for k in names] for g in got], dtype=float)
    y = np.array([g["good"] for g in got], dtype=float)
    kinds = np.array([g["kind"] for g in got])
    half = np.arange(len(y)) % 2 == 0
    model = boost(x[half], y[half], names)
    p = model.probability(x)
    return model, tuple((kind, threshold(p[~half & (kinds == kind)], y[~half & (kinds == kind)], precision)) for kind in EXTRA)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from 0.5 on of those from which on the share of true spans is ``precision``; beyond 1 where none is."""
    order = np.argsort(-p, kind="stable")
    p, share = p[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[1:] != p[:-1], True)[: len(p)]  # equal probabilities stand or fall together
    held = p[last & (share >= precision) & (p >= 0.5)]
    return float(held.min()) if len(held) else 1.1


def fitted(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The model and the threshold of each extra kind."""
    model, cuts = _fitted(spark.sparkContext.applicationId, n, precision)
    return model, dict(cuts)


SPANS = "array<struct<kind:string,rank:int,start:int,end:int,p:double>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra) for every row of ``docs`` (doc_id, text).

    ``base`` and ``extra`` are arrays of (kind, rank, start, end, p), the extra
    ones selected and free of overlaps; positions count code points, the end is
    exclusive.
    """
    model, least = fitted(docs.sparkSession)
    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    rows = docs.select("doc_id", text.alias("text")).withColumn("may", F.col("text").rlike("[0-9@]"))
    patterns = {kind: ("", pattern) for kind, pattern in BASE.items()} | {str(i): (before, pattern) for i, (_, before, pattern) in enumerate(GENERATORS)}
    # most patterns need a digit or @; a text that is not searched is one piece
    free = {str(i) for i, (kind, before, _) in enumerate(GENERATORS) if before or kind == "name"}
    cuts = {name: _pieces(F.col("text"), pattern, before) for name, (before, pattern) in patterns.items()}
    one = F.array(F.col("text"))
    rows = rows.withColumns({f"cut_{name}": c if name in free else F.when(F.col("may"), c).otherwise(one) for name, c in cuts.items()}).drop("text", "may")
    rows = rows.withColumns({f"ends_{name}": running(f"cut_{name}", "length(x)", "{a} + {b}", least=2) for name in cuts})
    ranks = {k: i for i, k in enumerate([*BASE, *EXTRA])}

    def base_spans(kind: str) -> Column:
        valid = F.filter(_spans(kind, kind, ranks[kind]), lambda x: _valid(kind, x["s"]))
        return F.transform(valid, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "rank", "start", "end")], F.lit(1.0).alias("p")))

    seen = F.concat(*[_spans(str(i), kind, ranks[kind]) for i, (kind, _, _) in enumerate(GENERATORS)])
    rows = rows.select("doc_id", F.concat(*[base_spans(k) for k in BASE]).alias("base"), seen.alias("seen"))

    def scored(x):
        f = features(x["kind"], x["s"], x["left"], x["right"])
        return F.struct(*[x[c].alias(c) for c in ("kind", "rank", "start", "end")], *[v.alias(n) for n, v in f.items()])

    rows = rows.withColumn("seen", F.transform("seen", scored))
    judged = f"transform(seen, x -> struct(x.kind AS kind, x.rank AS rank, x.start AS start, x.end AS end, {model.sql('x')} AS p))"
    enough = " ".join(f"WHEN '{k}' THEN {least[k]!r}D" for k in EXTRA)
    rows = rows.select("doc_id", "base", F.expr(f"filter({judged}, x -> x.p >= CASE x.kind {enough} END)").alias("found"))
    return choose(rows, len(BASE)).select("doc_id", "base", "extra")


def choose(rows: DataFrame, base: int) -> DataFrame:
    """Add ``extra``: those of the spans ``found`` that are chosen beside the spans ``base``, by kind and place.

    Spans of ``base`` (ranks below ``base``) stay.  The others follow, within
    each chain of overlapping spans, by falling probability (then rank, start
    and falling end), each if it overlaps none that stays or was chosen before.
    """
    none = F.array().cast(SPANS)
    placed = F.transform(F.concat("base", "found"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x.alias("x")))
    # a text without extra spans has nothing to settle
    rows = rows.withColumn("placed", F.when(F.size("found") > 0, F.transform(F.array_sort(placed), lambda x: x["x"])).otherwise(none))
    rows = rows.withColumn("reach", running("placed", "x.end", "greatest({a}, {b})"))
    # a chain begins where nothing before reaches
    rows = rows.withColumn("begins", F.expr(
        "concat(filter(sequence(1, greatest(size(placed), 1)), i -> i = 1 OR element_at(placed, i).start >= element_at(reach, greatest(i - 1, 1))), array(size(placed) + 1))"
    ))
    rows = rows.withColumn("chains", F.expr(
        "transform(sequence(1, size(begins) - 1), i -> slice(placed, element_at(begins, i), element_at(begins, i + 1) - element_at(begins, i)))"
    ))

    def overlap(a, b):
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def pick(chain: Column) -> Column:
        order = F.array_sort(F.transform(chain, lambda x: F.struct(
            F.when(x["rank"] < base, -2.0).otherwise(-x["p"]).alias("first"), x["rank"].alias("rank"), x["start"].alias("start"), (-x["end"]).alias("back"), x.alias("x"),
        )))
        taken = F.aggregate(
            F.transform(order, lambda x: x["x"]), none,
            lambda held, x: F.when((x["rank"] < base) | ~F.exists(held, lambda h: overlap(h, x)), F.concat(held, F.array(x))).otherwise(held),
        )
        return F.when(F.size(chain) > 1, taken).otherwise(chain)

    kept = F.when(F.size("placed") > 0, F.filter(F.flatten(F.transform("chains", pick)), lambda x: x["rank"] >= base)).otherwise(none)
    by_kind = F.array_sort(F.transform(kept, lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x.alias("x"))))
    return rows.withColumn("extra", F.transform(by_kind, lambda x: x["x"])).drop("placed", "reach", "begins", "chains")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_rows(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of :func:`find_spans`."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every found span replaced by its kind in square brackets."""
    found = find_spans(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text")).withColumnRenamed("doc_id", "doc")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    spans = F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(s, x):
        part = F.concat(s["out"], F.substr(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["end"] <= s["at"], s["out"]).otherwise(part).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    out = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return found.select(F.col("doc.doc_id").alias("doc_id"), out.alias("text"))
