"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source.  A token budget enters at
the root and is divided by weight among the children of each node, no child
getting more than its capacity (its tokens times ``max_epochs``).  What a child
cannot take is first shared among its siblings by weight; only when all of
them are full does it go back up, which happens by itself, since a node's
capacity is the sum of its children's and its own budget never exceeds it.

The shares are water levels: of siblings in order of capacity over weight, all
up to some point are full and the rest share the remainder by weight.  Window
sums over the (few) tree nodes give them, so nothing reaches the driver.

Each leaf then reads its documents in seeded order, epoch after epoch, and
takes the longest prefix of documents within its budget.  Documents are summed
by bins of that order first, bins by sixteenths of it; bins beyond the budget
drop out, and within a bin documents are summed one by one, so a leaf that
holds a third of all rows is never gathered in one task.

Defined results: null domain, language or source are leaves of their own; a
null or empty text has no tokens and costs nothing; a budget beyond all
capacity takes everything ``max_epochs`` times; repeated rows are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.plans.materialize import materialize, stat

LEVELS = ("domain", "lang", "source")


def tokens(text: Column) -> Column:
    """Words of a text, the token measure used for budgets."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def weight_column(level: str, weights: dict[str, float], default: float = 1.0) -> Column:
    """The weight of a node of a level, by its name."""
    out = F.lit(float(default))
    for name, w in weights.items():
        if w < 0:
            raise ValueError("weights are not negative")
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def divide(children: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Add ``budget``: each parent's ``given`` over its children (capacity, weight), by water level."""
    order = [(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))).alias("fill"), *child]
    w = Window.partitionBy(*parent).orderBy(*[F.col("fill"), *child])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ranked = children.withColumn("fill", order[0]).withColumns(
        {
            "full": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "rest": F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = F.when(F.col("rest") > 0, (F.col("given") - F.col("full")) / F.col("rest"))
    # a child is full while the water level of those from it on reaches its fill
    share = F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("weight") * F.col("level")))
    out = ranked.withColumn("level", level).withColumn("over", F.col("level") < F.col("fill"))
    # past the first child that is not full the levels only fall, so the first is the highest
    stop = F.max(F.when(F.col("over"), F.col("level"))).over(Window.partitionBy(*parent))
    return out.withColumn("level", F.coalesce(stop, F.lit(float("inf")))).withColumn(
        "budget", F.when(F.col("weight") > 0, F.when(F.col("level") == float("inf"), F.col("capacity").cast("double")).otherwise(share)).otherwise(0.0)
    ).drop("fill", "full", "rest", "level", "over")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, budget) of ``leaves`` (domain, lang, source, total), budget in whole tokens."""
    given = leaves.agg(budget.cast("double").alias("given")).first()["given"] or 0.0
    # what hangs on a weight of zero can't be taken, so it is no capacity of its ancestors
    live = F.lit(True)
    for k in LEVELS:
        live = live & (weight_column(k, weights.get(k, {})) > 0)
    nodes = leaves.withColumn("open", F.when(live, F.col("total") * max_epochs).otherwise(F.lit(0)))
    held: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:depth])
        level = nodes.groupBy(*keys).agg(F.sum("open").alias("capacity"))
        level = level.withColumn("weight", weight_column(keys[-1], weights.get(keys[-1], {})))
        if held is None:
            level = level.withColumn("root", F.lit(0)).withColumn("given", F.lit(float(given)))
            parent = ["root"]
        else:
            parent = keys[:-1]
            # null names are nodes too
            up = held.select(*[F.col(k).alias(f"up_{k}") for k in parent], F.col("budget").alias("given"))
            on = [F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in parent]
            level = level.join(up, on).drop(*[f"up_{k}" for k in parent])
        held = divide(level, parent, keys).drop("given", "root")
    return held.select(*LEVELS, F.floor("budget").cast("long").alias("budget"))


def place(epoch: Column, seed: int, doc_id: Column) -> Column:
    """A document's place in an epoch's order: a hex digest."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _measured(docs: DataFrame, domain: Column | None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of every row."""
    where = domain if domain is not None else F.lit("all")
    return materialize(docs.select("doc_id", where.alias("domain"), "lang", "source", tokens(F.col("text")).alias("n_tokens")), "tokens")


def _open_bins(measured: DataFrame, budget: Column, weights: dict, seed: int, max_epochs: int, bin_digits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``measured`` in each epoch with place and bin, and the bins that begin within the budget of their leaf."""
    leaf = list(LEVELS)
    leaves = materialize(measured.groupBy(*leaf).agg(F.sum("n_tokens").alias("total")), "leaves")
    shares = materialize(budgets(leaves, budget, weights, max_epochs), "shares")
    # epoch e of a leaf runs while e * total is within the budget
    rows = measured.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    rows = rows.withColumn("place", place(F.col("epoch"), seed, F.col("doc_id"))).withColumn("bin", F.substring("place", 1, bin_digits))
    sums = rows.groupBy(*leaf, "epoch", "bin").agg(F.sum("n_tokens").alias("n"))
    # prefix sums in two levels: a leaf's sixteenths of an epoch, and the bins of each
    part = F.substring("bin", 1, 1)
    sums = materialize(sums.withColumn("part", part), "bins")
    upto = Window.partitionBy(*leaf).orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = sums.groupBy(*leaf, "epoch", "part").agg(F.sum("n").alias("whole")).withColumn("base", F.sum("whole").over(upto) - F.col("whole"))
    w = Window.partitionBy(*leaf, "epoch", "part").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = [*_same("s", "p", leaf), F.col("s.epoch") == F.col("p.epoch"), F.col("s.part") == F.col("p.part")]
    summed = sums.withColumn("within", F.sum("n").over(w)).alias("s").join(parts.alias("p"), parted).select("s.*", (F.col("base") + F.col("within")).alias("upto"))
    bins = summed.alias("s").join(shares.alias("t"), _same("s", "t", leaf)).select(
        *[F.col(f"s.{k}").alias(k) for k in leaf], "epoch", "bin", "upto", (F.col("upto") - F.col("n")).alias("start"), "budget"
    )
    return rows, materialize(bins.where("start <= budget"), "open-bins")


def _same(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _summed(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """The rows in ``bins`` with ``after``, the tokens of the leaf up to and with each."""
    leaf = list(LEVELS)
    near = rows.alias("r").join(
        bins.alias("b"), [*_same("r", "b", leaf), F.col("r.epoch") == F.col("b.epoch"), F.col("r.bin") == F.col("b.bin")]
    ).select("doc_id", *[F.col(f"r.{k}").alias(k) for k in leaf], "n_tokens", F.col("r.epoch").alias("epoch"), F.col("r.bin").alias("bin"), "place", "upto", "start", "budget")
    # documents in one bin: about 1 / 16 ** bin_digits of a leaf
    within = Window.partitionBy(*leaf, "epoch", "bin").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return near.withColumn("after", F.col("start") + F.sum("n_tokens").over(within))


def mix(
    docs: DataFrame,
    budget: Column,
    domain: Column | None = None,
    weights: dict[str, dict[str, float]] | None = None,
    seed: int = 7,
    max_epochs: int = 1,
    bin_digits: int = 3,
) -> DataFrame:
    """The rows chosen from ``docs`` (doc_id, text, lang, source).

    ``budget`` is an expression over the leaves' ``total`` tokens, such as
    ``F.lit(10**12)`` or ``F.sum("total") * 0.5``.  Returns doc_id, domain,
    lang, source, n_tokens, epoch (from 0) and ``before``, the tokens of the
    leaf's prefix before the row.
    """
    rows, bins = _open_bins(_measured(docs, domain), budget, weights or {}, seed, max_epochs, bin_digits)
    return (
        _summed(rows, bins)
        .where("after <= budget")
        .select("doc_id", *LEVELS, "n_tokens", "epoch", (F.col("after") - F.col("n_tokens")).alias("before"))
    )


def keep_mixed(docs: DataFrame, budget: Column, domain: Column | None = None, weights=None, seed: int = 7, bin_digits: int = 3) -> DataFrame:
    """The rows of ``docs`` chosen in one epoch, with all their columns.

    Rows that repeat doc_id, place in the tree and tokens count one by one: of
    n of them as many stay as the budget took, the first by text.

    What a leaf gives is a prefix of its order, so it is told by the first row
    beyond the budget: one row a leaf, found in the one bin in which the budget
    ends.  The texts meet only those rows and are not shuffled for them.
    """
    where = domain if domain is not None else F.lit("all")
    keys = ["doc_id", *LEVELS, "n_tokens"]
    rows, bins = _open_bins(_measured(docs, where), budget, weights or {}, seed, 1, bin_digits)
    last = materialize(_summed(rows, bins.where("upto > budget")), "last-bins")
    cuts = materialize(last.where("after > budget").groupBy(*LEVELS).agg(F.min(F.struct("place", "doc_id", "n_tokens")).alias("cut")), "cuts")
    # rows like the first one beyond: some of them may be within
    like = [*_same("l", "c", list(LEVELS)), F.col("l.place") == F.col("cut.place"), F.col("l.doc_id").eqNullSafe(F.col("cut.doc_id")), F.col("l.n_tokens") == F.col("cut.n_tokens")]
    partial = last.where("after <= budget").alias("l").join(cuts.alias("c"), like).select("l.*").groupBy(*keys).agg(F.count("*").alias("some"))
    partial = materialize(partial, "taken", n=F.count("*"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", where.alias("domain"), "lang", "source", place(F.lit(0), seed, F.col("doc_id")).alias("place"), "text").alias("r")
    # tokens are counted again only for the documents at the cut
    at = F.struct(F.col("r.doc_id").alias("doc_id"), tokens(F.col("r.text")).alias("n_tokens"))
    before = F.when(F.col("cut").isNull(), True).when(F.col("r.place") != F.col("cut.place"), F.col("r.place") < F.col("cut.place"))
    before = before.otherwise(at < F.struct(F.col("cut.doc_id").alias("doc_id"), F.col("cut.n_tokens").alias("n_tokens")))
    kept = whole.join(cuts.alias("c"), _same("r", "c", list(LEVELS)), "left").where(before).select("doc")
    if stat(partial, "n"):
        # repeated rows are counted by text and ranked by those counts; rows alike in text are cut by salted ranks
        counted = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", where.alias("domain"), "lang", "source", tokens(F.col("text")).alias("n_tokens")).alias("r")
        some = materialize(counted.join(partial.alias("m"), _same("r", "m", keys)).select("doc", *[F.col(f"m.{k}").alias(k) for k in keys], "some")
            .withColumns({"text": F.coalesce("doc.text", F.lit("")), "salt": F.spark_partition_id()}), "repeated")
        counts = some.groupBy(*keys, "text", "salt").agg(F.count("*").alias("n"))
        before = Window.partitionBy(*keys).orderBy("text", "salt").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        cells = [*keys, "text", "salt"]
        placed = some.alias("s").join(counts.alias("c"), [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in cells]).select("s.*", "before")
        rank = F.row_number().over(Window.partitionBy(*cells).orderBy(F.lit(0)))
        kept = kept.union(placed.withColumn("rank", F.col("before") + rank).where("rank <= some").select("doc"))
    return kept.select("doc.*")
