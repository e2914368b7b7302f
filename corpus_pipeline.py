"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and gives it to the next stage.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import linededup, mixing, packing, quality, queries, simhash
from arcweave.llm.common import SLICE
from arcweave.plans.materialize import materialize
from arcweave.plans.ship import ship

#: Share of the tokens that the mix keeps.
KEPT_SHARE = 0.8


def _ready(spark: SparkSession) -> None:
    """Ship the package, and hand texts to Python in batches of the size that the operators work on.

    Larger ones stand in the memory of executors and of workers, and what a
    stage has taken stays with them through the later stages.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= SLICE:
        spark.conf.set(key, SLICE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules find good."""
    _ready(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least five documents share, but for the last."""
    _ready(spark)
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _ready(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of the tokens, by the target weights of domains, languages and sources."""
    return mixing.keep_mixed(docs, F.floor(F.sum("total") * KEPT_SHARE), queries.mix_domain(), queries.MIX_WEIGHTS, queries.MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    _ready(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Expectation-maximisation, SimHash, tokenizers and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
