"""The corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import collocations, licenses, linededup, minhash, mixing, packing, pii, quality, resampling, simhash, url_filters, warc, winnowing
from arcweave.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary that packing uses by default."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(pages, url_filters.page_outcomes(pages, table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest_rows(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(pii.find_spans(table(spark, sf_dir, "documents")))


#: Domains are groups of sources by the last digit of their name.
MIX_WEIGHTS = {
    "domain": {"web": 2.0, "reference": 1.0, "code": 1.0},
    "lang": {"en": 2.0},
    "source": {"src0": 1.0},
}
MIX_SHARE, MIX_SEED, MIX_EPOCHS = 0.6, 7, 2


def mix_domain():
    last = F.right("source", F.lit(1))
    return F.when(last.isin("0", "1", "2", "3", "4"), "web").when(last.isin("5", "6", "7"), "reference").otherwise("code")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(
        table(spark, sf_dir, "documents"), F.floor(F.sum("total") * MIX_SHARE), mix_domain(), MIX_WEIGHTS, MIX_SEED, MIX_EPOCHS
    )
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "before")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, percent=80, best=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_url_filter, op3_simhash, op4_quality_rules, op5_winnowing,
        op6_pack, op7_warc, op8_line_dedup, op9_pii, op10_mix,
        op11_minhash, op12_resample, op13_collocations,
    )
}
