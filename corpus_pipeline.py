"""From raw documents to training shards: one operator of spanloom.llm per stage."""

from spanloom.llm import decontaminate, langid, mixing, ngram_join, token_files
from spanloom.llm.queries import byte_bpe_definition
from spanloom.session import cut_lineage


def language(spark, docs, sf_dir):
    """Documents in one of the learned languages stay; those without letters, or that no language claims, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the least doc_id."""
    return ngram_join.one_per_component(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark question go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix takes them, quality labels being their weights."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_shards(spark, docs, sf_dir):
    """The token files' content: one row per document with its place and checksum."""
    return token_files.read_token_files(spark, token_files.write_token_files(docs, byte_bpe_definition()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("token_shards", token_shards),
]

# Trained scores, components and library tokens are beyond SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other, from the documents table on; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
