"""A training corpus in five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import decontaminate, language_id, mixing, sharding, simhash_gray
from pricewell.llm.queries import held_out, query
from pricewell.llm.text import stored

#: Language ID rejects documents whose best language has a smaller share than this.
LEAST_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; undetermined ones go."""
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    # Numbered on the way, so that no column clashes with those of the prediction.
    names = {f"column_{i}": name for i, name in enumerate(docs.columns)}
    judged = language_id.predict(docs, model, keep=[F.col(f"`{name}`").alias(n) for n, name in names.items()])
    known = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.drop("lang_pred", "score").withColumnsRenamed(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group."""
    return simhash_gray.without_duplicates(docs, shingle=3, limit=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; rows without an id and items without an id count like all others."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, as many as the mix takes; each file is in schedule order.

    Nulls, empty texts and repeated rows: see ``mixing``.  The result depends on the rows alone, not on their files.
    """
    return mixing.mixed(docs, ordered=False)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard``, ``slot`` (by id, then by a digest of the row) and ``grown_shard``.

    Documents without an id share a shard, as their key does; copies stand beside each other.
    """
    return sharding.shard_documents(docs, "doc_id", shards=24)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("sharding", place_in_shards),
]

#: Fitting, fingerprints and edit distances have no SQL.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
