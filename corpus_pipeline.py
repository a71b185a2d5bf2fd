"""From raw documents to token ids, one operator per stage.

Each stage takes all that its predecessor kept; documents that the quality
classifier rejects go, one document of each near-duplicate group stays, spans of
personal data are replaced, sources are mixed to their targets, and what is left
is encoded. Every stage is written before the next reads it; what a stage staged,
and the table it read, are removed after that.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendergrid.llm import byte_bpe, common, mixing, near_dup, pii, quality, queries


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed), and the digests of the ids and of what they decode to."""
    encoder = byte_bpe.share(docs, *queries.vocabulary())
    return byte_bpe.round_trip(docs.select("doc_id", "text"), encoder).select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", accept_quality),
    ("near_dup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# Learnt scores, sketches and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        with common.passing_tables(spark) as tables:
            docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
            tables.passing.extend(read)
        read = tables.lasting
    return STAGES[-1][1](spark, docs, sf_dir)
