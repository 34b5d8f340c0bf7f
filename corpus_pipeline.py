"""From documents to packed training sequences: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns
of documents. A stage's result is written as Parquet and read again as the next one's docs.

For every stage: an empty table gives no rows; other columns than those of documents are dropped; a very long text
is worked on whole; null and empty texts pass quality by the share of good labels, are linked with nothing, have no
passages and no personal data, and are packed as one end token. A document without an id is scored, compared with
others and packed like any; only its passages are not looked for. Ties and repeated rows are said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.neardup import one_of_each
from loomframe.llm.packing import pack
from loomframe.llm.passages import remove_passages
from loomframe.llm.pii import redact
from loomframe.llm.quality import keep_good
from loomframe.llm.shared import Shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; a score of just the threshold is. Rows that repeat score alike."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in shingles of five words: one of least id. Of rows that repeat id and
    text one stays; rows that repeat an id with other texts count each for itself; a document without an id goes before one with."""
    return one_of_each(docs.select(*COLUMNS), width=5, percent=80).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that a document of lesser id has are cut out; rows of one id are not compared with each other."""
    return _recounted(remove_passages(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; of spans that overlap, and of equal ones, the first kind's name stands for all."""
    return _recounted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens; every row has pieces of its own, repeated or not."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("passages", passages), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Shared(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifier, the chains or the trees of personal data.
ORACLE_SQL = None
