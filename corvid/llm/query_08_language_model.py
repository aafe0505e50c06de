"""op8: trigram scores of `documents`, learnt from those outside the held-out fold."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.language_model import score, train
from corvid.llm.toxicity import held_out
from corvid.session import table

NAME = "op8_language_model"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 7, 2)
    return score(docs, train(docs.filter(~out), least=1, order=3)).withColumn("held_out", out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLE_SQL = None
