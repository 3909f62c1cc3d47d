"""The question loop as a Structured Streaming query.

Questions arrive as JSON-lines files (question_id, question, store_name) in a folder. Each
micro-batch is answered with the same batch plan as ``plans.ask.ask_batch`` against the
static document store, and the answer records are written to a Parquet folder partitioned
by batch id with dynamic overwrite, so a retried batch replaces its own output instead of
appending twice (exactly-once output with the checkpointed source offsets).

Chart intent needs no state: ``classify_stream`` is a plain projection that can feed any sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intent import chart_intent
from ..functions.text import strip_outer
from ..plans.ask import ask_batch
from ..session import scratch_path

QUESTION_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("store_name", T.StringType()),
])


def question_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of the non-blank questions dropped into ``folder``."""
    raw = (spark.readStream.schema(QUESTION_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(folder))
    return raw.where(F.length(strip_outer(F.col("question"))) > 0)


def classify_stream(questions: DataFrame) -> DataFrame:
    """Add the chart intent of every question (stateless)."""
    return questions.withColumn("chart_type", chart_intent(F.col("question")))


def start_answering(questions: DataFrame, corpus: DataFrame, embed, out_path: str,
                    checkpoint: str | None = None, k: int = 3, trigger: dict | None = None):
    """Answer each micro-batch of ``questions`` against ``corpus``.

    ``embed(df) -> df`` adds the question vector column ``embedding`` (for example a fitted
    ``search.fit_text_embedder`` model applied with ``search.embed_text``).
    Returns the running ``StreamingQuery``.
    """
    spark = questions.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")

    def answer(batch: DataFrame, batch_id: int) -> None:
        res = ask_batch(embed(batch), corpus, k=k)
        (res.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
