"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadro.session import read_table

#: Texts are handed to the kernels in groups of about this many bytes, so the temporaries of a
#: task stay small whatever the Arrow batch holds. One longer text is a group of its own.
GROUP_BYTES = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so other columns cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls in the given fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def groups(batches: Iterator[pa.RecordBatch], size: Callable = len,
           limit: int = GROUP_BYTES) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as tuples, in lists of about ``limit`` bytes of their last column."""
    for batch in batches:
        rows: list[tuple] = []
        n = 0
        for start in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                rows.append(row)
                n += size(row[-1]) if row[-1] is not None else 0
                if n >= limit:
                    yield rows
                    rows, n = [], 0
        if rows:
            yield rows


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters outside space and \\x09-\\x0D, with A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode().lower().split()


#: A key is hot from this part of all rows on.
HOT_SHARE = 1000


def join_by_count(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key that counts the key's rows in ``n``.

    Keys with over 1/HOT_SHARE of all ``total`` rows, of which there are fewer than HOT_SHARE, are
    broadcast, so no task gathers the rows of a hot key; the other keys are joined as Spark likes.
    """
    is_hot = F.col("n") * HOT_SHARE > total
    hot, cold = keyed.where(is_hot).drop("n"), keyed.where(~is_hot).drop("n")
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold_rows.join(cold, key))
