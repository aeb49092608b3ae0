"""Problem 7: encoding of the whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import ready
from .bpe import ByteBPE

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("RANKLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


@cache
def _vocabulary(path: str) -> ByteBPE:
    return ByteBPE.read(path)


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary and its perfect hash, built once on the driver and sent to the workers: a fixed size of some MB."""
    return spark.sparkContext.broadcast(_vocabulary(path or f"{TOKENIZERS}/{VOCABULARY}"))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and the token ids of ``text`` in ``out``.

    One row for each input row; the list is empty for an empty or a null text. Blank texts have the ids of
    their white space. No special tokens. Texts are encoded whole, however long. There is no shuffle.
    A column that is already named ``out`` is replaced.
    """
    spark = df.sparkSession
    ready(spark)
    columns = [c for c in (df.columns if keep is None else keep) if c != out]
    own = "__text__"
    given = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias(own))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    shared = vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            ids, numbers = bpe.encode(batch.column(len(columns)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(numbers)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], lists], names=[*columns, out])

    return given.mapInArrow(run, schema)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"])


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
