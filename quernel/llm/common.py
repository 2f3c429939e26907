"""What the operators of this subpackage share: written intermediate tables, Arrow helpers, tokenizer files."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import Scratch

#: The characters that separate words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as decimal text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, remainder: int, most: int, text: str, scratch: Scratch) -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents that are not held out, chosen by hash: a written, bounded table.

    Of several labels of a document the largest counts, of several texts under an id the one with the least hash; null labels
    and ids take no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    # The chosen ones are `most` rows of two numbers at most, so they may be broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return scratch.keep(one.select("doc_id", "t.text", "y"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back at the end of its partition: Python workers are used again, and what one
    of them keeps stands beside all later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 2048) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows; fn gets a batch and returns the output columns in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out.values(), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(tidy(run), spark_schema)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
