"""What several operators share: words of whole texts, batches of bounded size, clashing column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows handed to a Python worker at once. Texts may be very long, so batches are kept far below Spark's default.
BATCH_ROWS = 256

# ASCII upper to lower case, and every byte that cannot be part of a letter-and-digit word to a space. Bytes from
# 0x80 on belong to characters outside ASCII and are kept.
ALNUM = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256)
)


def blank_words(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space (0x20 and 0x09 to 0x0D), as UTF-8; none of a null text."""
    return data.split() if data else []


def alnum_words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters outside ASCII; none of a null text."""
    return data.translate(ALNUM).split() if data else []


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mapped(
    df: DataFrame,
    columns: dict[str, Column],
    function: Callable[[dict[str, list]], dict[str, list]],
    schema: T.StructType | str,
) -> DataFrame:
    """Rows of ``function`` over batches of ``columns``, which are all that leaves the JVM.

    ``function`` takes and returns columns as lists; it may return more or fewer rows than it takes. It has
    to be deterministic, as a lost task is run again.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = function(part.to_pydict())
            arrays = [pa.array(rows[field.name], field.type) for field in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    small_batches(df.sparkSession)
    return df.select(*(column.alias(name) for name, column in columns.items())).mapInArrow(batches, schema)


def computed(function: Callable[..., dict], schema: str, *columns: Column) -> Column:
    """A struct per row: ``function`` of the row's values of ``columns``, other columns stay in the JVM.

    Values arrive in Arrow batches. ``function`` has to be deterministic.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    @F.arrow_udf(kind)
    def over(*arrays: pa.Array) -> pa.Array:
        values = zip(*(array.to_pylist() for array in arrays), strict=True)
        return pa.array([function(*row) for row in values], pa.struct(list(arrow)))

    small_batches(SparkSession.active())
    return over(*columns)


def computed_together(function: Callable[[list], list[dict]], schema: str, column: Column) -> Column:
    """Like :func:`computed`, for a function that takes the values of a whole batch at once."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    @F.arrow_udf(kind)
    def over(values: pa.Array) -> pa.Array:
        return pa.array(function(values.to_pylist()), pa.struct(list(arrow)))

    small_batches(SparkSession.active())
    return over(column)


def utf8(name: str = "text") -> Column:
    return F.col(name).cast("binary")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with ``names`` in any letter case: results replace them."""
    lowered = {name.lower() for name in names}
    return df.drop(*(name for name in df.columns if name.lower() in lowered))
