"""Shared helpers: reading tables, bounded membership bitmaps, stable random numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BUCKET_BITS = 32768            # fixed by bitmap_construct_agg: one bitmap holds 4 KB
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The rows that no model may learn from: crc32 of the id's text leaves 2 when divided by 4."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key only; the same in every engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def pieces(text: Column, seed: Column, chars: int, parts: int) -> Column:
    """A text of up to ``chars`` characters as it is; of a longer one a random piece from each of ``parts`` even stretches."""
    part = chars // parts
    stretch = F.floor(F.length(text) / parts)
    starts = [F.lit(i) * stretch + F.pmod(F.xxhash64(F.lit(i), seed), F.greatest(stretch - part, F.lit(0)) + 1) for i in range(parts)]
    made = F.concat_ws("\n", *[F.substring(text, (at + 1).cast("int"), F.lit(part)) for at in starts])
    return F.when(F.length(text) > chars, made).otherwise(text)


def folded(pattern: re.Pattern, text: str) -> list[str]:
    """The pattern's matches in lower case. A character whose lower case has another length does not move the others."""
    low = text.lower()
    return pattern.findall(low) if len(low) == len(text) else [w.lower() for w in pattern.findall(text)]


def membership(keys: DataFrame, col: str, n: int) -> np.ndarray:
    """Bits of a set of 64-bit keys: bit ``key mod len`` is on for each key of ``keys``.

    Built by Spark as 4 KB pieces and collected. Its size follows ``n``, the number of keys, up to
    MAX_BITS (16 MB), a fixed bound. It can only let too much through (all, when it is full), so
    callers use it to thin rows out before the exact join.
    """
    bits = MIN_BITS
    while bits < MAX_BITS and bits < 16 * n:
        bits *= 2
    # bitmap_bucket_number counts from 1 for the values 1..32768
    at = F.pmod(F.col(col), F.lit(bits)) + 1
    rows = (keys.filter(F.col(col).isNotNull()).select(at.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.k - 1) * BUCKET_BITS // 8: r.k * BUCKET_BITS // 8] = np.frombuffer(r.b, np.uint8)
    return out


def is_member(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys may be in the set."""
    at = keys.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def quoted(names: list[str]) -> list[Column]:
    """Columns by exact name, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def aside(df: DataFrame, reserved: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """Rename the columns of ``df`` that would clash with ``reserved`` names; also the way back."""
    back = {f"_aside_{i}": c for i, c in enumerate(df.columns) if c.lower() in reserved}
    return df.select(*[c.alias(f"_aside_{i}" if f"_aside_{i}" in back else n) for i, (n, c) in enumerate(zip(df.columns, quoted(df.columns)))]), back


def from_texts(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list], list[tuple]]], added: str) -> DataFrame:
    """The columns ``keep`` and, computed from ``text`` batch by batch, the columns declared in ``added``.

    A kept column that has the name of an added one gives way to it.

    ``make`` runs once per task and returns the function from texts to rows. Arrow carries the kept
    columns through unchanged, so nulls and large integers stay what they are.
    """
    new = {f.name.lower() for f in StructType.fromDDL(added).fields}
    keep = [c for c in keep if c.lower() not in new]
    types = to_arrow_schema(StructType.fromDDL(added))
    schema = StructType([*df.select(*quoted(keep)).schema.fields, *StructType.fromDDL(added).fields])
    names = [*keep, *types.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for b in batches:
            rows = judge(b.column(len(keep)).to_pylist())
            made = [pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=names)
    # columns travel under plain names, as any name may occur in ``keep``
    return df.select(*[c.alias(f"_{i}") for i, c in enumerate(quoted(keep))], F.col("text").alias("_text")).mapInArrow(run, schema)
