"""What the operators of this package share: word rules, column names, row identities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word rule of the contracts (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, replaced: Iterable[str]) -> list[Column]:
    """All columns but those that an operator is about to add; its outputs win over equal names."""
    gone = {c.lower() for c in replaced}
    return [quoted(c) for c in df.columns if c.lower() not in gone]


def hashable(df: DataFrame) -> list[Column]:
    """Columns a row hash can take: all but maps and variants."""
    return [quoted(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def array_literal(values: Sequence[float | int], kind: str) -> Column:
    """A short list of numbers as one constant array."""
    inner = ",".join(f"CAST('{v!r}' AS {kind})" for v in values)
    return F.expr(f"CAST(array({inner}) AS array<{kind}>)")


def text_slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of text; one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        upto = int(np.searchsorted(ends, before + size, side="right"))
        upto = min(max(upto, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto
