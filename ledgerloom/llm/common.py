"""What the operators share: table access, the shared folder, ASCII folding, bounded Arrow slices, skew-proof joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut, shared_dir

__all__ = [
    "ARROW", "FOLD", "HEAVY", "WORD", "ascii_lower", "bounded", "cut", "join_heavy", "per_row", "scratch", "shared_dir",
    "slices", "small_batches", "spare", "table", "whole",
]

#: Words are runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows and bytes of whole texts that a Python worker takes apart at once, and the bytes of an Arrow batch; a longer text
#: is a slice, and a batch, of its own.
SLICE_ROWS, SLICE_BYTES, BATCH_BYTES = 256, 4 << 20, 4 << 20
#: Rows of a group from which it counts as heavy, heavy groups up to which they are broadcast, and salts beyond that.
HEAVY, HEAVY_GROUPS, SALTS = 1000, 100_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from here on in this session; their number of rows stays as it is set.

    Spark reads the setting when a query runs, so it cannot be put back before a lazy result is used; it only ever
    falls, and no query gives other rows for it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < at <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def ascii_lower(text: Column) -> Column:
    """A-Z only; texts that are ASCII throughout take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def bounded(side: DataFrame, most: int) -> DataFrame:
    """`side`, broadcast if it has at most `most` rows; side should be cheap to count (checkpointed)."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def join_heavy(rows: DataFrame, groups: DataFrame, key: str, number: str, spread: Column, heavy: int = HEAVY, most: int = HEAVY_GROUPS) -> DataFrame:
    """rows with the columns of their group (null without one), and no task that holds all rows of a key.

    groups has one row a key, and in `number` its rows. Groups of over `heavy` rows are few: they are broadcast, or,
    beyond `most` of them, joined by key and salt, where `spread` is what differs among the rows of a key. The others
    are joined by shuffle. Keys of rows are not null. Both sides should be checkpointed: each is read twice.
    """
    big, light = groups.filter(F.col(number) > heavy), groups.filter(F.col(number) <= heavy)
    if big.limit(most + 1).count() <= most:
        tagged = rows.join(F.broadcast(big), key, "left")
    else:
        salt = spare(rows, "salt")[0]
        salted = big.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        tagged = dealt.join(salted, [key, salt], "left").drop(salt)
    rest = tagged.filter(F.col(number).isNull()).select(*rows.columns).join(light, key, "left")
    return rest.unionByName(tagged.filter(F.col(number).isNotNull()))


ARROW = {
    "string": (T.StringType(), pa.string()), "long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "binary": (T.BinaryType(), pa.binary()),
    "array<long>": (T.ArrayType(T.LongType()), pa.list_(pa.int64())), "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
}


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most so many rows and bytes of one column (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def per_row(df: DataFrame, keep: list[str], value: str, out: dict[str, str], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """`keep` as it is, plus the columns `out`, worked out from the values of one string or binary column.

    make() runs once in each task and returns what turns a list of values into a list of columns. A worker holds one
    Arrow batch and takes a slice of it apart at a time.
    """
    small_batches(df.sparkSession)
    value_name = spare(df, "value")[0]
    slim = df.select(*(F.col(f"`{c}`") for c in keep), F.col(value).alias(value_name))
    fields = [slim.schema[c] for c in keep] + [T.StructField(c, ARROW[t][0]) for c, t in out.items()]
    kinds = [ARROW[t][1] for t in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for part in slices(b, len(keep)):
                columns = work(part.column(len(keep)).to_pylist())
                made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], [*keep, *out])

    return slim.mapInArrow(run, T.StructType(fields))
