"""What the text operators share: tables in the shared folder, word rules, Arrow mapping.

Conventions that every operator of this package follows:

* Only the columns that an operator needs are read from its input, so extra columns, whatever their names, never
  clash with the ones that it makes.
* A null text is an empty text. A null doc_id is a document id of its own that is equal to itself.
* Repeated rows each get their own result row.
* An empty table gives an empty result with the same columns.
* A very long text is read whole, by one task, in a batch of its own if need be: Spark bounds an Arrow batch by its bytes,
  and mapped() hands it on in slices. Nothing grows with more than the length of that one text.
* Ties are broken by the smallest doc_id, then by a hash of the text, so that reruns agree.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, and bytes on average, of the slices of an Arrow batch that a function gets at once.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: Rows up to which a side may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000
#: And, for rows with strings or arrays of open length, the characters that all of them may have as JSON.
BROADCAST_CHARS = 64_000_000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only where the session names none, and only
    where driver and executors are one process: elsewhere each would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="lanternflow-"))
    return _own_folder[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lanternflow-{name}-{uuid.uuid4().hex}"
    schema = StructType.fromJson({**df.schema.jsonValue(), "fields": [{**f, "nullable": True} for f in df.schema.jsonValue()["fields"]]})
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int | None = None) -> bool:
    """Whether a saved table is small enough to broadcast: its rows, counted at most once past the bound, and with chars
    also the length of those rows as JSON, for rows that have no size of their own."""
    first = df.limit(rows + 1)
    if chars is None:
        return first.count() <= rows
    n, length = first.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (length or 0) <= chars


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast behind the check of its size, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and, on average, bytes; an empty one as it is."""
    step = max(1, min(BATCH_ROWS, BATCH_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes)))
    for at in range(0, max(1, batch.num_rows), step):
        yield batch.slice(at, step)


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """function over Arrow batches of bounded size."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield function(part)

    return df.mapInArrow(over, schema)


def at_label(rows: DataFrame, few: DataFrame, key: str, salt: str, parts: int = 32) -> DataFrame:
    """rows left joined with few, a saved table of one row for each value of key. A value may hold a third of rows: few is
    broadcast behind the check of its size, else rows are dealt to parts by a hash of their column salt, which few repeats."""
    if fits_broadcast(few):
        return rows.join(F.broadcast(few), key, "left")
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    copies = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, [key, "__part"], "left").drop("__part")


def set_aside(documents: DataFrame, *needed: str) -> DataFrame:
    """documents with all columns but the needed ones renamed by place, so that no name of theirs can clash."""
    return documents.toDF(*[c if c in needed else f"other{i}" for i, c in enumerate(documents.columns)])


def put_back(result: DataFrame, aside: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of aside from result, under their names in documents."""
    return result.select(*aside.columns).toDF(*documents.columns)


def remainder(column: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo by; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(None)).cast("string")) % by


#: bytes -> lower-case bytes, with a blank for each ASCII byte that is no letter or digit. Bytes over 0x7F stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def blank_split(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+; bytes.split() cuts at just these."""
    return (text or "").encode("utf-8", "surrogatepass").split()


_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_TO = "abcdefghijklmnopqrstuvwxyz" + " " * (len(_FROM) - 26)


def words(text: Column) -> Column:
    """The same words as word_bytes(), as a column of array<string>."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), "")


def result_copies(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its column copies says, without that column."""
    return df.withColumn("__one", F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop("__one", copies)
