"""What the operators share: tables, the shared folder, word splitting and hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The characters that separate words, as a Java and RE2 class body: space and \t to \r.
BLANKS = "\\x20\\x09-\\x0D"


def columns(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters a name has."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow, whatever characters the names of columns have: work sees c0, c1, ... and returns columns by position."""
    plain = [f"c{i}" for i in range(len(schema))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in work(batches):
            yield pa.RecordBatch.from_arrays(b.columns, plain)

    fields = [StructField(n, f.dataType, f.nullable) for n, f in zip(plain, schema.fields, strict=True)]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(named, StructType(fields)).toDF(*schema.names)


def schema_of(df: DataFrame, names: list[str] | tuple[str, ...], more: str) -> StructType:
    """The fields of df's columns, then those of a DDL string."""
    return StructType([*[next(f for f in df.schema.fields if f.name == n) for n in names], *StructType.fromDDL(more).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN_DIRS:
        _OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="turnloom-")
    return _OWN_DIRS[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written_at"] = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    path = table.__dict__.pop("_written_at", None)
    if path:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A table of at most so many bytes, as measured, is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 24_000_000


def broadcast_if_small(df: DataFrame, label: str, *texts: str) -> DataFrame:
    """df as a written table, with a broadcast hint only if its measured size is within BROADCAST_BYTES."""
    df = written(df, label)
    size = F.count(F.lit(1)) * 64 + sum((F.coalesce(F.sum(F.octet_length(t)), F.lit(0)) for t in texts), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_BYTES else df


#: What operators keep in a worker from task to task, by operator.
KEPT: dict[str, dict] = {}


def forget(but: str = "") -> None:
    """Clears what other operators keep in this worker."""
    for name, kept in KEPT.items():
        if name != but and kept:
            kept.clear()
            give_back()


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work in a worker that forgets what other operators kept there, and gives back freed memory afterwards."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(own)
        yield from work(batches)
        give_back()

    return done


def give_back() -> None:
    """Freed memory that allocators hold goes back to the system, where they know how to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most."""
    for whole in batches:
        for at in range(0, len(whole), rows):
            yield whole.slice(at, rows)


def crc_mod(doc_id: str, n: int):
    """crc32 of the decimal id, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(n)


def crc_of(doc_id: int | None) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode())


def blank_words(text: str | None) -> list[bytes]:
    """Words between space and \\t to \\r, A-Z lower-cased, as UTF-8. None has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_hashes(words) -> np.ndarray:
    """64-bit hashes, one for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def distinct(a: np.ndarray) -> np.ndarray:
    """The different values in order. By a sort, which is several times as fast here as numpy's hashing."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
