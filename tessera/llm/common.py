"""Shared pieces of the training-data operators: tables, the shared folder, and byte-level text kernels.

The kernels work on Arrow string buffers: all words, lines or byte windows of a chunk of documents are found and
hashed with a few numpy passes, without a Python object for each.  Chunks are bounded in bytes, not in rows, so that a
batch of very long texts needs no more memory than one of short ones (a single text is never split).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21

#: The white space of the contracts, `[\x20\x09-\x0D]`.
SPACES = b" \t\n\x0b\x0c\r"
#: The words of the contracts, as a pattern for Python, Java and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(SPACES)] = False
ALNUM_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a local one where it is unset and there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "/tmp/checkpoints/tessera"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting by which a finished query's shuffle files are deleted at once, not when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and any executor can read it again after a loss.

    The shuffles that made it are of no more use and are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class Kept:
    """Columns that pass through an operator under names of their own, so that none clashes with what it adds.

    A column that has the name of one of the result's own columns does not pass.
    """

    def __init__(self, df: DataFrame, keep: list[str] | None, own: tuple[str, ...] = ()):
        self.names = [c for c in (keep if keep is not None else ["doc_id"]) if c not in own]
        self.hidden = [f"__c{i}" for i in range(len(self.names))]
        self.columns = [column(c).alias(h) for c, h in zip(self.names, self.hidden, strict=True)]
        types = dict(df.dtypes)
        self.kinds = "".join(f"{h} {types[c]}, " for c, h in zip(self.names, self.hidden, strict=True))
        self.back = [F.col(h).alias(c) for c, h in zip(self.names, self.hidden, strict=True)]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    while name in df.columns:
        name += "_"
    return name


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns of a row (but maps, which have none)."""
    return F.xxhash64(*(column(c) for c, kind in docs.dtypes if "map<" not in kind))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK_BYTES + 1)
        _pow, _inv = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_BASE, _INV))
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() has the hash of any span of buf."""
    power, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * power[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal spans have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if where is None or data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts with about `most` bytes."""
    buf, offsets = strings(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of set bytes, none across two texts."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = offsets[(offsets > 0) & (offsets < len(mask))]
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[cut] = False
    after[-1], after[:-1] = False, mask[1:]
    after[cut - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


def per_text(n: int, texts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Count or sum by text, as int64."""
    return np.bincount(texts, weights, n).astype(np.int64)
