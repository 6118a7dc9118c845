"""Helpers that several text operators share: batches of texts, word hashes, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: tab, line feed, vertical tab, form feed, carriage return, space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Texts are worked on in slices of about this many bytes, so that a worker's memory does not follow the batch.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below the one that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local master takes one below its warehouse; on a cluster, where that could be a folder of one
    machine, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    folder = f"{root.rstrip('/')}/needmap-text-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.append(folder)
    return folder


_folders: list[str] = []


@atexit.register
def remove_folders() -> None:
    """Removes what ``cut`` stored, when the Python process that asked for it ends."""
    jvm = SparkContext._jvm
    with contextlib.suppress(Exception):
        while jvm is not None and _folders:
            path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame, stored as Parquet in the shared folder and read back: for what several jobs read, or a loop extends.

    What is read back survives lost executors and has a measured size. (A checkpoint keeps the size estimate of the plan that it
    replaces; a join's estimate is the product of its sides, so in a loop it grows until planning takes longer than the work.)
    """
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, and the folder, for ``discard`` when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # names that clash but for their case cannot be stored
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns), path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes what ``stored`` wrote."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that do not clash with the frame's own (compared without case)."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def text_of(column: str) -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def slices(batch: pa.RecordBatch, column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes; a longer text is a run of its own."""
    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        start = ends[low] - sizes[low]
        high = max(int(np.searchsorted(ends, start + limit, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of lists from the joined values and each row's length."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def gather(starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices that read the runs ``rows`` one after the other out of joined values."""
    sizes = lengths[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts[rows] - (ends - sizes), sizes)


# --- word hashes ------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(2**40, 2**63, dtype=np.uint64)) | 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[str, np.ndarray] = {}


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z; all other characters stay."""
    return text.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base², ... modulo 2**64; kept up to a few slices' length."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def forget_powers() -> None:
    _powers.clear()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each text.

    A polynomial over random byte values, modulo 2**64, for the whole slice at once; a word's hash does not depend on
    where it stands.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[joined]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * _power("base", _BASE, len(joined)), out=sums[1:])
    inverse = _power("inverse", pow(_BASE, -1, 1 << 64), len(joined))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    at = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return hashes, np.diff(at)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles, text by text, and their number; a shorter text is one shingle."""
    total = len(words)
    if total == 0:
        return words, counts.copy()
    multipliers = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    starts = np.cumsum(counts) - counts
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    position = gather(starts, out_counts, np.arange(len(counts)))
    width = np.repeat(np.minimum(counts, n), out_counts)
    value = np.zeros(len(position), dtype=np.uint64)
    for k in range(n):
        term = words[np.minimum(position + k, total - 1)] * multipliers[k]
        value += np.where(k < width, term, np.uint64(0))
    return mix(value + width.astype(np.uint64)), out_counts


# --- queries ----------------------------------------------------------------------------------------------------


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they do not find it by themselves.

    Where executors have it elsewhere, or not at all, it is shipped with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (have, root)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string: the register is shifted bit by bit, lowest bit of each byte first."""
    byte = f"('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::UBIGINT"
    bits = f"flatten(list_transform(range(octet_length(encode({value}))), lambda i: list_transform(range(8), lambda k: ({byte} >> k) & 1::UBIGINT)))"
    step = "lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1::UBIGINT))"
    return f"xor(list_reduce({bits}, {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"
