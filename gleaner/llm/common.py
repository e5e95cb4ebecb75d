"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches; everything below works on the UTF-8
buffers of such a batch with numpy, a slice of bounded size at a time, so the
cost per byte is a few array passes and memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.session import stored

SLICE_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. The driver keeps no freed memory of the plan."""
    out = stored(df, name)
    relieve(df.sparkSession)
    return out


def give_back() -> None:
    """Return to the system what this process has freed: numpy's memory by the C library, where it can, and Arrow's by its pool."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def relieve(spark: SparkSession) -> None:
    """Return to the system what the driver has freed, its Python and its JVM.

    The JVM's compilers work on the C library's memory, and with many plans hundreds of
    MB of it stay with the process, freed, beside the heap. A JVM without the command
    (before 17.0.9, or not on glibc) and a session without a JVM keep it.
    """
    give_back()
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    try:
        # By reflection on the interface: the server's own class is not exported to py4j.
        name = jvm.java.lang.Class.forName
        kinds = [name("javax.management.ObjectName"), name("java.lang.String"), name("[Ljava.lang.Object;"), name("[Ljava.lang.String;")]
        types, args = (spark.sparkContext._gateway.new_array(kind, 4) for kind in (jvm.java.lang.Class, jvm.java.lang.Object))
        for k, kind in enumerate(kinds):
            types[k] = kind
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)
    except Py4JError:
        pass


def lean(work):
    """``work`` on Arrow batches, after which the worker keeps no memory that it does not use: Spark keeps workers for later tasks, beside an executor's heap."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], independent of where the span stands."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the n + 1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes together."""
    data, offsets = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each row the index of its first word (n + 1 of them)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)




def remainder(column: str, modulus: int):
    """crc32(id as text) mod modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, whatever columns it brings along."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
