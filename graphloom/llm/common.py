"""Helpers shared by the corpus operators: tables in the shared folder, shipping of
this package to the executors, and vectorised byte-level text primitives."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

U64 = np.uint64
#: Bases of the two independent rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


# ---------------------------------------------------------------- cluster side

BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


#: What operators keep in a worker from task to task; the next operator's tasks drop it.
KEPT: list[dict] = []


def release(keep: bool = False) -> None:
    """Give memory that a task has freed back to the system, as workers live on. Unless
    ``keep``, what other operators have left in the worker goes too."""
    if not keep:
        for kept in KEPT:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers
    can import it wherever the driver was started. Where the workers share the driver's
    PYTHONPATH, nothing is sent."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_graphloom_shipped", False):
        return spark
    zipped = Path(tempfile.mkdtemp()) / "graphloom_pkg.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for f in (root / "graphloom").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(zipped))
    sc._graphloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only
    where that is unset (tests on one machine) a local folder is chosen and set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_graphloom_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---------------------------------------------------------------- byte primitives


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 on unsigned 64-bit lanes."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a rolling base and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            a = np.full(max(n, 1 << 16), U64(base), dtype=U64)
            a[0] = 1
            made.append(np.cumprod(a))
        _powers[which] = tuple(made)
    return _powers[which][0][:n], _powers[which][1][:n]


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """S with S[j]-S[i] = polynomial hash of data[i:j], times the i-th power."""
    p, _ = powers(len(data) + 1, which)
    s = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of data[lo:hi] from prefix sums, the same wherever the bytes stand."""
    _, inv = powers(len(s), which)
    return mix((s[hi] - s[lo]) * inv[lo])


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``mask`` holds; runs end at row boundaries."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    cut = off[:-1]
    before[cut[cut < len(mask)]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    last = off[1:] - 1
    after[last[(last >= 0) & (last < len(mask))]] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; on many wide integers faster than hashing them."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def row_of(off: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(off, pos, side="right") - 1


# ---------------------------------------------------------------- dropping rows by id

#: Bits of the filter below: its size is fixed, so it may travel with every task.
FILTER_BITS = 1 << 22
#: Columns that go along for a step, under names that no table has.
PLACES = {1: "__graphloom_place_1", 2: "__graphloom_place_2"}
MAYBE = "__graphloom_maybe"


def id_filter(ids: DataFrame, name: str = "doc_id") -> np.ndarray:
    """A Bloom filter of fixed size over an id column, built by the executors."""
    one = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(name)), F.lit(FILTER_BITS)) for k in (1, 2)])).alias("p"))
    words = one.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:  # bounded: FILTER_BITS / 64 rows
        out[r.w] = r.b
    return out


def filter_places(name: str = "doc_id") -> list:
    return [F.pmod(F.xxhash64(F.lit(k), F.col(name).cast("long")), F.lit(FILTER_BITS)).alias(f) for k, f in PLACES.items()]


def in_filter(b: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    found = np.ones(b.num_rows, bool)
    for k in PLACES.values():
        p = np.asarray(b.column(k).fill_null(0))
        found &= (bits[p >> 6] >> (p & 63) & 1) == 1
    return found


def maybe_in(docs: DataFrame, bits: np.ndarray, name: str = "doc_id") -> DataFrame:
    """``docs`` with ``MAYBE``: false only where the id is surely not in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = in_filter(b, bits)
            keep = [i for i, f in enumerate(b.schema.names) if f not in PLACES.values()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(found)], [*[b.schema.names[i] for i in keep], MAYBE])

    hashed = docs.select("*", *filter_places(name))
    return hashed.mapInArrow(run, StructType([*docs.schema.fields, StructField(MAYBE, BooleanType())]))


def drop_ids(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``ids``. Only rows that a Bloom filter can't
    rule out are shuffled for the exact anti-join; rows without an id stay."""
    bits = id_filter(ids, name)
    marked = maybe_in(docs, bits, name)
    sure = marked.where(~F.col(MAYBE)).drop(MAYBE)
    rest = marked.where(F.col(MAYBE)).drop(MAYBE).join(ids.select(name).distinct(), name, "left_anti")
    return sure.unionByName(rest.select(*docs.columns))
