"""Shared helpers: staged tables, word hashing over whole batches, hashing constants."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than these six (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs within one machine (tests) a temporary folder is made and
    set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends here.

    A lost executor costs the reader nothing, since the files are not on its own disk.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``staged`` returned, once nothing will read it again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of one Arrow batch that goes to a Python worker, and rows of it.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 2000


def in_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, so that neither side holds many whole texts at once.

    The settings are the session's own; where the user has set them they stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        if df.sparkSession.conf.get(key, None) is None:
            df.sparkSession.conf.set(key, str(most))
    return df.mapInArrow(f, schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


#: A random 64-bit value for every byte value, made by rule.
_BYTE = mix64((np.arange(1, 257, dtype=np.uint64)) * _MULT)


def rolled(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run ``data[starts[i]:starts[i]+lens[i]]`` (every run non-empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    begin = ends - lens
    pos = np.arange(int(ends[-1])) - np.repeat(begin, lens)
    power = np.full(int(lens.max()), _ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    values = _BYTE[data[pos + np.repeat(starts, lens)]] * power[pos]
    return mix64(np.add.reduceat(values, begin) + lens.astype(np.uint64))


class Words:
    """The words of a list of texts, as arrays.

    ``doc`` is each word's text number, ``h`` its 64-bit hash, ``count`` the words of each text.
    Texts are bytes; a null text must be passed as b"".
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = ~_SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.starts, ends = edge[::2], edge[1::2]
        self.lens = ends - self.starts
        self.doc = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.h = rolled(self.data, self.starts, self.lens)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words within one text, and the number of each window's first word."""
        size = max(0, len(self.h) - n + 1)
        acc = np.zeros(size, np.uint64)
        for k in range(n):
            acc = mix64(acc * _ODD + self.h[k : k + size] + np.uint64(k + 1))
        at = np.flatnonzero(self.doc[:size] == self.doc[n - 1 : n - 1 + size]) if size else np.zeros(0, np.int64)
        return acc[at], at


def chunks(texts: list, limit: int = 1 << 20):
    """Slices of a list of texts of about ``limit`` bytes or characters each, so that arrays stay small; all texts, none cut."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def small(batches, rows: int = 512):
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
