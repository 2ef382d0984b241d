"""A packed exchange between documents and a table keyed by hash.

Each task packs its documents into blocks of bounded size. A block asks for what it needs once per distinct
key: the keys are dealt to hash ranges, one compact request a block and range, none where a block has no key of a
range, so there are never more requests than distinct keys of the blocks. A range's server sees every
request for its keys, so it works once per distinct key over the whole corpus; its replies go back to the
blocks, where the merge puts the answers at their positions. A key that stands in all documents is one entry a
block; no server's load grows with a key's frequency. The number of ranges follows the input's bytes, that of
the partitions they are dealt to is bounded.

The input is read twice, once for the requests and once for the payloads, instead of being shuffled or
written twice. Both reads must give the same rows in the same partitions, as a scan of files does; the merge
compares check values and fails loudly if they don't.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, small

#: Characters of a block (a longer document is a block of its own), and input bytes for one hash range.
BLOCK_CHARS = 4 << 20
RANGE_BYTES = 12 << 20
#: Partitions of requests at most; beyond that a partition serves several ranges, one after the other.
MOST_PARTS = 20000
LAST = (1 << 31) - 1
#: Bytes below which packing costs more than it saves.
TINY = 64
REQUEST = "range int, block long, blob binary"


def planes(x: np.ndarray) -> bytes:
    """A compact form of an integer array: byte planes, then zstd; a tiny one as it is."""
    x = np.ascontiguousarray(x)
    if x.nbytes < TINY:
        return b"\0" + x.tobytes() if len(x) else b""
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unplanes(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    if blob[0] == 0:
        return np.frombuffer(blob, kind, offset=1)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def packed(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    return b"".join([np.uint32(len(parts)).tobytes(), np.array([len(p) for p in parts], np.uint64).tobytes(), *parts])


def unpacked(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(blob, np.uint64, n, 4).astype(np.int64)) + 4 + 8 * n
    return [blob[a:b] for a, b in zip([4 + 8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def range_count(docs: DataFrame, text: str = "text") -> int:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    return max(1, -(-int(total) // RANGE_BYTES))


def _blocks(batches):
    """(block id, doc_ids, texts) until the rows end."""
    base = seq = size = 0
    ids, texts = [], []
    for batch in small(batches):
        base = batch.column(2)[0].as_py() << 32 if batch.num_rows else base
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1]) + 1
            if size >= BLOCK_CHARS:
                yield base + seq, ids, texts
                ids, texts, seq, size = [], [], seq + 1, 0
    if ids:
        yield base + seq, ids, texts


def _rows(triples):
    import pyarrow as pa

    for r, block, blob in triples:
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([block], pa.int64()), pa.array([blob], pa.binary())], ["range", "block", "blob"])


def exchange(docs: DataFrame, ranges: int, request, payload, serve, merge, total, schema: str, text: str = "text") -> DataFrame:
    """``request(ids, texts, ranges)`` yields (range, blob); ``payload(ids, texts)`` gives a blob;
    ``serve([blob of each block])`` gives a blob about the range, then a reply blob for each;
    ``merge(payload blob, {range: reply})`` yields record batches of ``schema``, ``total(blob)``, if there is one, gives
    one for a range."""

    def ask(batches):
        return _rows((r, block, blob) for block, ids, texts in _blocks(batches) for r, blob in request(ids, texts, ranges))

    def keep(batches):
        return _rows((LAST, block, payload(ids, texts)) for block, ids, texts in _blocks(batches))

    def groups(batches, by):
        key, rows = None, []
        for batch in small(batches, 64):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[by] != key:
                    if rows:
                        yield rows
                    key, rows = row[by], []
                rows.append(row)
        if rows:
            yield rows

    def answer(batches):
        for rows in groups(batches, 0):
            served = serve([x[2] for x in rows])
            about = next(served)
            if total:
                yield from _rows([(LAST, -1 - rows[0][0], about)])
            for (r, block, _), blob in zip(rows, served, strict=True):
                yield from _rows([(r, block, blob)])

    def join(batches):
        for rows in groups(batches, 1):
            if rows[0][1] < 0:
                yield total(rows[0][2])
                continue
            if rows[-1][0] != LAST or (len(rows) > 1 and rows[-2][0] == LAST):
                raise RuntimeError("two reads of the documents dealt their rows differently; write them to files first")
            yield from merge(rows[-1][2], {x[0]: x[2] for x in rows[:-1]})

    parts = min(ranges, MOST_PARTS)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    asked = in_batches(df, ask, REQUEST).repartitionById(parts, F.expr(f"int(range * {parts}L div {ranges}L)")).sortWithinPartitions("range", "block")
    replies = in_batches(asked, answer, REQUEST)
    whole = replies.unionByName(in_batches(df, keep, REQUEST)).repartition("block").sortWithinPartitions("block", "range")
    return in_batches(whole, join, schema)
