"""Document fingerprints by Order MinHash.

The k-mers of a text are numbered by occurrence and hashed; in each of M parts of the hash space the L
smallest are selected, put back into text order and hashed as a tuple. Equal entries of two fingerprints
estimate a likeness that falls with edits and with reordering. The M selections come from one hash whose range is
cut into M parts (an empty part takes the next full one's tuple), instead of from M hashes, and an entry keeps 16
bits of its tuple's hash; a test holds the estimate against that of M independent hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, mix64, small, staged

K = 12
PARTS = 64
L = 2
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(58)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _kmers(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of K = 12 code points; a shorter text is one window."""
    h = mix64(codes.astype(np.uint64) + np.uint64(1))
    if len(h) < K:
        for _ in range(3):
            h = mix64(h + np.arange(len(h), dtype=np.uint64) * _ODD)
        return mix64(np.array([np.bitwise_xor.reduce(h)], np.uint64) + np.uint64(len(h))) if len(h) else h
    two = h[:-1] * _ODD + h[1:]
    two ^= two >> np.uint64(29)
    four = two[:-2] * _ODD + two[2:]
    four ^= four >> np.uint64(31)
    eight = four[:-4] * _ODD + four[4:]
    eight ^= eight >> np.uint64(30)
    return mix64(eight[:-4] * _ODD + four[8:])


def _numbered(h: np.ndarray) -> np.ndarray:
    """Each k-mer together with the number of its occurrence in the text."""
    ordered = np.sort(h)
    if len(h) < 2 or not (ordered[1:] == ordered[:-1]).any():
        return h
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.concatenate(([True], run[1:] != run[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    out = np.empty_like(h)
    times = (np.arange(len(h)) - start).astype(np.uint64)
    out[order] = np.where(times > 0, mix64(run + times * _ODD), run)
    return out


def fingerprint(text: str) -> np.ndarray:
    """PARTS numbers of 16 bits; none for an empty text."""
    if not text:
        return np.zeros(0, np.uint16)
    v = _numbered(_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))
    at = np.arange(len(v))
    if len(v) > 64 * PARTS:
        # The smallest of each part lie below this bound, or else all are sorted.
        low = np.flatnonzero((v << np.uint64(6)) < np.uint64(int(2**64 * (24 * PARTS / len(v)))))
        if (np.bincount((v[low] >> _SHIFT).astype(np.int64), minlength=PARTS) >= L).all():
            at = low
    at = at[np.argsort(v[at], kind="stable")]
    part = (v[at] >> _SHIFT).astype(np.int64)
    begin = np.searchsorted(part, np.arange(PARTS))
    count = np.minimum(np.searchsorted(part, np.arange(PARTS), "right") - begin, L)
    sig = np.zeros(PARTS, np.uint64)
    pick = np.full((PARTS, L), len(v), np.int64)
    for k in range(L):
        has = count > k
        pick[has, k] = at[begin[has] + k]
    pick.sort(1)  # back into text order
    for k in range(L):
        has = pick[:, k] < len(v)
        sig[has] = mix64(sig[has] * _ODD + v[pick[has, k]])
    full = np.flatnonzero(count)
    if len(full) < PARTS:  # an empty part repeats the next full one, with its distance
        nxt = full[np.searchsorted(full, np.arange(PARTS)) % len(full)]
        away = ((nxt - np.arange(PARTS)) % PARTS).astype(np.uint64)
        sig = np.where(away > 0, mix64(sig[nxt] + away), sig)
    return (sig >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; two empty texts are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def shown(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint) of every whole text.

    Null text counts as empty (""). Null and repeated ids and repeated rows each give a row, an empty table none;
    further columns are ignored.
    """

    def run(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(fingerprint(t or "")) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, fingerprint string")


def _ordered(docs: DataFrame, text: str) -> DataFrame:
    """(part, doc_id, text): ranges of documents, each sorted by descending doc_id, null last, then by the text's
    hash; a range stands behind the one before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "first", "last"]


def _row(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    cut = len(text) // 3
    edited = text[: len(text) - cut] + following[:cut]
    changed = own if edited == text else fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(changed), likeness(own, changed), likeness(own, other)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)


def _compare(batches):
    """A row for each document but the range's last; then one with the first text of the range and the last
    document, whose next one lies in another range."""
    part, first, held, out = None, None, None, []
    for batch in small(batches):
        for p, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = held[2] if held and held[1] == text else fingerprint(text)
            if held is None:
                part, first = p, text
            else:
                out.append((*_row(*held, text, own), None, None, None))
            held = doc_id, text, own
            if len(out) >= 256:
                yield _batch(out)
                out = []
    if held is not None:
        out.append((held[0], None, None, None, None, None, None, part, first, held[1]))
    if out:
        yield _batch(out)


def _edges(batches):
    for batch in small(batches, 16):
        out = []
        for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out.append((*_row(doc_id, text, fingerprint(text), following, fingerprint(following)), None, None, None))
        if out:
            yield _batch(out).select(_NAMES[:7])


def compared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last third taken from the next document, and the
    likeness of the first to the second and to the next document's.

    Next: by descending doc_id, null ids last, equal ids by the hash of the text; after the last comes the
    first. Null text counts as empty. Repeated rows are documents of their own. A single document is its own
    next. An empty table gives an empty result. Further columns are ignored.
    """
    found = staged(in_batches(_ordered(docs, text), _compare, f"{SCHEMA}, part int, first string, last string"), "fingerprints")
    edges = found.where("part is not null").select("part", "doc_id", "first", "last")  # a row a range
    by_part = Window.orderBy("part")
    after = edges.select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next"))
    pairs = edges.join(after, F.col("part") == F.col("at")).select("doc_id", F.col("last").alias("text"), "next")
    pairs = pairs.join(edges.select("part", "first"), F.col("next") == F.col("part")).select("doc_id", "text", "first")
    last = in_batches(pairs, _edges, SCHEMA)
    return found.where("part is null").drop("part", "first", "last").unionByName(last)
