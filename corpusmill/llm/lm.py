"""Scoring texts with a language model smoothed by deleted interpolation.

Bigram, unigram and uniform estimates are mixed; the weights depend on how often the context was seen, in
buckets of powers of two. They are learned by expectation-maximisation on deleted counts: each training token
is held out in turn, its own occurrence taken from the counts. A few rounds on a small histogram of the events
give the weights to start from; then each round is a pass over all events as they are, until nothing moves. N-gram
counts come from all training documents through the packed exchange, so one n-gram is counted in one place
however common it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import exchange, packed, planes, range_count, unpacked, unplanes
from .common import Words, in_batches, mix64, small, staged

#: Passes over all events at most, and the move of a weight below which they end.
ROUNDS, STILL = 50, 5e-4
#: The same for the rounds on the histogram.
FIRST_ROUNDS, FIRST_STILL = 500, 1e-5
BUCKETS = 48
FLOOR = 1e-6
_START, _END = mix64(np.array([11, 13], np.uint64))
_ODD = np.uint64(0xD6E8FEB86659FD93)
COUNTED = "blob binary, n_train long, n_types long, n_texts long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id) -> bool:
    """crc32 of the id as text, modulo 10, is 0. A null id is in training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _tokens(texts: list[str]):
    """Hash of each token (an end closes each text), hash of the bigram it closes, tokens of each text."""
    words = Words([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    lens = words.count + 1
    tok = np.full(int(lens.sum()), _END, np.uint64)
    tok[np.arange(len(words.h)) + words.doc] = words.h
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[np.cumsum(lens) - lens] = _START
    return tok, mix64(before * _ODD + tok + np.uint64(7)), lens


def _ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; a range is an interval of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _steps(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _request(ids, texts, ranges):
    tok, pair, lens = _tokens(texts)
    train = np.repeat([not held_out(i) for i in ids], lens)
    found = []
    for keys in (tok, pair):
        u, at = np.unique(keys, return_inverse=True)
        found.append((u, np.bincount(at, weights=train, minlength=len(u)).astype(np.uint32), _ranges_of(u, ranges)))
    for r in np.union1d(found[0][2], found[1][2]):
        cuts = [(u, c, *np.searchsorted(own, [r, r + np.uint64(1)])) for u, c, own in found]
        yield int(r), packed(*[f(x[a:b]) for u, c, a, b in cuts for f, x in ((_steps, u), (planes, c))])


def _payload(ids, texts):
    data = "".join(texts).encode("utf-8", "surrogatepass")
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
    import zstandard

    return packed(planes(np.array([i or 0 for i in ids], np.int64)), planes(np.array([i is not None for i in ids], np.uint8)), planes(sizes), zstandard.ZstdCompressor(level=3).compress(data))


def _serve(blobs):
    asked = [unpacked(b) for b in blobs]
    totals = []
    for k in (0, 2):
        keys = [np.cumsum(unplanes(p[k], np.uint64), dtype=np.uint64) for p in asked]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([unplanes(p[k + 1], np.uint32) for p in asked]), minlength=len(u)).astype(np.uint64)
        totals.append((np.split(at, np.cumsum([len(x) for x in keys])[:-1]), count))
    yield np.array([totals[0][1].sum(), (totals[0][1] > 0).sum()], np.int64).tobytes()
    for b in range(len(blobs)):
        yield packed(*[planes(count[at[b]]) for at, count in totals])


def _total(blob):
    """Training tokens and their kinds in one range."""
    tokens, types = np.frombuffer(blob, np.int64).tolist()
    return pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), *[pa.array([x], pa.int64()) for x in (tokens, types, 0)]], ["blob", "n_train", "n_types", "n_texts"])


def _merge(blob, replies):
    import zstandard

    own, known, sizes, data = unpacked(blob)
    data = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(unplanes(sizes, np.uint64)).astype(np.int64)
    texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    tok, pair, lens = _tokens(texts)
    replies = [unpacked(replies[r]) for r in sorted(replies)]
    seen = []
    for k, keys in ((0, tok), (1, pair)):
        u, at = np.unique(keys, return_inverse=True)
        count = np.concatenate([unplanes(x[k], np.uint64) for x in replies])
        if len(count) != len(u):
            raise RuntimeError("two reads of the documents differ; write them to files first")
        seen.append(count[at])
    texts_seen = int(seen[0][int(lens[0]) - 1])  # the count of the end token is that of training texts
    out = packed(own, known, planes(lens.astype(np.uint32)), planes(seen[0]), planes(seen[1]))
    yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary()), *[pa.array([x], pa.int64()) for x in (0, 0, texts_seen)]], ["blob", "n_train", "n_types", "n_texts"])


def counted(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """Blocks of documents with the training counts of each token and of the bigram that it closes; the training
    tokens and their kinds."""
    table = staged(exchange(docs, range_count(docs, text), _request, _payload, _serve, _merge, _total, COUNTED, text), "lm-counts")
    total = table.where("blob is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_types")]).first()
    return table.where("blob is not null").select("blob", "n_texts"), int(total[0]), int(total[1])


def _opened(row):
    own, known, lens, c1, c2 = unpacked(row["blob"])
    lens, c1, c2 = unplanes(lens, np.uint32).astype(np.int64), unplanes(c1, np.uint64).astype(float), unplanes(c2, np.uint64).astype(float)
    ch = np.empty_like(c1)
    ch[1:] = c1[:-1]
    ch[np.cumsum(lens) - lens] = row["n_texts"]
    return unplanes(own, np.int64), unplanes(known, np.uint8) > 0, lens, c1, c2, ch


def _bucket(ch: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(ch + 1)), BUCKETS - 1).astype(np.int64)


def _share(a, b):
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def _rungs(p: np.ndarray) -> np.ndarray:
    """Quarter-octave rungs of a probability; 0 has its own."""
    return np.where(p > 0, np.round(4 * -np.log2(np.where(p > 0, p, 1.0))), -1).astype(np.int64)


def _events(row, n_train: int):
    """Bucket and both estimates of each training token, its own occurrence taken away."""
    ids, known, lens, c1, c2, ch = _opened(row)
    train = np.repeat([not (k and held_out(int(i))) for i, k in zip(ids, known, strict=True)], lens)
    c1, c2, ch = (x[train] - 1 for x in (c1, c2, ch))
    return _bucket(ch), _share(c2, ch), _share(c1, np.full_like(c1, n_train - 1))


def _cells(n_train: int):
    """The events of each block by bucket and rungs of both estimates: how many, and the sums of the estimates."""

    def run(batches):
        for row in _one_by_one(batches):
            bucket, p2, p1 = _events(row, n_train)
            u, at = np.unique((bucket * 1024 + _rungs(p2) + 1) * 1024 + _rungs(p1) + 1, return_inverse=True)
            sums = [np.bincount(at, weights=w, minlength=len(u)) for w in (np.ones(len(at)), p2, p1)] if len(u) else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(u), *map(pa.array, sums)], ["cell", "n", "p2", "p1"])

    return run


def _one_by_one(batches):
    for batch in small(batches, 1):
        yield from batch.to_pylist()


def _expected(weights, n_train: int, n_types: int):
    """By bucket, the events and the share that each estimate has in them under the weights."""

    def run(batches):
        total = np.zeros((BUCKETS, 4))
        for row in _one_by_one(batches):
            bucket, p2, p1 = _events(row, n_train)
            w = weights[bucket]
            parts = [w[:, 0] * p2, w[:, 1] * p1, w[:, 2] / (n_types + 1)]
            mix = parts[0] + parts[1] + parts[2]
            total += np.stack([np.bincount(bucket, minlength=BUCKETS), *[np.bincount(bucket, weights=x / mix, minlength=BUCKETS) for x in parts]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *[pa.array(total[:, k]) for k in range(4)]], ["bucket", "n", "e2", "e1", "e0"])

    return run


def _moved(weights: np.ndarray, rows) -> np.ndarray:
    """The weights after a round: expected shares over the events; where none were seen they stay."""
    out = weights.copy()
    for bucket, n, *e in rows:
        if n:
            w = np.maximum(np.array(e) / n, FLOOR)
            out[bucket] = w / w.sum()
    return out


def _by_cells(cells, n_types: int) -> np.ndarray:
    weights = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    bucket = cells["cell"].to_numpy() >> 20
    for b in range(BUCKETS):
        own = cells[bucket == b]
        if not len(own):
            weights[b] = weights[b - 1] if b else weights[b]
            continue
        n = own["n"].to_numpy()
        p = np.stack([own["p2"] / n, own["p1"] / n, np.full(len(own), 1 / (n_types + 1))], 1)
        w = np.full(3, 1 / 3)
        for _ in range(FIRST_ROUNDS):
            part = w * p
            before, w = w, (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) / n.sum()
            if np.abs(w - before).max() < FIRST_STILL:
                break
        w = np.maximum(w, FLOOR)
        weights[b] = w / w.sum()
    return weights


def learned_weights(table: DataFrame, n_train: int, n_types: int, rounds: int = ROUNDS, still: float = STILL) -> np.ndarray:
    """(bucket, 3): weights of the bigram, unigram and uniform estimates.

    The likelihood has one maximum a bucket, so where the rounds start from changes their number only. A bucket
    without events has the weights of the one before it.
    """
    if not n_train:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    cells = in_batches(table, _cells(n_train), "cell long, n double, p2 double, p1 double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p1")])
    weights = _by_cells(cells.orderBy("cell").toPandas(), n_types)  # its rows are bounded by buckets and rungs, whatever the corpus
    for _ in range(rounds):
        part = in_batches(table, _expected(weights, n_train, n_types), "bucket long, n double, e2 double, e1 double, e0 double")
        seen = part.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "e2", "e1", "e0")]).collect()  # BUCKETS rows
        before, weights = weights, _moved(weights, seen)
        if np.abs(weights - before).max() < still:
            break
    return weights


def _scorer(weights, n: int, v: int):
    def run(batches):
        for row in _one_by_one(batches):
            ids, known, lens, c1, c2, ch = _opened(row)
            w = weights[_bucket(ch)]
            p = w[:, 0] * _share(c2, ch) + w[:, 1] * (c1 / max(n, 1)) + w[:, 2] / (v + 1)
            begin = np.cumsum(lens) - lens
            total = lambda x: np.add.reduceat(x, begin)  # noqa: B023, E731
            held = [bool(k) and held_out(int(i)) for i, k in zip(ids, known, strict=True)]
            columns = [pa.array(ids, mask=~known), pa.array(held), pa.array(lens), pa.array(total((c1 > 0).astype(np.int64))), pa.array(np.full(len(ids), n, np.int64)), pa.array(total(np.log10((c1 + 0.1) / (n + 0.1 * (v + 1))))), pa.array(total(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score
    (log10 of the text's probability under the interpolated model).

    Null text counts as empty: its one token is the end. A null doc_id is in training. Repeated rows count as
    often as they stand. Without training documents every token has the uniform probability. An empty table
    gives an empty result. Further columns are ignored.
    """
    table, n_train, n_types = counted(docs, text)
    return in_batches(table, _scorer(learned_weights(table, n_train, n_types), n_train, n_types), SCORED)
