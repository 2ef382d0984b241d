"""Byte-level BPE encoding and decoding by a table of distinct words.

Texts are split into words at places where the tokenizer's own splitting always cuts. A block of documents asks
for each of its distinct words once; the words are dealt by hash to ranges, where each distinct word of the corpus is
encoded once, by the library; its ids go back to the blocks that asked, which put them at all positions. Words
travel packed (see ``blocks``): as rows of their own they and their ids took more than twice the shuffle.
Decoding joins ids with the vocabulary's pieces (one row an id, so its size is the vocabulary's) and reads the
joined bytes as UTF-8.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import exchange, packed, planes, range_count, unpacked, unplanes
from .common import in_batches, small

#: Words that the library gets at a time; documents whose ids are put together at a time.
AT_ONCE, STEP = 20000, 256
#: Anything that some definition takes for white space, besides the four plain ones.
_ODD = "\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿"
#: A word ends only where a sure non-space meets a plain space: no token of the tokenizer spans that place,
#: and what it finds on either side doesn't depend on the other.
_WORD = re.compile(rf"[ \t\n\r{_ODD}]*[^ \t\n\r{_ODD}]+(?:[{_ODD}][ \t\n\r{_ODD}]*[^ \t\n\r{_ODD}]*)*|[ \t\n\r{_ODD}]+")
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def split_words(text: str) -> list[str]:
    """The words of a text; joined they are the text."""
    return _WORD.findall(text)


def _numbered(texts: list[str]):
    """Each distinct word's number in order of appearance, the numbers at all positions, words of each text."""
    number: dict[str, int] = {}
    at, counts = [], []
    for t in texts:
        words = split_words(t)
        counts.append(len(words))
        at.append(np.array([number.setdefault(w, len(number)) for w in words], np.uint32))
    return number, np.concatenate(at) if at else np.zeros(0, np.uint32), np.array(counts, np.uint32)


def _dealt(number: dict, ranges: int):
    """Distinct words as bytes, and each one's range."""
    raw = [w.encode() for w in number]
    return raw, np.fromiter((zlib.crc32(w) % ranges for w in raw), np.uint32, len(raw))


def _request(ids, texts, ranges):
    raw, dealt = _dealt(_numbered(texts)[0], ranges)
    order = np.argsort(dealt, kind="stable")
    cut = np.flatnonzero(np.diff(dealt[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        words = [raw[k] for k in part]
        yield int(dealt[part[0]]), packed(planes(np.array([len(w) for w in words], np.uint32)), planes(np.frombuffer(b"".join(words), np.uint8)))


def _payload_of(ranges: int):
    def payload(ids, texts):
        number, at, counts = _numbered(texts)
        _, dealt = _dealt(number, ranges)
        known = np.array([i is not None for i in ids], np.uint8)
        own = np.array([i or 0 for i in ids], np.int64)
        return packed(planes(own), planes(known), planes(counts), planes(at), planes(dealt))

    return payload


@functools.lru_cache(maxsize=1)
def _load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _server(vocabulary):
    def serve(blobs):
        tok = _load(vocabulary.value)
        number: dict[bytes, int] = {}
        asked = []
        for blob in blobs:
            lens, data = (unplanes(p, k) for p, k in zip(unpacked(blob), (np.uint32, np.uint8), strict=True))
            ends, data = np.cumsum(lens), data.tobytes()
            asked.append(np.array([number.setdefault(data[e - n : e], len(number)) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], np.int64))
        words, length, flat = list(number), [], []
        for a in range(0, len(words), AT_ONCE):
            found = [e.ids for e in tok.encode_batch([w.decode() for w in words[a : a + AT_ONCE]], add_special_tokens=False)]
            length.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(length[-1].sum())))
        length, flat = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((length, np.int64), (flat, np.uint32)))
        begin = np.cumsum(length) - length
        yield b""
        for want in asked:
            n = length[want]
            yield packed(planes(n.astype(np.uint32)), planes(flat[_runs(begin[want], n)]))

    return serve


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions begin[i], begin[i] + 1, ... of n[i] entries each."""
    stop = np.cumsum(n)
    return np.repeat(begin - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)


def _placed(blob, replies):
    """(doc_ids, array of ids) of a block, STEP documents at a time."""
    own, known, counts, at, dealt = (unplanes(p, k) for p, k in zip(unpacked(blob), (np.int64, np.uint8, np.uint32, np.uint32, np.uint32), strict=True))
    length, begin = np.zeros(len(dealt), np.int64), np.zeros(len(dealt), np.int64)
    flat, base = [], 0
    order = np.argsort(dealt, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1) if len(order) else []:
        lens, ids = (unplanes(p, np.uint32) for p in unpacked(replies.pop(int(dealt[part[0]]), None) or packed(b"", b"")))
        if len(lens) != len(part):
            raise RuntimeError("two reads of the documents differ; write them to files first")
        length[part] = lens
        begin[part] = base + np.cumsum(lens.astype(np.int64)) - lens
        flat.append(ids)
        base += len(ids)
    flat = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
    ends = np.cumsum(counts.astype(np.int64))
    for a in range(0, len(own), STEP):
        lo, hi = (int(ends[a - 1]) if a else 0), int(ends[min(a + STEP, len(own)) - 1])
        n = length[at[lo:hi]]
        word_end = np.concatenate(([0], np.cumsum(n)))
        offsets = word_end[np.concatenate(([lo], ends[a : a + STEP])) - lo].astype(np.int32)
        yield pa.array(own[a : a + STEP], mask=known[a : a + STEP] == 0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[_runs(begin[at[lo:hi]], n)]))


def vocabulary_text(path: str | None = None) -> str:
    """The tokenizer's file; by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(docs: DataFrame, text: str, path: str | None, shown: Callable, schema: str) -> DataFrame:
    """What ``shown`` makes of the doc_ids and ids of a few documents at a time."""
    ranges = range_count(docs, text)
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))
    merge = lambda blob, replies: (shown(own, ids) for own, ids in _placed(blob, replies))
    return exchange(docs, ranges, _request, _payload_of(ranges), _server(vocabulary), merge, None, schema, text)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    Null text counts as empty and has no ids. Repeated rows, repeated and null doc_ids pass through.
    An empty table gives an empty result; further columns are ignored.
    """
    return _encoded(docs, text, path, lambda own, ids: pa.RecordBatch.from_arrays([own, ids], ["doc_id", "ids"]), "doc_id long, ids array<int>")


def encoded_digest(docs: DataFrame, text: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``digest(encode(docs))`` in one Python stage instead of two; nulls, repeats and empty tables as there."""
    table = docs.sparkSession.sparkContext.broadcast(pieces(path))
    return _encoded(docs, text, path, lambda own, ids: _digest(own, ids, table.value, keep_ids), DIGEST + ", ids array<int>" * keep_ids)


def pieces(path: str | None = None) -> pa.Array:
    """The bytes of each id: the vocabulary's pieces in the order of ids, added ones included."""
    data = json.loads(vocabulary_text(path))
    # The public byte-to-letter rule of byte-level vocabularies: printable bytes stand for themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    by_id = {i: bytes(letter[c] for c in w) for w, i in data["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.binary())


def _texts(ids: pa.Array, table: pa.Array) -> list[str]:
    """Ids joined with their pieces, and the pieces joined to texts."""
    joined = table.take(ids.flatten())
    where = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, joined.offset * 4) if len(joined) else np.zeros(1, np.int32)
    data = joined.buffers()[2].to_pybytes() if len(joined) else b""
    ends = where[np.asarray(ids.offsets) - ids.offsets[0].as_py()]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Null ids give an empty text."""
    table = encoded.sparkSession.sparkContext.broadcast(pieces(path))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_texts(batch.column(1), table.value), pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    return in_batches(rows, run, "doc_id long, text string")


def _digest(own: pa.Array, ids: pa.Array, table: pa.Array, keep_ids: bool) -> pa.RecordBatch:
    flat, where = np.asarray(ids.flatten()).astype("<u4"), np.asarray(ids.offsets) - ids.offsets[0].as_py()
    hashes = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(where[:-1], where[1:], strict=True)]
    texts = [hashlib.sha256(t.encode()).hexdigest() for t in _texts(ids, table)]
    columns = [own, pa.array(np.diff(where).astype(np.int64)), pa.array(hashes), pa.array(texts), ids]
    return pa.RecordBatch.from_arrays(columns[: 4 + keep_ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids])


def digest(encoded: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and the hash of the text that the ids decode to; the ids too on demand.

    Null ids count as none, a null doc_id passes through, repeated rows each give a row, an empty table gives none.
    """
    table = encoded.sparkSession.sparkContext.broadcast(pieces(path))

    def run(batches):
        for batch in small(batches, STEP):
            yield _digest(batch.column(0), batch.column(1), table.value, keep_ids)

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    return in_batches(rows, run, DIGEST + ", ids array<int>" * keep_ids)
