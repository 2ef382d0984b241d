"""Personal data: fixed kinds by pattern, and terms that give a protected entity away by what the corpus knows.

An entity is a value found by pattern. A term that stands on its line tells log2(P(entity | term) / P(entity))
bits about it; where that is most of the bits that single the entity out, the term is disclosed with it: it is
generalised or, still closer, removed wherever it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, in_batches, small, staged
from .near_dedup import filter_bits, has_bits

KINDS = ("email", "ip", "card", "phone")
#: Contexts in which a term must meet an entity; all of them where the entity has fewer.
MIN_CONTEXTS = 3
#: Added to a term's documents: one meeting proves less than many.
SMOOTH = 0.5
#: Shares of the bits that identify the entity: from GENERALISE a term is generalised, from REMOVE removed.
GENERALISE, REMOVE = 0.90, 0.97
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Every ASCII byte that is no letter or digit becomes a space; offsets stay.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BASE = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        # A start further right in the same run would meet the same "@", so it fails as well.
        done = max(done, at + 1) if not m else done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = [(m.start(), m.end()) for m in _PART.finditer(text, run.start(), run.end())]
        for k in range(0, len(parts) - 3, 4):  # the pattern takes four parts at a time, whatever they hold
            four = parts[k : k + 4]
            if all(len(d := text[a:b].lstrip("0")) <= 3 and int(d or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then by start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(k, a, b) for k, f in (("ip", _ips), ("card", _cards), ("phone", _phones)) for a, b in f(text)]
    return found


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _terms(raw: bytes) -> list[bytes]:
    return [w for w in raw.translate(_PLAIN).lower().split() if len(w) >= 3 and not w.isdigit()]


def _line_terms(text: str, begin: int, end: int, spans) -> tuple[set[str], int]:
    """The terms of a line outside the entities, and a hash that tells one context from another."""
    parts, at = [], begin
    for a, b in sorted(spans):
        parts.append(text[at : max(a, at)])
        at = max(at, b)
    terms = _terms(" ".join([*parts, text[at:end]]).encode("utf-8", "surrogatepass"))
    return {t.decode("utf-8", "replace") for t in terms}, int.from_bytes(hashlib.blake2b(b" ".join(terms), digest_size=8).digest(), "little", signed=True)


def _meetings(text: str):
    """(entity, term, context, first) for each entity, term and context of a document; ``first`` is 1 in one row a pair.

    The entity itself comes with an empty term, a term on any entity's line with an empty entity.
    """
    lines: dict[tuple[int, int], list] = {}
    for kind, a, b in base_spans(text):
        end = text.find("\n", b)
        lines.setdefault((text.rfind("\n", 0, a) + 1, len(text) if end < 0 else end), []).append((f"{kind}:{text[a:b].lower()}", a, b))
    of: dict[str, dict[int, set[str]]] = {}
    every: set[str] = set()
    for (begin, end), found in lines.items():
        terms, context = _line_terms(text, begin, end, [x[1:] for x in found])
        every |= terms
        for entity, _, _ in found:
            of.setdefault(entity, {})[context] = terms
    yield from (("", t, 0, 1) for t in every)
    for entity, contexts in of.items():
        seen: set[str] = set()
        for context, terms in contexts.items():
            for t in {*terms, ""}:
                yield entity, t, context, int(t not in seen)
            seen |= terms | {""}


def _contexts(batches):
    names, kinds = ["entity", "term", "context", "first"], (pa.string(), pa.string(), pa.int64(), pa.int64())
    for batch in small(batches):
        rows = (r for text in batch.column(0).to_pylist() for r in _meetings(text or ""))
        while out := list(islice(rows, 65536)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def _at_bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.uint64(bits)
    return (h % n).astype(np.int64), ((h >> np.uint64(32)) % n).astype(np.int64)


def _hits(raw: list[bytes], bits: np.ndarray):
    """Occurrences of words that a bit set may hold: (text number, word, first byte)."""
    words = Words([r.translate(_PLAIN).lower() for r in raw])
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    one, two = _at_bits(words.h, 8 * len(bits))
    for k in np.flatnonzero(has_bits(bits, one) & has_bits(bits, two)):
        a, size, doc = int(words.starts[k]), int(words.lens[k]), int(words.doc[k])
        yield doc, words.data[a : a + size].tobytes(), a - int(begin[doc])


def _term_bits(terms: DataFrame) -> np.ndarray:
    """A bit set over the terms, by the hash that ``_hits`` uses. Its size follows their number up to a bound;
    beyond that it lets more words through, and the join that follows does more of the work."""
    bits = filter_bits(terms.count())

    def probes(batches):
        for batch in batches:
            h = Words([t.encode() for t in batch.column(0).to_pylist()]).h
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_at_bits(h, bits)))], ["p"])

    at = in_batches(terms.select("term"), probes, "p long")
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("x")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy().astype(np.int64)] = rows["x"].to_numpy()
    return out.view(np.uint8)


def _document_counts(bits):
    """(term, documents of this batch that hold it) for the terms asked for."""

    def run(batches):
        for batch in small(batches, 4096):
            texts = batch.column(0).to_pylist()
            count: dict[bytes, int] = {}
            for a, b in chunks(texts):
                raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
                for _, w in {(d, w) for d, w, _ in _hits(raw, bits.value)}:
                    count[w] = count.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    return run


def disclosing_terms(docs: DataFrame, text: str = "text", min_contexts: int = MIN_CONTEXTS, share: float = GENERALISE) -> DataFrame:
    """(term, share, entity): terms that tell at least ``share`` of the bits that identify an entity.

    Counts cover all documents. A term needs ``min_contexts`` different contexts, or all where the entity has
    fewer, and meets an entity no more often than in different contexts, so that copies of one text disclose
    nothing by being many.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"))
    near = staged(in_batches(rows, _contexts, "entity string, term string, context long, first long"), "pii-contexts")
    total = docs.count()
    pairs = near.where("entity != ''").groupBy("entity", "term").agg(F.sum("first").alias("docs"), F.count_distinct("context").alias("contexts"))
    pairs = staged(pairs.withColumn("both", F.least("docs", "contexts")), "pii-pairs")
    known = pairs.where("term = ''").select("entity", F.col("docs").alias("n_entity"), F.col("contexts").alias("n_contexts"))
    # More documents than stand here hold a term, so what falls short already can't reach the share.
    beside = near.where("entity = ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    bits_of = lambda p: -F.log2(p)
    alone = F.col("n_entity") / F.lit(float(max(total, 1)))
    told = F.when(alone < 1, 1 - bits_of(F.least(F.lit(1.0), F.col("both") / (F.col("n_term") + SMOOTH))) / bits_of(alone))
    some = pairs.where("term != ''").join(known, "entity").where(F.col("contexts") >= F.least(F.lit(min_contexts), F.col("n_contexts")))
    asked = staged(some.join(beside, "term").where(told >= share).drop("n_term"), "pii-candidates")
    bits = spark.sparkContext.broadcast(_term_bits(asked.select("term").distinct()))
    held = in_batches(rows, _document_counts(bits), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    found = asked.join(held, "term").withColumn("share", told)
    return found.where(F.col("share") >= share).groupBy("term").agg(F.max("share").alias("share"), F.max_by("entity", F.struct("share", "entity")).alias("entity"))


def _found(bits):
    def run(batches):
        for batch in small(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            maybe: list[list] = [[] for _ in texts]
            if bits.value.any():
                for a, b in chunks(texts):
                    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
                    starts: dict[int, np.ndarray] = {}
                    for d, w, at in _hits(raw, bits.value):
                        if d not in starts:  # how many code points begin before each byte
                            starts[d] = np.concatenate(([0], np.cumsum(np.frombuffer(raw[d], np.uint8) & 0xC0 != 0x80)))
                        maybe[a + d].append({"term": w.decode("utf-8", "replace"), "start": int(starts[d][at]), "end": int(starts[d][at + len(w)])})
            spans = [base_spans(t or "") for t in texts]
            counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            joined = [_joined(x) for x in spans]
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
            hits = pa.array(maybe, pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(joined, pa.string()), pa.array(digests, pa.string()), hits], ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "base_sha256", "hits"])

    return run


def find_personal_data(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256, spans (all, ``kind:start:end``), n_term, and the sums n_base
    (spans by pattern) and n_spans (all).

    Spans come by kind: the patterns' kinds as in KINDS, ``term`` (to generalise) and ``gone`` (to remove).
    Null text counts as empty. Repeated rows each give a row; an empty table gives none. A term inside a span
    found by pattern is not listed again. Further columns are ignored.
    """
    spark = docs.sparkSession
    terms = staged(disclosing_terms(docs, text, **how), "pii-terms")
    bits = spark.sparkContext.broadcast(_term_bits(terms))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = in_batches(rows, _found(bits), f"doc_id long, {BASE}, hits array<struct<term: string, start: long, end: long>>")
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    columns = ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "base_sha256"]
    plain = found.where(F.size("hits") == 0).select(*columns, F.lit("").alias("more"), F.lit(0).cast("long").alias("n_term"))
    # The filter may let other words through; the join is exact. Only documents with a hit are shuffled.
    some = found.where(F.size("hits") > 0)
    each = some.select("row", "base_spans", F.explode("hits").alias("h")).join(terms, F.col("h.term") == F.col("term"))
    inside = F.exists(F.split("base_spans", ","), lambda s: (F.element_at(F.split(s, ":"), -2).cast("long") < F.col("h.end")) & (F.element_at(F.split(s, ":"), -1).cast("long") > F.col("h.start")))
    each = each.where((F.col("base_spans") == "") | ~inside)
    kind = F.when(F.col("share") >= REMOVE, 1).otherwise(0)
    agg = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(kind.alias("gone"), F.col("h.start").alias("start"), F.col("h.end").alias("end")))).alias("t"))
    more = F.array_join(F.transform("t", lambda x: F.concat_ws(":", F.when(x["gone"] == 1, "gone").otherwise("term"), x["start"].cast("string"), x["end"].cast("string"))), ",")
    rest = some.join(agg, "row", "left").select(*columns, F.coalesce(more, F.lit("")).alias("more"), F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n_term"))
    out = plain.unionByName(rest)
    spans = F.concat_ws(",", F.nullif("base_spans", F.lit("")), F.nullif("more", F.lit("")))
    base = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), "n_term", base.alias("n_base"), (base + F.col("n_term")).alias("n_spans"))


def redact(text: str, spans: str) -> str:
    """The text without its spans: ``<KIND>`` in their place, nothing where the kind is ``gone``."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at : max(a, at)], "" if kind == "gone" else f"<{kind.upper()}>"]
            at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with every span replaced (see ``redact``); null text stays null, all other columns pass through.

    Rows are matched by doc_id and text together, so repeated and null ids do no harm.
    """
    key = F.xxhash64("doc_id", text)
    spans = find_personal_data(docs.select(key.alias("doc_id"), F.col(text).alias("text")), **how)
    spans = spans.groupBy(F.col("doc_id").alias("__key")).agg(F.first("spans").alias("__spans"))

    @F.pandas_udf("string")
    def masked(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else redact(x, y or "") for x, y in zip(t, s, strict=True)], dtype=object)

    rows = docs.select(F.struct("*").alias("__row"), key.alias("__own"), F.col(text).cast("string").alias("__text"))
    out = rows.join(spans, F.col("__own") == F.col("__key"), "left")
    return out.select(*[masked(F.col("__text"), F.col("__spans")).alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in docs.columns])
