"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Table keys are pairs: key (i, j) joins the i-th part of one small hash collection with the j-th part of
another, so ``2 * m`` parts give ``m * m`` tables. Only documents that share part i with another are
carried to the pairs. Documents that share a key are candidates; the links among them are confirmed on
whole sets, so the tables decide only what is compared. Candidate clusters too large for one task are first cut
where no two documents share one of their rarest shingles, as linked documents must.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, discard, in_batches, mix64, small, staged
from .graph import components, joined_by_key

#: Minhashes in one part of a table key.
PART = 4
#: Chance that a pair exactly at the threshold shares no part of a collection.
MISS = 1e-5
#: Documents, and bytes of their shingle sets, that a task compares at once; larger clusters are cut, or dealt in chunks.
CHUNK, CHUNK_BYTES = 4096, 8 << 20
LEADERS = 16
#: Bits of a filter for each value it holds; the most bits one may have. Beyond that ids are joined instead.
BITS_EACH, MAX_BITS = 16, 1 << 27
#: Buckets in which the shingles of large clusters are counted, so that the rare ones are known.
BUCKETS = 1 << 19


def parts_for(threshold: float, part: int = PART, miss: float = MISS) -> int:
    """Parts of each collection, so that a pair at the threshold shares one with chance 1 - miss."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999) ** part)))


def _shingles(texts: list[str | None], size: int):
    """(text number, shingle) of each distinct shingle, ordered by text; the number of each text's shingles."""
    words = Words([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    gram, at = words.grams(size)
    doc = words.doc[at]
    for n in range(1, size):  # a text of n words: its whole sequence is its one shingle
        if (words.count == n).any():
            h, first = words.grams(n)
            own = words.count[words.doc[first]] == n
            gram, doc = np.concatenate([gram, mix64(h[own] + np.uint64(n))]), np.concatenate([doc, words.doc[first[own]]])
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.bincount(doc, minlength=len(texts))


def _signer(size: int, m: int, part: int):
    hashes = 2 * m * part
    odd = mix64(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    plus = mix64(np.arange(1001, 1001 + hashes, dtype=np.uint64))

    def sign(texts):
        gram, count = _shingles(texts, size)
        n = len(texts)
        keys, parts = np.zeros((2, n), np.uint64), np.zeros((n, 2 * m), np.uint64)
        full = np.flatnonzero(count)
        if len(full):
            begin = (np.cumsum(count) - count)[full]
            for k in range(2):
                keys[k, full] = mix64(np.add.reduceat(mix64(gram ^ plus[k]), begin))
            for i in range(2 * m):
                key = np.full(len(full), i, np.uint64)
                for k in range(i * part, (i + 1) * part):
                    key = mix64(key * odd[0] + np.minimum.reduceat(gram * odd[k] + plus[k], begin))
                parts[full, i] = key
        return count, keys.view(np.int64), parts.view(np.int64)

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                count, keys, parts = sign(texts[a:b])
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, (b - a) * m + 1, m, dtype=np.int32), pa.array(np.ascontiguousarray(x).reshape(-1)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(count.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists(parts[:, :m]), lists(parts[:, m:])],
                    ["doc_id", "n_shingles", "k1", "k2", "u", "v"],
                )

    return run


def signatures(docs: DataFrame, size: int, m: int, part: int = PART, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, the 128-bit key (k1, k2) of the shingle set, and the parts u and v of table keys."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_batches(df, _signer(size, m, part), "doc_id long, n_shingles long, k1 long, k2 long, u array<long>, v array<long>")


def filter_bits(values: int) -> int:
    """Bits of a filter for so many values: a power of two, MAX_BITS at most."""
    return min(MAX_BITS, max(1 << 16, 1 << (BITS_EACH * values - 1).bit_length()))


def bloom(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set over a column's values; two bits for each."""
    at = df.select(F.explode(F.array(*_probes(column, bits))).alias("p"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("x")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy().astype(np.int64)] = rows["x"].to_numpy()
    return out.view(np.uint8)


def has_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bit numbers are set."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _probes(column: str, bits: int):
    return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(bits)) for k in (1, 2)]


def _full_sets(size: int, wanted):
    def run(batches):
        bits = wanted.value if wanted else None
        for batch in small(batches):
            if bits is not None:
                batch = batch.take(pa.array(np.flatnonzero(has_bits(bits, batch.column(2).to_numpy()) & has_bits(bits, batch.column(3).to_numpy()))))
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                gram, count = _shingles(texts[a:b], size)
                ends = np.concatenate(([0], np.cumsum(count * 8))).astype(np.int32)
                sets = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(gram)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], sets], ["node", "grams"])

    return run


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    """Binary values as arrays of shingles; they stay in the column's buffer."""
    raw, where = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else []
    return [np.frombuffer(raw, np.uint64, (b - a) // 8, a) if b > a else np.zeros(0, np.uint64) for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)] if len(column) else []


def _linked(sets: list[np.ndarray], first: int | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever the confirmed links among ``sets`` connect.

    ``first``: compare only the first so many sets, each with all. None: every pair is compared unless
    both of its sets end up in the largest component, so no link between components can be missed.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    flat, owner = flat[order], owner[order]
    del order
    root, members, links = np.arange(n), {i: [i] for i in range(n)}, []

    def compare(q):
        lo, hi = np.searchsorted(flat, sets[q], "left"), np.searchsorted(flat, sets[q], "right")
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(owner[at], minlength=n)
        for j in np.flatnonzero(100 * both >= percent * (size + size[q] - both)):
            a, b = root[q], root[j]
            if a != b:
                links.append((q, int(j)))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                root[members[b]] = a
                members[a] += members.pop(b)

    if first is not None:
        for q in range(first):
            compare(q)
        return links
    done = np.zeros(n, bool)
    while True:
        largest = max(members, key=lambda r: len(members[r]))
        left = np.flatnonzero(~done & (root != largest))
        if not len(left) and (done.any() or n < 2):
            return links
        q = int(left[0]) if len(left) else 0
        done[q] = True
        compare(q)


def _confirm(percent: int, only_queries: bool):
    """Rows (g1, g2, g3, query, node, grams), sorted by group: the confirming links of each group."""

    def close(rows):
        rows.sort(key=lambda r: not r[0])
        first = sum(r[0] for r in rows) if only_queries else None
        return [(rows[i][1], rows[j][1]) for i, j in _linked([r[2] for r in rows], first, percent)] if len(rows) > 1 else []

    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            group = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            query, node, sets = batch.column(3).to_pylist(), batch.column(4).to_pylist(), _sets_of(batch.column(5))
            for i, g in enumerate(map(tuple, group.tolist())):
                if g != key:
                    if links := close(rows):
                        yield batch_of(links)
                    key, rows = g, []
                rows.append((query[i], node[i], sets[i]))
        if links := close(rows):
            yield batch_of(links)

    return run


def _links(rows: DataFrame, percent: int, only_queries: bool) -> DataFrame:
    parts = rows.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return in_batches(parts.select("g1", "g2", "g3", "query", "node", "grams"), _confirm(percent, only_queries), "a long, b long")


def _candidates(reps: DataFrame, m: int) -> DataFrame:
    """Edges (a, b) from the smallest document of each table key to the others that share the key."""
    parts = reps.select("node", F.posexplode("u").alias("i", "u"))
    shared = parts.groupBy("i", "u").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    some = staged(joined_by_key(parts, shared, ["i", "u"], reps.count() * m), "near-parts")
    pairs = some.join(reps.select("node", "v"), "node").select("node", "i", "u", F.posexplode("v").alias("j", "v"))
    keys = pairs.select("node", F.xxhash64("i", "j", "u", "v").alias("key"))
    return _stars(keys, ["key"], some.count() * m)


def _stars(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Edges (a, b) from the smallest node of each key to its others."""
    least = rows.groupBy(*keys).agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return joined_by_key(rows, least, keys, total).where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _chunks(n_bytes, docs):
    """How many chunks so much makes, as a fraction."""
    return F.greatest(n_bytes / CHUNK_BYTES, docs / CHUNK)


def _weighed(cluster: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, component) -> (node, g1, load): with the chunks that all sets of the component make."""
    own = cluster.join(sizes, "node")
    total = own.groupBy("component").agg(_chunks(8 * F.sum("n_shingles"), F.count(F.lit(1))).alias("load"), F.count(F.lit(1)).alias("c"))
    return joined_by_key(cluster, total, ["component"], cluster.count()).select("node", F.col("component").alias("g1"), "load")


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Links join documents whose shingle sets satisfy 100 * intersection >= percent * union. Equal sets are one
    node, so copies are never expanded to pairs. Null or empty text has no shingles, links with nothing and is
    kept. Rows that share a doc_id count as one document; a row without doc_id is linked with nothing, has a
    null component and is kept. Ties cannot arise: the smallest doc_id stands for its component. An empty
    table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    m = parts_for(percent / 100, part)
    sig = staged(signatures(docs, size, m, part, text), "near-signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "u", "v")])
    reps = staged(classes, "near-classes")
    edges = staged(_candidates(reps, m), "near-candidates")
    cluster = staged(components(edges, "near-clusters"), "near-clusters")
    discard(edges)
    # Whole sets, only of documents in a cluster: a filter sized by their number goes to the scan, the join is exact.
    n = cluster.count()
    probe = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    if BITS_EACH * n <= MAX_BITS:
        bits = filter_bits(n)
        wanted = spark.sparkContext.broadcast(bloom(cluster, "node", bits))
        probe = probe.select("doc_id", "text", *_probes("doc_id", bits))
    else:
        wanted, probe = None, probe.join(cluster.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = in_batches(probe, _full_sets(size, wanted), "node long, grams binary").where("length(grams) > 0")
    sizes = reps.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    members = staged(_weighed(cluster, sizes).join(sets, "node").select("g1", "node", "load", "grams"), "near-members")
    large = members.where("load > 1")
    groups = members.where("load <= 1")
    found, done = None, [cluster, members]
    if not large.isEmpty():
        finer = staged(components(_sharing_rare_shingles(large, percent), "near-finer"), "near-finer")
        cut = staged(large.drop("g1", "load").join(_weighed(finer, sizes), "node").select("g1", "node", "load", "grams"), "near-cut")
        done += [finer, cut]
        groups = groups.unionByName(cut.where("load <= 1"))
        if not (still := cut.where("load > 1")).isEmpty():
            found = _large_clusters(still, percent)
    zero = F.lit(0).cast("long")
    links = _links(groups.withColumns({"g2": zero, "g3": zero, "query": F.lit(False)}), percent, only_queries=False)
    joined = components(links if found is None else links.unionByName(found), "near-components")
    for table in done:  # the components are written, so nothing reads these again
        discard(table)
    comp = reps.join(joined, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    out = sig.drop("u", "v").join(comp, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _bucket_counts(batches):
    count = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for grams in _sets_of(batch.column(0)):
            np.add.at(count, (grams & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bucket", "n"])


def _prefixes(often, percent: int):
    """(g1, s, node): of each set the rarest shingles, one more than two linked sets can differ by."""

    def run(batches):
        for batch in batches:
            groups, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for grams in _sets_of(batch.column(2)):
                keep = len(grams) - -(-percent * len(grams) // 100) + 1
                rare = np.lexsort((grams, often.value[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:keep]
                found.append(grams[rare])
            times = [len(x) for x in found]
            s = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups, times)), pa.array(s.view(np.int64)), pa.array(np.repeat(nodes, times))], ["g1", "s", "node"])

    return run


def _sharing_rare_shingles(large: DataFrame, percent: int) -> DataFrame:
    """Edges between documents of a cluster that share one of their rarest shingles.

    Sets with 100 * intersection >= percent * union share at least percent of either one, so whatever order the
    shingles are put in, one shared shingle is among the first of both. Here the rare ones come first; how often
    a shingle stands is counted in BUCKETS buckets, which changes the order only. No link is lost.
    """
    counted = in_batches(large.select("grams"), _bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    often = np.zeros(BUCKETS, np.int64)
    often[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    shared = large.sparkSession.sparkContext.broadcast(often)
    rare = staged(in_batches(large.select("g1", "node", "grams"), _prefixes(shared, percent), "g1 long, s long, node long"), "near-rare")
    return _stars(rare, ["g1", "s"], rare.count())


def _large_clusters(members: DataFrame, percent: int) -> DataFrame:
    """Links within clusters that are too large for one task.

    First a few leaders are compared with every member, chunk by chunk. Then every member outside its
    cluster's largest component is compared with every member: no link between components is missed.
    """
    parts = F.ceil("load").cast("long")
    zero = F.lit(0).cast("long")
    dealt = members.withColumns({"g2": F.pmod(F.xxhash64("node", F.lit(5)), parts), "g3": zero, "query": F.lit(False)})
    every = F.explode(F.sequence(zero, parts - 1))
    columns = ["g1", "g2", "g3", "query", "node", "grams"]
    # The leaders: bounded by LEADERS a cluster, through partial aggregates of so many each.
    lead = members.groupBy("g1", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(LEADERS)).alias("slot")).agg(F.min_by("node", F.xxhash64("node", F.lit(11))).alias("node"))
    query = members.join(lead.select("g1", "node"), ["g1", "node"], "left_semi").withColumns({"query": F.lit(True), "g3": zero}).withColumn("g2", every)
    first = staged(_links(dealt.select(columns).unionByName(query.select(columns)), percent, only_queries=True), "near-leaders")
    joined = staged(components(first, "near-leaders"), "near-leaders")
    at = members.select("g1", "node", F.length("grams").cast("long").alias("own")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    weight = at.groupBy("g1", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = weight.groupBy("g1").agg(F.max(F.struct("c", "component")).alias("x")).select(F.col("x.component").alias("component"))
    # A component lies in one cluster, so its own id tells both; the clusters are few, each over CHUNK_BYTES.
    rest = staged(at.join(largest, "component", "left_anti").select("g1", "node", "own"), "near-rest")
    blocks = rest.groupBy("g1").agg(F.ceil(_chunks(F.sum("own"), F.count(F.lit(1)))).cast("long").alias("blocks"), F.count(F.lit(1)).alias("c"))
    asked = members.join(joined_by_key(rest.drop("own"), blocks, ["g1"], rest.count()), ["g1", "node"])
    asked = asked.withColumns({"query": F.lit(True), "g3": F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))}).withColumn("g2", every)
    counts = members.groupBy("g1").agg(F.count(F.lit(1)).alias("c"))
    against = joined_by_key(dealt.drop("g3"), counts.join(blocks.drop("c"), "g1"), ["g1"], members.count()).withColumn("g3", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    second = _links(against.select(columns).unionByName(asked.select(columns)), percent, only_queries=True)
    return first.unionByName(second)


def near_dedup(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id.

    Rows without doc_id, text or words stay; rows that share the kept id all stay. All columns pass through.
    """
    gone = near_duplicates(docs, text, size, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
