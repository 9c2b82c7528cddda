"""MinHash near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketching (Dahlgaard, Knudsen and Thorup, 2017): in round r < t every shingle of a set is hashed to one of t
bins with value r + fraction and each bin keeps its least value; rounds t..2t-1 send all shingles to bin r - t,
so every coordinate fills. Two sets agree in a coordinate with probability equal to their Jaccard similarity,
with concentration like that of independent samples. t = 512 coordinates in 64 bands of 8 miss a pair at 0.85
with a probability below 2e-9. Every link is confirmed on the full shingle sets.

Equal sets are one class from the start. Classes that share a band meet in candidate clusters. A cluster up to
`group_limit` classes and `shingles` shingles is verified in one task, with union-find so that no more comparisons are made than the
components need. A larger one is never gathered: its members are compared with its least member in salted
blocks, and the triangle inequality of the Jaccard distance leaves for block-wise comparison only members that
are not linked to it and those that could link to one of these. Links are exact in all paths; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import stash, string_slices, text_or_empty, utf8_parts
from lodestone.llm.graph import components
from lodestone.llm.shingles import U, mix, odd_constants, shingle_sets

MAX = U(0xFFFFFFFFFFFFFFFF)


def fast_sketch(sets: list[np.ndarray], t: int = 512) -> np.ndarray:
    """The (len(sets), t) sketch; rows of empty sets stay at the greatest value."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sketch = np.full(len(sets) * t, MAX, U)
    if sizes.sum() == 0:
        return sketch.reshape(len(sets), t)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    bits = U(t.bit_length() - 1)
    assert 1 << int(bits) == t, "t must be a power of two"
    for r in range(2 * t):
        h = mix(items ^ mix(np.array([r + 1], U) * U(0x9E3779B97F4A7C15)))
        bins = (h & U(t - 1)).astype(np.int64) if r < t else r - t
        np.minimum.at(sketch, owner * t + bins, (h >> U(12)) | (U(r) << U(52)))
        open_ = (sketch.reshape(len(sets), t) == MAX).any(1)
        open_ &= sizes > 0
        if not open_.any():
            break
        keep = open_[owner]
        if not keep.all():
            items, owner = items[keep], owner[keep]
    return sketch.reshape(len(sets), t)


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    n, t = sketch.shape
    rows = t // bands
    parts = sketch.reshape(n, bands, rows) * odd_constants(rows, 11)
    return mix(parts.sum(2, dtype=U) + odd_constants(bands, 13))


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sketch_batches(words: int, t: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for i, j in string_slices(text):
                sets = shingle_sets(*utf8_parts(text.slice(i, j - i)), words)
                keys = band_hashes(fast_sketch(sets, t), bands).astype(np.int64)
                d = [_digest(s) if len(s) else (None, None) for s in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), flat],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for i, j in string_slices(text):
                sets = shingle_sets(*utf8_parts(text.slice(i, j - i)), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "cluster", "shingles"],
                )

    return run


class Linker:
    """Exact links among shingle sets, comparing a set only with those outside its component so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = ids, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.vocab, self.code = np.unique(flat, return_inverse=True)
        self.ends = np.concatenate(([0], np.cumsum(self.sizes)))
        self.root = np.arange(len(sets))

    def common(self, i: int, among: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with the sets among (a mask)."""
        mark = np.zeros(len(self.vocab), bool)
        mark[self.code[self.ends[i] : self.ends[i + 1]]] = True
        take = among[self.owner]
        return np.bincount(self.owner[take][mark[self.code[take]]], minlength=len(self.ids))

    def linked(self, i: int, among: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(self.sizes, self.sizes[i]), np.maximum(self.sizes, self.sizes[i])
        among = among & (100 * lo >= self.percent * hi)
        if not among.any():
            return among
        inter = self.common(i, among)
        return among & (100 * inter >= self.percent * (self.sizes + self.sizes[i] - inter))

    def run(self, queries: np.ndarray | None = None, targets: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links between queries and targets that together connect all that is linked."""
        n = len(self.ids)
        targets = np.ones(n, bool) if targets is None else targets
        for i in range(n) if queries is None else np.flatnonzero(queries):
            rest = targets & (self.root != self.root[i])
            for j in np.flatnonzero(self.linked(i, rest)):
                if self.root[j] != self.root[i]:
                    yield self.ids[i], self.ids[j]
                    self.root[self.root == self.root[j]] = self.root[i]


def _sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in column.to_pylist()]


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _verify_group(percent: int):
    def run(table: pa.Table) -> pa.Table:
        return _pairs(list(Linker(table["doc_id"].to_pylist(), _sets(table["shingles"]), percent).run()))

    return run


def _against_leader(percent: int):
    """Members of a block with their similarity to the cluster's least member, which stands in every block."""

    def run(table: pa.Table) -> pa.Table:
        ids, sets = table["doc_id"].to_pylist(), _sets(table["shingles"])
        lead = int(np.argmin(ids))
        x = Linker(ids, sets, percent)
        inter = x.common(lead, np.ones(len(ids), bool))
        union = x.sizes + x.sizes[lead] - inter
        keep = ~np.array(table["is_lead"].to_pylist())
        return pa.table({
            "doc_id": pa.array(np.array(ids)[keep]), "cluster": table["cluster"].filter(pa.array(keep)), "lead": pa.array(np.full(int(keep.sum()), ids[lead])),
            "linked": pa.array((100 * inter >= percent * union)[keep]), "distance": pa.array((1 - inter / np.maximum(union, 1))[keep]), "shingles": table["shingles"].filter(pa.array(keep)).cast(pa.binary()),
        })

    return run


def _verify_blocks(percent: int):
    def run(table: pa.Table) -> pa.Table:
        query = np.array(table["query"].to_pylist(), bool)
        return _pairs(list(Linker(table["doc_id"].to_pylist(), _sets(table["shingles"]), percent).run(query, ~query)))

    return run


def _blocks(block: int, shingles: int):
    """How many blocks of about `block` rows and `shingles` shingles at most the grouped sets make."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("shingles")) / (8 * shingles))).cast("int")


def _large_links(sets: DataFrame, percent: int, block: int, shingles: int) -> DataFrame:
    """Links within clusters too large for one task; see the module's text."""
    sizes = sets.groupBy("cluster").agg(F.min("doc_id").alias("lead"), _blocks(block, shingles).alias("blocks"))
    dealt = sets.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    lead = dealt.where("doc_id = lead").select("doc_id", "cluster", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_lead"))
    members = dealt.where("doc_id <> lead").select("doc_id", "cluster", "shingles", "block", F.lit(False).alias("is_lead"))
    held = stash(members.union(lead).groupBy("cluster", "block").applyInArrow(_against_leader(percent), "doc_id long, cluster long, lead long, linked boolean, distance double, shingles binary"))
    links = held.where("linked").select(F.col("lead").alias("u"), F.col("doc_id").alias("v"))
    reach = 1 - percent / 100 + 1e-9
    out = held.where("not linked").groupBy("cluster").agg(F.min("distance").alias("least"), _blocks(block, shingles).alias("qb"))
    near = held.join(out, "cluster").where(F.expr(f"not linked or distance >= least - {reach}"))
    near = near.join(near.groupBy("cluster").agg(_blocks(block, shingles).alias("tb")), "cluster")
    at = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col(n)).cast("int")
    as_query = near.where("not linked").select("cluster", at("qb").alias("a"), F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("b"), F.lit(True).alias("query"), "doc_id", "shingles")
    as_target = near.select("cluster", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("a"), at("tb").alias("b"), F.lit(False).alias("query"), "doc_id", "shingles")
    more = as_query.union(as_target).groupBy("cluster", "a", "b").applyInArrow(_verify_blocks(percent), "u long, v long")
    return links.union(more)


def near_components(docs: DataFrame, percent: int = 85, words: int = 5, t: int = 512, bands: int = 64, group_limit: int = 1000, block: int = 500, shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Rows with 100 * |intersection| >= percent * |union| of their word shingle sets are linked; component_id is
    the least doc_id reachable. Null texts count as empty; a text without words has n_shingles 0 and is linked
    with nothing. A null doc_id has a null component and is not kept; rows with the same doc_id are one node, so
    a row repeated whole appears as often as it came, with one component. Extra columns are ignored; no rows
    give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = stash(docs.mapInArrow(_sketch_batches(words, t, bands), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    edges = keys.join(shared, "key").where("doc_id <> lead").select(F.col("lead").alias("u"), F.col("doc_id").alias("v"))
    clusters = stash(components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    weights = base.select("doc_id", "n_shingles").join(clusters, "doc_id")
    sizes = weights.groupBy("cluster").agg(((F.count("*") > group_limit) | (F.sum("n_shingles") > shingles)).alias("large"))
    rows = docs.join(clusters, "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "cluster", "text")
    sets = rows.mapInArrow(_set_batches(words), "doc_id long, cluster long, shingles binary")
    if sizes.where("large").isEmpty():
        links = sets.groupBy("cluster").applyInArrow(_verify_group(percent), "u long, v long")
    else:
        sets = stash(sets.join(sizes, "cluster"))
        small = sets.where("not large").drop("large").groupBy("cluster").applyInArrow(_verify_group(percent), "u long, v long")
        links = small.union(_large_links(sets.where("large").drop("large"), percent, block, shingles))
    found = components(links.union(full.join(classes, ["d1", "d2"]).where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))))
    out = base.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
