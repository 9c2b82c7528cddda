"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are pairs of item words with no word or one between them, met in a text with no word or one between. Whatever
the edits, an alignment that scores s has such pairs: of its m matched words, which earn 2 each, the steps from
one to the next cost what lies between, so steps worth s - 2 (2 for neighbours on both sides, 1 with a word
between on either) must be such pairs. Each place of an item begins one step. An alignment from a score of T on
therefore keeps a seed when the (T - 3) / 2 most frequent places of the item are passed over: the seeds are the pairs
of all other, rarer places, and no alignment that reaches T is lost. Items whose T is below 3 use single words.

A first pass over the corpus counts the items' pairs, a second emits where seeds stand, and a join on the pair brings
the items' places to them. Documents with seeds are written apart and join what they met, and the words around
each meeting are aligned, as far as gaps can reach. Seeds, places and meetings are tables; the driver holds only a
Bloom filter of 2**BITS bits that passes the hashes of the items' pairs (and few others, which the join drops).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stash, string_slices, text_or_empty, utf8_parts
from lodestone.llm.shingles import U, mix, words

MATCH, MISMATCH, GAP = 2, -1, -1
PAD_ITEM, PAD_TEXT = U(1), U(2)
BITS = 22


def _steps(h: np.ndarray, d: int) -> np.ndarray:
    """Hashes of the pairs of words d apart from each word on; of single words for d = 0."""
    return mix(h + U(0x2545F4914F6CDD1D)) if d == 0 else mix(mix(h[:-d]) + h[d:]) if len(h) > d else np.zeros(0, U)


def _within(bounds: np.ndarray, at: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, valid): whose text the word `at` is of, and whether the word d further on is of the same."""
    owner = np.searchsorted(bounds, at, side="right") - 1
    return owner, bounds[owner + 1] > at + d


def target(n_words: int, least: float, passage: int) -> float:
    """The score from which a pair is reported."""
    return MATCH * min(n_words * least, passage)


def _seed_batches(least: float, passage: int):
    """(gram, item_id, item_hash, o, n_words) of each item's pairs, or single words where its target is below 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, _, bounds = words(*utf8_parts(batch.column(2)))
            n = np.diff(bounds)
            single = np.array([target(int(x), least, passage) < 3 for x in n], bool)
            for d in (0, 1, 2):
                x = _steps(h, d)
                owner, valid = _within(bounds, np.arange(len(x)), d)
                at = np.flatnonzero(valid & (single[owner] == (d == 0)) if len(x) else valid)
                k = owner[at]
                cols = [pa.array(x[at].view(np.int64)), batch.column(0).take(pa.array(k)), batch.column(1).take(pa.array(k)), pa.array(at - bounds[k]), pa.array(n[k])]
                yield pa.RecordBatch.from_arrays(cols, names=["gram", "item_id", "item_hash", "o", "n_words"])

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << BITS, bool)
    for batch in batches:
        table[batch.column(0).to_numpy()] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], names=["bits"])


def _bit_table(seeds: DataFrame):
    """A Bloom filter of the grams: one bit for the value of the first BITS bits of each, one for that of the BITS after them."""
    two = F.array(F.shiftrightunsigned("gram", 64 - BITS), F.shiftrightunsigned(F.shiftleft("gram", BITS), 64 - BITS))
    places = seeds.select(F.explode(two).alias("place")).distinct().repartition(1)  # 2**BITS rows at most
    return seeds.sparkSession.sparkContext.broadcast(bytes(places.mapInArrow(_bitmap, "bits binary").first().bits))


def _passed(text: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, owners, word positions in their texts, grams) of what the bit table passes."""
    for i, j in string_slices(text):
        h, _, _, bounds = words(*utf8_parts(text.slice(i, j - i)))
        for d in (0, 1, 2):
            x = _steps(h, d)
            at = np.flatnonzero(table[(x >> U(64 - BITS)).astype(np.int64)])
            at = at[table[((x[at] << U(BITS)) >> U(64 - BITS)).astype(np.int64)]]
            owner, valid = _within(bounds, at, d)
            at, owner = at[valid], owner[valid]
            yield i, owner, at - bounds[owner], x[at]


def _unpacked(bits) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)


def _count_batches(bits, most: int = 500_000):
    """(gram, n) of what the bit table passes, summed within a task as far as `most` grams go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpacked(bits)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for *_, grams in _passed(batch.column(2), table):
                held.append(grams)
                if sum(map(len, held)) > most:
                    yield out()
        yield out()

    return run


def _hit_batches(bits):
    """Documents that the bit table passes a pair of, with these pairs and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpacked(bits)
        for batch in batches:
            found = [(i + owner, p, grams) for i, owner, p, grams in _passed(batch.column(2), table)]
            if not found:
                continue
            owner, p, grams = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(owner, kind="stable")
            rows, first = np.unique(owner[order], return_index=True)
            held = batch.take(pa.array(rows))
            bounds = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order].view(np.int64))) for x in (grams, p)]
            yield pa.RecordBatch.from_arrays([*(held.column(c) for c in range(3)), *lists], names=["doc_id", "doc_hash", "text", "grams", "ps"])

    return run


def smith_waterman(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of items with the same row of texts, with linear gaps.

    Rows are padded with PAD_ITEM and PAD_TEXT, which match nothing.
    """
    k, width = texts.shape
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    above = np.zeros((k, width + 1), np.int32)
    best = np.zeros(k, np.int32)
    for r in range(items.shape[1]):
        row = np.zeros((k, width + 1), np.int32)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(texts == items[:, r : r + 1], MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        # A gap along the text costs the same for each word: a running maximum of scores with the cost taken out.
        above = np.maximum.accumulate(row + ramp, axis=1) - ramp
        best = np.maximum(best, above.max(axis=1))
    return best


def _aligned(items: list[np.ndarray], texts: list[np.ndarray], cells: int = 1 << 22) -> list[int]:
    """Scores of pairs, in batches of about equal widths so that little is padding; memory follows `cells`."""
    order = sorted(range(len(items)), key=lambda i: (len(texts[i]), len(items[i])))
    out = [0] * len(items)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * (len(texts[order[hi]]) + 1) <= cells // 4:
            hi += 1
        part = order[lo:hi]
        a = np.full((len(part), max(len(items[i]) for i in part)), PAD_ITEM, U)
        b = np.full((len(part), max(len(texts[i]) for i in part)), PAD_TEXT, U)
        for r, i in enumerate(part):
            a[r, : len(items[i])], b[r, : len(texts[i])] = items[i], texts[i]
        for i, s in zip(part, smith_waterman(a, b).tolist(), strict=True):
            out[i] = s
        lo = hi
    return out


OUT = "doc_id long, item_id long, score double, n_seeds long, first_word long"


def _align_batches(least: float, passage: int):
    """Over documents with the items that they met and on which diagonals: the pairs that reach their target."""
    fields = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_hash", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("first_word", pa.int64())]

    def solve(h: np.ndarray, met: list[dict], items: list[np.ndarray]) -> list[tuple]:
        jobs = []
        for k, (m, item) in enumerate(zip(met, items, strict=True)):
            w = len(item)
            goal = target(w, least, passage)
            slack = math.ceil(MATCH * w - goal)  # words that gaps can take and leave enough score
            diagonals = sorted(m["diagonals"])
            cuts = [0, *(i for i in range(1, len(diagonals)) if diagonals[i] - diagonals[i - 1] > slack), len(diagonals)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                lo, hi = max(0, diagonals[a] - slack), min(len(h), diagonals[b - 1] + w + slack)
                if MATCH * np.isin(h[lo:hi], item).sum() >= goal:
                    jobs.append((k, b - a, lo, hi, goal))
        scores = _aligned([items[k] for k, *_ in jobs], [h[lo:hi] for _, _, lo, hi, _ in jobs])
        best: dict[int, tuple[float, int, int]] = {}
        for (k, n, lo, _, goal), s in zip(jobs, scores, strict=True):
            if s >= goal:
                best[k] = max(best.get(k, (0.0, 0, 0)), (s / (MATCH * len(items[k])), n, -lo))
        return [(met[k]["item_id"], met[k]["item_hash"], s, n, -lo) for k, (s, n, lo) in sorted(best.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                met = batch.column(2)[r].as_py()
                h = words(*utf8_parts(batch.column(1).slice(r, 1)))[0]
                held, _, _, bounds = words(*utf8_parts(pa.array([m["item"] for m in met], pa.large_string())))
                doc_id = batch.column(0)[r].as_py()
                rows += [(doc_id, *x) for x in solve(h, met, [held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, (_, t) in enumerate(fields)], names=[f for f, _ in fields])

    return run


def _block_pairs(docs: DataFrame, items: DataFrame, least: float, passage: int) -> DataFrame | None:
    """Pairs (doc_id, item_id, item_hash, score, n_seeds, first_word) of docs(doc_id, doc_hash, text) with items(item_id, item_hash, item)."""
    places = stash(items.mapInArrow(_seed_batches(least, passage), "gram long, item_id long, item_hash long, o long, n_words long"))
    if places.isEmpty():
        return None
    counts = docs.mapInArrow(_count_batches(_bit_table(places)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stash(counts.join(places.select("gram").distinct(), "gram", "left_semi"))  # pairs of this block at most
    met = places.join(counts, "gram")
    # The most frequent places of each item are passed over, as many as an alignment can spare; places not met at all cost nothing.
    often = met.groupBy("item_id", "item_hash", "o").agg(F.sum("n").alias("often"), F.first("n_words").alias("n_words"))
    spare = F.floor((F.least(F.col("n_words") * least, F.lit(passage)) * MATCH - 3) / 2)
    ranked = often.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "item_hash").orderBy(F.desc("often"), "o")))
    rare = ranked.where(F.col("rank") > spare).select(F.col("item_id").alias("i"), F.col("item_hash").alias("ih"), F.col("o").alias("at"))
    seeds = stash(met.join(rare, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih")) & (F.col("o") == F.col("at")), "left_semi").select("gram", "item_id", "item_hash", "o"))
    if seeds.isEmpty():
        return None
    met_docs = stash(docs.mapInArrow(_hit_batches(_bit_table(seeds)), "doc_id long, doc_hash long, text string, grams array<long>, ps array<long>"))
    hits = met_docs.select("doc_id", "doc_hash", F.explode(F.arrays_zip("grams", "ps")).alias("x")).select("doc_id", "doc_hash", F.col("x.grams").alias("gram"), F.col("x.ps").alias("p"))
    meetings = hits.join(seeds, "gram").groupBy("doc_id", "doc_hash", "item_id", "item_hash").agg(F.collect_set(F.col("p") - F.col("o")).alias("diagonals"))
    named = items.select(F.col("item_id").alias("i"), F.col("item_hash").alias("ih"), "item")
    meetings = meetings.join(named, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih")))
    meetings = stash(meetings.groupBy(F.col("doc_id").alias("d"), F.col("doc_hash").alias("dh")).agg(F.collect_list(F.struct("item_id", "item_hash", "item", "diagonals")).alias("met")))
    # Both sides grow alike, so the join is by merging at every size.
    joined = met_docs.join(meetings.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_hash") == F.col("dh"))).select("doc_id", "text", "met")
    return joined.mapInArrow(_align_batches(least, passage), "doc_id long, item_id long, item_hash long, score double, n_seeds long, first_word long")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 8_000_000, passage: int = 50) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word) of each document of docs(doc_id, text, ...) and item of
    benchmark(item_id, text, ...) whose best alignment reaches least of the item's own score or that of passage words.

    Words are split at white space with A-Z lower-cased. score is the share of the item's own score, n_seeds the seeds
    of the best place and first_word where its window begins. Null and empty texts and items align with nothing; null
    ids stay null; repeated rows and items each give their rows; equal places count by their seeds, then the earlier;
    extra columns are ignored; without documents or items there are no rows. Items go through in blocks of about
    block_bytes, so that the bit table stays sparse.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("doc_hash"), text_or_empty().alias("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text_or_empty()).alias("item_hash"), text_or_empty().alias("item"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = None
    for b in range(blocks):
        items = stash(rows.where(F.pmod(F.col("item_hash"), F.lit(blocks)) == b).groupBy("item_id", "item_hash", "item").agg(F.count("*").alias("copies")))
        pairs = _block_pairs(docs, items.drop("copies"), least, passage)
        if pairs is None:
            continue
        copies = items.select(F.col("item_id").alias("i"), F.col("item_hash").alias("ih"), "copies")
        pairs = pairs.join(copies, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih")))
        pairs = pairs.select("doc_id", "item_id", "score", "n_seeds", "first_word", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
        out = pairs if out is None else out.union(pairs)
    return spark.createDataFrame([], OUT) if out is None else out
