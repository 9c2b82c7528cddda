"""Exact substring deduplication with suffix arrays built by the difference-cover algorithm.

Every byte that a `length`-byte string covers which also starts earlier in the corpus goes. The work is dealt out so
that equal strings always meet: each window of `length` bytes belongs to the `gram`-byte string of least hash
within it, its anchor. Consecutive windows with the same anchor in the same place are a run, about one for 43 bytes of text. Equal runs with
one anchor need no more than their order: all but the first are repeats. Where runs with one anchor differ, a window
that is in two of them reaches half of what a window has beside its anchor to the left of it or to the right, and so
these bytes are the same in both. Runs without such a side in common have no window in common. Of the others, the
bytes of the first of each kind are gathered by anchor, and a suffix array of these decides window by window:

  the difference-cover algorithm (Karkkainen and Sanders) sorts the triples at positions 1 and 2 modulo 3, names
  them, recurses on the names, orders the remaining suffixes by their first symbol and the rank of the next, and
  merges; then windows that are neighbours in the array and agree in all bytes are repeats of the earliest of them.

Because windows with different anchors cannot be equal, no suffix array spans tasks, and only runs that may repeat
in part are sorted. A task first drops the repeats within its own batch, so a passage in a third of all documents
reaches the shuffle once for each batch. An anchor with more than `hot` such runs is not gathered: its single
windows meet by 128-bit digests, and an aggregation with partial sums finds the first of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stash, string_slices, text_or_empty, utf8_parts
from lodestone.llm.shingles import U, blocks_at, digests, mix

KEY = ["ord", "dup"]


# --- the suffix array ----------------------------------------------------------------------------------------------


def _ranks(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, name of each row, number of names) of rows compared column by column."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        key = np.zeros(len(columns[0]), np.int64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << b) | c
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([False], sorted_key[1:] != sorted_key[:-1]))
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names, int(names.max()) if len(names) else 0


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers above 0) in lexicographic order; a prefix sorts before what it begins."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    # Position n joins the sample when n % 3 == 1, so that the names of the two classes stay apart.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    order, names, count = _ranks([t[sample], t[sample + 1], t[sample + 2]])
    if count < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[_ranks([t[zeros], rank[zeros + 1]])[0]]
    # Merge: a suffix at 0 modulo 3 compares with one at 1 by one symbol and a rank, with one at 2 by two and a rank.
    before = np.zeros(len(zeros), np.int64)
    for residue in (1, 2):
        own = sampled[sampled % 3 == residue]
        cols = [np.concatenate((t[own + k], t[zeros + k])) for k in range(residue)]
        cols.append(np.concatenate((rank[own + residue], rank[zeros + residue])))
        _, place, _ = _ranks(cols)
        before += np.searchsorted(place[: len(own)], place[len(own) :], side="left")
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + before
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at], out[~taken] = zeros, sampled
    return out


def repeated_windows(raw: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Mask of the windows at `starts` whose `length` bytes are also those of a window earlier by `place`.

    Neighbours in the suffix array are compared byte by byte; each row of equal ones keeps its earliest place.
    """
    where = np.full(len(raw), -1, np.int64)
    where[starts] = np.arange(len(starts))
    order = where[suffix_array(raw.astype(np.int64) + 1)]
    order = order[order >= 0]
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    equal = np.zeros(len(order), bool)
    for lo in range(1, len(order), 50_000):
        hi = min(lo + 50_000, len(order))
        equal[lo:hi] = (views[starts[order[lo:hi]]] == views[starts[order[lo - 1 : hi - 1]]]).all(1)
    group = np.cumsum(~equal)
    first = np.full(int(group[-1]) + 1 if len(group) else 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, place[order])
    out = np.zeros(len(starts), bool)
    out[order] = place[order] > first[group]
    return out


# --- runs of windows -----------------------------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position on, chained through blocks of 8."""
    m = len(raw) - gram + 1
    blocks = blocks_at(raw)
    out = np.full(m, U(gram))
    for k in range(0, gram, 8):
        part = blocks[k : k + m]
        out = mix(out ^ (part if gram - k >= 8 else part & U((1 << 8 * (gram - k)) - 1)))
    return out


def _beside(hashes: np.ndarray, gram: int, starts: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
    """32 bits of hash, never 0, of the `size` bytes from each start on, out of those of its grams; 0 where none are there.

    Equal bytes give equal hashes; fewer bytes than a gram are not told apart."""
    out = np.full(len(starts), U(size))
    for k in sorted({*range(0, size - gram + 1, gram), size - gram}) if size >= gram else []:
        out = mix(out ^ hashes[np.where(there, starts + k, 0)])
    return np.where(there, (out >> U(32)) | U(1), U(0))


def runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, content, text, start, windows, sides) of each run; text is the index of its text, start is within it.

    sides holds the hashes of the bytes on the left and on the right of the anchor, 0 where no window of the run reaches as far."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = _gram_hashes(raw, gram)
    # The least by 32 bits of hash, then the leftmost: what is chosen depends on the window's bytes alone. Equal windows
    # have it at the same distance, so two in one text never share its position, and no run repeats within itself.
    least = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    steps = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(steps, offsets[:-1][long], 1)
    np.add.at(steps, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(steps[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    text = np.searchsorted(offsets, a, side="right") - 1
    # Empty texts share an offset with the text after them; side="right" finds the last of these, which holds the bytes.
    at = (least[a] & U(0xFFFFFFFF)).astype(np.int64)
    half = (length - gram) // 2  # a window with fewer bytes on the left of its anchor has the rest of length - gram + 1 on the right
    left = _beside(hashes, gram, at - half, half, at - a >= half)
    right = _beside(hashes, gram, at + gram, length - gram - half + 1, at - b < half)
    return hashes[at].view(np.int64), digests(raw, a, b + length)[:, 0], text, a - offsets[text], b - a + 1, (left << U(32) | right).view(np.int64)


FIELDS = [("ord", pa.int64()), ("dup", pa.int32()), ("start", pa.int64()), ("windows", pa.int64())]
RUN = "anchor long, content long, repeat boolean, ord long, dup int, start long, windows long, sides long"
FOUND = "anchor long, ord long, dup int, start long, windows long"


def _merged(ord_: np.ndarray, dup: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows with those that touch joined."""
    order = np.lexsort((start, dup, ord_))
    ord_, dup, start, windows = ord_[order], dup[order], start[order], windows[order]
    new = np.ones(len(order), bool)
    new[1:] = (ord_[1:] != ord_[:-1]) | (dup[1:] != dup[:-1]) | (start[1:] > start[:-1] + windows[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return ord_, dup, start, windows
    end = np.maximum.reduceat(start + windows, first)
    return ord_[first], dup[first], start[first], end - start[first]


def _run_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dups, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            parts = []
            for i, j in string_slices(text):
                anchor, content, at, start, windows, sides = runs(*utf8_parts(text.slice(i, j - i)), length, gram)
                parts.append((anchor, content, ids[i + at], dups[i + at], start, windows, sides))
            if not parts:
                continue
            anchor, content, ord_, dup, start, windows, sides = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, dup, ord_, content, anchor))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
            rest = ~again
            o, d, s, w = _merged(ord_[again], dup[again], start[again], windows[again])
            spread = mix(o.astype(np.uint64) ^ s.astype(np.uint64)).view(np.int64)
            cols = [np.concatenate(x) for x in ((anchor[rest], spread), (content[rest], np.zeros_like(o)), (np.zeros(rest.sum(), bool), np.ones(len(o), bool)), (ord_[rest], o), (dup[rest], d), (start[rest], s), (windows[rest], w), (sides[rest], np.zeros_like(o)))]
            table = pa.table(dict(zip((c.split()[0] for c in RUN.split(", ")), cols, strict=True)))
            yield from table.cast(pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("repeat", pa.bool_()), *FIELDS, ("sides", pa.int64())])).to_batches(max_chunksize=200_000)

    return run


def _may_share(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Mask of the runs, ordered by anchor, whose bytes on one side of it another run with their anchor has as well."""
    group = np.cumsum(np.concatenate(([False], anchor[1:] != anchor[:-1]))).astype(U) << U(32)
    out = np.zeros(len(anchor), bool)
    for side in (sides.view(U) >> U(32), sides.view(U) & U(0xFFFFFFFF)):
        own = np.flatnonzero(side)
        key = group[own] | side[own]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[own[order[1:][same]]] = True
        out[own[order[:-1][same]]] = True
    return out


def _sift(most: int = 200_000):
    """Over runs sorted by anchor, content and place: repeats with a null anchor; firsts of each content that may share a window.

    The firsts of one anchor are held together until it ends. From `most` on all of them are passed instead of compared, so
    what is held has a bound.
    """

    def rows(cols: list[np.ndarray], anchors: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([anchors, *(pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True))], names=["anchor", *(c for c, _ in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", *(c for c, _ in FIELDS), "sides"]
        held: list[list[np.ndarray]] = []  # firsts of the anchor that came last
        holding, size, passing = None, 0, False  # that anchor, the number held, whether there were too many
        last: tuple[int, int] | None = None  # anchor and content of the run before

        def settled(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                take = np.flatnonzero(_may_share(cols[0], cols[-1]))
                if len(take):
                    yield rows([c[take] for c in cols[1:-1]], pa.array(cols[0][take]))

        for batch in batches:
            known = batch.column("repeat").to_numpy(zero_copy_only=False)
            cols = [batch.column(c).to_numpy() for c in names]
            again = known.copy()
            fresh = np.flatnonzero(~known)
            anchor, content = cols[0][fresh], batch.column("content").to_numpy()[fresh]
            if len(fresh):
                again[fresh[1:]] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                again[fresh[0]] = last == (anchor[0], content[0])
            if again.any():
                yield rows([c[again] for c in cols[1:-1]], pa.nulls(int(again.sum()), pa.int64()))
            if not len(fresh):
                continue
            cols = [c[~again] for c in cols]
            last = (anchor[-1], content[-1])
            if not len(cols[0]):
                continue
            breaks = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            tail = int(breaks[-1]) if len(breaks) else 0  # where the firsts of the last anchor begin
            if holding != cols[0][0]:
                yield from settled(held)
                held, size, passing = [], 0, False
            holding = cols[0][-1]
            if passing:
                end = int(breaks[0]) if len(breaks) else len(cols[0])
                yield rows([c[:end] for c in cols[1:-1]], pa.array(cols[0][:end]))
                if not len(breaks):
                    continue
                cols, tail, passing = [c[end:] for c in cols], tail - end, False
            if tail:
                yield from settled([*held, [c[:tail] for c in cols]])
                held, size = [], 0
            held.append([c[tail:] for c in cols])
            size += len(cols[0]) - tail
            if size >= most:
                for part in held:
                    yield rows(part[1:-1], pa.array(part[0]))
                held, size, passing = [], 0, True
        yield from settled(held)

    return run


def _cut_batches(length: int):
    """Bytes of the runs listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for ord_, dup, text, anchors, starts, windows in zip(*(batch.column(c).to_pylist() for c in ("ord", "dup", "text", "anchors", "starts", "windows")), strict=True):
                raw = text.encode()
                for anchor, start, count in zip(anchors, starts, windows, strict=True):
                    piece = raw[start : start + count + length - 1]
                    for col, x in zip(rows, (anchor, ord_, dup, start, piece), strict=True):
                        col.append(x)
                    size += len(piece)
                if size > 8_000_000:
                    yield _cut_rows(rows)
                    rows, size = [[], [], [], [], []], 0
            if rows[0]:
                yield _cut_rows(rows)

    return run


WINDOW = "w1 long, w2 long, ord long, dup int, start long"


def _window_batches(length: int):
    """The 128-bit digest of every single window of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dups, starts = (batch.column(c).to_numpy() for c in ("ord", "dup", "start"))
            data = batch.column("bytes")
            sizes = np.array([len(x) for x in data.to_pylist()], np.int64)
            raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
            counts = sizes - length + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = inner + np.repeat(np.cumsum(sizes) - sizes, counts)
            for lo in range(0, len(at), 50_000):
                part, own = at[lo : lo + 50_000], owner[lo : lo + 50_000]
                d = digests(raw, part, part + length)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(ids[own]), pa.array(dups[own], pa.int32()), pa.array(starts[own] + inner[lo : lo + 50_000])], names=[c.split()[0] for c in WINDOW.split(", ")])

    return run


def _cut_rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "ord", "dup", "start", "bytes"])


def _decide(length: int, most_bytes: int = 1_000_000):
    """Over runs sorted by anchor: the windows that repeat. Whole anchors are sorted together, about most_bytes at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        _, ord_, dup, start, data = zip(*rows, strict=True)
        raw = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.array([len(d) for d in data])
        counts = sizes - length + 1
        base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        owner = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        ords, dups, begins = np.array(ord_, np.int64), np.array(dup, np.int32), np.array(start, np.int64) + 0
        where = begins[owner] + inner
        place = np.empty(len(owner), np.int64)
        place[np.lexsort((where, dups[owner], ords[owner]))] = np.arange(len(owner))
        hit = repeated_windows(raw, base[owner] + inner, place, length)
        o, d, s, w = _merged(ords[owner][hit], dups[owner][hit], where[hit], np.ones(int(hit.sum()), np.int64))
        return pa.RecordBatch.from_arrays([pa.nulls(len(o), pa.int64()), *(pa.array(c, t) for c, (_, t) in zip((o, d, s, w), FIELDS, strict=True))], names=["anchor", *(c for c, _ in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ord", "dup", "start", "bytes")), strict=True):
                if size >= most_bytes and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)

    return run


def _removed_batches(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            kept_texts = []
            for text, starts, windows in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "windows")), strict=True):
                raw = text.encode()
                pieces, at, removed, spans, last = [], 0, 0, 0, -1
                for start, count in sorted(zip(starts or [], windows or [], strict=True)):
                    end = start + count + length - 1
                    if start > last:  # does not touch the span before
                        spans += 1
                    if end > at:
                        begin = max(at, start)
                        pieces.append(raw[at:begin])
                        removed += end - begin
                        at = end
                    last = max(last, end)
                kept = b"".join([*pieces, raw[at:]])
                for col, x in zip(cols, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest()), strict=False):
                    col.append(x)
                kept_texts.append(kept.decode("utf-8", "ignore") if with_text else None)
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs(ord, text, ...) with dup, the place of a row among those with its ord, by text. Blocks of a range partitioning
    keep rows of one ord, such as all without an id, from meeting in one task."""
    if docs.groupBy("ord").count().where("count > 1").isEmpty():
        return docs.withColumn("dup", F.lit(0))
    ranged = stash(docs.repartitionByRange("ord", "text").withColumn("block", F.spark_partition_id()))
    before = Window.partitionBy("ord").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy("ord", "block").agg(F.count("*").alias("n")).select("ord", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = ranged.withColumn("inner", F.row_number().over(Window.partitionBy("ord", "block").orderBy("text")))
    return stash(inner.join(blocks, ["ord", "block"]).withColumn("dup", (F.col("base") + F.col("inner")).cast("int")).drop("block", "inner", "base"))


def _lists(open_: DataFrame) -> DataFrame:
    return open_.groupBy(*KEY).agg(*(F.collect_list(c).alias(d) for c, d in (("anchor", "anchors"), ("start", "starts"), ("windows", "windows"))))


def _hot_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Repeats among the single windows of runs whose anchors have too many to sort together."""
    windows = stash(pieces.mapInArrow(_window_batches(length), WINDOW))
    place = F.struct(*KEY, "start")
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["w1", "w2"]).where(place > F.col("first"))
    return later.select(F.lit(None).cast("long").alias("anchor"), *KEY, "start", F.lit(1).cast("long").alias("windows"))


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 16, hot: int = 20_000, with_text: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if asked for).

    A byte is removed if a string of `length` bytes covers it that also starts earlier: in a row with a smaller doc_id, or
    earlier in the same one; overlaps count. A null text counts as empty; a null doc_id comes before all others and
    stays null; rows with the same doc_id follow each other by text, so all but one of equal rows lose every byte if
    they have `length` bytes. Shorter texts lose nothing. kept_text leaves out what is no whole code point any more.
    Extra columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63))))
    docs = _numbered(docs)
    mapped = docs.select(*KEY, "text").mapInArrow(_run_batches(length, gram), RUN)
    sorted_runs = mapped.repartition(F.col("anchor")).sortWithinPartitions("anchor", "content", *KEY, "start")
    found = stash(sorted_runs.mapInArrow(_sift(), FOUND))
    repeats, open_ = found.where("anchor is null"), found.where("anchor is not null")
    hot_anchors = stash(open_.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    pieces = docs.select(*KEY, "text").join(_lists(open_), KEY).mapInArrow(_cut_batches(length), "anchor long, ord long, dup int, start long, bytes binary")
    if not hot_anchors.isEmpty():
        pieces = stash(pieces)  # the texts move once for both ways
        repeats = repeats.union(_hot_repeats(pieces.join(hot_anchors, "anchor", "left_semi"), length))
        pieces = pieces.join(hot_anchors, "anchor", "left_anti")
    decided = pieces.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(_decide(length), FOUND)
    ranges = repeats.union(decided).groupBy(*KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows"))
    final = docs.join(ranges, KEY, "left").select("doc_id", "text", "starts", "windows")
    return final.mapInArrow(_removed_batches(length, with_text), OUT + ", kept_text string" * with_text)
