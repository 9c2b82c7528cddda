"""Best-fit packing of tokenised documents by bin completion with branch and bound.

Documents are tokenised where they lie, one id ends each, and only longer ones are cut. Packing needs nothing
but how many pieces there are of each length: at most `capacity` numbers, whatever the size of the corpus. On
these the driver searches as in Korf's bin completion: take the largest piece left, enumerate all undominated
fillings of the room beside it, least waste first, and prune by the waste that a better packing may have. Best-fit
decreasing is the first incumbent; where it reaches the lower bound, no packing has fewer sequences and the search
ends at its root. A filling is used for as many sequences at once as the counts allow, then for fewer. The result is
a list of patterns with multiplicities; each piece finds its place from its rank among the pieces of its length.
Ranks come from counts of salted groups, so neither a task nor the driver ever holds the pieces of one length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stash, string_slices, text_or_empty

END = 1
#: Levels of the search whose sums are held, about two megabytes each at most; those of higher levels are made again.
HELD_LEVELS = 10
#: Pieces left from which on the search does not look whether one of them fits nowhere.
FEW = 400

#: What the tokenizer's file splits words by, for texts of ASCII and Latin-1 letters in lower case.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\x0b\x0c\r0-9a-zß-öø-ÿ]+")
#: Texts that this holds for: no letters or digits but those, nothing to normalise, no other white space.
LATIN = re.compile("[\x00-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
#: Byte-level models write each byte as a character: itself if it prints, else the next free one from 256 on.
PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: b if b in PRINTS else 256 + sum(c not in PRINTS for c in range(b)) for b in range(256)}


class Held(dict):
    """What `make` gives for each key, held in two generations of at most `most` bytes each: keys still in use move to the younger.

    An entry counts as its characters, its value and what a dictionary and two objects take beside them. Keys of more
    than LONGEST characters are made each time, so one text cannot fill a generation.
    """

    LONGEST, EACH = 64, 220

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def __missing__(self, key: str) -> bytes:
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self[key] = self.old.get(key) or self.make(key)
        self.size += self.EACH + 2 * len(key) + len(value)
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        return value


class CachedTokenizer:
    """Ids of whole texts, each distinct word encoded about once for each worker.

    Tokens never span words, so a text's ids are those of its words one after the other. Latin texts are split here as the
    tokenizer's file says and their words go to its model; any other text is split at ASCII white space, which no
    word spans, and its parts go through the whole tokenizer. Latin words hold 2 * cache_bytes at most, others a quarter.
    """

    def __init__(self, definition: str, cache_bytes: int = 20_000_000):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(definition)
        model = whole.model
        self.latin = Held(lambda w: _bytes([t.id for t in model.tokenize(w.encode().decode("latin-1").translate(BYTES))]), cache_bytes)
        self.other = Held(lambda w: _bytes(whole.encode(w, add_special_tokens=False).ids), cache_bytes // 4)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            latin = LATIN.fullmatch(text) and "<|" not in text
            parts, held = (WORDS.findall(text.lower()), self.latin) if latin else ([w.decode() for w in text.encode().split()], self.other)
            yield b"".join(map(held.__getitem__, parts))


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_HELD: dict[str, CachedTokenizer] = {}


def worker_tokenizer(name: str, definition) -> CachedTokenizer:
    """One for each Python worker, which serves many tasks."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = CachedTokenizer(definition.value)
    return _HELD[name]


def _piece_batches(name: str, definition, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(name, definition)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for lo, hi in string_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                cols: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.ids(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        for col, x in zip(cols, (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, times): best fit by falling size, equal steps taken together."""
    left: Counter = Counter(counts)
    sizes = sorted(left)
    out = []
    while sizes:
        first = sizes[-1]
        pattern, room = [first], capacity - first
        spare = Counter({first: 1})
        while True:
            i = bisect_right(sizes, room) - 1
            while i >= 0 and left[sizes[i]] - spare[sizes[i]] <= 0:
                i -= 1
            if i < 0:
                break
            pattern.append(sizes[i])
            spare[sizes[i]] += 1
            room -= sizes[i]
        times = min(left[s] // n for s, n in spare.items())
        for s, n in spare.items():
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
        out.append((tuple(pattern), times))
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by the total, and by Martello and Toth's count of what pieces above half a bin leave for others."""
    sizes = sorted(counts)
    number, total = [0], [0]  # of all pieces smaller than sizes[i]
    for s in sizes:
        number.append(number[-1] + counts[s])
        total.append(total[-1] + s * counts[s])
    best = -(-total[-1] // capacity)
    half = bisect_right(sizes, capacity // 2)
    for i in range(half + 1):
        least = sizes[i] if i < half else capacity // 2 + 1
        alone = bisect_right(sizes, capacity - least)  # from here on, nothing of at least `least` fits beside
        middle, large = number[max(alone, half)] - number[half], number[-1] - number[max(alone, half)]
        room = middle * capacity - (total[max(alone, half)] - total[half])
        best = max(best, large + middle + max(0, -(-(total[half] - total[i] - room) // capacity)))
    return best


def _spread(bits: int, least: int, most: int) -> int:
    """bits moved up by every number from least to most."""
    if most < least:
        return 0
    out, have = bits << least, 1
    width = most - least + 1
    while have < width:
        step = min(have, width - have)
        out |= out << step
        have += step
    return out


def _exact(left: dict[int, int], sizes: list[int], reach: list[int], i: int, rest: int) -> Iterator[list[tuple[int, int]]]:
    """(size, number) lists from the i least sizes that sum to rest, larger sizes first."""
    if not rest:
        yield []
        return
    while i and reach[i] >> rest & 1:
        s, lower = sizes[i - 1], reach[i - 1]
        if s <= rest:
            for n in range(min(left[s], rest // s), 0, -1):
                if lower >> (rest - n * s) & 1:
                    for more in _exact(left, sizes, reach, i - 1, rest - n * s):
                        yield [(s, n), *more]
        i -= 1


def fillings(left: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(filling, waste) for each undominated filling of room from the pieces left, least waste first, then larger pieces first.

    A filling is dominated if some of its pieces, or none, can be exchanged for one larger or equal piece that is left
    over and fits: whatever packing uses the filling stays one after the exchange (Martello and Toth). Nothing else is
    left out, but for fillings that waste more than most_waste. Sums that can be reached are kept as bits of a number,
    so that the enumeration meets no dead ends.
    """
    sizes = sorted(s for s, n in left.items() if n > 0 and s <= room)
    reach = _reach(sizes, left, room)
    spare = 0
    for s in sizes:
        spare |= 1 << s

    for waste in range(min(room, most_waste) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for chosen in _exact(left, sizes, reach, len(sizes), room - waste):
            free, one, many, every = spare, 0, 0, 1
            for s, n in chosen:
                if left[s] == n:
                    free &= ~(1 << s)
                for _ in range(n):
                    many |= (every & ~1) << s
                    every |= every << s
                one |= 1 << s
            if free & (_spread(many, 0, waste) | _spread(one | 1, 1, waste)):
                continue
            yield tuple(s for s, n in chosen for _ in range(n)), waste


def _reach(sizes: list[int], left: dict[int, int], most: int) -> list[int]:
    """[i]: as the bits of a number, the sums up to most that pieces of the i least sizes can have."""
    mask = (1 << (most + 1)) - 1
    out = [1]
    for i, s in enumerate(sizes):
        if (mask ^ out[-1]).bit_length() <= s:  # all sums from s on are there, and pieces of s or more add no others
            return out + out[-1:] * (len(sizes) - i)
        bits, n, step = out[-1], min(left[s], most // s), 1
        while n > 0:
            take = min(step, n)
            bits |= (bits << (s * take)) & mask
            n -= take
            step *= 2
        out.append(bits)
    return out


def _hopeless(left: dict[int, int], capacity: int, waste: int) -> bool:
    """Whether some piece left has no filling beside it that wastes at most `waste`, even if it could be used beside itself."""
    if waste >= capacity or sum(left.values()) > FEW:  # with many pieces left, next to every sum can be reached
        return False
    sizes = sorted(left)
    sums = _spread(_reach(sizes, left, capacity)[-1], 0, waste)
    rooms = 0
    for s in sizes:
        rooms |= 1 << (capacity - s)
    return bool(rooms & ~sums)


def _complete(counts: dict[int, int], capacity: int, bins: int, nodes: int) -> tuple[list[tuple[tuple[int, ...], int]] | None, bool]:
    """(packing into at most `bins` bins or None, whether the search came to its end), depth first over at most `nodes` nodes.

    Each level takes the largest piece left and tries its fillings. `bins` leaves a fixed waste to spend, which prunes
    them. A filling goes into as many bins as the counts allow, then into half as many, and so on down to one. One that
    failed is not tried again further down beside a piece of the same size: its packings have been seen.
    """
    left = dict(counts)
    waste = bins * capacity - sum(s * n for s, n in counts.items())
    if waste < 0:
        return None, True
    chosen: list[tuple[tuple[int, ...], int]] = []

    def options(failed: frozenset) -> Iterator[tuple[tuple[int, ...], int, int]]:
        first = max(left)
        left[first] -= 1
        beside = {s: n for s, n in left.items() if n}
        left[first] += 1
        seen = set(failed)
        for filling, lost in fillings(beside, capacity - first, waste):
            pattern = (first, *filling)
            if pattern in seen:
                continue
            used = Counter(pattern)
            times = min(left[s] // n for s, n in used.items())
            while times:
                if lost * times <= waste:
                    failed_now[-1] = frozenset(seen)
                    yield pattern, times, lost * times
                times //= 2
            seen.add(pattern)

    failed_now: list[frozenset] = [frozenset()]
    inherited_at: list[frozenset] = [frozenset()]
    stack: list[Iterator | None] = [options(frozenset())]
    came = [0]  # how many options of each level have come
    while stack:
        if stack[-1] is None:  # its sums were let go; the options that came are passed over
            stack[-1] = islice(options(inherited_at[-1]), came[-1], None)
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            failed_now.pop()
            came.pop()
            inherited_at.pop()
            if chosen:
                pattern, times = chosen.pop()
                for s, n in Counter(pattern).items():
                    left[s] = left.get(s, 0) + n * times
                waste += times * (capacity - sum(pattern))
            continue
        came[-1] += 1
        if not nodes:
            return None, False
        nodes -= 1
        pattern, times, lost = step
        for s, n in Counter(pattern).items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        waste -= lost
        chosen.append((pattern, times))
        if not left:
            return chosen, True
        if _hopeless(left, capacity, waste):
            chosen.pop()
            for s, n in Counter(pattern).items():
                left[s] = left.get(s, 0) + n * times
            waste += lost
            continue
        same = max(left) == pattern[0]
        inherited = failed_now[-1] if same else frozenset()
        failed_now.append(inherited)
        inherited_at.append(inherited)
        came.append(0)
        if len(stack) >= HELD_LEVELS:
            stack[-HELD_LEVELS] = None
        stack.append(options(inherited))
    return None, True


def search(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """((pattern, times) over all pieces, whether no packing has fewer bins). counts: pieces of each length.

    Best fit by falling size is the first incumbent. While it has more bins than the lower bound, bin completion looks for
    a packing into a given number of bins, the bound first, then numbers nearer to the incumbent's, with at most
    `nodes` nodes for each of these (at most 5). A search that ends without a packing raises the bound. `nodes` is the
    only limit; where it is met, the result may have more bins than it must, and the second value is False.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    if not counts:
        return [], True
    floor = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    most = sum(t for _, t in best)
    proven = floor
    gap = most - 1 - floor
    for bins in sorted({floor + gap * k // 8 for k in (0, 1, 2, 4, 8)} if gap >= 0 else ()):
        if bins < proven:
            continue
        found, ended = _complete(counts, capacity, bins, nodes)
        if found is not None:
            best, most = found, sum(t for _, t in found)
            break
        if ended:
            proven = bins + 1
    return best, most <= proven


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """The packing that `search` finds."""
    return search(counts, capacity, nodes)[0]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, by rank: from which rank on which pattern's places hold it."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for s, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((s, ranks[s], sequence, n, offset))
            ranks[s] += n * times
            offset += s * n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def _placer(slots: dict[str, np.ndarray]):
    span = 1 << 40
    keys = slots["length"] * span + slots["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            k = rank - slots["rank"][at]
            each = slots["each"][at]
            place = [pa.array(slots["sequence"][at] + k // each), pa.array(slots["offset"][at] + (k % each) * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *place], names=[*names, "sequence_id", "offset"])

    return run


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _running(sizes: DataFrame, span: int = 1000) -> DataFrame:
    """sizes(length, salt, n) with before: the sum of n over smaller salts of the length, in two levels so that no task has all salts of one."""
    sizes = sizes.withColumn("part", F.floor(F.col("salt") / span))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    parts = sizes.groupBy("length", "part").agg(F.sum("n").alias("n")).select("length", "part", total(upto("length", "part")).alias("base"))
    inner = sizes.withColumn("inner", total(upto("length", "part", "salt")))
    return inner.join(parts, ["length", "part"]).select("length", "salt", (F.col("base") + F.col("inner")).alias("before"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, nodes: int = 20_000, group: int = 500) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and optimal: whether no packing has fewer sequences.

    A null or empty text is the one end id. Pieces of a document longer than capacity are full but for the last. A null
    doc_id stays null; repeated rows are packed each; ties between equal lengths go by doc_id and piece; extra columns
    are ignored; no rows give no rows. The tokenizer's file is read by the driver and sent to the workers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    definition = docs.sparkSession.sparkContext.broadcast(text)  # one vocabulary file
    name = hashlib.sha256(text.encode()).hexdigest()
    pieces = stash(docs.mapInArrow(_piece_batches(name, definition, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    patterns, proven = search(by_length, capacity, nodes)
    slots = _slots(patterns)
    salts = max(16, -(-sum(by_length.values()) // group))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    before = _running(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    within = Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    ranked = salted.withColumn("in_group", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_group")).alias("rank"))
    return ranked.mapInArrow(_placer(slots), OUT).withColumn("optimal", F.lit(proven))
