"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (lines), cut at words that a hash chooses so that a long one does not stand or fall whole,
give 64-bit digests. A table holds each digest in one cell of each of three parts: cells add a count and combine
digests and check digests by exclusive or. Subtracting two tables cell by cell leaves the symmetric difference,
and peeling cells that hold a single digest recovers it. When peeling gets stuck, both tables are built at twice
the size and it starts again, so a difference of any size is recovered whole. Likeness is the Jaccard
similarity that the recovered difference gives. Tables of a whole Arrow batch are built and peeled at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import text_or_empty, utf8_parts
from lodestone.llm.shingles import U, mix, span_hash, words

PARTS, CELLS = 3, 8
CELL = np.dtype([("count", "<i4"), ("digests", "<u8"), ("checks", "<u4")])


def paragraph_digests(raw: np.ndarray, offsets: np.ndarray, cut: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(digests, owners), distinct for each text and sorted: of runs of words within a line, ended by chosen words."""
    hashes, starts, ends, bounds = words(raw, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    new = np.ones(n, bool)
    new[1:] = (lines[starts[1:]] != lines[ends[:-1]]) | ((hashes[:-1] & U(cut)) == 0)
    new[bounds[:-1][bounds[:-1] < n]] = True
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [n])) - 1
    digests = span_hash(raw, starts[first], ends[last])
    owner = np.searchsorted(bounds, first, side="right") - 1
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    keep = np.ones(len(digests), bool)
    keep[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
    return digests[keep], owner[keep]


class Tables:
    """One table for each owner, side by side in flat arrays; cells[i] is the number of cells in each part of table i."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.base = np.concatenate(([0], np.cumsum(cells * PARTS)))
        self.count = np.zeros(self.base[-1], np.int64)
        self.digests = np.zeros(self.base[-1], U)
        self.checks = np.zeros(self.base[-1], U)

    @staticmethod
    def check(digests: np.ndarray) -> np.ndarray:
        return mix(digests ^ U(0x5851F42D4C957F2D)) & U(0xFFFFFFFF)

    def add(self, digests: np.ndarray, owner: np.ndarray, sign) -> Tables:
        checks = self.check(digests)
        for part in range(PARTS):
            at = self.base[owner] + part * self.cells[owner] + (mix(digests + U(part + 1)) % self.cells[owner].astype(U)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digests, at, digests)
            np.bitwise_xor.at(self.checks, at, checks)
        return self

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.cells)
        out.count, out.digests, out.checks = self.count - other.count, self.digests ^ other.digests, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, owners, signs, done) of what the tables hold; done tells for each table whether nothing is left."""
        cell_owner = np.repeat(np.arange(len(self.cells)), self.cells * PARTS)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        most = np.zeros(len(self.cells), np.int64)
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self.checks[pure] == self.check(self.digests[pure])]
            pure = pure[most[cell_owner[pure]] <= 64 + 4 * self.cells[cell_owner[pure]]]  # ends even if a check deceives
            if not len(pure):
                break
            digests, owner, sign = self.digests[pure], cell_owner[pure], self.count[pure]
            order = np.lexsort((digests, owner))
            digests, owner, sign = digests[order], owner[order], sign[order]
            first = np.ones(len(order), bool)
            first[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
            digests, owner, sign = digests[first], owner[first], sign[first]
            self.add(digests, owner, -sign)
            np.add.at(most, owner, 1)
            got.append((digests, owner, sign))
        done = np.ones(len(self.cells), bool)
        done[cell_owner[(self.count != 0) | (self.digests != 0)]] = False
        if not got:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), done
        return *(np.concatenate(x) for x in zip(*got, strict=True)), done

    def strings(self) -> list[str]:
        """Each table's cells in order, packed and in base64."""
        flat = np.empty(len(self.count), CELL)
        flat["count"], flat["digests"], flat["checks"] = self.count, self.digests, self.checks
        return [base64.b64encode(flat[a:b].tobytes()).decode() for a, b in zip(self.base[:-1], self.base[1:], strict=True)]


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> np.ndarray:
    """Size of the symmetric difference of the digest sets a and b of each of n owners, recovered by peeling."""
    out, todo = np.zeros(n, np.int64), np.arange(n)
    (da, oa), (db, ob) = a, b
    while len(todo):
        size = np.full(len(todo), cells)
        tables = Tables(size).add(da, oa, 1).minus(Tables(size).add(db, ob, 1))
        _, owner, _, done = tables.peel()
        out[todo[done]] = np.bincount(owner, minlength=len(todo))[done]
        again = np.full(len(todo), -1)
        again[~done] = np.arange(int((~done).sum()))
        ka, kb = again[oa] >= 0, again[ob] >= 0
        da, oa, db, ob, todo = da[ka], again[oa[ka]], db[kb], again[ob[kb]], todo[~done]
        cells *= 2
    return out


def _likeness(na: np.ndarray, nb: np.ndarray, d: np.ndarray) -> np.ndarray:
    union = na + nb + d
    return np.where(union == 0, 1.0, (na + nb - d) / np.maximum(union, 1))


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for ids; texts has one text more: the one that follows the last."""
    n = len(ids)
    edits = [edited_text(t, f) for t, f in zip(texts[:-1], texts[1:], strict=True)]
    own = paragraph_digests(*utf8_parts(pa.array(texts, pa.large_string())))
    edit = paragraph_digests(*utf8_parts(pa.array(edits, pa.large_string())))
    size = np.full(n, CELLS)
    mine = tuple(x[own[1] < n] for x in own)
    following = (own[0][own[1] > 0], own[1][own[1] > 0] - 1)
    count = lambda s: np.bincount(s[1], minlength=n)
    near = lambda other: _likeness(count(mine), count(other), differing(mine, other, n))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
            pa.array(Tables(size).add(*mine, 1).strings()), pa.array(Tables(size).add(*edit, 1).strings()), pa.array(near(edit)), pa.array(near(following)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(rows: int = 400, chars: int = 2_000_000):
    """Over rows (bucket, ctx, ord, doc_id, text), each bucket ended by its context rows: emit each row with the text after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, bucket, closed = 0, None, True
        for batch in batches:
            for b, ctx, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ctx", "doc_id", "text")), strict=True):
                if b != bucket:
                    bucket, closed = b, False
                elif closed:
                    continue  # a further context row of the same id
                if ids and (ctx or len(ids) >= rows or size >= chars):
                    yield _emit(ids, [*texts, text])
                    ids, texts, size = [], [], 0
                if ctx:
                    closed = True
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    return run


def fingerprint(docs: DataFrame, rows_per_bucket: int = 1000, most_buckets: int = 20_000, partition_bytes: int = 32_000_000) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third replaced by the start of the next document's, in descending doc_id
    with the first after the last. A null text counts as empty; two empty texts have likeness 1; a null doc_id comes after
    all others and stays null; rows with the same doc_id follow each other by a hash of the text, then the text; a single
    row is its own next; extra columns are ignored; no rows give no rows.

    Rows are dealt by ranges of doc_id, so that neighbours meet without a global sort; an id with more rows than a
    bucket should have (as all rows without one) is split by ranges of the hash. What the driver holds is the ranges'
    bounds and first rows' ids and hashes, at most about most_buckets of each; tasks stream through their rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = docs.withColumns({"ord": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.shiftrightunsigned(F.xxhash64("text"), 32)})
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    parts = max(1, min(most_buckets, -(-n // rows_per_bucket)))
    at = [k / parts for k in range(1, parts)]
    bounds = np.array(sorted(set(docs.agg(F.percentile_approx("ord", at, max(10_000, 20 * parts))).first()[0] or [])) if at else [], np.int64)
    crowd = max(rows_per_bucket, n // most_buckets)
    split = {r.ord: -(-r["count"] // crowd) for r in docs.groupBy("ord").count().where(F.col("count") > crowd).collect()}
    crowded = np.array(sorted(split), np.int64)
    shares = np.array([split[x] for x in crowded.tolist()], np.int64)

    def bucket_numbers(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Ranges of ids, those of a crowded id and of its hashes apart; greater numbers come first in the order."""
        own = np.searchsorted(bounds, ids, side="left").astype(np.int64) + np.searchsorted(crowded, ids, side="left") + np.searchsorted(crowded, ids, side="right")
        sub = np.zeros(len(ids), np.int64)
        if len(crowded):
            k = np.minimum(np.searchsorted(crowded, ids), len(crowded) - 1)
            hit = crowded[k] == ids
            sub[hit] = shares[k[hit]] - 1 - (ties[hit] * shares[k[hit]] >> 32)
        return own << 32 | sub

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(bucket_numbers(ids.to_numpy(), ties.to_numpy()))

    first = F.max(F.struct("ord", -F.col("tie"))).alias("head")
    heads = docs.select("ord", "tie", bucket_of("ord", "tie").alias("bucket")).groupBy("bucket").agg(first).orderBy("bucket").collect()
    above = {(h["head"][0], -h["head"][1]): heads[(k + 1) % len(heads)]["bucket"] for k, h in enumerate(heads)}

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series, ties: pd.Series) -> pd.Series:
        own = bucket_numbers(ids.to_numpy(), ties.to_numpy()).tolist()
        return pd.Series([[b, above[x]] if x in above else [b] for b, x in zip(own, zip(ids.tolist(), ties.tolist(), strict=True), strict=True)])

    dealt = docs.select("ord", "tie", "doc_id", "text", F.posexplode(places("ord", "tie")).alias("ctx", "bucket"))
    partitions = max(spark.sparkContext.defaultParallelism, -(-size // partition_bytes))
    dealt = dealt.repartition(partitions, F.col("bucket")).sortWithinPartitions("bucket", "ctx", F.desc("ord"), "tie", "text")
    return dealt.select("bucket", "ctx", "doc_id", "text").mapInArrow(_walk(), SCHEMA)
