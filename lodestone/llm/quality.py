"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on features of the whole text gives each document its own evidence. It is fitted on a
bounded sample of labelled documents; everything else covers all rows. Grouped aggregation then gives every
host and every path below it a mean quality, shrunk towards the level above: a path towards its host, a host
towards the global mean. How far follows from the corpus: the prior weight of each level comes from the variance
between its sites by the method of moments, so sparse sites stay near their prior. A document's score joins its
own evidence with what its path says beyond the global prior, the document itself left out at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import stash, string_slices, text_or_empty, utf8_parts
from lodestone.llm.shingles import U, words

FEATURES = ["log_words", "short", "upper", "digits", "marks", "bars", "bangs", "odd_ends", "repeats", "distinct", "word_length", "long_words"]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text, shares taken over its bytes or words."""
    n = len(offsets) - 1
    h, starts, ends, bounds = words(raw, offsets)
    n_words = np.diff(bounds)
    w = np.maximum(n_words, 1)
    n_bytes = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        return (c[offsets[1:]] - c[offsets[:-1]]) / n_bytes

    def of_words(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (c[bounds[1:]] - c[bounds[:-1]]) / w

    def table(*spans: tuple[int, int]) -> np.ndarray:
        t = np.zeros(256, bool)
        for a, b in spans:
            t[a : b + 1] = True
        return t

    letters = share(table((65, 90), (97, 122), (128, 255)))
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    ends_well = table((48, 57), (65, 90), (97, 122), (128, 255))
    ends_well[[33, 34, 39, 41, 44, 46, 58, 59, 63]] = True  # ! " ' ) , . : ; ?
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    lengths = ends - starts
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], float).reshape(n)
    bang = table((33, 33))
    return np.column_stack([
        np.log1p(n_words), n_words < 20, share(table((65, 90))) / np.maximum(letters, 1e-6), share(table((48, 57))), share(table((33, 47), (58, 64), (91, 96), (123, 126))),
        share(table((124, 124))), share(bang), of_words(~ends_well[last]), of_words(same), np.log((distinct + 1) / (n_words + 1)), of_words(lengths) / 10, of_words(lengths > 30),
    ]).astype(float)


class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -12, 12)))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        for i, j in string_slices(text):
            x = features(*utf8_parts(text.slice(i, j - i)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), flat], names=["quality", "x"])


def _score_batches(model: Logistic | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3)
            for i, j in string_slices(text):
                raw, offsets = utf8_parts(text.slice(i, j - i))
                p = np.full(j - i, prior) if model is None else model.probability(features(raw, offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(p)], names=["doc_id", "host", "path", "p_document"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[Logistic | None, float]:
    """The model, and the share of good ones among the labelled. Fits on at most `sample` labelled documents, those with
    the least hashes of doc_id. With one class only, there is no model and the share alone speaks; without labels it is 1."""
    wanted = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    wanted = wanted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")  # at most `sample` ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of each
    got = rows.mapInArrow(_feature_batches, "quality int, x array<double>").toPandas()
    if got.empty:
        return None, 1.0
    y = (got["quality"].to_numpy() > 0).astype(float)
    if y.min() == y.max():
        return None, float(y.mean())
    return Logistic(np.vstack(got["x"].to_list()), y), float(y.mean())


def _prior_weight(sites: DataFrame, n: str, total: str, prior: Column) -> float:
    """The Beta prior's weight from the spread of site means about `prior` beyond what their own sizes explain."""
    mean = F.col(total) / F.col(n)
    row = sites.where(F.col(n) > 1).agg(
        F.count("*").alias("k"), F.sum(F.col(n) * (mean - prior) ** 2).alias("ss"), F.sum(n).alias("n"), F.sum(F.col(n) * prior * (1 - prior)).alias("inner"), (F.sum(F.col(n) ** 2) / F.sum(n)).alias("nn")
    ).first()
    if not row.k or row.k < 2 or not row.inner:
        return 100.0
    inner = row.inner / row.n
    between = (row.ss / row.n - inner * row.k / row.n) / max(1 - row.k / row.n, 1e-9)
    return float(np.clip(inner / max(between, 1e-9) - 1, 1.0, 1e5))


def score(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", sample: int = 20_000, keep_from: float = 0.5) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, p_document, host_mean, path_mean, p_quality, keep.

    host_mean is the posterior of the whole host; path_mean that of the document's path from all other documents, and
    p_quality joins it with the document's own evidence. host names the site and path the part of it (here source and lang); a null is a site of its own, as an empty name is.
    Null and empty texts are judged by their (empty) features. A doc_id that is null or has no label is judged as any
    other; one with several labels counts with the lowest. Repeated rows each get their row and count in their site;
    extra columns are ignored; no rows give no rows. keep is p_quality >= keep_from.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    model, share = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(col(path).cast("string"), F.lit("")).alias("path"), text_or_empty().alias("text"))
    scored = stash(rows.mapInArrow(_score_batches(model, share), "doc_id long, host string, path string, p_document double"))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_document").alias("total"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_total").alias("total")).first()
    if not whole.n:
        return scored.select("doc_id", "p_document", *(F.lit(None).cast("double").alias(c) for c in ("host_mean", "path_mean", "p_quality")), F.lit(None).cast("boolean").alias("keep"))
    mean = float(np.clip(whole.total / whole.n, 1e-4, 1 - 1e-4))
    w_host = _prior_weight(hosts, "host_n", "host_total", F.lit(mean))
    hosts = hosts.withColumn("host_mean", (F.col("host_total") + w_host * mean) / (F.col("host_n") + w_host))
    sites = paths.join(hosts, "host")
    w_path = _prior_weight(sites, "n", "total", F.col("host_mean"))
    out = scored.join(sites, ["host", "path"])
    own = F.col("p_document")
    rest = F.lit(share) if whole.n == 1 else (whole.total - own) / (whole.n - 1)
    on_host = (F.col("host_total") - own + w_host * rest) / (F.col("host_n") - 1 + w_host)
    others = (F.col("total") - own + w_path * on_host) / (F.col("n") - 1 + w_path)
    logit = lambda p: F.log(p / (1 - p))
    clip = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    z = logit(clip(own)) + logit(clip(F.col("path_mean"))) - float(np.log(mean / (1 - mean)))
    out = out.withColumn("path_mean", others).withColumn("p_quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "p_document", "host_mean", "path_mean", "p_quality", (F.col("p_quality") >= keep_from).alias("keep"))
