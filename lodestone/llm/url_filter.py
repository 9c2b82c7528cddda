"""URL filters: host and path rules, and a ratio of character language models for what no rule decides.

Two variable-order Markov models over characters, of accepted and of rejected URLs, interpolate all context
lengths up to `order` with Witten-Bell weights, so that a long context counts as far as it was seen. The score of
a URL is the difference of its log-likelihoods divided by its length; the threshold is calibrated on labelled
URLs held out from the counts. Every URL that the rules label has its part, whole: of each class, in the order of
hashes, the first of every four is held out, the other three are counted.

The models are tables of the cluster, so neither counts nor scores nor the calibration meet on one machine. The counts of
the longest n-grams hold those of all shorter ones. What a character adds to a score depends on its n-gram only, so each
distinct n-gram is weighed once, from no context upwards. Weights are whole numbers of 2^-32, whose sums do not depend on
their order.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import release, stash

#: Verdict, host, path prefix. A rule fits its host and all subdomains.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


#: Fills the context before the first character.
START = "\x02"
#: The share that the flat distribution under the empty context has is over this many symbols.
ALPHABET = 256
#: Weights are whole numbers of this.
UNIT = 2.0**-32
#: URLs are dealt into so many blocks where n-grams meet their weights, so that an n-gram of every URL is not one key.
BLOCKS = 64
#: Of so many labelled URLs one is held out.
FOLDS = 4


class CharModel:
    """The model of one class in plain Python, with contexts of 0 to `order` characters: what the tables must agree with."""

    def __init__(self, order: int):
        self.order = order
        self.counts: dict[str, int] = defaultdict(int)
        self.totals: dict[str, int] = defaultdict(int)
        self.kinds: dict[str, int] = defaultdict(int)

    def add(self, text: str) -> None:
        padded = START * self.order + text
        for i in range(self.order, len(padded)):
            for k in range(self.order + 1):
                context, gram = padded[i - k : i], padded[i - k : i + 1]
                if not self.counts[gram]:
                    self.kinds[context] += 1
                self.counts[gram] += 1
                self.totals[context] += 1

    def freeze(self) -> CharModel:
        self.counts, self.totals, self.kinds = dict(self.counts), dict(self.totals), dict(self.kinds)
        return self

    def log_likelihood(self, text: str) -> float:
        padded = START * self.order + text
        counts, totals, kinds = self.counts, self.totals, self.kinds
        out = 0.0
        for i in range(self.order, len(padded)):
            p = 1 / ALPHABET
            for k in range(self.order + 1):
                n = totals.get(padded[i - k : i])
                if n is None:
                    break
                t = kinds[padded[i - k : i]]
                p = (counts.get(padded[i - k : i + 1], 0) + t * p) / (n + t)
            out += math.log(p)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, with A-Z lower-cased; path: from there up to ? or #."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """(*keep, gram) of each character of `url`: the character after the `order` before it."""
    chars = F.split(F.concat(F.lit(START * order), F.col("url")), "")
    each = F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.array_join(F.slice("chars", i, order + 1), ""))
    return urls.where("url <> ''").select(*keep, "url", chars.alias("chars")).select(*keep, F.explode(each).alias("gram"))


def numbered(labelled: DataFrame) -> DataFrame:
    """labelled(url, verdict, ...) with `place`, from 0 in each verdict in the order of hashes: counted within ranges of hashes, then by range."""
    out = labelled.withColumn("hash", F.xxhash64("url")).withColumn("range", F.shiftright("hash", 54))
    before = Window.partitionBy("verdict").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 ranges
    starts = out.groupBy("verdict", "range").agg(F.count("*").alias("n")).select("verdict", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = out.withColumn("place", F.row_number().over(Window.partitionBy("verdict", "range").orderBy("hash", "url")) - 1)
    return within.join(F.broadcast(starts), ["verdict", "range"]).withColumn("place", F.col("place") + F.col("start")).drop("hash", "range", "start")


def weights(counts: DataFrame, order: int) -> DataFrame:
    """(gram, weight in UNITs) of the asked rows of counts(gram, a, b, asked): how much likelier a is than b to go on with its last character."""
    out = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("asked").alias("asked"))
        after = Window.partitionBy(F.substring("gram", 1, k))  # as many rows as the alphabet has characters at most
        seen = [x for c in "ab" for x in (F.sum(c).over(after).alias(f"n{c}"), F.count(F.when(F.col(c) > 0, 1)).over(after).alias(f"t{c}"))]
        level = level.select("*", *seen).where("asked")
        if out is None:
            level = level.select("*", F.lit(1 / ALPHABET).alias("pa"), F.lit(1 / ALPHABET).alias("pb"))
        else:
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(out.withColumnRenamed("gram", "shorter"), "shorter")
        p = lambda c: F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}"))
        out = level.select("gram", p("a").alias("pa"), p("b").alias("pb"))
    return out.select("gram", F.round((F.log("pa") - F.log("pb")) / UNIT).cast("long").alias("weight"))


def score(urls: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(row, score) of urls(row, url) by counts(gram, a, b) of n-grams."""
    at = grams(urls, order, "row").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(BLOCKS)).cast("int"))
    pairs = stash(at.select("block", "gram").distinct())
    asked = pairs.select("gram", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("asked"))
    model = stash(counts.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("asked").alias("asked")))
    sums = at.join(pairs.join(weights(model, order), "gram"), ["block", "gram"]).groupBy("row").agg(F.sum("weight").alias("weight"))
    out = stash(urls.select("row", F.length("url").alias("length")).join(sums, "row", "left").select("row", (F.coalesce("weight", F.lit(0)) * UNIT / F.greatest("length", F.lit(1))).alias("score")))
    release(pairs)
    release(model)
    return out


def calibrate(scored: DataFrame) -> float:
    """Of scored(score, good): the cut with the least mean error rate of the two classes; between equals, the one nearest 0."""
    spark = scored.sparkSession
    each = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    each = stash(each.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "score").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = each.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("score").alias("last"))
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "gb"), F.lag("last").over(Window.orderBy("part")).alias("last"))
    total = each.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    ordered = Window.partitionBy("part").orderBy("score")
    below = lambda c, g: F.col(g) + F.coalesce(F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = each.join(F.broadcast(parts), "part").select("score", below("good", "g").alias("g"), below("bad", "b").alias("b"), F.coalesce(F.lag("score").over(ordered), "last").alias("last"))
    whole = lambda x: x.cast("decimal(19,0)")
    error = whole(F.col("g")) * whole(F.lit(total.bad)) + whole(total.bad - F.col("b")) * whole(F.lit(total.good))  # times good * bad
    middle = (F.col("last") + F.col("score")) / 2
    cut = F.when(middle > F.col("last"), middle).otherwise(F.col("score"))
    best = cuts.select(error.alias("error"), cut.alias("cut")).orderBy("error", F.abs("cut"), "cut").first().cut
    release(each)
    return best


def judge(pages: DataFrame, rules=RULES, order: int = 5) -> DataFrame:
    """Per row of pages(page_id, url, ...): page_id, host, path, rule, verdict, score.

    A null URL or one without :// has an empty host and path and fits no rule; the whole URL is scored, null as the empty
    text, whose score is 0. score is null where a rule decided. If the rules label fewer than four distinct URLs of either class, what no rule decides is
    allowed. Repeated rows each get their row; equal scores get equal verdicts; extra columns are ignored; no
    rows give no rows. For fitting, each URL counts once and whole.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    split = split.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "r.rule", "r.verdict")
    split = stash(split.withColumn("row", F.monotonically_increasing_id()))
    labelled = stash(numbered(split.where("rule is not null").groupBy("url", "verdict").agg(F.min("row").alias("row"))))
    sizes = {x.verdict: x.n for x in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(v, 0) for v in ("allow", "block")) < FOLDS:
        release(labelled)
        free = F.col("rule").isNull()
        return split.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(free, F.lit(math.inf)).alias("score"))
    held, learned = (labelled.where(x) for x in (F.col("place") % FOLDS == 0, F.col("place") % FOLDS != 0))
    of = lambda v: F.count_if(F.col("verdict") == v)
    counts = grams(learned, order, "verdict").groupBy("gram").agg(of("allow").alias("a"), of("block").alias("b"))
    scored = score(split.where("rule is null").select("row", "url").unionByName(held.select("row", "url")), counts, order)
    threshold = calibrate(held.join(scored, "row").select("score", (F.col("verdict") == "allow").alias("good")))
    release(labelled)
    said = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    free = split.join(scored, "row", "left").withColumn("score", F.when(F.col("rule").isNull(), F.col("score")))
    return free.select("page_id", "host", "path", "rule", F.coalesce("verdict", said).alias("verdict"), "score")
