"""URL filters: rules first, then gradient-boosted trees on lexical features.

The rules label URLs; the trees learn from those labels and judge the rest.
Suffix statistics (how often each host ending, each first path segment, and each
pair of the two is blocked) are counted over all labelled URLs, in a fixed number
of hashed classes. What a URL is fitted with comes from the other folds, so no
label is a feature of itself. The path's first segments are also features by
hash and by first character.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches, table

#: Fixed rules: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labelled URLs that the trees are fitted on, at most: the smallest hashes of page_id. Verdicts and suffix statistics cover all rows.
SAMPLE_ROWS = 6_000
#: Hashed classes of each kind of suffix statistic, folds, hashed classes of a path's first segment, and characters that first characters are told apart by.
SUFFIX_CLASSES, FOLDS, SEGMENT_CLASSES, FIRST_CHARACTERS = 1024, 5, 16, "0123456789abcdefghijklmnopqrstuvwxyz"
STATISTICS = ("suffix", "segment", "both")
FEATURES = (
    "length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "host_parts", "hyphens", "first_segment", "second_segment", "last_segment", "second_first", "last_first", "secure", "fragment",
    *(f"{s}_blocked" for s in STATISTICS), *(f"segment_is_{k}" for k in range(SEGMENT_CLASSES)),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all subdomains."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def statistic_keys(host: Column, path: Column) -> list[Column]:
    """The hashed class of each of STATISTICS."""
    ending, segment = F.substring_index(host, ".", -1), F.get(F.split(path, "/"), F.lit(1))
    both = F.concat(ending, F.lit("/"), F.coalesce(segment, F.lit("")))
    return [F.pmod(F.crc32(F.coalesce(x, F.lit("")).cast("binary")), F.lit(SUFFIX_CLASSES)).cast("int") for x in (ending, segment, both)]


def fold_of(page_id: Column) -> Column:
    return F.pmod(F.xxhash64(page_id, F.lit(11)), F.lit(FOLDS)).cast("int")


def blocked_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed shares of blocked URLs, [fold, statistic, class], from [fold, statistic, class, (all, blocked)]: fold k without its own URLs, and last with all."""
    total = counts.sum(0)
    use = np.concatenate([total[None] - counts, total[None]])
    n = use[:, :, :, 0].sum(2, keepdims=True)
    prior = (use[:, :, :, 1].sum(2, keepdims=True) + 0.5) / (n + 1)
    return (use[:, :, :, 1] + 2 * prior) / (use[:, :, :, 0] + 2)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def features(urls: list[str], hosts: list[str], paths: list[str], folds: list[int], shares: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each URL; shares are taken from a URL's own row of blocked_shares, -1 for the last."""
    out = np.zeros((len(urls), len(FEATURES)))
    hashed = lambda x, n: zlib.crc32(x.encode()) % n
    for k, (u, h, p, fold) in enumerate(zip(urls, hosts, paths, folds, strict=True)):
        query = u.partition("?")[2].partition("#")[0]
        segments = [x for x in p.split("/") if x]
        first, second, last = (segments + ["", ""])[0], (segments + ["", ""])[1], segments[-1] if segments else ""
        ending, segment = h.rpartition(".")[2], (p.split("/") + [""])[1]
        known = [shares[fold, j, hashed(x, SUFFIX_CLASSES)] for j, x in enumerate((ending, segment, f"{ending}/{segment}"))]
        lead = lambda x: FIRST_CHARACTERS.find(x[:1].lower()) if x else -2
        out[k, : len(FEATURES) - SEGMENT_CLASSES] = (
            len(u), len(h), len(segments), sum(c.isdigit() for c in u) / max(len(u), 1), entropy(u), len([x for x in query.split("&") if x]), h.count(".") + bool(h), h.count("-"), len(first), len(second), len(last), lead(second), lead(last), u[:8].lower().startswith("https:"), "#" in u, *known,
        )
        out[k, len(FEATURES) - SEGMENT_CLASSES + hashed(first, SEGMENT_CLASSES)] = 1
    return out


@dataclass
class Tree:
    """A complete binary tree: inner nodes compare one feature with a limit, leaves add to the score."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(self.leaf)))):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.limit[at])
        return self.leaf[at - len(self.feature)]


class BoostedTrees:
    """Gradient boosting for the logistic loss with Newton leaves, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, smooth: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """y is 1 for a block. Rows of one kind, or none, leave the base score alone."""
        if not len(y):
            return self
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(p / (1 - p))
        if y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            score += tree.score(x)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        inner = (1 << self.depth) - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(g), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, -1)
            for f, e in enumerate(edges if len(rows) > 1 else []):
                gs, hs = (np.cumsum(np.bincount(binned[f, rows], weights=w[rows], minlength=len(e) + 1))[:-1] for w in (g, h))
                if len(gs):
                    G, H = g[rows].sum(), h[rows].sum()
                    gain = gs**2 / (hs + self.smooth) + (G - gs) ** 2 / (H - hs + self.smooth) - G**2 / (H + self.smooth)
                    k = int(np.argmax(gain))
                    best = max(best, (float(gain[k]), -f, -k))
            _, f, k = best
            split = best[0] > 1e-6
            feature[node] = -f if split else 0
            if split:
                limit[node] = edges[-f][-k]
            at[rows] = 2 * node + 1 + ((binned[-f, rows] > -k) if split else 0)
        leaf = np.array([self.rate * g[at == n].sum() / (h[at == n].sum() + self.smooth) for n in range(inner, 2 * inner + 1)])
        return Tree(feature, limit, leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum((t.score(x) for t in self.trees), np.full(len(x), self.base))


def fit(labelled: DataFrame, sample: int = SAMPLE_ROWS) -> tuple[BoostedTrees, np.ndarray]:
    """(trees, shares) of page_id, url, host, path, said. Counts cover all rows, in a fixed number of classes; at most `sample` rows by hash reach the driver."""
    keys = F.array(*[F.struct(F.lit(j).alias("statistic"), x.alias("class")) for j, x in enumerate(statistic_keys(F.col("host"), F.col("path")))])
    wide = labelled.select("said", fold_of(F.col("page_id")).alias("fold"), F.explode(keys).alias("k"))
    found = wide.groupBy("fold", "k.statistic", "k.class").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("b")).toPandas()
    counts = np.zeros((FOLDS, len(STATISTICS), SUFFIX_CLASSES, 2))
    counts[found["fold"], found["statistic"], found["class"]] = found[["n", "b"]]
    total, shares = int(counts[:, 0, :, 0].sum()), blocked_shares(counts)
    # by hash about 1.2 times the sample, of which tasks pass on no more than the sample
    part = F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.2 * sample / max(total, 1)))
    known = labelled.where(part).select("url", "host", "path", "said", fold_of(F.col("page_id")).alias("fold"), "page_id").orderBy(F.xxhash64("page_id"), "page_id", "url").limit(sample).toPandas()
    x = features(known["url"].tolist(), known["host"].tolist(), known["path"].tolist(), known["fold"].tolist(), shares)
    # each row once more as if its host ending had never been labelled, and once as if its first segment had not
    prior = (counts[:, :, :, 1].sum((0, 2)) + 0.5) / (counts[:, :, :, 0].sum((0, 2)) + 1)
    new_ending, new_segment = x.copy(), x.copy()
    for rows, statistics in ((new_ending, ("suffix", "both")), (new_segment, ("segment", "both"))):
        for name in statistics:
            rows[:, FEATURES.index(f"{name}_blocked")] = prior[STATISTICS.index(name)]
    new_segment[:, len(FEATURES) - SEGMENT_CLASSES :] = 0
    model = BoostedTrees().fit(np.concatenate([x, new_ending, new_segment]), np.tile((known["said"] == "block").to_numpy(float), 3))
    if not total:
        model.base = -1.0
    return model, shares


def predict(pages: DataFrame, model: BoostedTrees, shares: np.ndarray) -> DataFrame:
    """page_id, host, path, rule, verdict, score of page_id, url, host, path, rule, said: said where there is one, else the trees' verdict."""

    def make():
        def step(batch):
            url, host, path, said = ([x or "" for x in batch.column(c).to_pylist()] for c in ("url", "host", "path", "said"))
            score = model.score(features(url, host, path, [-1] * len(url), shares))
            yield {c: batch.column(c) for c in ("page_id", "host", "path", "rule")} | {"verdict": pa.array([s or ("block" if x > 0 else "allow") for s, x in zip(said, score, strict=True)], pa.string()), "score": pa.array(score)}

        return step

    return map_batches(pages, "page_id long, host string, path string, rule string, verdict string, score double", make)


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    A null url, or one without "://", has an empty host and path and is judged
    by the trees on its text. Without labelled URLs everything is allowed.
    Repeated rows give repeated rows; other columns are not carried.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("said", said)
    return predict(seen, *fit(seen.where("said is not null"), sample))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")
