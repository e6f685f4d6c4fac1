"""Quality rules: a decision list that is learned from labelled statistics.

Statistics of a text are counted in one pass over whole texts. Sequential
covering grows conjunctions of thresholds on the labelled rows, prunes each on
rows held back, and keeps those that are precise enough; the list becomes one
ordered chain of Spark conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import WORD_GAPS, map_batches, table, text_slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Labelled rows that a list is fitted on, at most: the smallest hashes of doc_id. Statistics and verdicts cover all rows.
SAMPLE_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct")
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"), "mean_word": ("word_chars", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "distinct_share": ("n_distinct", "n_words"), "words": ("n_words", None),
}
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), b"0123456789", b"!?"


def _word_counts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words, words in windows that it holds twice or more, distinct words."""
    words = [r.split() for r in raws]
    n = np.array([len(w) for w in words], np.int64)
    total = int(n.sum())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, total)
    doc = np.repeat(np.arange(len(raws)), n)
    distinct = np.array([len(set(w)) for w in words], np.int64)
    covered = np.zeros(len(raws), np.int64)
    if total >= WINDOW:
        key = h[: total - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += h[k : total - WINDOW + 1 + k]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        start = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
        # only windows whose key repeats in the slice are compared by document
        order = start[np.argsort(key[start], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        twins = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
        if len(twins):
            twins = twins[np.lexsort((key[twins], doc[twins]))]
            eq = (doc[twins][1:] == doc[twins][:-1]) & (key[twins][1:] == key[twins][:-1])
            hit = twins[np.append(eq, False) | np.insert(eq, 0, False)]
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            covered = np.bincount(doc, weights=np.cumsum(edge)[:-1] > 0, minlength=len(raws)).astype(np.int64)
    return n, covered, distinct


def _repeated_lines(raw: bytes) -> tuple[int, int]:
    lines = [x for x in raw.split(b"\n") if x.translate(None, WORD_GAPS)]
    return len(lines) - len(set(lines)), len(lines)


def text_statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` and COUNTS of every whole text; null and empty texts count 0 throughout, repeated rows give repeated rows."""

    def make():
        def step(batch):
            for at, raws in text_slices(batch, text):
                n, covered, distinct = _word_counts(raws)
                lines = [_repeated_lines(r) for r in raws]
                count = lambda chars: [len(r) - len(r.translate(None, chars)) for r in raws]
                cols = {
                    "n_words": n, "word_chars": [len(r.translate(None, WORD_GAPS).decode()) for r in raws], "n_symbols": count(SYMBOLS), "n_dup_lines": [x[0] for x in lines], "n_repeat_words": covered,
                    "n_lines": [x[1] for x in lines], "n_upper": count(_UPPER), "n_digits": count(_DIGITS), "n_stops": count(_STOPS), "n_distinct": distinct,
                }
                yield {c: batch.column(c)[at : at + len(raws)] for c in carry} | {k: pa.array(v, pa.int64()) for k, v in cols.items()}

        return step

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry] + [f"{c} long" for c in COUNTS]
    return map_batches(docs.select(*{*carry, text}), ", ".join(kinds), make)


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.col(over).cast("double") if under is None else F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def _features(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({k: rows[a].astype(float) if b is None else np.where(rows[b] > 0, rows[a] / np.maximum(rows[b], 1), 0.0) for k, (a, b) in FEATURES.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def test(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.limit if self.above else v <= self.limit

    def column(self) -> Column:
        c = feature(self.feature)
        return c > self.limit if self.above else c <= self.limit


def _covers(rule: list[Condition], x: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.test(x)
    return hit


def _best_condition(x: pd.DataFrame, y: np.ndarray, steps: int = 64) -> tuple[float, Condition | None]:
    """The threshold with the largest gain in information on the positives that it keeps."""
    p0, n0 = y.sum(), len(y) - y.sum()
    base, best = math.log2(max(p0, 1e-9) / max(p0 + n0, 1e-9)), (0.0, None)
    for name in x.columns:
        v = x[name].to_numpy()
        order = np.argsort(v, kind="stable")
        v, c = v[order], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts) > steps:
            cuts = cuts[np.unique(np.linspace(0, len(cuts) - 1, steps).astype(int))]
        for k in cuts:
            for above, p, n in ((False, c[k], k + 1 - c[k]), (True, p0 - c[k], n0 - (k + 1 - c[k]))):
                if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-12:
                    best = gain, Condition(name, above, float((v[k] + v[k + 1]) / 2))
    return best


def learn_list(rows: pd.DataFrame, bad: np.ndarray, precision: float = 0.97, support: int = 3, most: int = 12) -> list[list[Condition]]:
    """Rules that say "reject", in order. rows holds COUNTS; bad marks the rows to reject.

    With no rows, or none of either kind, the list is empty and keeps everything.
    """
    x, y = _features(rows), np.asarray(bad, bool)
    if not y.any() or y.all():
        return []
    held = np.arange(len(x)) % 3 == 2
    grow_x, grow_y, test_x, test_y = x[~held], y[~held], x[held], y[held]
    rules: list[list[Condition]] = []
    while len(rules) < most and grow_y.sum() >= support:
        rule: list[Condition] = []
        gx, gy = grow_x, grow_y
        while len(rule) < 4 and not gy.all():
            _, condition = _best_condition(gx, gy)
            if condition is None:
                break
            rule.append(condition)
            hit = condition.test(gx)
            gx, gy = gx[hit], gy[hit]

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, test_x)
            p, n = test_y[hit].sum(), (~test_y[hit]).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = _covers(rule, grow_x) if rule else np.zeros(len(grow_x), bool)
        out = _covers(rule, test_x) if rule else np.zeros(len(test_x), bool)
        good = (grow_y[hit].sum() + test_y[out].sum()) / max(hit.sum() + out.sum(), 1)
        if hit.sum() < support or good < precision:
            break
        rules.append(rule)
        grow_x, grow_y, test_x, test_y = grow_x[~hit], grow_y[~hit], test_x[~out], test_y[~out]
    return rules


def list_verdict(rules: list[list[Condition]]) -> Column:
    """keep as one chain of conditions over COUNTS: the first rule that fits rejects, none keeps."""
    chain = None
    for rule in rules:
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        chain = F.when(fits, F.lit(False)) if chain is None else chain.when(fits, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """A list learned from at most `sample` labelled documents (quality 0 is to be rejected; null labels teach nothing).

    By hash about 1.2 times the sample is picked, of which tasks pass on no more
    than the sample, so what one task sorts doesn't follow the labels.
    """
    usable = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.2 * sample / max(usable.count(), 1)))
    marked = usable.where(part).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # bounded by `sample` rows
    # a doc_id may repeat, so the limit comes again before anything reaches the driver
    known = text_statistics(texts).join(F.broadcast(marked), "doc_id").orderBy("doc_id", "n_words", "quality", *COUNTS[1:]).limit(sample).toPandas()
    known = known.sort_values(["doc_id", "n_words", "quality", *COUNTS[1:]], ignore_index=True)
    order = np.argsort([xxhash.xxh3_64_intdigest(str(d)) for d in known["doc_id"]], kind="stable")
    known = known.iloc[order].reset_index(drop=True)
    return learn_list(known, known["quality"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for every row of docs."""
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & list_verdict(fit_rules(docs, labels, sample)))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Each row is judged by its own text where it is: no join and no shuffle, so
    rows that repeat a doc_id, or have none, are each judged by themselves.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]  # so that no column has a count's name
    counted = text_statistics(docs.toDF(*names), names[docs.columns.index("text")], tuple(names))
    kept = counted.where(~base_failed() & list_verdict(fit_rules(docs, labels, sample)))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
