"""Secret scans with DataFrame functions alone.

Positions of regular-expression matches: the parts between matches (split) and
the matches (regexp_extract_all) alternate, so running sums of their lengths
are the borders. Beside the three base kinds, candidate strings are scored by
the Shannon entropy of a sliding window: the sum of c * log2 c over the counts
in the window is carried along and changed only for the character that enters
and the one that leaves. The threshold depends on the candidate's character
class, and an allow-list suppresses well-known harmless strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import let
from quillspark.llm.common import table

#: Fixed patterns of the base kinds. Letters of an assignment's name match in either case, ASCII only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The secret's length decides, so what goes before it is cut off: an ASSIGN match ends with the secret.
ASSIGN_LEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan, and its window.
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
WINDOW = 20
#: Items of a block of a running sum, and characters of a block that parts of a text are cut from, as powers of two.
RUN_BITS, CUT_BITS = 7, 10
#: Bits a character that a window must reach, by character class: hexadecimal, letters and digits, base64.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 3.0, 3.8, 4.0
#: A word of one case or capitalised, or a number: a part of joined words. A key's groups mix them.
_PART = r"(?:[a-z]{1,14}|[A-Z]{1,14}|[A-Z][a-z]{1,13}|[0-9]{1,14})"
#: Marks of sample keys, as whole parts: next to no letter that would carry the word on.
_SAMPLE = "|".join(rf"(?<![A-Za-z]){w}(?![a-z])|(?<![A-Za-z]){w.capitalize()}(?![a-z])|(?<![A-Za-z]){w.upper()}(?![A-Z])" for w in ("example", "sample", "dummy", "placeholder"))
_SAMPLE += "|(?<![A-Za-z])x{6,}(?![a-z])|(?<![A-Za-z])X{6,}(?![A-Z])"
#: Fixed allow-list: UUIDs, sample keys, words and numbers joined by signs, one or two characters repeated.
ALLOW = rf"^[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$|{_SAMPLE}|^{_PART}(?:[/_=+-]+{_PART})+$|^(?i:(.{{1,2}})\1+)$"


def running(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes, from 0 on, of all items before each place: an array one longer than items.

    An array that grows in `aggregate` is copied at each step, so sums are taken
    by blocks: of whole blocks, of the blocks before each, and within a block.
    """
    zero, inside = F.lit(0), (1 << RUN_BITS) - 1

    def placed(xs: Column, starts: Column) -> Column:
        within = lambda i: F.slice(xs, i - i.bitwiseAND(inside) + 1, i.bitwiseAND(inside))
        return F.transform(F.sequence(F.lit(0), F.size(xs)), lambda i: F.aggregate(within(i), F.get(starts, F.shiftright(i, RUN_BITS)), join))

    def walked(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.shiftright(F.size(xs), RUN_BITS))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(xs, F.shiftleft(b, RUN_BITS) + 1, F.lit(inside + 1)), zero, join))
        starts = lambda done: F.transform(done, lambda _, b: F.aggregate(F.slice(done, 1, b), zero, join))
        return let(let(sums, starts), lambda at: placed(xs, at))

    return let(items, walked)


def _larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def spans_of(text: Column, pattern: str) -> Column:
    """array of (start, end, found) of the leftmost non-overlapping matches, in code points, end exclusive."""
    between = F.transform(F.split(text, pattern, -1), F.length)

    def placed(found: Column) -> Column:
        ends = running(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: gap + F.length(m)), lambda x, y: x + y)
        return let(ends, lambda at: F.transform(found, lambda m, k: F.struct((F.get(at, k + 1) - F.length(m)).alias("start"), F.get(at, k + 1).alias("end"), m.alias("found"))))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits a character, of any `window` characters in a row; shorter strings count as one window."""
    chars = F.split(s, "")
    size = F.least(F.length(s), F.lit(window))
    none = F.expr("cast(map() as map<string, int>)")

    def count(counts: Column, ch: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, ch), F.lit(0))

    def put(counts: Column, ch: Column, n: Column) -> Column:
        return F.map_concat(F.map_filter(counts, lambda k, _: k != ch), F.map_from_arrays(F.array(ch), F.array(n)))

    def add(acc: Column, ch: Column, change: int) -> Column:
        now = count(acc["counts"], ch)
        return F.struct(put(acc["counts"], ch, now + change).alias("counts"), (acc["s"] + _term(now + change) - _term(now)).alias("s"), acc["least"].alias("least"))

    def step(acc: Column, i: Column) -> Column:
        grown = add(acc, F.get(chars, i), 1)
        full = F.when(i >= size, add(grown, F.get(chars, i - size), -1)).otherwise(grown)
        return F.struct(full["counts"].alias("counts"), full["s"].alias("s"), F.when(i >= size - 1, F.least(full["least"], full["s"])).otherwise(full["least"]).alias("least"))

    start = F.struct(none.alias("counts"), F.lit(0.0).alias("s"), F.lit(math.inf).alias("least"))
    done = F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), start, step)["least"]
    return F.when(F.length(s) > 0, F.log2(size) - done / size).otherwise(F.lit(0.0))


def _suspicious(s: Column) -> Column:
    """Mixed enough for its class: at least two of upper case, lower case and digits, and a window over the threshold."""
    has = [F.regexp_like(s, F.lit(p)).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")]
    limit = F.when(F.regexp_like(s, F.lit("^[0-9a-fA-F]+$")), F.lit(HEX_BITS)).when(F.regexp_like(s, F.lit("^[A-Za-z0-9]+$")), F.lit(ALNUM_BITS)).otherwise(F.lit(BASE64_BITS))
    # CASE stops at the first branch that holds, so entropy is computed for what is left
    return F.when(F.regexp_like(s, F.lit(ALLOW)), False).when(sum(has[1:], has[0]) < 2, False).otherwise(window_entropy(s) >= limit)


def _outside(candidates: Column, base: Column) -> Column:
    """Parts of the candidates, of LEAST characters or more, that the base spans, ordered by start, leave.

    Candidates and base spans are sorted together by start: a candidate's place
    among all less its place among candidates is the number of base spans
    before it, and those that begin in it follow up to the next candidate.
    """

    def left(x: Column, before: Column, after: Column, spans: Column, ends: Column) -> Column:
        starts = F.transform(F.filter(F.slice(spans, before + 1, after - before), lambda b: b["start"] < x["end"]), lambda b: b["start"])
        part = lambda at, k: F.struct(F.greatest(x["start"], F.get(ends, before + k)).alias("start"), at.alias("end"))
        parts = F.filter(F.transform(F.concat(starts, F.array(x["end"])), part), lambda p: p["end"] - p["start"] >= LEAST)
        return F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring(x["found"], p["start"] - x["start"] + 1, p["end"] - p["start"]).alias("found")))

    def cut(xs: Column, spans: Column, ends: Column) -> Column:
        events = F.array_sort(F.concat(F.transform(xs, lambda x, k: F.struct(x["start"].alias("at"), k.alias("which"))), F.transform(spans, lambda b: F.struct(b["start"].alias("at"), F.lit(1 << 30).alias("which")))))
        order = F.filter(F.transform(events, lambda e, i: F.struct((i - e["which"]).alias("before"), e["which"].alias("which"))), lambda e: e["which"] < (1 << 30))
        numbers = F.transform(order, lambda e: e["before"])
        return let(numbers, lambda n: F.flatten(F.transform(xs, lambda x, k: left(x, F.get(n, k), F.coalesce(F.get(n, k + 1), F.size(spans)), spans, ends))))

    with_base = lambda xs: let(base, lambda spans: let(running(F.transform(spans, lambda b: b["end"]), _larger), lambda ends: cut(xs, spans, ends)))
    return let(candidates, lambda xs: F.when((F.size(xs) > 0) & (F.size(base) > 0), with_base(xs)).otherwise(xs))


def _as_kind(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column `found`: array of (kind, start, end), ordered by start and then kind.

    Null and empty texts have none. Base spans are cut out of the candidates of
    the entropy scan, and what is left is scored part by part. A column named `found` in docs, in any case of letters, is replaced;
    all others stay, whatever their names.
    """
    t = F.coalesce(F.col("row")[text], F.lit(""))
    access_like = F.contains(t, F.lit("AKIA"))
    parts = docs.select(F.struct("*").alias("row")).withColumn("_assign", F.filter(spans_of(t, ASSIGN), lambda x: F.length(F.regexp_replace(x["found"], ASSIGN_LEAD, "")) >= ASSIGN_LEAST))
    parts = parts.withColumn("_access", F.when(access_like, spans_of(t, ACCESS)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))).withColumn("_hex", spans_of(t, HEX))
    parts = parts.withColumn("_base", F.array_sort(F.concat(*[_as_kind(f"_{k}", n) for n, k in enumerate(KINDS[:3])])))
    fresh = F.filter(_outside(spans_of(t, CANDIDATE), F.col("_base")), lambda x: _suspicious(x["found"]))
    parts = parts.withColumn("_entropy", fresh)
    every = F.array_sort(F.concat("_base", _as_kind("_entropy", 3)))
    named = F.transform(every, lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return parts.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "found"], named.alias("found"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with the spans, ordered by start, replaced; parts are cut from short blocks of the text, as substring counts from the start."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.shiftright(start, CUT_BITS)
        return F.substring(F.array_join(F.slice(blocks, first + 1, F.shiftright(end, CUT_BITS) - first + 1), ""), start.bitwiseAND((1 << CUT_BITS) - 1) + 1, end - start)

    def joined(blocks: Column, xs: Column, ends: Column) -> Column:
        kept = F.transform(xs, lambda x, k: F.when(x["start"] >= F.get(ends, k), F.concat(piece(blocks, F.get(ends, k), x["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(kept, ""), piece(blocks, F.get(ends, F.size(xs)), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CUT_BITS}}}"), F.lit(0))
    return let(spans, lambda xs: let(running(F.transform(xs, lambda x: x["end"]), _larger), lambda ends: let(blocks, lambda bs: joined(bs, xs, ends))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by `mark`; overlapping spans count as one. n_chars follows the text."""
    found = scan(docs.select(F.struct("*").alias("row"), "text"))
    clean = found.withColumn("_clean", F.when(F.size("found") > 0, _without(F.col("text"), F.col("found"), mark)).otherwise(F.col("text")))
    of = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.when(F.size("found") > 0, F.length("_clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(of["n_chars"])
    return clean.select(*[x.alias(c) for c, x in of.items()])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count_kind(k).alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("found", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))
