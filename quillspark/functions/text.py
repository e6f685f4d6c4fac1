"""Text functions as Spark columns. White space is Unicode's, as in Python's str.split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The characters of WHITE one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row.

    The optimiser merges projections, so a column that a lambda refers to may be
    computed anew for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, finish: Callable[[Column, Column], Column] = lambda _, out: out, block: int = 64) -> Column:
    """What a walk over an array puts out, in time nearly proportional to its length.

    step(state, item) is (next state, what is put out: of type `kind`, or null for
    nothing); finish(state, out) makes the result. Spark copies an accumulator in
    depth at each step of `aggregate`, so an array must not grow in it. Here a
    first walk keeps the state at the start of each block only, and a second one puts out block by block.
    The state should be small.
    """
    empty = F.array().cast(f"array<{kind}>")

    def walked(xs: Column) -> Column:
        part = lambda b: F.slice(xs, b * block + 1, F.lit(block))
        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(state.alias("state"), F.filter(F.array(state), lambda _: F.lit(False)).alias("starts"))
        over = lambda acc, b: F.struct(F.aggregate(part(b), acc["state"], lambda s, x: step(s, x)[0]).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

        def put(acc: Column, x: Column) -> Column:
            new, out = step(acc["state"], x)
            return F.struct(new.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

        def outs(ends: Column) -> Column:
            made = F.transform(ends["starts"], lambda s, b: F.aggregate(part(b), F.struct(s.alias("state"), empty.alias("out")), put, lambda acc: F.array_compact(acc["out"])))
            return finish(ends["state"], F.flatten(made))

        return let(F.aggregate(blocks, begin, over), outs)

    return let(items, walked)


def words(text: Column) -> Column:
    """Tokens between white space, never empty; null reads as no text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def terms(text: Column) -> Column:
    return words(F.lower(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def pieces(text: Column, delimiter: str) -> Column:
    """Parts between a literal delimiter, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\Q" + delimiter + r"\E"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts that end with ., ! or ? before white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){WHITE}+"), strip), lambda s: s != "")


def quantised(x: Column, digits: int) -> Column:
    """x at so many digits, halves up: the same in every engine, where round() is not."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def lexical_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token lists as sets, with a guarded denominator; 0 where one is empty."""
    size = lambda x: F.size(F.array_distinct(x)).cast("double")
    return F.size(F.array_intersect(a, b)) / (F.sqrt(size(a)) * F.sqrt(size(b)) + F.lit(1e-10))


def fact_found(answer: Column, fact: Column) -> Column:
    """Whether a fact occurs in an answer: in any case as it stands, or by its number.

    A numeric fact counts as found if its digits occur anywhere, also within a
    larger number; an empty fact always counts.
    """
    # fixed pattern of a numeric fact: sign, digits and commas, a fraction, a percent sign
    number = F.regexp_extract(strip(fact), r"^(-?[\d,]+\.?\d*)%?$", 1)
    return F.contains(F.lower(answer), F.lower(fact)) | ((number != "") & F.contains(F.lower(answer), number))
