"""Positions of regular-expression matches, as Catalyst expressions only.

Spark returns matches or the text between them, not offsets. Both together give the
offsets: a match starts where all earlier pieces and matches end. ``length`` counts code
points, so the offsets do too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed one by one inside a block, and levels of blocks of blocks: an element costs about ``_BLOCK / 2`` additions
#: a level, and the blocks of the last level, of which a text of 16 million matches has a thousand, are summed one by one.
_BLOCK, _LEVELS = 128, 2
SPAN = "array<struct<s:int,e:int,m:string,before:string,left:string,right:string,near:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.transform(F.array(value), body)[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def prefix_sums(lens: Column, levels: int = _LEVELS) -> Column:
    """Exclusive prefix sums of a non-empty array<int>."""

    def inner(a: Column) -> Column:
        if not levels:
            return F.transform(a, lambda _, i: _total(F.slice(a, F.lit(1), i)))
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), block(F.size(a) - 1)), lambda b: _total(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(prefix_sums(sums, levels - 1), lambda s: F.transform(a, lambda _, i: s[block(i)] + _total(F.slice(a, block(i) * _BLOCK + 1, i % _BLOCK))))

    return let(lens, inner)


def _around(p: Column, h: Column, window: int, body: Callable[[Callable[[Column], Column], Callable[[Column], Column]], Column]) -> Column:
    """``body`` of the up to ``window`` code points before and after match ``i``, across its neighbours.

    A neighbour gives its own ``window`` at most and a match is never empty, so ``window`` neighbours reach far enough.
    """
    if not window:
        return body(lambda i: F.lit(""), lambda i: F.lit(""))
    w = F.lit(window)
    ends = F.transform(h, lambda m, i: F.right(F.concat(p[i], m), w))
    starts = F.transform(h, lambda m, i: F.left(F.concat(m, p[i + 1]), w))

    def both(x: Column, y: Column) -> Column:
        before = lambda i: F.right(F.concat(F.array_join(F.slice(x, F.greatest(F.lit(1), i - window + 1), F.least(i, w)), ""), F.right(p[i], w)), w)
        after = lambda i: F.left(F.concat(F.left(p[i + 1], w), F.array_join(F.slice(y, i + 2, w), "")), w)
        return body(before, after)

    return let(ends, lambda x: let(starts, lambda y: both(x, y)))


def _said(p: Column, context: int, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of the nearest pieces around match ``i`` that are more than separators, cut to ``context``."""
    if not context:
        return body(lambda i: F.lit(""))
    says = lambda x: x.rlike(r"\p{L}") | (F.length(x) > context)
    flags = F.transform(p, lambda x: F.when(says(x), 1).otherwise(0))
    cut = lambda x: F.coalesce(x, F.lit(""))

    def near(told: Column, before: Column) -> Column:
        # Before piece ``i`` stand ``before[i]`` telling pieces; of those up to it the last, of those after it the first.
        last = lambda i: F.right(cut(F.get(told, before[i + 1] - 1)), F.lit(context))
        first = lambda i: F.left(cut(F.get(told, before[i + 1])), F.lit(context))
        return body(lambda i: F.concat(last(i), F.lit("\n"), first(i)))

    return let(F.filter(p, says), lambda told: let(prefix_sums(flags), lambda before: near(told, before)))


def matches(text: Column, pattern: str, present: Column, context: int = 0, window: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array<struct<s,e,m,before,left,right,near>>.

    ``present`` is a cheap necessary condition; where it fails the expression is an empty
    array. ``before`` holds up to ``context`` code points between the previous match and
    this one; ``left`` and ``right`` the ``window`` code points of the text on either side,
    other matches included. ``near`` is, with ``context``, the ``context`` code points of the nearest
    texts on either side that say something: texts between matches that hold no letter and are no longer
    than ``context`` are passed over, so a heading reaches all of a column. Patterns must not match the
    empty string.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(SPAN)

    def spans(p: Column, h: Column) -> Column:
        steps = F.transform(h, lambda m, i: F.length(p[i]) + F.length(m))

        def found(at: Column, left: Callable[[Column], Column], right: Callable[[Column], Column], near: Callable[[Column], Column]) -> Column:
            return F.transform(
                h,
                lambda m, i: F.struct(
                    (at[i] + F.length(p[i])).alias("s"),
                    (at[i] + F.length(p[i]) + F.length(m)).alias("e"),
                    m.alias("m"),
                    (F.right(p[i], F.lit(context)) if context else F.lit("")).alias("before"),
                    left(i).alias("left"),
                    right(i).alias("right"),
                    near(i).alias("near"),
                ),
            )

        return let(prefix_sums(steps), lambda at: _around(p, h, window, lambda left, right: _said(p, context, lambda near: found(at, left, right, near))))

    found = let(hits, lambda h: F.when(F.size(h) > 0, let(pieces, lambda p: spans(p, h))).otherwise(empty))
    return F.when(present, found).otherwise(empty)


def flat(text: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(text, F.lit(""))
