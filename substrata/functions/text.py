"""String expressions. Positions and lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for "any one character" in a pattern; a private-use code point, so a real question mark stays itself.
WILDCARD = "\uE000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def between(low: Column, high: Column) -> Column:
    """ARRAY<INT> low..high, empty if high < low (sequence() alone would count down)."""
    return F.when(high >= low, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(F.array().cast("array<int>"))


def chars(s: Column | str) -> Column:
    """ARRAY<STRING> of the characters."""
    return F.filter(F.split(_c(s), ""), lambda x: x != "")


def from_chars(a: Column | str) -> Column:
    return F.array_join(_c(a), "")


def code_points(s: Column | str) -> Column:
    """ARRAY<INT>: the UTF-32 value of each character, read from its bytes in UTF-32."""
    return F.transform(chars(s), lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int"))


def prefixes(s: Column | str, most: int | None = None) -> Column:
    """All non-empty prefixes, shortest first, up to a length."""
    n = F.length(_c(s))
    return F.transform(between(F.lit(1), n if most is None else F.least(n, F.lit(most))), lambda i: F.substring(_c(s), F.lit(1), i))


def suffixes(s: Column | str, most: int | None = None) -> Column:
    """All non-empty suffixes, shortest first, up to a length."""
    n = F.length(_c(s))
    return F.transform(between(F.lit(1), n if most is None else F.least(n, F.lit(most))), lambda i: F.substring(_c(s), n - i + 1, i))


def substrings(s: Column | str, low: Column | int, high: Column | int) -> Column:
    """Every occurrence of a substring of length low..high, by length and then position."""
    s, low, high = _c(s), *(F.lit(x) if isinstance(x, int) else x for x in (low, high))
    n = F.length(s)
    return F.flatten(F.transform(between(F.greatest(low, F.lit(1)), F.least(high, n)), lambda k: F.transform(between(F.lit(1), n - k + 1), lambda i: F.substring(s, i, k))))


def qgrams(s: Column | str, q: int) -> Column:
    """ARRAY of the length-q substrings in order; empty if the string is shorter."""
    return F.transform(between(F.lit(1), F.length(_c(s)) - (q - 1)), lambda i: F.substring(_c(s), i, F.lit(q)))


def positional_qgrams(s: Column | str, q: int) -> Column:
    """ARRAY<STRUCT<pos INT, gram STRING>>, positions from 0."""
    return F.transform(between(F.lit(1), F.length(_c(s)) - (q - 1)), lambda i: F.struct((i - 1).alias("pos"), F.substring(_c(s), i, F.lit(q)).alias("gram")))


def parts(s: Column | str, n: int) -> Column:
    """n contiguous parts of nearly equal length; the first ones are one longer where the length doesn't divide."""
    s = _c(s)
    size = F.floor(F.length(s) / n).cast("int")
    rest = (F.length(s) % n).cast("int")
    return F.array(*[F.substring(s, F.lit(i) * size + F.least(F.lit(i), rest) + 1, size + F.when(F.lit(i) < rest, 1).otherwise(0)) for i in range(n)])


def gram_bound(q: Column | str, s: Column | str, gram: int) -> Column:
    """At most the substring edit distance: an edit touches one of the disjoint q-grams of q at most, so each that s lacks costs one."""
    q, s = _c(q), _c(s)
    places = between(F.lit(0), F.floor(F.length(q) / gram).cast("int") - 1)
    return F.size(F.filter(places, lambda k: ~F.contains(s, F.substring(q, k * gram + 1, F.lit(gram)))))


def sed_within(q: Column | str, s: Column | str, delta: int, banded: bool = False) -> Column:
    """Substring edit distance if it is at most delta, else something above delta.

    Smallest Levenshtein distance from q to a substring of s whose length is
    within delta of q's; the empty substring costs all of q. banded: let
    levenshtein() give up early.
    """
    q, s = _c(q), _c(s)
    n = F.length(q)
    within = substrings(s, F.greatest(n - delta, F.lit(1)), n + delta)
    if banded:
        near = F.transform(within, lambda t: F.levenshtein(q, t, delta))
        best = F.array_min(F.filter(near, lambda d: d >= 0))
        return F.least(n, F.coalesce(best, F.lit(delta + 1)))
    return F.least(n, F.coalesce(F.array_min(F.transform(within, lambda t: F.levenshtein(q, t))), n))


def sed(q: Column | str, s: Column | str) -> Column:
    """Substring edit distance, exact for all values: a fold over s of the column of the distance table."""
    q, s = _c(q), _c(s)
    letters, n = chars(q), F.length(q)
    start = F.struct(F.sequence(F.lit(0), n).alias("col"), n.alias("best"))

    def step(state: Column, x: Column) -> Column:
        old = state["col"]
        new = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.array(F.lit(0)),
            lambda made, i: F.when(i > n, made).otherwise(
                F.concat(made, F.array(F.least(F.element_at(made, -1) + 1, F.element_at(old, i + 1) + 1, F.element_at(old, i) + F.when(F.element_at(letters, i) == x, 0).otherwise(1))))
            ),
        )
        return F.struct(new.alias("col"), F.least(state["best"], F.element_at(new, -1)).alias("best"))

    return F.when(n == 0, 0).otherwise(F.aggregate(chars(s), start, step, lambda state: state["best"]))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix; 0 if either is null."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(between(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))


def masks(s: Column | str) -> Column:
    """All 2^n strings in which any set of characters is replaced by WILDCARD; bit i of a mask stands for character i."""
    letters = chars(s)
    n = F.size(letters)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1), lambda m: F.array_join(F.transform(letters, lambda x, i: F.when(F.call_function("shiftright", m, i) % 2 == 1, F.lit(WILDCARD)).otherwise(x)), ""))


def like_pattern(pattern: Column | str, inside: bool = True) -> Column:
    """For LIKE with backslash as escape: WILDCARD stands for one character, all others for themselves; inside: anywhere."""
    out = _c(pattern)
    for x in ("\\", "%", "_"):
        out = F.replace(out, F.lit(x), F.lit("\\" + x))
    out = F.replace(out, F.lit(WILDCARD), F.lit("_"))
    return F.concat(F.lit("%"), out, F.lit("%")) if inside else out


def contains_pattern(s: Column | str, pattern: Column | str) -> Column:
    return F.like(_c(s), like_pattern(pattern))


def matches_pattern(s: Column | str, pattern: Column | str) -> Column:
    return F.like(_c(s), like_pattern(pattern, inside=False))


def is_ascii(s: Column | str) -> Column:
    return F.octet_length(_c(s)) == F.length(_c(s))


def fixed_width(s: Column | str, widths: list[int]) -> Column:
    """ARRAY: the string cut into pieces of the given lengths."""
    starts = [1 + sum(widths[:k]) for k in range(len(widths))]
    return F.array(*[F.substring(_c(s), a, w) for a, w in zip(starts, widths, strict=True)])


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """The part after the last full stop of the file name, empty if there is none."""
    return F.regexp_extract(basename(path), r"\.([^.]*)$", 1)


def csv_token(s: Column | str) -> Column:
    """Quoted if it holds a comma or a quote, quotes doubled."""
    s = _c(s)
    return F.when(s.rlike('[,"]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def padded(a: Column | str, length: int, value=0, post: bool = True) -> Column:
    """Exactly so many elements: cut or filled up at the end, or at the front."""
    a = _c(a)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    if post:
        return F.slice(F.concat(a, fill), 1, length)
    whole = F.concat(fill, a)
    return F.slice(whole, F.size(whole) - (length - 1), F.lit(length))


def one_hot(ids: Column | str, width: int) -> Column:
    """ARRAY<ARRAY<INT>>: for each id (from 0) a row with a 1 at its place."""
    return F.transform(_c(ids), lambda k: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: (j == k).cast("int")))


def bit_positions(ids: Column | str, most_length: int, tau: int) -> Column:
    """Places of the 1 bits that encode a string with room for tau shifts: the character with id c (from 0) at place p
    sets p to p + 2 tau in its block of most_length + 2 tau bits. Sorted and distinct."""
    width = most_length + 2 * tau
    spans = F.transform(_c(ids), lambda c, p: F.sequence(c * width + p, c * width + p + 2 * tau))
    return F.array_sort(F.array_distinct(F.flatten(spans)))
