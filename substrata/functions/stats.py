"""Numeric expressions: MinHash signatures, errors of estimates, scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Mersenne prime 2^31 - 1: products of hashed ids stay within a BIGINT.
PRIME = 2**31 - 1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_coefficients(n: int, seed: int = 0) -> list[tuple[int, int]]:
    """(a, b) of n hash functions: a from 1 and b from 0, both below PRIME."""
    r = np.random.RandomState(seed)
    return [(int(r.randint(1, PRIME)), int(r.randint(0, PRIME))) for _ in range(n)]


def linear_hash(x: Column | str, a: int, b: int) -> Column:
    return (_c(x).cast("long") * F.lit(a) + F.lit(b)) % F.lit(PRIME)


def equal_share(a: Column | str, b: Column | str) -> Column:
    """Estimated Jaccard similarity: the share of places at which two signatures agree."""
    a, b = _c(a), _c(b)
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def signature_union(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.least(x, y))


def signature_intersection(a: Column | str, b: Column | str) -> Column:
    """The larger of each pair: what stands in for the signature of the intersection."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(x, y))


def union_size(n: Column | str, m: Column | str, share: Column) -> Column:
    """Size of a union of sets of sizes n and m with that Jaccard similarity."""
    return (_c(n) + _c(m)) / (1 + share)


def intersection_size(counts: Column | str, signatures: Column | str) -> Column:
    """Size of the intersection of several sets, from ARRAY of sizes and ARRAY of signatures.

    The largest set's size over its share of the union gives the union, whose
    share at which all signatures agree is the intersection. The share is at
    least the largest size over the sum of sizes.
    """
    counts, signatures = _c(counts), _c(signatures)
    places = F.sequence(F.lit(0), F.size(signatures[0]) - 1)
    n = F.size(signatures[0])
    most = F.array_max(counts)
    largest = signatures[F.array_position(counts, most).cast("int") - 1]
    at = lambda k: F.transform(signatures, lambda s: s[k])
    share = F.size(F.filter(places, lambda k: largest[k] == F.array_min(at(k)))) / n
    floor = most / F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    agree = F.size(F.filter(places, lambda k: F.array_min(at(k)) == F.array_max(at(k)))) / n
    return most / F.greatest(share, floor) * agree


def q_error(y: Column | str, estimate: Column | str) -> Column:
    """max(y / e, e / y), both raised to 1 at least."""
    y, e = (F.greatest(_c(x).cast("double"), F.lit(1.0)) for x in (y, estimate))
    return F.greatest(y / e, e / y)


def q_error_eps(y: Column | str, estimate: Column | str, eps: float = 10.0) -> Column:
    """The same with eps added to both and the estimate raised to 0 at least."""
    y, e = _c(y).cast("double") + eps, F.greatest(_c(estimate).cast("double"), F.lit(0.0)) + eps
    return F.greatest(y / e, e / y)


def log10_error(y: Column | str, estimate: Column | str) -> Column:
    return F.log10(F.greatest(_c(estimate).cast("double"), F.lit(1.0)) / F.greatest(_c(y).cast("double"), F.lit(1.0)))


def squared_log_error(y: Column | str, estimate: Column | str) -> Column:
    return F.pow(F.log1p(_c(estimate).cast("double")) - F.log1p(_c(y).cast("double")), F.lit(2.0))


def log_scaled(y: Column | str, low: Column, high: Column) -> Column:
    """(ln max(1, y) - low) / (high - low), kept within 0 and 1; 0 if low is high."""
    x = (F.ln(F.greatest(_c(y).cast("double"), F.lit(1.0))) - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def log_unscaled(x: Column | str, low: Column, high: Column) -> Column:
    return F.exp(_c(x) * (high - low) + low)
