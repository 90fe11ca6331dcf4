"""Column expressions over vectors (arrays of numbers): metrics, norms, codes. All are evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def zero() -> Column:
    return F.lit(0.0)


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def fold_sum(v: Column) -> Column:
    """The sum of an array in order."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def sum_of(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return fold_sum(F.zip_with(a, b, f))


def inner_product(a: Column, b: Column) -> Column:
    return sum_of(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; no root is taken."""
    return sum_of(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return sum_of(a, b, lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def lp(p: float) -> Callable[[Column, Column], Column]:
    """Sum of |x - y| to the power p; no root is taken."""
    if float(p).is_integer() and 1 <= p <= 8:
        def power(d: Column) -> Column:
            out = d
            for _ in range(int(p) - 1):
                out = out * d
            return out
    else:
        def power(d: Column) -> Column:
            return F.pow(d, F.lit(float(p)))
    return lambda a, b: sum_of(a, b, lambda x, y: power(F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    return sum_of(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, F.lit(float("nan"))).otherwise(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), zero())))


def bray_curtis(a: Column, b: Column) -> Column:
    return l1(a, b) / F.nullif(sum_of(a, b, lambda x, y: F.abs(x + y)), zero())


def jensen_shannon(a: Column, b: Column) -> Column:
    """For positive components."""
    return sum_of(a, b, lambda x, y: -x * F.ln((x + y) / 2 / x) - y * F.ln((x + y) / 2 / y)) * 0.5


def jaccard(a: Column, b: Column) -> Column:
    """For positive components; larger is nearer."""
    return sum_of(a, b, lambda x, y: F.least(x, y)) / F.nullif(sum_of(a, b, lambda x, y: F.greatest(x, y)), zero())


def nan_euclidean(a: Column, b: Column) -> Column:
    """Over the components that both have, scaled to all; NaN if there are none."""
    ok = lambda x, y: ~(F.isnan(x) | F.isnan(y))
    present = sum_of(a, b, lambda x, y: F.when(ok(x, y), 1.0).otherwise(0.0))
    part = sum_of(a, b, lambda x, y: F.when(ok(x, y), (x - y) * (x - y)).otherwise(0.0))
    return F.when(present == 0, F.lit(float("nan"))).otherwise(F.size(a) / F.nullif(present, zero()) * part)


def gower(a: Column, b: Column) -> Column:
    """Mean of |x - y| for components in [0, 1] and of mismatches for negative (categorical) ones; NaN for mixed signs or beyond 1."""
    bad = lambda x, y: (x > 1) | (y > 1) | ((x < 0) != (y < 0))
    one = lambda x, y: F.when(bad(x, y), F.lit(float("nan"))).when(x < 0, F.when(x == y, 0.0).otherwise(1.0)).otherwise(F.abs(x - y))
    return sum_of(a, b, one) / F.size(a)


def norm(a: Column) -> Column:
    return F.sqrt(fold_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(inner_product(a, b) / F.nullif(na * nb, zero()))


#: Name -> (expression, larger is nearer). Aliases as accepted by the factory call, in lower case.
METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "ip": (inner_product, True), "l2": (l2, False), "l1": (l1, False), "linf": (linf, False), "canberra": (canberra, False), "braycurtis": (bray_curtis, False),
    "jensenshannon": (jensen_shannon, False), "jaccard": (jaccard, True), "nan_euclidean": (nan_euclidean, False), "gower": (gower, False), "cosine": (cosine, True),
}
ALIASES = {"innerproduct": "ip", "manhattan": "l1", "cityblock": "l1", "infinity": "linf"}


def metric(name: str, p: float | None = None) -> tuple[Callable[[Column, Column], Column], bool]:
    key = ALIASES.get(name.lower(), name.lower())
    if key == "lp":
        if p is None:
            raise ValueError("metric lp needs p")
        return lp(p), False
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return METRICS[key]


def normalized(a: Column) -> Column:
    """v / |v|; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def sign_bits(a: Column, lo: int, hi: int) -> Column:
    """Bits lo to hi - 1 of the sign code: bit j is set if component j is not negative."""
    return F.aggregate(F.sequence(F.lit(lo), F.lit(hi - 1)), F.lit(0).cast("bigint"), lambda s, i: s + F.when(F.get(a, i) >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i - lo)).otherwise(F.lit(0).cast("bigint")))


def scalar_code(x: Column, lo: Column, width: Column, levels: int) -> Column:
    """Scalar quantizer: floor(levels * (x - lo) / width), the fraction kept in [0, 1]."""
    part = F.when(width == 0, 0.0).otherwise((x - lo) / F.nullif(width, zero()))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * levels).cast("int")


def padded(a: Column, size: int) -> Column:
    """Zeros behind the components up to the size; a longer vector stays."""
    return F.when(F.size(a) >= size, a).otherwise(F.concat(a, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(a))))


def scaled(a: Column, mode: int) -> Column:
    """-1 none, 0 greatest absolute component to 32760, 2 Euclidean, else the norm of that power; a zero vector gives zeros."""
    if mode == -1:
        return a
    if mode == 0:
        size = F.array_max(F.transform(a, F.abs)) / 32760.0
    elif mode == 2:
        size = norm(a)
    else:
        size = F.pow(fold_sum(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(mode))))), F.lit(1.0 / mode))
    return F.transform(a, lambda x: F.when(size > 0, x / F.nullif(size, zero())).otherwise(0.0))


def packer(half: bool = False) -> Callable[[Column], Column]:
    """Numbers to little-endian bytes of 32 or 16 bits a component, over Arrow batches."""
    kind = "<f2" if half else "<f4"

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda v: None if v is None else np.asarray(v, kind).tobytes())

    return run


def unpacker(half: bool = False) -> Callable[[Column], Column]:
    """Bytes to numbers; an empty or ragged value is an error."""
    kind = "<f2" if half else "<f4"

    def one(b: bytes | None) -> np.ndarray | None:
        if b is None:
            return None
        if not b or len(b) % np.dtype(kind).itemsize:
            raise ValueError(f"{len(b)} bytes are no whole number of components")
        return np.frombuffer(b, kind).astype(np.float32)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(one)

    return run


def reformatter(to_half: bool) -> Callable[[Column], Column]:
    """Bytes of 32-bit floats to bytes of 16-bit floats, or back; an empty or ragged value is an error."""
    old, new = ("<f4", "<f2") if to_half else ("<f2", "<f4")

    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        if not b or len(b) % np.dtype(old).itemsize:
            raise ValueError(f"{len(b)} bytes are no whole number of components")
        return np.frombuffer(b, old).astype(new).tobytes()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(one)

    return run


#: What converts between numbers and packed bytes.
CONVERTER_BACKEND = "arrow"
