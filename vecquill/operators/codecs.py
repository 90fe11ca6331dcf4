"""Vector codes: trained on a bounded sample in numpy, applied to all rows over Arrow batches.

A model is a dictionary of arrays whose sizes depend on the dimensions and the bits, never on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecquill.plans.spec import SCALAR, Code

Model = dict[str, np.ndarray]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals; in blocks."""
    size = (centres**2).sum(1)
    blocks = [(size - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)]
    return np.concatenate(blocks) if blocks else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, steps: int = 25, seed: int = 1234, spherical: bool = False) -> np.ndarray:
    """Lloyd's steps; an empty cluster takes half of the largest. With fewer rows than k, rows repeat. spherical: centres of length 1."""
    if not len(x):
        raise ValueError("no vectors to train on")
    centres = x[np.random.default_rng(seed).permutation(len(x))[np.arange(k) % len(x)]].copy()
    for _ in range(steps if len(x) > k else 0):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k).astype(float)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        for empty in np.flatnonzero(n == 0):
            big = int(n.argmax())
            centres[empty], centres[big] = centres[big] * (1 + 1 / 1024), centres[big] * (1 - 1 / 1024)
            n[empty] = n[big] = n[big] / 2
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _bits(code: Code) -> list[tuple[int, int]]:
    return [(m, b) for m, b in enumerate(code.sizes)]


def train(code: Code, x: np.ndarray) -> Model:
    d = x.shape[1]
    if code.kind == "sq" and SCALAR[code.name] is not None:
        return {"low": x.min(0), "width": np.ptp(x, axis=0)}
    if code.kind == "pq":
        w = d // len(code.sizes)
        return {f"book{m}": kmeans(x[:, m * w : (m + 1) * w], 1 << b) for m, b in _bits(code)}
    if code.kind == "pqr":
        first, second = _halves(code)
        model = train(first, x)
        rest = x - decode(first, model, encode(first, model, x), d)
        return model | {f"fine_{k}": v for k, v in train(second, rest).items()}
    if code.kind in ("rq", "lsq"):
        per, model = len(code.sizes) // code.splits, {}
        for i, part in enumerate(np.split(x, code.splits, axis=1)):
            books = _residual_books(part, code.sizes[i * per : (i + 1) * per])
            books = books if code.kind == "rq" else _additive_books(part, books)
            model |= {f"book{i * per + m}": b for m, b in enumerate(books)}
        return model
    if code.kind == "sh":
        z = _turned(x, {"turn": train_turn(code, x)}, 0)
        return {"turn": train_turn(code, x), "cut": np.median(z, axis=0) if code.name.endswith("m") else np.zeros(z.shape[1])}
    if code.kind == "lattice":
        norms = np.linalg.norm(x.reshape(len(x), code.splits, -1), axis=2)
        return {"low": norms.min(0), "width": np.ptp(norms, axis=0)}
    if code.kind == "minmax":
        return {f"in_{k}": v for k, v in train(code.inner, _unit_rows(x)[0]).items()}
    if code.kind == "lsh":
        bits, model = len(code.sizes), {}
        if code.rotate:
            wide = max(bits, d)
            model["turn"] = np.linalg.qr(np.random.default_rng(5).normal(size=(wide, wide)))[0][:d, :bits]
        if code.thresholds:
            model["cut"] = np.median(_turned(x, model, bits), axis=0)
        return model
    if code.kind == "rabitq":
        return {"centre": x.mean(0)}
    return {}


def train_turn(code: Code, x: np.ndarray) -> np.ndarray:
    """The principal directions of a spectral code."""
    values, directions = np.linalg.eigh(np.cov((x - x.mean(0)).T, bias=True).reshape(x.shape[1], -1))
    return directions[:, np.argsort(-values, kind="stable")[: len(code.sizes)]]


def _halves(code: Code) -> tuple[Code, Code]:
    """A product code, and the product code of what it leaves."""
    return Code("pq", code.name, code.sizes[: code.splits]), Code("pq", code.name, code.sizes[code.splits :])


def _residual_books(x: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    books, rest = [], x
    for b in sizes:
        books.append(kmeans(rest, 1 << b))
        rest = rest - books[-1][nearest(rest, books[-1])]
    return books


def beam_codes(x: np.ndarray, books: list[np.ndarray], beam: int = 5) -> np.ndarray:
    """Codes of a sum of entries, one of each book: after each book the ``beam`` sums nearest to the vector are kept."""
    out = []
    for lo in range(0, len(x), 256):
        rest, codes = x[lo : lo + 256, None, :], np.zeros((len(x[lo : lo + 256]), 1, 0), np.int64)
        for book in books:
            d = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
            n, b, k = d.shape
            best = np.argsort(d.reshape(n, b * k), axis=1, kind="stable")[:, : min(beam, b * k)]
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, best // k], (best % k)[:, :, None]], axis=2)
            rest = rest[row, best // k] - book[best % k]
        out.append(codes[:, 0])
    return np.concatenate(out) if out else np.zeros((0, len(books)), np.int64)


def searched_codes(x: np.ndarray, books: list[np.ndarray], rounds: int = 4) -> np.ndarray:
    """Codes of a sum of entries by local search: each book's entry in turn is the best for what the others leave."""
    codes = beam_codes(x, books, 1)
    total = sum(b[codes[:, m]] for m, b in enumerate(books))
    for _ in range(rounds if len(x) else 0):
        for m, b in enumerate(books):
            rest = x - (total - b[codes[:, m]])
            total = total - b[codes[:, m]]
            codes[:, m] = nearest(rest, b)
            total = total + b[codes[:, m]]
    return codes


def _additive_books(x: np.ndarray, books: list[np.ndarray], rounds: int = 6) -> list[np.ndarray]:
    """Books that fit the codes of a local search by least squares, in turn with these."""
    ends = np.cumsum([0] + [len(b) for b in books])
    for _ in range(rounds):
        codes = searched_codes(x, books, 2) + ends[:-1]
        gram, sums = np.zeros((ends[-1], ends[-1])), np.zeros((ends[-1], x.shape[1]))
        for m in range(len(books)):
            np.add.at(sums, codes[:, m], x)
            for n in range(len(books)):
                np.add.at(gram, (codes[:, m], codes[:, n]), 1.0)
        fit = np.linalg.solve(gram + 1e-3 * np.eye(len(gram)), sums + 1e-3 * np.concatenate(books))
        books = [fit[a:b] for a, b in zip(ends, ends[1:])]
    return books


def lattice_points(x: np.ndarray, radius2: int) -> np.ndarray:
    """The integer points of squared length ``radius2`` in the direction nearest to each row."""
    n = x.shape[1]
    shapes: list[list[int]] = []

    def grow(rest: int, most: int, own: list[int]) -> None:
        if len(own) == n or not rest:
            if not rest:
                shapes.append(own + [0] * (n - len(own)))
            return
        for v in range(min(most, int(rest**0.5)), 0, -1):
            grow(rest - v * v, v, [*own, v])

    grow(radius2, radius2, [])
    if not shapes:
        raise ValueError(f"no integer point of {n} dimensions has the squared length {radius2}")
    order = np.argsort(-np.abs(x), axis=1, kind="stable")
    shape = np.array(shapes)[(np.take_along_axis(np.abs(x), order, 1) @ np.array(shapes, float).T).argmax(1)]
    out = np.zeros(x.shape, np.int64)
    np.put_along_axis(out, order, shape, 1)
    return np.where(x < 0, -out, out)


def _unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row moved and scaled to [0, 1], with its least component and its width."""
    low, width = x.min(1, keepdims=True), np.ptp(x, axis=1)[:, None]
    return np.divide(x - low, width, out=np.zeros_like(x), where=width > 0), low, width


def sign_periods(z: np.ndarray, period: float) -> np.ndarray:
    """The bits of a spectral code: which half of the period a value lies in."""
    return np.floor(z * 2 / period).astype(np.int64) & 1


def _turned(x: np.ndarray, model: Model, bits: int) -> np.ndarray:
    return x @ model["turn"] if "turn" in model else x[:, :bits]


def _pack(numbers: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Numbers of the given bits, the low bit first, as bytes."""
    bits = np.concatenate([(numbers[:, m, None] >> np.arange(b)) & 1 for m, b in enumerate(sizes)], axis=1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
    ends = np.cumsum((0, *sizes))
    return np.stack([(bits[:, a:b] << np.arange(b - a)).sum(1) for a, b in zip(ends, ends[1:])], axis=1)


def encode(code: Code, model: Model, x: np.ndarray) -> np.ndarray:
    """Codes, one row of bytes each."""
    if code.kind == "sq":
        levels = SCALAR[code.name]
        if levels is not None:
            part = np.divide(x - model["low"], model["width"], out=np.zeros_like(x), where=model["width"] > 0)
            numbers = np.floor(np.clip(part, 0, 1) * levels).astype(np.int64)
            return _pack(numbers, (levels.bit_length(),) * x.shape[1])
        if code.name == "SQfp16":
            return np.ascontiguousarray(x.astype("<f2")).view(np.uint8)
        if code.name == "SQbf16":
            word = np.ascontiguousarray(x.astype("<f4")).view("<u4")
            return np.ascontiguousarray(((word + 0x7FFF + ((word >> 16) & 1)) >> 16).astype("<u2")).view(np.uint8)
        return np.clip(np.round(x) + (128 if code.name.endswith("signed") else 0), 0, 255).astype(np.uint8)
    if code.kind == "pq":
        w = x.shape[1] // len(code.sizes)
        return _pack(np.stack([nearest(x[:, m * w : (m + 1) * w], model[f"book{m}"]) for m, _ in _bits(code)], axis=1), code.sizes)
    if code.kind == "pqr":
        (first, second), fine = _halves(code), {k[5:]: v for k, v in model.items() if k.startswith("fine_")}
        raw = encode(first, model, x)
        return np.concatenate([raw, encode(second, fine, x - decode(first, model, raw, x.shape[1]))], axis=1)
    if code.kind in ("rq", "lsq"):
        per = len(code.sizes) // code.splits
        codes = beam_codes if code.kind == "rq" else searched_codes
        parts = np.split(x, code.splits, axis=1)
        return _pack(np.concatenate([codes(part, [model[f"book{i * per + m}"] for m in range(per)]) for i, part in enumerate(parts)], axis=1), code.sizes)
    if code.kind == "sh":
        return _pack(sign_periods(x @ model["turn"] - model["cut"], code.period), code.sizes)
    if code.kind == "lattice":
        parts = x.reshape(len(x), code.splits, -1)
        norms = np.linalg.norm(parts, axis=2)
        part = np.divide(norms - model["low"], model["width"], out=np.zeros_like(norms), where=model["width"] > 0)
        numbers = np.floor(np.clip(part, 0, 1) * ((1 << code.sizes[0]) - 1) + 0.5).astype("<u4")
        points = lattice_points(parts.reshape(-1, parts.shape[2]), int(code.period)).astype(np.int8).reshape(len(x), -1)
        return np.concatenate([points.view(np.uint8), np.ascontiguousarray(numbers).view(np.uint8).reshape(len(x), -1)], axis=1)
    if code.kind == "minmax":
        unit, low, width = _unit_rows(x)
        kind = "<f2" if code.half else "<f4"
        head = np.ascontiguousarray(np.concatenate([low, width], axis=1).astype(kind)).view(np.uint8).reshape(len(x), -1)
        return np.concatenate([head, encode(code.inner, {k[3:]: v for k, v in model.items()}, unit)], axis=1)
    if code.kind == "lsh":
        return _pack((_turned(x, model, len(code.sizes)) - model.get("cut", 0.0) >= 0).astype(np.int64), code.sizes)
    if code.kind == "rabitq":
        z = x - model["centre"]
        off = np.abs(z).sum(1)
        step = np.divide((z * z).sum(1), off, out=np.zeros(len(z)), where=off > 0)
        return np.concatenate([_pack((z > 0).astype(np.int64), (1,) * x.shape[1]), np.ascontiguousarray(step.astype("<f8")).view(np.uint8).reshape(-1, 8)], axis=1)
    return np.ascontiguousarray(x.astype("<f4")).view(np.uint8)


def decode(code: Code, model: Model, raw: np.ndarray, d: int) -> np.ndarray:
    """Vectors of d dimensions; for sign codes the bits."""
    if code.kind == "sq":
        levels = SCALAR[code.name]
        if levels is not None:
            return (_unpack(raw, (levels.bit_length(),) * d) + 0.5) / levels * model["width"] + model["low"]
        if code.name == "SQfp16":
            return raw.view("<f2").astype(float)
        if code.name == "SQbf16":
            return (raw.view("<u2").astype("<u4") << 16).view("<f4").astype(float)
        return raw.astype(float) - (128 if code.name.endswith("signed") else 0)
    if code.kind == "pq":
        numbers = _unpack(raw, code.sizes)
        return np.concatenate([model[f"book{m}"][numbers[:, m]] for m, _ in _bits(code)], axis=1)
    if code.kind == "pqr":
        (first, second), fine = _halves(code), {k[5:]: v for k, v in model.items() if k.startswith("fine_")}
        n = (sum(first.sizes) + 7) // 8
        return decode(first, model, np.ascontiguousarray(raw[:, :n]), d) + decode(second, fine, np.ascontiguousarray(raw[:, n:]), d)
    if code.kind in ("rq", "lsq"):
        numbers, per = _unpack(raw, code.sizes), len(code.sizes) // code.splits
        return np.concatenate([sum(model[f"book{m}"][numbers[:, m]] for m in range(i * per, (i + 1) * per)) for i in range(code.splits)], axis=1)
    if code.kind == "sh":
        return _unpack(raw, code.sizes).astype(float)
    if code.kind == "lattice":
        points = np.ascontiguousarray(raw[:, :d]).view(np.int8).astype(float).reshape(len(raw), code.splits, -1)
        numbers = np.ascontiguousarray(raw[:, d:]).view("<u4")
        norms = numbers / ((1 << code.sizes[0]) - 1) * model["width"] + model["low"]
        return (points / code.period**0.5 * norms[:, :, None]).reshape(len(raw), -1)
    if code.kind == "minmax":
        size = 4 if code.half else 8
        head = np.ascontiguousarray(raw[:, :size]).view("<f2" if code.half else "<f4").astype(float)
        return decode(code.inner, {k[3:]: v for k, v in model.items()}, np.ascontiguousarray(raw[:, size:]), d) * head[:, 1:] + head[:, :1]
    if code.kind == "lsh":
        return _unpack(raw, code.sizes).astype(float)
    if code.kind == "rabitq":
        signs = _unpack(np.ascontiguousarray(raw[:, :-8]), (1,) * d) * 2.0 - 1.0
        return model["centre"] + signs * np.ascontiguousarray(raw[:, -8:]).view("<f8")
    return raw.view("<f4").astype(float)


def _mapped(step: Callable[[list], list], type_: str) -> Callable[[Column], Column]:
    @F.pandas_udf(type_)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            good = rows.notna()
            if good.any():
                out[good] = pd.Series(step(rows[good].tolist()), index=rows.index[good], dtype=object)
            yield out

    return run


def encoder(code: Code, model: Model) -> Callable[[Column], Column]:
    """Vectors to bytes; null stays null."""
    return _mapped(lambda rows: [c.tobytes() for c in encode(code, model, np.array(rows, float))], "binary")


def numbered(code: Code, model: Model) -> Callable[[Column], Column]:
    """Vectors to the numbers of their code; null stays null."""
    return _mapped(lambda rows: list(_unpack(encode(code, model, np.array(rows, float)), code.sizes).astype(np.int32)), "array<int>")


def decoder(code: Code, model: Model, d: int) -> Callable[[Column], Column]:
    """Bytes to vectors; null stays null."""
    return _mapped(lambda rows: list(decode(code, model, np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), d)), "array<double>")


# ---- distance tables of product codes
def split_tables(queries: np.ndarray, model: Model, code: Code, inner: bool) -> np.ndarray:
    """(parts, queries, entries): each query's part against each entry of the part's book: inner products or squared distances."""
    w = queries.shape[1] // len(code.sizes)
    out = []
    for m, _ in _bits(code):
        q, book = queries[:, m * w : (m + 1) * w], model[f"book{m}"]
        out.append(q @ book.T if inner else ((q[:, None, :] - book[None, :, :]) ** 2).sum(2))
    return np.stack(out)


def looked_up(tables: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """(rows, queries): the sums of the tables' entries at the rows' codes."""
    total = np.zeros((len(numbers), tables.shape[1]))
    for m in range(len(tables)):
        total += tables[m].T[numbers[:, m]]
    return total


def numbers_of(raw: np.ndarray, code: Code) -> np.ndarray:
    """The numbers of packed codes; codes of whole bytes are taken as they are."""
    return raw if set(code.sizes) == {8} else _unpack(raw, code.sizes)
