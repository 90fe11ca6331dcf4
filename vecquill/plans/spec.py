"""Index descriptions: a string such as ``"OPQ8,IVF64,PQ8x4,RFlat"`` as a specification of steps.

In order: an id map before or behind (ids are always kept, so it changes nothing), refinement behind, transforms in
front, one coarse step or graph, one code. What is not built is refused: a description never gives another index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from vecquill.functions.vectors import ALIASES, METRICS

#: Scalar codes: name -> levels, or None for those that need no training.
SCALAR = {"SQ8": 255, "SQ6": 63, "SQ4": 15, "SQfp16": None, "SQbf16": None, "SQ8_direct": None, "SQ8_direct_signed": None}

_TRANSFORM = re.compile(r"PCA(?P<w>W?)(?P<r>R?)(?P<pca>\d+)|(?P<l2>L2norm)|RR(?P<rr>\d*)|ITQ(?P<itq>\d*)|OPQ(?P<opq>\d+)(?:_(?P<opqd>\d+))?|Pad(?P<pad>\d+)")
_COARSE = re.compile(r"IVF(\d+)([kM]?)(?:_(HNSW|NSG)(\d*)|\((HNSW|NSG)(\d*)(?:,Flat)?\))?")
_MULTI = re.compile(r"IMI2x(\d+)")
_LAYERS = re.compile(r"Residual(?:(\d+)x)?(\d+)")
_PRODUCT = re.compile(r"PQ(\d+)(?:x(\d+))?(?:fs(?:r)?(?:_\d+)?|np)?")
_REFINED = re.compile(r"PQ(\d+)\+(\d+)")
_RESIDUAL = re.compile(r"(RQ|LSQ)((?:\d+x\d+_?)+)(?:fsr?)?")
_PRODUCT_SUM = re.compile(r"P(RQ|LSQ)(\d+)x(\d+)x(\d+)(?:fsr?)?")
_SPECTRAL = re.compile(r"(?:PCAR?|ITQ)(\d+),SH([\d.]+)([gcm]?)")
_LATTICE = re.compile(r"ZnLattice(\d+)x(\d+)_(\d+)")
_MINMAX = re.compile(r"MinMax(FP16)?,(.+)")
_SIGNS = re.compile(r"LSH(\d*)(r?)(t?)")
_GRAPH = re.compile(r"(HNSW|NSG)(\d*)")


@dataclass(frozen=True)
class Code:
    """kind: flat, dedup, sq, pq, pqr (a product code and one of what it leaves), rq, lsq, lsh, rabitq, sh, lattice or minmax. sizes: the bits of each part."""

    kind: str
    name: str
    sizes: tuple[int, ...] = ()
    rotate: bool = False
    thresholds: bool = False
    splits: int = 1  # parts of the dimensions that are coded apart (sums of entries, lattices)
    period: float = 0.0  # of a spectral code; of a lattice its squared radius
    inner: "Code | None" = None
    half: bool = False


@dataclass(frozen=True)
class IndexSpec:
    description: str
    dimensions: int
    metric: str = "l2"
    transforms: tuple[tuple[str, tuple[int, ...]], ...] = ()
    lists: int = 0
    code: Code = field(default_factory=lambda: Code("flat", "Flat"))
    refine: "IndexSpec | None" = None
    graph: str = ""
    links: int = 32
    multi: bool = False  # lists are pairs of centroids of the two halves
    whole: bool = False  # all lists are searched
    coarse_graph: str = ""

    @property
    def needs_training(self) -> bool:
        if self.code.kind == "minmax":
            return replace(self, code=self.code.inner).needs_training
        fixed = self.code.kind in ("flat", "dedup") or (self.code.kind == "sq" and SCALAR[self.code.name] is None) or (self.code.kind == "lsh" and not self.code.thresholds)
        learnt = any(name in ("pca", "itq", "opq") for name, _ in self.transforms)
        return bool(self.lists) or learnt or not fixed or bool(self.refine and self.refine.needs_training)

    @property
    def inner_dimensions(self) -> int:
        """The dimensions behind the transforms."""
        d = self.dimensions
        for name, args in self.transforms:
            if name != "l2norm":
                d = args[0]
        return d

    def code_size(self) -> int:
        """Bytes of one code, without its id."""
        d, c = self.inner_dimensions, self.code
        if c.kind == "lattice":
            return d + 4 * c.splits
        if c.kind == "minmax":
            return (4 if c.half else 8) + replace(self, code=c.inner).code_size()
        if c.kind in ("pq", "pqr", "rq", "lsq", "lsh", "sh"):
            return (sum(c.sizes) + 7) // 8
        if c.kind == "rabitq":
            return (d + 7) // 8 + 8
        if c.kind == "sq":
            return {"SQ6": (6 * d + 7) // 8, "SQ4": (4 * d + 7) // 8, "SQfp16": 2 * d, "SQbf16": 2 * d}.get(c.name, d)
        return 4 * d

    def type_name(self) -> str:
        inner = {"flat": "Flat", "dedup": "FlatDedup", "sq": "ScalarQuantizer", "pq": "PQ", "pqr": "PQR", "rq": "ResidualQuantizer", "lsq": "LocalSearchQuantizer", "lsh": "LSH", "rabitq": "RaBitQ", "sh": "SpectralHash", "lattice": "Lattice", "minmax": "RowwiseMinMax"}[self.code.kind]
        return f"{'IVF' if self.lists else ''}{self.graph}{inner}"


def _transform(part: str, d: int) -> tuple[tuple[str, tuple[int, ...]], int] | None:
    m = _TRANSFORM.fullmatch(part)
    if m is None:
        return None
    g = m.groupdict()
    if g["pca"]:
        n = int(g["pca"])
        if n > d:
            raise ValueError(f"{part}: more directions than the {d} dimensions")
        return ("pca", (n, int(bool(g["w"])), int(bool(g["r"])))), n
    if g["l2"]:
        return ("l2norm", ()), d
    if g["opq"]:
        m_, n = int(g["opq"]), int(g["opqd"] or d)
        if n > d or n % m_:
            raise ValueError(f"{part}: {n} dimensions do not split into {m_} parts")
        return ("opq", (n, m_)), n
    for name in ("rr", "itq", "pad"):
        if g[name] is not None:
            n = int(g[name] or d)
            if (name == "itq" and n > d) or (name == "pad" and n < d):
                raise ValueError(f"{part}: {n} dimensions from {d}")
            return (name, (n,)), n
    return None


def _code(part: str, d: int) -> Code | None:
    if part in ("", "Flat"):
        return Code("flat", "Flat")
    if part == "FlatDedup":
        return Code("dedup", part)
    if part in SCALAR:
        return Code("sq", part)
    if part == "RaBitQ":
        return Code("rabitq", part)
    if m := _PRODUCT.fullmatch(part):
        parts, bits = int(m[1]), int(m[2] or 8)
        if not parts or d % parts:
            raise ValueError(f"{part}: {d} dimensions do not split into {parts} parts")
        if not 1 <= bits <= 16:
            raise ValueError(f"{part}: codes of {bits} bits")
        return Code("pq", part, (bits,) * parts)
    if m := _REFINED.fullmatch(part):
        a, b = int(m[1]), int(m[2])
        if not a or not b or d % a or d % b:
            raise ValueError(f"{part}: {d} dimensions do not split into {a} and {b} parts")
        return Code("pqr", part, (8,) * (a + b), splits=a)
    if m := _RESIDUAL.fullmatch(part):
        sizes = tuple(int(b) for n, b in re.findall(r"(\d+)x(\d+)", m[2]) for _ in range(int(n)))
        if not sizes or not all(1 <= b <= 16 for b in sizes):
            raise ValueError(f"{part}: codes of such bits")
        return Code(m[1].lower(), part, sizes)
    if m := _PRODUCT_SUM.fullmatch(part):
        splits, per, bits = int(m[2]), int(m[3]), int(m[4])
        if not splits or d % splits or not per or not 1 <= bits <= 16:
            raise ValueError(f"{part}: {d} dimensions do not split so")
        return Code(m[1].lower(), part, (bits,) * (splits * per), splits=splits)
    if m := _LATTICE.fullmatch(part):
        splits = int(m[1])
        if not splits or d % splits or not 1 <= int(m[3]) <= 32:
            raise ValueError(f"{part}: {d} dimensions do not split so")
        return Code("lattice", part, (int(m[3]),), splits=splits, period=float(m[2]))
    if m := _SPECTRAL.fullmatch(part):
        if int(m[1]) > d or not float(m[2]):
            raise ValueError(f"{part}: {d} dimensions")
        return Code("sh", part, (1,) * int(m[1]), period=float(m[2]))
    if (m := _MINMAX.fullmatch(part)) and (inner := _code(m[2], d)) and inner.kind != "minmax":
        return Code("minmax", part, inner=inner, half=bool(m[1]))
    if m := _SIGNS.fullmatch(part):
        bits = int(m[1] or d)
        return Code("lsh", part, (1,) * bits, bool(m[2]) or bits > d, bool(m[3]))
    return None


def parse(description: str, dimensions: int, metric: str = "l2") -> IndexSpec:
    """The specification of a description; ValueError for what is unknown or does not fit the dimensions."""
    metric = ALIASES.get(metric.lower(), metric.lower())
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if dimensions < 1:
        raise ValueError("dimensions are below 1")
    text = re.sub(r"^IDMap2?,|,IDMap2?$", "", description.strip())
    refine = None
    if m := re.search(r",(?:RFlat|Refine\((.+)\))$", text):
        refine, text = parse(m[1] or "Flat", dimensions, metric), text[: m.start()]
    parts, d, transforms, lists, graph = re.split(r",(?![^(]*\))", text), dimensions, [], 0, ""
    while parts and (found := _transform(parts[0], d)):
        transforms.append(found[0])
        d = found[1]
        parts.pop(0)
    links, multi, whole, coarse_graph = 32, False, False, ""
    if parts and (m := _COARSE.fullmatch(parts[0])):
        lists, coarse_graph = int(m[1]) * {"": 1, "k": 1024, "M": 1024 * 1024}[m[2]], m[3] or m[5] or ""
        links = int(m[4] or m[6] or 32)
    elif parts and (m := _MULTI.fullmatch(parts[0])):
        lists, multi = 1 << 2 * int(m[1]), True
        if metric != "l2" or d % 2 or int(m[1]) > 10:
            raise ValueError(f"{description!r}: pairs of half centroids take l2, an even number of dimensions and 10 bits at most")
    elif parts and (m := _LAYERS.fullmatch(parts[0])):
        if m[1] not in (None, "1", "2"):
            raise ValueError(f"{description!r}: layers of {m[1]} parts are not built")
        multi, whole = m[1] == "2", True
        lists = 1 << 2 * int(m[2]) if multi else int(m[2])
    if lists or whole:
        parts.pop(0)
        if not lists or not parts:
            raise ValueError(f"{description!r}: a coarse step needs lists and a code")
    elif parts and (m := _GRAPH.fullmatch(parts[0])):
        graph, links = m[1], int(m[2] or 32)
        parts.pop(0)
        parts = parts or ["Flat"]
    whole_code = ",".join(parts)
    code = _code(whole_code, d) if parts and parts[0] and (len(parts) == 1 or _SPECTRAL.fullmatch(whole_code) or _MINMAX.fullmatch(whole_code)) else None
    if code is None or (code.kind in ("dedup", "sh") and not lists):
        raise ValueError(f"unknown index description {description!r}")
    if code.kind in ("lsh",) and metric != "l2":
        raise ValueError("sign codes take metric l2")
    if code.kind == "rabitq" and metric not in ("l2", "ip"):
        raise ValueError("RaBitQ takes metrics l2 and ip")
    if code.kind == "sh" and metric != "l2":
        raise ValueError("sign codes take metric l2")
    return IndexSpec(description, dimensions, metric, tuple(transforms), lists, code, refine, graph, links, multi, whole, coarse_graph)
