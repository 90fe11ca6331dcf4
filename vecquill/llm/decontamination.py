"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

1. Words are lower-cased; a shingle is five words (an item with fewer words is one shingle). A window has an item's
   number of words. If any window of a text is similar to an item, so is the one that starts at the first shingle they
   share: it holds all the shared ones and is no longer. So windows are laid at those places only where a text has a
   shingle of some item of their size, whichever; nothing is lost, and nothing else about the item is asked.
2. Each window gets a fingerprint of ``BITS`` bits, the majority of its shingles' hashes, each weighted by how often it
   occurs. Fingerprints are cut into blocks of ``BLOCK`` bits. Within ``RADIUS`` bits of each other, two have a block
   that differs in ``NEAR`` bits at most (pigeonhole). Windows ask with all values within ``ASKED`` bits of their blocks,
   items are entered under all values within ``NEAR`` - ``ASKED`` bits of theirs, so an equi-join on (size, block, value)
   finds every fingerprint within the radius. Of the ways in which a pair meets, one is kept.
3. Candidates within the radius are verified: weighted Jaccard similarity (sum of the lesser counts over the sum of the
   greater) of the shingles.

At a similarity of 0.8 two fingerprints differ in 18 of 120 bits on average, four bits being a standard deviation; the
radius of 31 loses about one such pair in a thousand and fewer above. Unrelated windows are 60 bits apart.

The tables of items that are broadcast hold ``BROADCAST_ROWS`` rows at most: larger benchmarks are taken in so many
parts, each against all windows. No text is shuffled; a pair of window and item is, once, for the best of each document.

Defined results: null or empty texts match nothing; rows that share an id are matched apart; a null id is reported as
null; items without words are ignored; of equal similarities the first window, of these the shorter one is told; an
empty table gives an empty result; further columns, whatever their names, are not read. Very long texts and items need no
bound: the work is linear but for shingles that are repeated in both window and item.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecquill.llm.shared import durable

BITS, BLOCK, RADIUS, ASKED, BROADCAST_ROWS = 120, 15, 31, 1, 2_000_000
BLOCKS = BITS // BLOCK
NEAR = RADIUS // BLOCKS
_WHITE = " \t\n\x0b\f\r"
#: A one in each of the four 15-bit fields of a long; half of a fingerprint fills these fields.
_ONES = sum(1 << 15 * i for i in range(4))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _up(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(by) if isinstance(by, int) else by)


def _down(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(by) if isinstance(by, int) else by)


def _words(text: Column) -> Column:
    lowered = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WHITE))
    return _let(lowered, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[ \t\n\x0B\f\r]+")))


def _shingles(words: Column, k: int) -> Column:
    """64-bit hashes of each k consecutive words."""
    none = F.array().cast("array<bigint>")
    return _let(words, lambda w: F.when(F.size(w) < k, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))))


def _majority(hashes: Column, n: Column) -> Column:
    """60 bits, each set if more than half of the n hashes have it set; counted in 15-bit fields, four to a long."""
    spare = ((F.lit((1 << 14) - 1) - F.floor(n / 2)) * _long(_ONES)).cast("bigint")

    def of(shift: int) -> Column:
        counts = F.aggregate(hashes, _long(0), lambda a, x: a + F.shiftrightunsigned(x, shift).bitwiseAND(_long(_ONES)))
        return F.shiftleft(F.shiftrightunsigned(counts + spare, 14).bitwiseAND(_long(_ONES)), shift)

    return reduce(lambda a, b: a.bitwiseOR(b), map(of, range(15)))


def _majority_of_many(hashes: Column, n: Column) -> Column:
    """The same for any number of hashes, bit by bit."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(59)), lambda b: F.aggregate(hashes, _long(0), lambda a, x: a + _down(x, b).bitwiseAND(_long(1))) * 2 > n)
    return F.aggregate(set_, _long(0), lambda a, b: a.bitwiseOR(_up(_long(1), b)))


def fingerprinted(rows: DataFrame, shingles: str) -> DataFrame:
    """Adds p0 and p1, the two halves of the fingerprint of an array of shingles."""
    n = F.size(shingles)
    rows = rows.withColumn("__more", F.transform(shingles, lambda x: F.xxhash64(x)))
    half = lambda c: F.when(n < 1 << 15, _majority(F.col(c), n)).otherwise(_majority_of_many(F.col(c), n))
    return rows.withColumn("p0", half(shingles)).withColumn("p1", half("__more")).drop("__more")


def _masks(most: int) -> list[int]:
    """The changes of a block in ``most`` bits at most."""
    return [sum(1 << b for b in bits) for r in range(most + 1) for bits in combinations(range(BLOCK), r)]


def _asks(rows: DataFrame, most: int) -> DataFrame:
    """Adds block, mask and key for every value within ``most`` bits of each block of (n, p0, p1)."""
    every = F.array(*(F.lit(block << BLOCK | mask) for block in range(BLOCKS) for mask in _masks(most)))
    out = rows.withColumn("__ask", F.explode(every))
    out = out.withColumn("block", _down(F.col("__ask"), BLOCK)).withColumn("mask", F.col("__ask").bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("bigint")).drop("__ask")
    half = F.when(F.col("block") < BLOCKS // 2, F.col("p0")).otherwise(F.col("p1"))
    value = _down(half, F.col("block") % (BLOCKS // 2) * BLOCK).bitwiseAND(_long((1 << BLOCK) - 1)).bitwiseXOR(F.col("mask"))
    return out.withColumn("key", _up(F.col("n").cast("bigint") * BLOCKS + F.col("block"), BLOCK).bitwiseOR(value))


def _shared_weight(a: Column, b: Column) -> Column:
    """The sum over shingles of the lesser of their counts in two arrays: once each, and more only where both repeat them."""
    repeated = lambda x: _let(F.array_sort(x), lambda s: F.array_distinct(F.filter(s, lambda y, i: (i > 0) & (F.get(s, i - 1) == y))))
    count = lambda x, y: F.size(F.filter(x, lambda z: z == y))
    more = F.aggregate(F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda s, y: s + F.least(count(a, y), count(b, y)) - 1)
    return F.size(F.array_intersect(a, b)) + more


def item_table(benchmark: DataFrame, k: int, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(item_id, n words, k, shingles, p0, p1) of the items with words, and the values of k, five at most."""
    items = (
        benchmark.select(F.col(f"`{item_col}`").alias("item_id"), _words(F.col(f"`{text_col}`")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("n", F.size("words"))
        .withColumn("k", F.least(F.col("n"), F.lit(k)))
    )
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # k values at most
    parts = [items.where(F.col("k") == kk).withColumn("shingles", _shingles(F.col("words"), kk)) for kk in lengths or [k]]
    return durable(fingerprinted(reduce(DataFrame.unionByName, parts), "shingles").drop("words")), lengths


def windows_of(base: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, row, n, start, window, p0, p1): the windows of each item size that start at a shingle of an item of that size."""
    places = durable(items.select(F.explode("shingles").alias("shingle"), "n", "k", (F.col("n") - F.col("k") + 1).alias("m")).distinct())
    passes = max(1, -(-places.count() // BROADCAST_ROWS))
    found = []
    for kk in lengths:
        own = base.select("id", "row", _shingles(_words(F.col("text")), kk).alias("shingles"))
        opened = own.select("id", "row", "shingles", F.posexplode("shingles").alias("start", "shingle"))
        for i in range(passes):
            part = F.broadcast(places.where((F.col("k") == kk) & (F.pmod(F.xxhash64("shingle"), F.lit(passes)) == i)))
            found.append(opened.join(part, "shingle").select("id", "row", "n", "start", F.slice("shingles", F.col("start") + 1, F.col("m")).alias("window")))
    return fingerprinted(reduce(DataFrame.unionByName, found), "window")


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a window and an item of its size whose fingerprints differ in ``RADIUS`` bits at most, each once."""
    entered = _asks(items.select("item_id", "n", "p0", "p1"), NEAR - ASKED).select("key", "item_id", F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    rows = items.count() * BLOCKS * len(_masks(NEAR - ASKED))
    passes = max(1, -(-rows // BROADCAST_ROWS))
    asking = _asks(windows, ASKED)
    x0, x1 = F.col("p0").bitwiseXOR(F.col("q0")), F.col("p1").bitwiseXOR(F.col("q1"))
    differ = [F.shiftrightunsigned(x, i * BLOCK).bitwiseAND(_long((1 << BLOCK) - 1)) for x in (x0, x1) for i in range(BLOCKS // 2)]
    # one meeting of a pair counts: in its first near block, by the least change on the window's side
    first = reduce(lambda rest, i: F.when(F.bit_count(differ[i]) <= NEAR, F.lit(i)).otherwise(rest), reversed(range(BLOCKS)), F.lit(-1))
    here = reduce(lambda rest, i: F.when(F.col("block") == i, differ[i]).otherwise(rest), range(1, BLOCKS), differ[0])
    change = F.when(F.bit_count(here) <= NEAR - ASKED, _long(0)).otherwise(here.bitwiseAND(-here))
    found = []
    for i in range(passes):
        part = F.broadcast(entered.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i))
        met = asking.join(part, "key").where((F.bit_count(x0) + F.bit_count(x1) <= RADIUS) & (F.col("block") == first) & (F.col("mask") == change))
        found.append(met.select("id", "row", "n", "start", "window", "item_id"))
    return reduce(DataFrame.unionByName, found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item_id, start (word), n_words and similarity of the best window for each document and item that match."""
    items, lengths = item_table(benchmark, k, item_col, text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").withColumn("row", F.xxhash64("id", "text"))
    windows = durable(windows_of(base, items, lengths or [k]))
    pairs = candidates(windows, items)
    n_items = items.count()
    verified = []
    for i in range(passes := max(1, -(-n_items // (BROADCAST_ROWS // 64)))):  # an item's row holds its shingles
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).select(F.col("item_id").alias("item"), F.col("n").alias("size"), "shingles")
        verified.append(pairs.join(F.broadcast(own), F.col("item_id").eqNullSafe(F.col("item")) & (F.col("n") == F.col("size"))))
    judged = (
        reduce(DataFrame.unionByName, verified)
        .withColumn("both", _shared_weight(F.col("window"), F.col("shingles")))
        .withColumn("all", F.size("window") + F.size("shingles") - F.col("both"))
        .where(F.col("both") * 100 >= F.col("all") * percent)
    )
    best = judged.groupBy("id", "row", "item_id").agg(F.min(F.struct((-F.col("both") / F.col("all")).alias("s"), "start", "n")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("best.start").cast("long").alias("start"), F.col("best.n").cast("long").alias("n_words"), F.round(-F.col("best.s"), 9).alias("similarity"))
