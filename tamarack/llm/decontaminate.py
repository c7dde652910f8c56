"""Benchmark decontamination: documents that hold a benchmark item or nearly so. DataFrame functions only.

Texts become arrays of word hashes (words are runs of letters, marks and digits of the lower-cased text). A window is as
many consecutive words of a document as an item has.

1. Windows. What is reported must share a shingle with its item, so only windows that are aligned with such a
   shared shingle are formed: nothing above the threshold is lost, and of a run of shared shingles the first is enough.
   Shingles of items are broadcast, in as many passes over the documents as keep each under ANCHORS rows. Equal
   windows are one from here on. A window keeps its anchors: which shingles it shares, and where.
2. SimHash. Of each window and each item a 64-bit fingerprint of its words: 16-bit lanes count the set bits.
3. Multi-index. A fingerprint is cut into RADIUS + 1 blocks; two fingerprints within RADIUS agree in a block at
   least. Windows meet the items of their size that agree in a block and share one of their anchors, so that what a window meets does not grow with
   the items; those within RADIUS go on. An estimate, not a measurement: of pairs at the threshold fewer than one in 1,000 differ in more bits.
4. Verification. The weighted Jaccard similarity of the shingles, as multisets, where a shingle weighs as many as it has
   distinct words; THRESHOLD or more is reported.

Items of fewer words than SIZE have one shingle of all of them; windows and items of more than 32,767 words skip the
fingerprints and are verified. Null and empty texts, and items without words, match nothing. Items that repeat are reported each; rows that
repeat are one (doc_id, item_id). Null ids are reported as null. Empty tables give an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mark_of, require, stored, text_of

SIZE = 5
THRESHOLD = 0.8
RADIUS = 19
#: Rows of item shingles that one pass broadcasts at most, about 50 MB.
ANCHORS = 1 << 20
_LANES, _MOST_WORDS = 0x0001000100010001, 32767


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later steps do not compute again: the optimizer inlines nothing through a generator."""
    for name, column in columns.items():
        df = df.withColumn(name, F.explode(F.array(column)))
    return df


def words(text: Column) -> Column:
    """Hashes of the words of a text."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` words; none if there are fewer words."""
    return let(hashes, lambda h: F.transform(_starts(h, size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))))


def _starts(hashes: Column, size: int) -> Column:
    n = F.size(hashes) - (size - 1)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is set if it is in more than half of the hashes. Lane j of sum k counts bit 16 j + k."""

    def bits(h: Column, k: int) -> Column:
        set_ = lambda s, j: F.when(F.shiftrightunsigned(s, 16 * j).bitwiseAND(0xFFFF) * 2 > F.size(h), F.lit(_signed(1 << (16 * j + k)))).otherwise(F.lit(0).cast("long"))
        return let(_lane_sum(h, k), lambda s: set_(s, 0).bitwiseOR(set_(s, 1)).bitwiseOR(set_(s, 2)).bitwiseOR(set_(s, 3)))

    return let(hashes, lambda h: reduce(Column.bitwiseOR, [bits(h, k) for k in range(16)]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lane_sum(hashes: Column, k: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_LANES)))


def index_blocks(print_: Column) -> Column:
    """RADIUS + 1 blocks of a fingerprint: array of (number, bits)."""
    n = RADIUS + 1
    edge = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(print_, a).bitwiseAND((1 << (b - a)) - 1).alias("bits")) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a number for each id and text), hashes, n, size (of its shingles), stored."""
    require(benchmark, "item_id", "text")
    rows = benchmark.select("item_id", F.xxhash64("item_id", text_of()).alias("item"), words(text_of()).alias("hashes")).dropDuplicates(["item"])
    rows = rows.withColumn("n", F.size("hashes")).filter("n > 0")
    return stored(rows.withColumn("size", F.least("n", F.lit(SIZE))), "items")


def windows(docs: DataFrame, items: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, mark, n, the hashes of windows that share an aligned shingle with an item, and their anchors, stored; w1 and w2 name the content."""
    require(docs, "doc_id", "text")
    found = None
    rows = once(docs.select("doc_id", mark_of().alias("mark"), "text"), hashes=words(text_of())).select("doc_id", "mark", "hashes")
    for (size,) in sorted(items.select("size").distinct().collect()):
        own = items.filter(F.col("size") == size).withColumn("shingles", shingles(F.col("hashes"), size))
        anchor = own.select("n", F.posexplode("shingles").alias("at", "shingle"), "shingles").select("shingle", "n", "at", F.when(F.col("at") > 0, F.get("shingles", F.col("at") - 1)).alias("before")).distinct()
        anchor = stored(anchor, "anchors")
        passes = max(1, -(-anchor.count() // anchors))
        text = once(rows, shingles=shingles(F.col("hashes"), size)).select("doc_id", "mark", "hashes", "shingles", F.posexplode("shingles").alias("pos", "shingle"))
        for i in range(passes):
            part = F.broadcast(anchor.filter(F.pmod("shingle", F.lit(passes)) == i))
            begins = F.col("before").isNull() | (F.col("pos") == 0) | (F.get("shingles", F.col("pos") - 1) != F.col("before"))
            start = F.greatest(F.col("pos") - F.col("at"), F.lit(0))
            hit = text.join(part, "shingle").filter(begins).select("doc_id", "mark", "n", F.slice("hashes", start + 1, "n").alias("window"), F.xxhash64("shingle", "at").alias("anchor"))
            found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = rows.limit(0).select("doc_id", "mark", F.lit(0).alias("n"), F.col("hashes").alias("window"), F.lit(0).cast("long").alias("anchor"))
    named = found.withColumn("w1", F.xxhash64("window")).withColumn("w2", F.xxhash64(F.lit(1), F.reverse("window")))
    # Equal windows of a document are one; its anchors are as many as it has shingles at most.
    return stored(named.groupBy("doc_id", "mark", "n", "w1", "w2").agg(F.first("window").alias("window"), F.collect_set("anchor").alias("anchors")), "windows")


def _keys(anchors: Column, print_: Column, n: Column) -> Column:
    """What windows and items meet by: size, anchor, and a block of the fingerprint. Those of too many words have one block."""
    blocks = F.when(n <= _MOST_WORDS, index_blocks(print_)).otherwise(F.array(F.struct(F.lit(-1).alias("number"), F.lit(0).cast("long").alias("bits"))))
    return F.flatten(F.transform(anchors, lambda a: F.transform(blocks, lambda b: F.xxhash64(n, a, b["number"], b["bits"]))))


def candidates(contents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct windows (w1, w2, n, window) with items of their size that share an anchor and are within RADIUS."""
    printed = once(contents, print=fingerprint(F.col("window"))).select("w1", "w2", "n", "print", F.explode(_keys(F.col("anchors"), F.col("print"), F.col("n"))).alias("key"))
    each = None
    for size in range(1, SIZE + 1):
        own = items.filter(F.col("size") == size)
        own = own.select("item", "n", "hashes", F.transform(shingles(F.col("hashes"), size), lambda s, at: F.xxhash64(s, at)).alias("anchors"))
        each = own if each is None else each.unionByName(own)
    index = once(each, item_print=fingerprint(F.col("hashes"))).select("item", "item_print", F.explode(_keys(F.col("anchors"), F.col("item_print"), F.col("n"))).alias("key"))
    near = (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS) | (F.col("n") > _MOST_WORDS)
    pairs = printed.join(index, "key").filter(near).select("w1", "w2", "n", "item").distinct()
    return pairs.join(contents.drop("anchors"), ["w1", "w2", "n"]).join(items.drop("n"), "item").select("w1", "w2", "n", "window", "item", "item_id", "hashes", "size")


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """w1, w2, n, item_id, similarity of pairs that reach the threshold."""
    def exploded(column: str, one: str) -> DataFrame:
        sizes = F.lit(None).cast("array<struct<s:bigint,w:int>>")
        for k in range(1, SIZE + 1):
            sizes = F.when(F.col("size") == k, F.transform(_starts(F.col(column), k), _shingle(column, k))).otherwise(sizes)
        rows = pairs.select("w1", "w2", "n", "item", "item_id", F.explode(sizes).alias("x"))
        return rows.select("w1", "w2", "n", "item", "item_id", "x.s", "x.w", *(F.lit(int(c == one)).alias(c) for c in "ab"))

    both = exploded("window", "a").unionByName(exploded("hashes", "b"))
    counted = both.groupBy("w1", "w2", "n", "item", "item_id", "s", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counted.groupBy("w1", "w2", "n", "item", "item_id").agg((F.sum(F.col("w") * F.least("a", "b")) / F.sum(F.col("w") * F.greatest("a", "b"))).alias("similarity"))
    return total.filter(F.col("similarity") >= threshold)


def _shingle(column: str, k: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.xxhash64(*(F.get(column, i + j) for j in range(k))).alias("s"), F.size(F.array_distinct(F.slice(column, i + 1, k))).alias("w"))


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """doc_id, mark (the hash of the row's text), item_id and similarity of each window that reaches the threshold."""
    items = items_of(benchmark)
    held = windows(docs, items)
    contents = held.groupBy("w1", "w2", "n").agg(F.first("window").alias("window"), F.array_distinct(F.flatten(F.collect_set("anchors"))).alias("anchors"))
    hits = stored(similar(candidates(stored(contents, "contents"), items), threshold), "hits")
    return held.select("doc_id", "mark", "n", "w1", "w2").join(hits, ["w1", "w2", "n"])


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity (the largest of the document's windows), n_windows (that reach the threshold)."""
    return _found(docs, benchmark, threshold).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n_windows"))


def cleaned(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold an item. Rows that repeat id and text go or stay together."""
    return dropped(docs, _found(docs, benchmark, threshold).select("doc_id", "mark"))
