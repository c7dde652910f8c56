"""Fixity of WARC replicas by Merkle trees over records and ordered ranges of offsets.

Pages become WARC records in files; a record has an offset, a length and a SHA-256. The tree of a file: level 0 are its
records in order of offset; a node of level 1 covers RANGE_BYTES of offsets and hashes its records' offsets, lengths
and hashes in order; a node of each further level covers FAN ranges of the level below. Above the files' roots stands
the replica's root over (file, root).

Audit: if the replicas' roots are equal nothing else is read. Otherwise the files whose roots differ are descended
level by level, and at each level only the children of nodes that differ are compared, down to records, which are
`changed`, `missing` (only in the first replica) or `extra` (only in the second).

A node gathers the records that begin in RANGE_BYTES of offsets, or FAN nodes, and never a whole file. Null pages, addresses
and ids count as empty; pages that repeat are records of their own; empty tables have an empty tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import require, stored

RANGE_BYTES, FAN = 1 << 18, 16
RECORDS_PER_FILE = 2048


def record(url: Column, name: Column, payload: Column) -> Column:
    """A WARC record as text; its bytes are those of its UTF-8."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def records_of(pages: DataFrame, n_files: int | None = None) -> DataFrame:
    """page_id, file, offset, length, sha256 of each page's record; files are dealt by id, records stand in order of id, address and hash."""
    require(pages, "page_id", "url", "html")
    n_files = n_files or files_for(pages)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    text = record(F.coalesce("url", F.lit("")), name, F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(n_files)).cast("long").alias("file"), F.explode(F.array(text)).alias("record"))
    rows = rows.select("page_id", "url", "file", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "url", "sha256").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("page_id", "file", (F.sum("length").over(before) - F.col("length")).alias("offset"), "length", "sha256")


def files_for(pages: DataFrame) -> int:
    return max(1, -(-pages.count() // RECORDS_PER_FILE))


def _joined(rows: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["hash"]), ""), 256)


def tree_of(records: DataFrame) -> list[DataFrame]:
    """Levels from the records (file, node = offset, hash) to one node a file, each stored."""
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "sha256"), 256)
    level = stored(records.select("file", F.col("offset").alias("node"), leaf.alias("hash")), "tree")
    levels, width = [level], RANGE_BYTES
    while True:
        grouped = level.groupBy("file", F.floor(F.col("node") / width).cast("long").alias("up"))
        level = stored(grouped.agg(_joined(F.struct("node", "hash")).alias("hash")).withColumnRenamed("up", "node"), "tree")
        levels.append(level)
        if level.filter("node > 0").isEmpty():
            return levels
        width = FAN


def root_of(levels: list[DataFrame]) -> str:
    """The replica's root: files' roots are reduced FAN at a time."""
    top = levels[-1].select(F.col("file").alias("node"), "hash")
    while True:
        top = top.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(_joined(F.struct("node", "hash")).alias("hash")).withColumnRenamed("up", "node").checkpoint()
        if top.filter("node > 0").isEmpty():
            row = top.first()
            return row["hash"] if row else ""


def differing(first: list[DataFrame], second: list[DataFrame]) -> DataFrame | None:
    """(file, node = offset, state) of the records that differ; None if the roots are equal."""
    if len(first) == len(second) and root_of(first) == root_of(second):
        return None
    while len(first) < len(second):
        first = [*first, _raised(first)]
    while len(second) < len(first):
        second = [*second, _raised(second)]
    found = None
    for k in reversed(range(len(first))):
        a, b = first[k], second[k]
        if found is not None:
            width = RANGE_BYTES if k == 0 else FAN
            child = lambda df: df.withColumn("up", F.floor(F.col("node") / width).cast("long")).join(found.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").drop("up")  # noqa: B023, E731
            a, b = child(a), child(b)
        both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), ["file", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
        state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed")
        found = stored(both.select("file", "node", state.alias("state")), "differing")
        if found.isEmpty():
            break
    return found


def _raised(levels: list[DataFrame]) -> DataFrame:
    """A level above one that has a node a file."""
    return levels[-1].groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(_joined(F.struct("node", "hash")).alias("hash")).withColumnRenamed("up", "node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two replicas' records, each with its state: intact, changed, missing or extra.

    Columns page_id, file, offset, length, sha256 are the first replica's, or the second's for extra records.
    """
    a, b = stored(first, "records"), stored(second, "records")
    found = differing(tree_of(a), tree_of(b))
    if found is None:
        return a.withColumn("state", F.lit("intact"))
    marks = found.withColumnRenamed("node", "offset")
    own = a.join(marks.filter("state <> 'extra'"), ["file", "offset"], "left").withColumn("state", F.coalesce("state", F.lit("intact")))
    more = b.join(marks.filter("state = 'extra'"), ["file", "offset"])
    columns = ["page_id", "file", "offset", "length", "sha256", "state"]
    return own.select(columns).unionByName(more.select(columns))


def damaged(pages: DataFrame, which: Column) -> DataFrame:
    """A replica of pages in which the first character of the chosen pages' html is another one."""
    html = F.coalesce("html", F.lit(""))
    other = F.when(F.substring(html, 1, 1) == "#", "*").otherwise("#")
    return pages.withColumn("html", F.when(which & (html != ""), F.concat(other, F.substring(html, 2, 1 << 30))).otherwise(html))
