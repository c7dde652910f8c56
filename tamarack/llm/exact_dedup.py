"""Exact duplicates through a log-structured merge index of text digests.

Writing: every task is a memtable. It gathers (digest, id) pairs and flushes them as sorted runs, one for each
shard of the digest space; within a run each digest stands once, with its smallest and largest id and its number of
rows. Each run carries a Bloom filter of its digests.

Compaction: for each shard the runs meet. A digest that stands once in its run and that no filter of another
run may contain is settled without a merge; the others ("hits") are merged, keeping the smallest identifier (or the
largest, on request). Shards are as many as keep their runs within bounds, so no task gathers a group: copies are
already one entry per run.

Verification: the texts of rows whose digest hit are grouped by digest and bytes, with partial aggregation
before the shuffle. Where a digest has one text, as always but for a SHA-256 collision, members take the
digest's identifier; otherwise members of that digest are resolved by digest and bytes.

An index can live on disk (`DigestIndex`): batches are appended as level-0 runs and are merged level by level.

Defined results: null text counts as empty, a null id stays only where a
group has no other; rows that repeat (same id, same text) are all answered, all as kept if their id is; an empty table gives
an empty result. Columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import Markers, delete_path, fresh, names_in, path_exists, require, require_ids, scratch_path, small, stored, text_of

#: Rows that a memtable holds before it is flushed, and digests that one shard holds on average.
MEMTABLE_ROWS = 1 << 18
SHARD_ROWS = 1 << 18
FILTER_BITS_PER_KEY = 12

RUN_SCHEMA = "shard long, run string, n long, digests binary, least binary, most binary, rows binary, filter binary"
HIT_SCHEMA = "digest binary, least_id long, most_id long, group_size long"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _words(digests: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each digest as two numbers."""
    return np.ascontiguousarray(digests[:, :16]).view(">u8").astype(np.uint64)


def make_filter(digests: np.ndarray) -> np.ndarray:
    """A Bloom filter; its size is a power of two, so that a smaller one tiles to the size of a larger one."""
    return bloom.make(_words(digests), 1 << max(6, (len(digests) * FILTER_BITS_PER_KEY - 1).bit_length()))


def may_contain(packed: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return bloom.may_contain(packed, _words(digests))


def merged(digests: np.ndarray, least: np.ndarray, most: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in order of digest, each once."""
    if not len(digests):
        return digests, least, most, rows
    order = np.lexsort(np.ascontiguousarray(digests).view(">u8").T[::-1])
    digests, least, most, rows = digests[order], least[order], most[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (digests[1:] != digests[:-1]).any(axis=1)]))
    return digests[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.add.reduceat(rows, first)


def flush(rows: DataFrame, shards: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Sorted runs of rows (id long, digest binary)."""

    def runs(digests: np.ndarray, ids: np.ndarray, name: str) -> pa.RecordBatch:
        digests, least, most, n = merged(digests, ids, ids, np.ones(len(ids), np.int64))
        shard = (_words(digests)[:, 0] % np.uint64(shards)).astype(np.int64)
        out: list[list] = [[] for _ in range(8)]
        for s in np.unique(shard):
            own = shard == s
            d = digests[own]
            entry = (int(s), name, len(d), d.tobytes(), least[own].tobytes(), most[own].tobytes(), n[own].tobytes(), make_filter(d).tobytes())
            for column, value in zip(out, entry, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "run", "n", "digests", "least", "most", "rows", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, count, flushed = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            if batch.num_rows:
                d = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 32)
                held.append((d, batch.column(0).to_numpy(zero_copy_only=False)))
                count += batch.num_rows
            if count >= memtable_rows:
                yield runs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), f"{task}-{flushed}")
                held, count, flushed = [], 0, flushed + 1
        if held:
            yield runs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), f"{task}-{flushed}")

    return rows.select("id", "digest").mapInArrow(run, RUN_SCHEMA)


def _entries(runs: pa.Table) -> list[tuple[np.ndarray, ...]]:
    cols = [runs.column(c).to_pylist() for c in ("digests", "least", "most", "rows", "filter")]
    return [(np.frombuffer(d, np.uint8).reshape(-1, 32), *(np.frombuffer(x, np.int64) for x in (a, b, n)), np.frombuffer(f, np.uint8)) for d, a, b, n, f in zip(*cols, strict=True)]


def hits_of(entries: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of the runs of a shard, the entries that stand for more than one row."""
    size = max(len(e[4]) for e in entries)
    filters = [np.tile(e[4], size // len(e[4])) for e in entries]
    before, after = [np.zeros_like(filters[0])], [np.zeros_like(filters[0])]
    for f, g in zip(filters[:-1], filters[:0:-1], strict=True):
        before.append(before[-1] | f)
        after.append(after[-1] | g)
    picked = []
    for (digests, least, most, rows, _), b, a in zip(entries, before, reversed(after), strict=True):
        hit = (rows > 1) | may_contain(b | a, digests)
        picked.append((digests[hit], least[hit], most[hit], rows[hit]))
    out = merged(*(np.concatenate(x) for x in zip(*picked, strict=True)))
    many = out[3] > 1
    return tuple(x[many] for x in out)


def compact(runs: DataFrame) -> DataFrame:
    """One row for each digest that more than one row has: digest, least_id, most_id, group_size."""

    def run(table: pa.Table) -> pa.Table:
        digests, least, most, rows = hits_of(_entries(table))
        return pa.table([pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(least), pa.array(most), pa.array(rows)], ["digest", "least_id", "most_id", "group_size"])

    return runs.groupBy("shard").applyInArrow(run, HIT_SCHEMA)


def _ids(column: str, keep: str) -> tuple[Column, int]:
    """Ids in which null loses to every other, and the number that stands for null."""
    if keep not in ("least", "most"):
        raise ValueError("keep is least or most")
    null = (1 << 63) - 1 if keep == "least" else -(1 << 63)
    return F.coalesce(F.col(column).cast("long"), F.lit(null)), null


def resolve(docs: DataFrame, keep: str = "least", id_column: str = "doc_id") -> DataFrame:
    """All rows of docs as (doc_id, digest, keep_id, group_size, kept).

    keep: `least` or `most`, the identifier that stays. Identifiers are integers.
    """
    require_ids(docs, id_column)
    require(docs, "text")
    spark = docs.sparkSession
    ids, null = _ids(id_column, keep)
    rows = docs.select(ids.alias("id"), digest_of(text_of()).alias("digest"), text_of().alias("text"))
    path = scratch_path(spark, "hits")
    compact(flush(rows, max(1, -(-docs.count() // SHARD_ROWS)))).write.parquet(path)
    hits = spark.read.schema(HIT_SCHEMA).parquet(path)
    keeper = "most_id" if keep == "most" else "least_id"

    # Bytes of all hits, one row for each text of a digest.
    likely = bloom.passing(rows.select("digest", "text"), "digest", bloom.bloom_of(hits.select("digest"), hits.count()))
    seen = likely.join(hits.select("digest"), "digest", "left_semi")
    texts = seen.groupBy("digest", "text").agg(F.lit(1).alias("one"))
    path = scratch_path(spark, "collisions")
    texts.groupBy("digest").count().filter("count > 1").select("digest").write.parquet(path)
    collided = spark.read.schema("digest binary").parquet(path)

    if collided.isEmpty():
        found = rows.select("id", "digest").join(hits, "digest", "left")
    else:
        own = rows.join(collided, "digest", "left_semi")
        by_text = own.groupBy("digest", "text").agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.count(F.lit(1)).alias("group_size"))
        exact = own.join(by_text, ["digest", "text"]).select("id", "digest", "least_id", "most_id", "group_size")
        rest = rows.select("id", "digest").join(collided, "digest", "left_anti").join(hits, "digest", "left")
        found = rest.select(exact.columns).unionByName(exact)
    keep_id = F.coalesce(keeper, "id")
    real = lambda c: F.when(c != null, c)
    return found.select(real(F.col("id")).alias(id_column), "digest", real(keep_id).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("id") == keep_id).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """resolve() with the largest id kept and the digest as text."""
    return resolve(docs, keep="most").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "most") -> DataFrame:
    """The rows of docs that stay, one for each text, with all columns of docs.

    Of rows with the same id and text one stays. docs must have unique ids otherwise.
    """
    gone = resolve(docs, keep)
    own, again, repeated, digest_ = (fresh(docs, n) for n in ("own_id", "own_mark", "repeated", "own_digest"))
    # Rows to drop are few; ids that stay but repeat are thinned by id and text.
    drop = gone.filter(~F.col("kept")).select(F.col("doc_id").alias(own), F.col("digest").alias(again), F.lit(False).alias(repeated))
    same = gone.filter(F.col("kept") & (F.col("group_size") > 1)).groupBy("doc_id", "digest").count().filter("count > 1")
    marks = stored(drop.unionByName(same.select(F.col("doc_id").alias(own), F.col("digest").alias(again), F.lit(True).alias(repeated))).distinct(), "drop")
    tagged = docs.withColumn(digest_, digest_of(text_of())).join(small(marks), F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(digest_) == F.col(again)), "left")
    once = tagged.filter(F.col(repeated).isNull())
    if marks.filter(repeated).isEmpty():
        return once.select(docs.columns)
    thinned = tagged.filter(repeated).dropDuplicates(["doc_id", digest_])
    return once.unionByName(thinned).select(docs.columns)


class DigestIndex:
    """An index in a folder. Batches are appended as runs of level 0; compaction leaves one run for each shard.

    Runs of level 0 are folders of their own; a folder counts when its writer has finished it. Compaction writes a new generation beside the old one,
    with a list of the batches that it holds, and a pointer names the last complete generation: created once, it either is there or is not. So an
    interrupted call leaves the index as it was, and may be repeated. Folders that no pointer needs go with the compaction after the next,
    when readers of the last generation are done with them. The number of shards is fixed when the index is made; choose it for the final number of digests.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.log = Markers(spark, f"{self.path}/generations")

    def _state(self) -> tuple[int, str, str, set[str]]:
        """The last generation, 0 if there is none, its folder, the folder before it, and the batches in it."""
        number, text = self.log.last()
        folder, before, *batches = [*text.split("\n"), ""][:2] + text.split("\n")[2:]
        return number, folder, before, set(batches)

    def _batches(self) -> list[str]:
        return [b for b in names_in(self.spark, f"{self.path}/level0") if path_exists(self.spark, f"{self.path}/level0/{b}/_SUCCESS")]

    def _folders(self, state: tuple[int, str, str, set[str]], batches: list[str]) -> list[str]:
        return [f"{self.path}/level0/{b}" for b in batches if b not in state[3]] + ([f"{self.path}/level1/{state[1]}"] if state[0] else [])

    def _runs(self) -> DataFrame | None:
        paths = self._folders(self._state(), self._batches())
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else None

    def append(self, docs: DataFrame, batch: str) -> None:
        """A batch that was appended before is left alone, so a repeated call changes nothing."""
        if batch in self._batches() or batch in self._state()[3]:
            return
        require_ids(docs, "doc_id")
        ids, _ = _ids("doc_id", "least")
        rows = docs.select(ids.alias("id"), digest_of(text_of()).alias("digest"))
        flush(rows, self.shards).write.mode("overwrite").parquet(f"{self.path}/level0/{batch}")

    def compact(self) -> None:
        def run(table: pa.Table) -> pa.Table:
            entries = _entries(table)
            d, a, b, n = merged(*(np.concatenate(x) for x in list(zip(*entries, strict=True))[:4]))
            values = [table.column("shard")[0].as_py(), "compacted", len(d), d.tobytes(), a.tobytes(), b.tobytes(), n.tobytes(), make_filter(d).tobytes()]
            return pa.table([[v] for v in values], names=table.column_names)

        state, batches = self._state(), self._batches()
        number, folder, before, held = state
        if not set(batches) - held:
            return
        runs, new = self.spark.read.schema(RUN_SCHEMA).parquet(*self._folders(state, batches)), f"{number + 1}-{uuid.uuid4().hex}"
        runs.groupBy("shard").applyInArrow(run, RUN_SCHEMA).write.parquet(f"{self.path}/level1/{new}")
        if not self.log.add(number + 1, "\n".join([new, folder, *sorted(held | set(batches))])):
            return delete_path(self.spark, f"{self.path}/level1/{new}")
        # Readers of the last generation may go on; nobody who began after it reads what it already held.
        for b in set(batches) & held:
            delete_path(self.spark, f"{self.path}/level0/{b}")
        if before:
            delete_path(self.spark, f"{self.path}/level1/{before}")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, keep_id): the smallest indexed id of each text of docs, null where the index has none.

        Runs whose filter refuses a digest are not searched for it. The index holds digests, not texts: bytes are compared where both
        texts are at hand, in `resolve`; of hits here, `verified` does so against a table of the indexed documents.
        """

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            digests = np.frombuffer(b"".join(left.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            best = np.full(len(digests), (1 << 63) - 1)
            hit = np.zeros(len(digests), bool)
            for d, least, _, _, packed in _entries(right) if right.num_rows else []:
                maybe = np.flatnonzero(may_contain(packed, digests))
                own = {x.tobytes(): i for i, x in enumerate(d)} if len(maybe) else {}
                for i in maybe:
                    at = own.get(digests[i].tobytes())
                    if at is not None:
                        best[i], hit[i] = min(best[i], least[at]), True
            return pa.table([left.column("doc_id"), left.column("digest"), pa.array([int(b) if h else None for b, h in zip(best, hit, strict=True)], pa.int64())], ["doc_id", "digest", "keep_id"])

        runs = self._runs()
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"))
        if runs is None:
            return ids.withColumn("keep_id", F.lit(None).cast("long"))
        shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 8)), 16, 10).cast("decimal(20,0)"), F.lit(self.shards)).cast("long")
        return ids.withColumn("shard", shard).groupBy("shard").cogroup(runs.groupBy("shard")).applyInArrow(run, "doc_id long, digest binary, keep_id long")

    def verified(self, docs: DataFrame, indexed: DataFrame) -> DataFrame:
        """lookup() with a hit only where the indexed document of that id has the same bytes; indexed: doc_id, text."""
        found = self.lookup(docs)
        texts = indexed.select(F.col("doc_id").cast("long").alias("keep_id"), digest_of(text_of()).alias("digest"), text_of().alias("old"))
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"), text_of().alias("new")).dropDuplicates(["doc_id", "digest", "new"])
        hits = found.filter("keep_id is not null").distinct()
        same = hits.join(texts.dropDuplicates(["keep_id", "digest", "old"]), ["keep_id", "digest"]).join(asked, ["doc_id", "digest"]).filter(F.col("old") == F.col("new")).select("doc_id", "digest", F.col("keep_id").alias("sure")).distinct()
        return found.join(same, ["doc_id", "digest"], "left").select("doc_id", "digest", F.col("sure").alias("keep_id"))
