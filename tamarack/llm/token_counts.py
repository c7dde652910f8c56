"""Token counts by source, language and tokenizer version, kept by deltas.

A rollup is a folder. A batch of changes is reduced to one signed row for each group (inserts add, deletes
subtract, revisions add the difference, and move between groups if the group changes), written to a folder of its own,
and becomes valid when its commit marker, which names the folder, is renamed into place. A batch whose marker exists
is not applied again; a folder that no marker names, of a call that broke off or lost to another writer, is never read. Totals are sums of the last base and
the committed batches after it; compaction makes a new base and lists the batches that it holds, again by a marker that is there whole or not at all.

Groups are reduced in each task before rows move, so a source with a third of all rows is no heavier than others.
Counting: a null or empty text has no tokens; texts are counted whole. A null source or language is a group of its own. Groups
whose documents are all gone are left out of totals. An empty batch is a valid batch.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Markers, create_once, delete_path, names_in, path_exists, read_small, require, text_of

GROUP = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
#: Fixed value: the published pattern by which the byte-level vocabulary splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def count_tokens(docs: DataFrame, ranks: bytes, version: str) -> DataFrame:
    """doc_id, source, lang, version, n_tokens, n_chars. ranks: a vocabulary file of base64 tokens and ranks."""
    require(docs, "doc_id", "text", "source", "lang")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(known.value)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            n = [len(encoding.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", *GROUP, "n_tokens", "n_chars"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, lang string, version string, n_tokens long, n_chars long")


def signed(changes: DataFrame) -> DataFrame:
    """Changes to signed rows of a group.

    changes: op (insert, delete or revise), the group and counts that hold after it (insert, revise), and as old_source, old_lang,
    old_version, old_tokens, old_chars those that held before (delete, revise). Other values of op raise an error.
    """
    checked = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("op is "), F.coalesce("op", F.lit("null")))))

    def side(sign: int, names: list[str], counts: list[str]) -> Column:
        return F.struct(*(F.col(c).alias(g) for c, g in zip(names, GROUP, strict=True)), F.lit(sign).cast("long").alias("n_docs"), *((sign * F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(s) for c, s in zip(counts, SUMS[1:], strict=True)))

    new, old = side(1, GROUP, SUMS[1:]), side(-1, [f"old_{g}" for g in GROUP], ["old_tokens", "old_chars"])
    sides = F.when(checked == "insert", F.array(new)).when(checked == "delete", F.array(old)).otherwise(F.array(new, old))
    return changes.select(F.explode(sides).alias("x")).select("x.*")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Markers(spark, f"{self.path}/generations")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of changes; False if it had been applied before, or another writer of it was first."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError("a batch's name is a file name")
        if path_exists(self.spark, f"{self.path}/commits/{batch}"):
            return False
        sums = signed(changes).groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
        folder = f"{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/deltas/{folder}")
        if create_once(self.spark, f"{self.path}/commits/{batch}", folder):
            return True
        delete_path(self.spark, f"{self.path}/deltas/{folder}")
        return False

    def _state(self) -> tuple[int, str, str, set[str], dict[str, str]]:
        """The last base (0: none), its folder, the folder of the base before it, the batches in it, and the folders of the batches after it."""
        number, text = self.log.last()
        folder, before, *held = text.split("\n") if number else ("", "")
        batches = [b for b in names_in(self.spark, f"{self.path}/commits") if not b.startswith(".")]
        return number, folder, before, set(held), {b: read_small(self.spark, f"{self.path}/commits/{b}") for b in batches if b not in set(held)}

    def _sums(self, folder: str, deltas: dict[str, str]) -> DataFrame:
        parts = [f"{self.path}/deltas/{d}" for d in deltas.values()] + ([f"{self.path}/bases/{folder}"] if folder else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        _, folder, _, _, deltas = self._state()
        return self._sums(folder, deltas)

    def compact(self) -> None:
        """A new base of the last one and what was committed after it, as of one look at the folder.

        What the last base held is deleted only now, so readers that began before this call keep their files.
        """
        number, folder, before, held, deltas = self._state()
        if not deltas:
            return
        new = f"{number + 1}-{uuid.uuid4().hex}"
        self._sums(folder, deltas).write.parquet(f"{self.path}/bases/{new}")
        if not self.log.add(number + 1, "\n".join([new, folder, *sorted(held | set(deltas))])):
            return delete_path(self.spark, f"{self.path}/bases/{new}")
        if before:
            delete_path(self.spark, f"{self.path}/bases/{before}")
        for name in names_in(self.spark, f"{self.path}/deltas"):
            if name.rpartition("-")[0] in held:
                delete_path(self.spark, f"{self.path}/deltas/{name}")


def inserts(counts: DataFrame) -> DataFrame:
    return _changes(counts, "insert", old=False)


def deletes(counts: DataFrame) -> DataFrame:
    return _changes(counts, "delete", old=True)


def _changes(counts: DataFrame, op: str, old: bool) -> DataFrame:
    null = F.lit(None)
    columns = []
    for c, kind in (*((g, "string") for g in GROUP), ("n_tokens", "long"), ("n_chars", "long")):
        before = f"old_{c.removeprefix('n_')}"
        columns += [(null.cast(kind) if old else F.col(c)).alias(c), (F.col(c) if old else null.cast(kind)).alias(before)]
    return counts.select(F.lit(op).alias("op"), *columns)


def revisions(counts: DataFrame, estimates: Column) -> DataFrame:
    """Counts that replace estimates of the tokens in the same group."""
    own = [F.col(c) for c in GROUP]
    return counts.select(F.lit("revise").alias("op"), *own, "n_tokens", "n_chars", *(c.alias(f"old_{g}") for c, g in zip(own, GROUP, strict=True)), estimates.cast("long").alias("old_tokens"), F.col("n_chars").alias("old_chars"))
