"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the set of its shingles of five words (see `words`), each with weight tf * ln(1 + min(N / df, RARE)), where df counts
the documents, copies included, that hold the shingle. Without the bound the shingles of a text would weigh the less against those of an
edit the more copies it has and the larger the table is, and edited copies in large groups would not be linked. Two documents are linked if their weighted Jaccard similarity, the
sum of minima over the sum of maxima, is THRESHOLD or more. Classes are the connected components of the links.

1. Documents are dealt into blocks. Each block asks for the document frequencies of its distinct shingles, sorted
   and packed by range of the shingle's hash; each range is summed over all blocks and answered to each block.
2. A document of whose weight other documents hold too little to reach THRESHOLD with any of them is a class of its own.
   For each other the block draws ROWS * BANDS consistent weighted samples: the chosen shingle and its quantised level, so that
   two documents agree in a sample with the probability of their similarity. Samples are joined to bands of ROWS.
3. Documents with the same weighted shingles are one entity. Entities that share a band's value, a bucket, are candidates. In each bucket
   the member with the most candidates leads, and all others are compared with it, exactly: of copies of one text that
   is the text itself or one that is close to it, and what is not linked to it is little.
4. What is left are pairs of members of different components. Of a bucket that has few members, or few
   outside its largest component, all of those are compared (`SMALL`, `MINOR`): a member has a bounded number of partners there.
   Members of other buckets, which agree by chance, as on a passage that many documents hold, are dealt into buckets again, by
   FINE_BANDS bands of FINE_ROWS samples, and 3 and 4 are done once more, now with all pairs that are left.
   Of those a pair is formed only if its similarity can reach THRESHOLD: the shingles are dealt into PARTS parts by hash, and two
   documents have no more in common than, over the parts, the lesser of their weights in shingles that other texts hold too.

So no candidate pair of different components is given up that could be a link, and no bucket is paired off as a whole unless its members agree in FINE_ROWS samples.

A document without words is a class of its own. Null text counts as empty; documents of fewer than five words have one
shingle of all of them. Rows that repeat share a class. The class id is the smallest id in it (null ids lose to others).
An empty table gives an empty result; columns other than doc_id and text do not matter. Ids are whole numbers; others raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import bloom_of, passing
from .common import BROADCAST_ROWS, block_count, block_of, dropped, mark_of, require, require_ids, small, stored, text_of, trim_after, trimmed
from .pack import pack_counts, pack_sorted, unpack_counts, unpack_sorted
from .words import mix, shingle_hashes

THRESHOLD = 0.8
#: A shingle that one document in so many holds, or fewer, has the full weight: what copies share weighs as much as what an edit puts in.
RARE = 200
ROWS, BANDS = 3, 10
#: Bands of members of crowded buckets. A pair of similarity 0.8 shares none with a probability of 0.0002.
FINE_ROWS, FINE_BANDS, FINE_SAMPLES = 8, 48, 192
#: A bucket is compared in whole if it has so many members at most, or so many outside its largest component.
SMALL, MINOR = 64, 32
#: Parts of a document's shingles whose weights bound what two documents have in common.
PARTS = 64
#: Text bytes of a block, which bound a worker's arrays.
BLOCK_BYTES = 4 << 20
#: Pairs of one leader that one group verifies on average.
GROUP_PAIRS = 128
#: Links between classes that are brought to the driver at most, some 32 bytes each.
DRIVER_EDGES = 1 << 17
#: Packed shingles that are unpacked at a time.
PART_BYTES = 1 << 20
_CHUNK = 1 << 16


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in ascending order of key, and where in it each distinct key begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]]))


def shingles_of_block(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Distinct shingles of a block, ascending; then, ordered by document, for each document's distinct shingles: document, place among the block's, frequency."""
    keys, offset = shingle_hashes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offset))
    order, first = ranked(keys)
    place = np.zeros(len(keys), np.uint64)
    place[order] = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(keys))))
    entry, tf = np.unique((doc << np.uint64(32)) | place, return_counts=True)
    return keys[order[first]], (entry >> np.uint64(32)).astype(np.int64), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64), tf


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n ranges begins in ascending keys."""
    edges = np.array([-(-(i << 64) // n) for i in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20101)
    r = rng.gamma(2, 1, 1 << 16)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, rng.random(1 << 16), np.log(rng.gamma(2, 1, 1 << 16))))


def sample(keys: np.ndarray, log_weight: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """n samples of each document, 32 bits of the chosen shingle and level; start: where the documents' shingles begin."""
    r, inverse, beta, log_c = _draws()
    out = np.zeros((len(start), n), np.uint32)
    ends = np.append(start[1:], len(keys))
    low, lo = np.uint64(0xFFFF), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] + _CHUNK, "right")))
        own, lw, at = keys[start[lo] : ends[hi - 1]], log_weight[start[lo] : ends[hi - 1]], start[lo:hi] - start[lo]
        name = mix(own)
        for k in range(n):
            x = own * np.uint64(2 * (0x9E3779B97F4A7C15 * (k + 1) % (1 << 62)) + 1)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            i = (x >> np.uint64(48)).astype(np.int32)
            rk, bk = r[i], beta[((x >> np.uint64(32)) & low).astype(np.int32)]
            level = np.floor(lw * inverse[i] + bk)
            value = log_c[((x >> np.uint64(16)) & low).astype(np.int32)] - rk * (level - bk + np.float32(1))
            bits = value.view(np.int32)
            bits = (bits ^ ((bits >> 31) | np.int32(-(1 << 31)))).view(np.uint32)
            chosen = (name + level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            out[lo:hi, k] = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | chosen, at) & np.uint64(0xFFFFFFFF)
        lo = hi
    return out


def bands_of(samples: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A number for each band of a document; chosen: for each band which samples make it."""
    out = np.zeros((len(samples), len(chosen)), np.uint64)
    for j, band in enumerate(chosen):
        h = np.full(len(samples), j + 1, np.uint64)
        for i in band:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + samples[:, i])
        out[:, j] = h
    return out.view(np.int64)


@lru_cache(maxsize=1)
def _fine_bands() -> np.ndarray:
    """Bands of samples, each drawn without repeats."""
    rng = np.random.default_rng(82)
    return np.stack([rng.choice(FINE_SAMPLES, FINE_ROWS, replace=False) for _ in range(FINE_BANDS)])


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    return tf * np.log1p(np.minimum(n_docs / np.maximum(df, 1), RARE))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two documents: ascending shingles and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total > 0 else 0.0


SKETCH = "doc_id long, mark long, same binary, weight double, bands array<long>, shingles binary, tf binary, df binary"


def sketch(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with words, stored; all but doc_id and mark is null where no link is possible."""
    require_ids(docs, "doc_id")
    require(docs, "text")
    n_docs, n_blocks = block_count(docs, text_of(), BLOCK_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of().alias("mark"), text_of().alias("text"), block_of(n_blocks, F.col("doc_id"), text_of()).alias("block"))
    n_ranges = max(1, n_blocks // 2)

    @trimmed
    def ask(table: pa.Table) -> pa.Table:
        keys, _, place, _ = shingles_of_block(table.column("text").to_pylist())
        df, edge, block = np.bincount(place, minlength=len(keys)), _ranges(keys, n_ranges), table.column("block")[0].as_py()
        out = [(i, block, pack_sorted(keys[a:b]), pack_counts(df[a:b])) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "block", "keys", "n"])

    @trimmed
    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        n = np.concatenate([unpack_counts(x) for x in table.column("n").to_pylist()]).astype(np.int64)
        order, first = ranked(np.concatenate(keys))
        df = np.zeros(len(n), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(n))))
        cut = np.split(df, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([table.column("block"), table.column("range"), pa.array([pack_counts(x) for x in cut], pa.binary())], ["block", "range", "df"])

    @trimmed
    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("same", pa.binary()), ("weight", pa.float64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary()), ("tf", pa.binary()), ("df", pa.binary())])
        keys, doc, place, tf = shingles_of_block(left.column("text").to_pylist()) if left.num_rows else (np.zeros(0, np.uint64),) * 4
        if not len(keys):
            return schema.empty_table()
        answers = sorted(zip(right.column("range").to_pylist(), right.column("df").to_pylist(), strict=True))
        df = np.concatenate([unpack_counts(x) for _, x in answers]).astype(np.int64)[place]
        w = weights(tf, df, n_docs)
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total, shared, number = np.add.reduceat(w, start), np.add.reduceat(np.where(df > 1, w, 0), start), doc[start]
        # No similarity can exceed the share of weight that other documents hold too.
        close = shared >= (threshold - 1e-9) * total
        ids = list(zip(*(left.column(c).to_pylist() for c in ("doc_id", "mark")), strict=True))
        out = [(*ids[i], *[None] * 6) for i in number[~close]]
        kept = np.repeat(close, np.diff(np.append(start, len(doc))))
        own, w, tf, df = keys[place[kept]], w[kept], tf[kept], df[kept]
        number, total = number[close], total[close]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), np.diff(doc[kept]) != 0]))
        bands = bands_of(sample(own, np.log(w).astype(np.float32), start, ROWS * BANDS), np.arange(ROWS * BANDS).reshape(BANDS, ROWS))
        for i, (a, b) in enumerate(zip(start, np.append(start, len(own))[1:], strict=True)):
            shingles, counts = own[a:b], tf[a:b]
            same = hashlib.blake2b(shingles.tobytes() + counts.astype(np.int64).tobytes(), digest_size=16).digest()
            out.append((*ids[number[i]], same, float(total[i]), bands[i].tolist(), pack_sorted(shingles), pack_counts(counts), pack_counts(df[a:b])))
        return pa.table([pa.array([x[k] for x in out], t.type) for k, t in enumerate(schema)], schema=schema)

    asked = rows.groupBy("block").applyInArrow(ask, "range long, block long, keys binary, n binary")
    answered = asked.groupBy("range").applyInArrow(answer, "block long, range long, df binary")
    return stored(rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(draw, SKETCH), "sketches").withColumn("n_docs", F.lit(n_docs))


def _rooted(edges: pa.Table) -> pa.Table:
    """components() of edges in memory: the root is the least node."""
    a, b = (edges.column(c).combine_chunks() for c in "ab")
    both = pa.concat_arrays([a, b]).unique()
    nodes = both.take(pc.sort_indices(both))
    a, b, root = *(pc.index_in(x, nodes).to_numpy() for x in (a, b)), np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b])[apart], np.maximum(root[a], root[b])[apart]
        np.minimum.at(root, high, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return pa.table([nodes, nodes.take(pa.array(root))], ["node", "root"])


def components(edges: DataFrame, most: int = DRIVER_EDGES) -> DataFrame:
    """Edges (a, b) to (node, root) for all their nodes; root is a node that is connected, the same for all that are.

    Up to `most` stored edges meet on the driver, in one job. Beyond, each node hooks onto its smallest neighbour, paths are shortened by
    doubling, and edges are contracted. A path that is longer than that stays as an edge of the next round.
    """
    if edges.count() <= most:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame(_rooted(edges.select("a", "b").toArrow()), T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")).checkpoint()
        for _ in range(2):
            up = _hop(up.select("node", F.col("root").alias("last")), up, "last").select("node", F.col("next").alias("root"))
        up = up.checkpoint()
        found = up if found is None else _hop(found, up, "root").select("node", F.coalesce("next", "root").alias("root"))
        ends = [up.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
        contracted = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        longer = up.select(F.col("root").alias("a")).distinct().join(ends[0], "a").select("a", F.col("a_root").alias("b"))
        edges = contracted.unionByName(longer).filter("a <> b").distinct().checkpoint()
        if edges.isEmpty():
            return found


def _hop(nodes: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """nodes with `next`, the root in up of the node that the column names."""
    return nodes.join(up.select(F.col("node").alias(column), F.col("root").alias("next")), column, "left")


def features_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and weights of the documents of a table, and where each begins."""
    keys = [unpack_sorted(x) for x in table.column("shingles").to_pylist()]
    tf, df = (np.concatenate([unpack_counts(x) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("tf", "df"))
    start = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(k) for k in keys])[:-1]])
    return np.concatenate(keys), weights(tf, df, table.column("n_docs")[0].as_py()), start


def slices(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of a table in parts of about PART_BYTES of packed shingles, so that arrays stay small."""
    ends, lo = np.cumsum([len(x) for x in table.column("shingles").to_pylist()]), 0
    while lo < table.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART_BYTES, "right")))
        yield table.slice(lo, hi - lo)
        lo = hi


def verify(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Of stored pairs (a, b) of entities those that are similar enough. A leader with many pairs is dealt over several groups.

    Pairs are small and features are not: up to BROADCAST_ROWS pairs go to the features, beyond that both are shuffled.
    """
    sent = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda x: x
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_PAIRS).cast("int").alias("salts"))
    salted = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    left = features.withColumnRenamed("same", "b").join(sent(salted.select("a", "salt", "b")), "b")
    again = features.toDF(*features.columns)
    salts = sizes.toDF("a", "salts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("a", "salt")
    right = again.withColumnRenamed("same", "a").join(sent(salts), "a")
    right = right.toDF(*right.columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return left.select(["a", "b"]).slice(0, 0)
        own, weight, _ = features_of(right)
        similar = []
        for part in slices(left):
            keys, w, start = features_of(part)
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            both = np.add.reduceat(np.where(own[at] == keys, np.minimum(weight[at], w), 0), start)
            similar.append(both >= (threshold - 1e-9) * (weight.sum() + np.add.reduceat(w, start) - both))
        trim_after(left.nbytes)
        return left.select(["a", "b"]).filter(pa.array(np.concatenate(similar)))

    return left.groupBy("a", "salt").cogroup(right.groupBy("a", "salt")).applyInArrow(run, "a binary, b binary")


def parts_of(table: pa.Table, keys: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each document of a table (df, copies) the weight of each part of its shingles, without those that it and its copies alone hold; rounded up."""
    sizes = np.diff(np.append(start, len(keys)))
    df = np.concatenate([unpack_counts(x) for x in table.column("df").to_pylist()]).astype(np.int64)
    shared = df > np.repeat(table.column("copies").to_numpy(), sizes)
    part = np.repeat(np.arange(len(start)) * PARTS, sizes) + (keys % np.uint64(PARTS)).astype(np.int64)
    sums = np.bincount(part, np.where(shared, weight, 0), len(start) * PARTS).reshape(-1, PARTS)
    return np.nextafter(sums.astype(np.float32), np.float32(np.inf))


def fine_bands(features: DataFrame) -> DataFrame:
    """Features (same, weight, copies and the shingles) to (same, weight, bands, common, parts), by FINE_BANDS bands; common: the sum of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(pa.Table.from_batches([batch])):
                keys, w, start = features_of(part)
                bands = bands_of(sample(keys, np.log(w).astype(np.float32), start, FINE_SAMPLES), _fine_bands())
                parts = parts_of(part, keys, w, start)
                columns = [pa.array(bands.tolist(), pa.list_(pa.int64())), pa.array(parts.sum(1, dtype=np.float64)), pa.array(parts.tolist(), pa.list_(pa.float32()))]
                yield from pa.table([part.column(0), part.column(1), *columns], ["same", "weight", "bands", "common", "parts"]).to_batches()
            trim_after(batch.nbytes)

    own = features.select("same", "weight", "shingles", "tf", "df", "n_docs", "copies")
    return own.mapInArrow(run, "same binary, weight double, bands array<long>, common double, parts array<float>")


def reachable(overlap: Column, threshold: float) -> Column:
    """Whether two documents (weight, a_weight) that have so much in common at most can be similar enough."""
    return overlap * (1 + threshold) >= (threshold - 1e-6) * (F.col("weight") + F.col("a_weight"))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows (same, weight, bands) to (bucket, same, weight, n) for each bucket that two or more share, stored; n: its members."""
    each = rows.select("same", "weight", F.explode("bands").alias("bucket"))
    sizes = rows.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stored(each.join(sizes, "bucket"), "buckets")


def _merged(pairs: DataFrame, labels: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """labels after the links among pairs (a, b, a_root, b_root)."""
    pairs = stored(pairs.distinct(), "pairs")
    similar = stored(verify(pairs.select("a", "b"), features, threshold), "links")
    if similar.isEmpty():
        return labels
    edges = stored(similar.join(pairs, ["a", "b"]).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("next"))
    return stored(labels.join(moved, "root", "left").select("same", F.coalesce("next", "root").alias("root")), "labels")


def settle(buckets: DataFrame, labels: DataFrame, features: DataFrame, threshold: float, bands: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """labels after the links in buckets (bucket, n, same, weight), and the members of crowded buckets.

    With bands (same, bands, common, parts) of the members, all pairs that are left and can be links are compared, and no bucket is crowded.
    """
    close = F.least("weight", "a_weight") >= threshold * F.greatest("weight", "a_weight") - 1e-9
    whole = bands is not None
    central = buckets.groupBy("same").agg(F.sum("n").alias("central"))
    known = stored(buckets.select("bucket", "same", "weight").join(central.join(labels, "same"), "same"), "members")
    # The leader is the member with the most candidates; ties go by hash.
    first = F.max(F.struct("central", F.xxhash64("same").alias("h"), "same", "root", "weight")).alias("l")
    leaders = known.groupBy("bucket").agg(first).select("bucket", F.col("l.same").alias("a"), F.col("l.root").alias("a_root"), F.col("l.weight").alias("a_weight"))
    led = known.join(leaders, "bucket").filter((F.col("same") != F.col("a")) & (F.col("root") != F.col("a_root")) & close)
    labels = _merged(led.select("a", F.col("same").alias("b"), "a_root", F.col("root").alias("b_root")), labels, features, threshold)

    # Leaders have met all others of their buckets.
    left = known.select("bucket", "same", "weight").join(leaders.select("bucket", F.col("a").alias("same")), ["bucket", "same"], "left_anti").join(labels, "same")
    left = stored(left, "members")
    roots = left.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = roots.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    few = F.lit(whole) | (F.col("n") <= SMALL) | (F.col("n") - F.col("top.n") <= MINOR)
    open_ = stored(sizes.select("bucket", F.col("top.root").alias("top"), few.alias("few")), "open")
    if open_.isEmpty():
        return labels, None
    met = left.join(open_.filter("few"), "bucket")
    if whole:
        met = stored(met.join(bands, "same"), "met")
    minor = met.filter(F.col("root") != F.col("top")).select("bucket", F.col("same").alias("a"), F.col("root").alias("a_root"), F.col("weight").alias("a_weight"), *(F.col(c).alias(f"a_{c}") for c in ("bands", "common", "parts") if whole))
    # Of two members outside the largest component the smaller asks.
    once = (F.col("root") == F.col("top")) | (F.col("a") < F.col("same"))
    if whole:
        # A pair is of the first bucket that it shares; where one of the two led that, they have met.
        both = F.filter(F.zip_with("bands", "a_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        once &= F.get(both, F.lit(0)) == F.col("bucket")
        # What needs less work is tested first.
        overlap = F.aggregate(F.zip_with("parts", "a_parts", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y.cast("double"))
        once = reachable(F.least("common", "a_common"), threshold) & once & reachable(overlap, threshold)
    rest = met.join(minor, "bucket").filter((F.col("root") != F.col("a_root")) & once & close)
    labels = _merged(rest.select("a", F.col("same").alias("b"), "a_root", F.col("root").alias("b_root")), labels, features, threshold)
    crowded = None if whole else stored(left.join(open_.filter("not few"), "bucket").select("same").distinct(), "crowded")
    return labels, crowded


def linked(entities: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """Entities (same, rep, n, weight, bands) that have candidates, as (same, root); None if there are none."""
    buckets = shared_buckets(entities.select("same", "weight", "bands"))
    candidates = stored(buckets.select("same").distinct().join(entities.select("same", "rep", F.col("n").alias("copies")), "same"), "candidates")
    n = candidates.count()
    if not n:
        return None
    # One row of each entity is read: the filter is of entity and id, so that copies are not shuffled.
    chosen = lambda i: F.unhex(F.md5(F.concat(F.hex("same").cast("binary"), F.coalesce(F.col(i).cast("string"), F.lit("")).cast("binary")))).alias("chosen")
    few = passing(sketches.filter("same is not null").withColumn("chosen", chosen("doc_id")), "chosen", bloom_of(candidates.select(chosen("rep")), n)).drop("chosen")
    features = few.join(small(candidates).select(F.col("same").alias("_same"), "rep", "copies"), (F.col("same") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    features = stored(features.select("same", "weight", "shingles", "tf", "df", "n_docs", "copies").dropDuplicates(["same"]), "features")
    labels, crowded = settle(buckets, candidates.select("same", F.col("same").alias("root")), features, threshold)
    if crowded is not None and not crowded.isEmpty():
        fine = stored(fine_bands(features.join(small(crowded), "same", "left_semi")), "fine")
        labels, _ = settle(shared_buckets(fine), labels, features, threshold, fine.drop("weight"))
    return labels


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """classes() with `mark`, the hash of the row's text."""
    sketches = sketch(docs, threshold)
    entities = stored(sketches.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "entities")
    labels = linked(entities, sketches, threshold)
    own = entities.select("same", "rep", "n")
    if labels is None:
        roots = own.select("same", F.col("rep").alias("class_id"), F.col("n").alias("class_size"))
    else:
        in_class = own.join(labels, "same", "left").withColumn("root", F.coalesce("root", "same"))
        ids = in_class.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
        roots = in_class.join(ids, "root").select("same", "class_id", "class_size")
    roots = stored(roots, "roots")
    found = sketches.filter("same is not null").select("doc_id", "mark", "same").join(roots, "same").select("doc_id", "mark", "class_id", "class_size")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of().alias("mark"), text_of().alias("text")).filter(~has_words(F.col("text"))).select("doc_id", "mark")
    alone = sketches.filter("same is null").select("doc_id", "mark").unionByName(bare)
    return found.unionByName(alone.select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, kept (the document is its class's first) for all rows of docs."""
    return _classes(docs, threshold).drop("mark")


def has_words(text: Column) -> Column:
    """As in `words`: letters, digits and non-ASCII characters."""
    return text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that are not their class's first. Rows that repeat id and text stay or go together; rows without words stay."""
    gone = _classes(docs, threshold).filter(~F.col("kept"))
    return dropped(docs, gone.select("doc_id", "mark"))
