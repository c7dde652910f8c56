"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted documents.

Symbols are UTF-16 code units of the text with runs of white space as one space; a word that repeats the word before it is
one symbol of its own, without a space, so that stuttering text is as unlikely as it looks. N-grams have ORDER = 4 symbols, which one
64-bit number holds exactly. Counts of all trusted documents are used; nothing is sampled.

The model is never in one place. Documents are dealt into blocks. Each block sends its trusted counts, and the distinct
n-grams that it needs, to shards by the two middle symbols: a shard has all that the orders 4 and 3 need of
an n-gram (its count, its context's total and types, the same of the shorter n-gram). What is left, the
probability of the last symbol after the third, comes from tables of bigrams by joins. Log probabilities go back to the
blocks, which sum them for each document.

Trusted documents fall into FOLDS = 5 folds by hash of the id, and there is a model without each of them. A trusted
document is scored by the model without its own fold, any other by the one without fold 0, so all are scored by
models of the same size that have not seen them, and every trusted document calibrates.

A document's score is its bits per symbol, drawn towards its language's mean as by SHRINK symbols, so that a few
odd symbols don't condemn a short text. Means and thresholds are of the scores of trusted documents. A language's mean is
drawn towards that of all as by MEAN_PULL documents. Its threshold is its mean and an excess over it, a quantile of
its own documents' excesses drawn towards that of all documents' as by 1 / (1 - quantile) documents, of
which one is beyond the quantile. So nothing switches at a number of documents. Rows without a language may be of any:
their threshold is the quantile of all scores. Quantiles are counted in steps of 2**-20 bits and sums are of whole numbers or
decimals, so results do not depend on the order in which parts of the data are merged.

Defined results: a null text or one without words has a null perplexity and is rejected; without trusted documents nothing
else is rejected. Rows that repeat are scored each. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_count, dropped, mark_of, release, require, require_ids, small, stored, text_of, trimmed
from .pack import pack_counts, pack_floats, pack_sorted, pack_text, unpack_counts, unpack_floats, unpack_sorted, unpack_text
from .words import mix

ORDER = 4
PAD, REPEAT, END = "\x01", "\x02", "\x03"
BLOCK_BYTES = 2 << 20
SHRINK = 60
QUANTILE = 0.995
FOLDS = 5
MEAN_PULL = 1
#: Steps to a bit in which quantiles are counted, and steps of which the first pass makes one, as a power of two.
STEPS, COARSE_BITS = 1 << 20, 12
#: Rows of a table by language that are broadcast at most.
BROADCAST_LANGUAGES = 1 << 16


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code units of all texts, each after ORDER - 1 pads and before an end, and where the texts begin (with the end)."""
    parts, sizes = [], []
    for text in texts:
        words = text.split()
        plain = "".join([REPEAT if w == p else f" {w}" for p, w in zip([None, *words], words, strict=False)])
        code = (PAD * (ORDER - 1) + plain[1:] + END).encode("utf-16-le", "surrogatepass")
        parts.append(code)
        sizes.append(len(code) // 2)
    return np.frombuffer(b"".join(parts), "<u2"), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def ngrams(units: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-grams, ascending; for each position, in order of n-gram, the position; where each n-gram begins in that; and which text each position is of.

    An n-gram a b c d stands as the number b c a d, 16 bits each.
    """
    text = np.repeat(np.arange(len(offset) - 1, dtype=np.int32), np.maximum(np.diff(offset) - ORDER + 1, 0))
    at = np.arange(len(text), dtype=np.int32) + text * np.int32(ORDER - 1)
    seen = np.bincount(units, minlength=1 << 16) > 0
    rank = (np.cumsum(seen) - 1).astype(np.uint64)[units]
    width = np.uint64(max(1, int(seen.sum() - 1).bit_length()))
    whole = np.zeros(max(0, len(units) - ORDER + 1), np.uint64)
    for i in (1, 2, 0, 3):
        whole = (whole << width) | rank[i : len(rank) - ORDER + 1 + i]
    key = whole[at]
    del rank, whole
    bits = np.uint64(max(1, len(key).bit_length()))
    if 4 * int(width) + int(bits) <= 64:
        both = np.sort((key << bits) | np.arange(len(key), dtype=np.uint64))
        order, ordered = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), ordered[1:] != ordered[:-1]]))
    place = at[order[first]]
    full = np.zeros(len(first), np.uint64)
    for i in (1, 2, 0, 3):
        full = (full << np.uint64(16)) | units[place + i].astype(np.uint64)
    return full, order, first, text


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def discounts(n: list[int]) -> list[float]:
    """Of an order, from how many n-grams have the counts 1 to 4: what counts of 1, 2, and more lose."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _interpolated(n_gram: np.ndarray, context: np.ndarray, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """For n-grams asked for: their discounted share in their context, and the share that the context leaves to the lower order.

    keys, counts: those of the model, ascending; contexts: those of the keys.
    """
    if not len(keys):
        return np.zeros(len(n_gram)), np.ones(len(n_gram))
    loss = np.array([0.0, *d])[np.minimum(counts, 3)]
    known, start = np.unique(contexts, return_index=True)
    total, left = np.add.reduceat(counts, start), np.add.reduceat(loss, start)
    i = np.minimum(np.searchsorted(keys, n_gram), len(keys) - 1)
    j = np.minimum(np.searchsorted(known, context), len(known) - 1)
    own = np.where(keys[i] == n_gram, counts[i] - loss[i], 0.0)
    there = known[j] == context
    return np.where(there, own / total[j], 0.0), np.where(there, left[j] / total[j], 1.0)


def _shorter(keys: np.ndarray) -> np.ndarray:
    """b c a d to b c d."""
    return ((keys >> np.uint64(32)) << np.uint64(16)) | (keys & np.uint64(0xFFFF))


def _types(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (table.column(c).to_pylist() for c in ("keys", "counts"))
    return np.concatenate([unpack_sorted(k) for k in keys]), np.concatenate([unpack_counts(c) for c in counts]).astype(np.int64)


def build(pieces: DataFrame) -> DataFrame:
    """Counts of blocks to one row for each shard and fold left out: the counts of the orders 4 and 3, and the types of bigrams."""
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6, *[pa.list_(pa.int64())] * 2]
    names = ["shard", "fold", "keys4", "counts4", "keys3", "counts3", "keys2", "counts2", "types4", "types3"]

    @trimmed
    def run(table: pa.Table) -> pa.Table:
        fold = table.column("fold").to_numpy()
        own = [summed(*_gather(table.filter(pa.array(fold == k)))) if (fold == k).any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k in range(FOLDS)]
        keys, counts = summed(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
        rows = []
        for fold, (k, c) in enumerate(own):
            rest = counts.copy()
            rest[np.searchsorted(keys, k)] -= c
            k4, c4 = keys[rest > 0], rest[rest > 0]
            k3, c3 = summed(_shorter(k4), np.ones(len(k4), np.int64))
            k2, c2 = summed(k3 & np.uint64(0xFFFFFFFF), np.ones(len(k3), np.int64))
            rows.append([table.column("shard")[0].as_py(), fold, *(f(x) for k, c in ((k4, c4), (k3, c3), (k2, c2)) for f, x in ((pack_sorted, k), (pack_counts, c))), _types(c4), _types(c3)])
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    kind = "shard long, fold long, keys4 binary, counts4 binary, keys3 binary, counts3 binary, keys2 binary, counts2 binary, types4 array<long>, types3 array<long>"
    return stored(pieces.filter("trusted").select("shard", "fold", "keys", "counts").groupBy("shard").applyInArrow(run, kind), "ngrams")


def _by_fold(df: DataFrame, *columns: Column) -> list[list[float]]:
    """Of each fold left out: the discounts, from the columns n0 to n3."""
    found = {r["fold"]: [r[f"n{i}"] or 0 for i in range(4)] for r in df.groupBy("fold").agg(*(c.alias(f"n{i}") for i, c in enumerate(columns))).collect()}
    return [discounts(found.get(k, [0] * 4)) for k in range(FOLDS)]


def _sum_types(df: DataFrame, column: str) -> list[list[float]]:
    return _by_fold(df, *(F.sum(F.col(column)[i]) for i in range(4)))


def _count_types(df: DataFrame) -> list[list[float]]:
    return _by_fold(df, *(F.count_if(F.col("n") == i + 1) for i in range(4)))


def _of_fold(values: list) -> Column:
    """The value of the row's fold; values are numbers, or lists of which n - 1 chooses, the last for larger n."""
    if not isinstance(values[0], list):
        return F.element_at(F.array(*map(F.lit, values)), F.col("fold").cast("int") + 1)
    table = F.array(*(F.lit(float(x)) for row in values for x in row))
    return F.element_at(table, (F.col("fold") * len(values[0]) + F.least("n", F.lit(len(values[0])))).cast("int"))


def _lost(ds: list[list[float]]) -> Column:
    """What all counts of a group lose by the discounts of its fold, from numbers of counts."""
    return sum((F.count_if(F.least("n", F.lit(3)) == i + 1) * _of_fold([d[i] for d in ds]) for i in range(3)), F.lit(0.0))


def log_probabilities(pieces: DataFrame) -> DataFrame:
    """(shard, fold, n_gram, log_p) for every distinct n-gram that a block needs of the model without a fold."""
    model = build(pieces)
    d4, d3 = _sum_types(model, "types4"), _sum_types(model, "types3")

    def bigrams_of(batches):
        for batch in batches:
            for f, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = _signed(unpack_sorted(k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), f)), pa.array(keys), pa.array(unpack_counts(c).astype(np.int64))], ["fold", "pair", "n"])

    bigrams = stored(model.select("fold", "keys2", "counts2").mapInArrow(bigrams_of, "fold long, pair long, n long").groupBy("fold", "pair").agg(F.sum("n").alias("n")), "bigrams")
    c, d = F.shiftrightunsigned("pair", 16).alias("c"), F.col("pair").bitwiseAND(0xFFFF).alias("d")
    d2 = _count_types(bigrams)
    unigrams = bigrams.groupBy("fold", d).agg(F.count(F.lit(1)).alias("n"))
    d1 = _count_types(unigrams)
    sums = {r["fold"]: r for r in unigrams.groupBy("fold").agg(F.sum("n").alias("t"), _lost(d1).alias("l"), F.count(F.lit(1)).alias("v")).collect()}
    totals = [sums[k]["t"] if k in sums else 1 for k in range(FOLDS)]
    rests = [sums[k]["l"] / sums[k]["t"] / (sums[k]["v"] + 1) if k in sums else 1.0 for k in range(FOLDS)]
    # Both tables have at most 65,536 rows for each fold, one for each code unit.
    last = F.broadcast(unigrams.select("fold", "d", ((F.col("n") - _of_fold(d1)) / _of_fold(totals) + _of_fold(rests)).alias("p1")))
    before = F.broadcast(bigrams.groupBy("fold", c).agg(F.sum("n").alias("t2"), _lost(d2).alias("l2")))
    pairs = bigrams.select("fold", "pair", (F.col("n") - _of_fold(d2)).alias("own2"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard, fold = (int(k.as_py()) for k in key)
        asked = np.unique(np.concatenate([unpack_sorted(k) for k in left.column("keys").to_pylist()] or [np.zeros(0, np.uint64)]))
        one = (lambda c, f: f(right.column(c)[0].as_py())) if right.num_rows else (lambda c, f: np.zeros(0, np.uint64))
        k4, k3 = one("keys4", unpack_sorted), one("keys3", unpack_sorted)
        c4, c3 = one("counts4", unpack_counts).astype(np.int64), one("counts3", unpack_counts).astype(np.int64)
        p4, l4 = _interpolated(asked, asked >> np.uint64(16), k4, c4, k4 >> np.uint64(16), d4[fold])
        short = _shorter(asked)
        p3, l3 = _interpolated(short, short >> np.uint64(16), k3, c3, k3 >> np.uint64(16), d3[fold])
        pair = ((asked >> np.uint64(16)) & np.uint64(0xFFFF0000)) | (asked & np.uint64(0xFFFF))
        return pa.table([pa.array(np.full(len(asked), shard)), pa.array(np.full(len(asked), fold)), pa.array(_signed(asked)), pa.array(_signed(pair)), pa.array(p4 + l4 * p3), pa.array(l4 * l3)], ["shard", "fold", "n_gram", "pair", "p", "left"])

    wanted = asking(pieces).groupBy("shard", "fold").cogroup(model.select("shard", "fold", "keys4", "counts4", "keys3", "counts3").groupBy("shard", "fold")).applyInArrow(run, "shard long, fold long, n_gram long, pair long, p double, left double")
    joined = wanted.withColumn("c", F.shiftrightunsigned("pair", 16)).withColumn("d", F.col("pair").bitwiseAND(0xFFFF)).join(pairs, ["fold", "pair"], "left").join(before, ["fold", "c"], "left").join(last, ["fold", "d"], "left")
    p1 = F.coalesce("p1", _of_fold(rests))
    p2 = F.when(F.col("t2").isNull(), p1).otherwise(F.coalesce("own2", F.lit(0.0)) / F.col("t2") + F.col("l2") / F.col("t2") * p1)
    return joined.select("shard", "fold", "n_gram", F.log(F.col("p") + F.col("left") * p2).alias("log_p"))


def asking(pieces: DataFrame) -> DataFrame:
    """What blocks need: all their n-grams of the model without fold 0, those of trusted documents of another fold of the model without that one."""
    return pieces.filter("not trusted or fold > 0").select("block", "shard", "fold", "keys")


def folds_of(ids: pa.ChunkedArray, trusted: np.ndarray) -> np.ndarray:
    """The fold of each document, -1 if it is not trusted."""
    known = set(trusted.tolist())
    return np.array([crc32(str(i).encode()) % FOLDS if i in known else -1 for i in ids.to_pylist()], np.int64)


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, mark (the hash of the text), lang, n (symbols), nll (natural, of the model without fold 0), out_nll (of the model without the own fold; null unless trusted), calibrates (of fold 0); stored.

    trusted: doc_id of trusted documents, distinct.
    """
    require_ids(docs, "doc_id")
    require(docs, "text")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    _, n_blocks = block_count(docs, text_of(), BLOCK_BYTES)
    n_shards = max(4, n_blocks // 16)
    block = lambda *k: F.pmod(F.xxhash64(F.coalesce(*k)), F.lit(n_blocks)).cast("long").alias("block")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_of().alias("text"), mark_of().alias("mark"), block(F.col("doc_id").cast("string"), text_of()))

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), pa.array([pack_text(t) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "lang", "mark", "block", "packed"])

    # Texts are shuffled twice; packed one by one they take a third less than by the shuffle's own compression.
    rows = rows.mapInArrow(packed, "doc_id long, lang string, mark long, block long, packed binary")
    texts = lambda table: [unpack_text(x) for x in table.column("packed").to_pylist()]
    known = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    train = known.select(F.col("doc_id").alias("id"), block(F.col("doc_id").cast("string")))

    @trimmed
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["trusted", "shard", "fold", "block", "keys", "counts"], (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        out: list[tuple] = []
        if left.num_rows:
            keys, order, first, text = ngrams(*symbols(texts(left)))
            ids = right.column("id").to_numpy()
            fold = folds_of(left.column("doc_id"), ids)[text[order]]
            place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            counts = [np.bincount(place[fold == k], minlength=len(first)) for k in range(FOLDS)]
            shard, number = shard_of(keys, n_shards), left.column("block")[0].as_py()
            # Neither asks nor counts: which documents are trusted.
            out.append((None, -1, -1, number, ids.tobytes(), None))
            for s in np.unique(shard):
                own = shard == s
                out.append((False, int(s), 0, number, pack_sorted(keys[own]), None))
                for k, n in enumerate(counts):
                    if (there := own & (n > 0)).any():
                        out.append((True, int(s), k, number, pack_sorted(keys[there]), pack_counts(n[there])))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    @trimmed
    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known, log_p = right.column("n_gram").to_numpy().view(np.uint64), right.column("log_p").to_numpy()
        order = np.argsort(known)
        known, log_p = known[order], log_p[order]
        out = [pack_floats(log_p[np.searchsorted(known, unpack_sorted(k))]) for k in left.column("keys").to_pylist()]
        return pa.table([left.column("block"), left.column("shard"), left.column("fold"), pa.array(out, pa.binary())], ["block", "shard", "fold", "found"])

    @trimmed
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "mark", "lang", "n", "nll", "out_nll", "calibrates"], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        keys, order, first, text = ngrams(*symbols(texts(left)))
        answers = sorted(zip(*(right.column(c).to_pylist() for c in ("fold", "shard", "found")), strict=True))
        fold = folds_of(left.column("doc_id"), np.frombuffer(answers[0][2], np.int64))
        shard, owner = shard_of(keys, n_shards), fold[text[order]]
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))

        def log_p(k: int, which: np.ndarray) -> np.ndarray:
            """Of the model without fold k, for the n-grams `which`."""
            out = np.zeros(len(keys))
            out[which[np.argsort(shard[which], kind="stable")]] = np.concatenate([unpack_floats(x) for f, _, x in answers if f == k])
            return out

        each = np.zeros(len(order))
        if len(keys):
            each = log_p(0, np.arange(len(keys)))[place]
        total = lambda: -np.bincount(text[order], each, minlength=left.num_rows)
        nll, n = total(), np.bincount(text, minlength=left.num_rows)
        for k in range(1, FOLDS):
            if (at := owner == k).any():
                each[at] = log_p(k, np.unique(place[at]))[place[at]]
        return pa.table([left.column("doc_id"), left.column("mark"), left.column("lang"), pa.array(n.astype(np.int64) - 1), pa.array(nll), pa.array(total(), mask=fold < 0), pa.array(fold == 0)], names=names)

    asked = rows.groupBy("block").cogroup(train.groupBy("block")).applyInArrow(ask, "trusted boolean, shard long, fold long, block long, keys binary, counts binary")
    pieces = stored(asked, "pieces")
    del asked
    release(docs.sparkSession)
    answered = asking(pieces).groupBy("shard", "fold").cogroup(log_probabilities(pieces).groupBy("shard", "fold")).applyInArrow(answer, "block long, shard long, fold long, found binary")
    answered = answered.unionByName(pieces.filter("trusted is null").select("block", "shard", "fold", F.col("keys").alias("found")))
    return stored(rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(add, "doc_id long, mark long, lang string, n long, nll double, out_nll double, calibrates boolean"), "scores")


def _few(by_language: DataFrame) -> DataFrame:
    """A table of a row for each language, stored, and broadcast if those are few, as they are unless the column holds something else."""
    return small(stored(by_language, "languages"), BROADCAST_LANGUAGES)


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """(kind, lang, at): of each group the smallest whole step that `quantile` of its values at least don't exceed; stored.

    values: kind, lang, value, none null. The first pass counts values in coarse bins, the second those of the bin that holds the quantile
    by steps. A group is a row for each of its bins, of which there are some thousands, whatever its values are as many.
    """
    steps = values.select("kind", "lang", F.ceil(F.col("value") * STEPS).alias("step")).withColumn("bin", F.shiftright("step", COARSE_BITS))
    group = Window.partitionBy("kind", "lang")

    def holding(counts: DataFrame, by: str, need: Column) -> DataFrame:
        upto = F.sum("n").over(group.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("upto", upto).withColumn("need", need).filter("upto >= need and upto - n < need")

    coarse = steps.groupBy("kind", "lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = holding(coarse, "bin", F.greatest(F.lit(1), F.ceil(quantile * F.sum("n").over(group))))
    bins = _few(bins.select("kind", "lang", "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("rest")))
    fine = steps.join(bins, ["kind", "lang", "bin"]).groupBy("kind", "lang", "step", "rest").agg(F.count(F.lit(1)).alias("n"))
    return stored(holding(fine, "step", F.col("rest")).select("kind", "lang", (F.col("step") / STEPS).alias("at")), "quantiles")


def judged(found: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, mark, lang, n_symbols, perplexity, score (bits per symbol, shrunk), threshold, rejected."""
    bits = F.log(F.lit(2.0))
    found = found.select("doc_id", "mark", "lang", "n", F.coalesce("out_nll", "nll").alias("nll"), (F.col("out_nll").isNotNull() & (F.col("n") > 0)).alias("usable"))
    average = F.sum(F.col("nll").cast("decimal(28,6)")).cast("double") / F.sum("n")
    whole = found.filter("usable").agg(average.alias("m")).first()["m"]
    pull = 1 / max(1 - quantile, 1e-9)
    towards = lambda own, pooled, by: (F.col("n_docs") * own + by * pooled) / (F.col("n_docs") + by)
    means = found.filter("usable and lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), average.alias("own"))
    means = means.select("lang", "n_docs", towards(F.col("own"), F.lit(whole), MEAN_PULL).alias("own_mean"))
    # One row for each language; rows without a language meet none.
    mean = F.coalesce("own_mean", F.lit(whole))
    score = F.when(F.col("n") > 0, (F.col("nll") + SHRINK * F.coalesce(mean, F.col("nll") / F.col("n"))) / (F.col("n") + SHRINK) / bits)
    scored = found.join(_few(means), "lang", "left").withColumn("score", score).withColumn("excess", F.col("score") - mean / bits)
    kept, value = scored.filter("usable"), lambda kind, lang, x: F.struct(F.lit(kind).alias("kind"), lang.alias("lang"), x.alias("value"))
    own = F.when(F.col("lang").isNotNull(), F.col("excess"))
    values = kept.select(F.inline(F.array(value("score", F.lit(""), F.col("score")), value("excess", F.lit(""), own), value("own", F.coalesce("lang", F.lit("")), own))))
    found = quantiles(values.filter("value is not null"), quantile)
    limit = {r["kind"]: r["at"] for r in found.filter("kind <> 'own'").collect()}
    limit = {kind: F.lit(limit.get(kind)).cast("double") for kind in ("score", "excess")}
    limits = found.filter("kind = 'own'").select("lang", F.col("at").alias("own_excess"))
    excess = F.coalesce(towards(F.col("own_excess"), limit["excess"], pull), limit["excess"])
    threshold = F.when(F.col("lang").isNull(), limit["score"]).otherwise(F.coalesce(mean / bits + excess, limit["score"]))
    limited = scored.join(_few(limits), "lang", "left").withColumn("threshold", threshold)
    return limited.select("doc_id", "mark", "lang", F.greatest("n", F.lit(0)).cast("long").alias("n_symbols"), F.when(F.col("n") > 0, F.exp(F.col("nll") / (F.col("n") + 1))).alias("perplexity"), "score", "threshold", ((F.col("n") <= 0) | F.coalesce(F.col("score") > F.col("threshold"), F.lit(False))).alias("rejected"))


def trusted_of(labels: DataFrame) -> DataFrame:
    """Documents that a label calls good and not toxic, and none calls otherwise."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Scores and decisions for all rows of docs: doc_id, lang, n_symbols, perplexity, score, threshold, rejected."""
    return judged(scores(docs, trusted_of(labels)), quantile).drop("mark")


def filtered(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs without rejected rows. Rows that repeat id and text go if one of them is rejected."""
    found = judged(scores(docs, trusted_of(labels)), quantile)
    return dropped(docs, found.filter("rejected").select("doc_id", "mark"))
