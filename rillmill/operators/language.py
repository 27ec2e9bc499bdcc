"""Counts over token sequences: pairs of neighbours, keyness, smoothed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rillmill.functions.text import g2, poisson_surprise
from rillmill.operators.recursion import cut
from rillmill.sources.tables import file_bytes, spread

BLOCK = 1 << 20  # tokens that a task counts at once
BROADCAST_ROWS = 1_000_000
MERGED = 16 << 20  # bytes of a corpus whose pairs are merged by one task
_KIND = np.array([1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 0 for c in range(256)], dtype=np.uint8)
SHARE = 3 << 20  # bytes of a corpus whose n-grams one partition takes


def collocations(df: DataFrame, keys: list[str], text: Column, least: int = 5) -> DataFrame:
    """(keys, left, right, joint, g2, surprise) of the pairs of neighbouring words that occur ``least`` times; rows with a null key are left out.

    Pairs, the marginals of either side and the number of all pairs are counted in blocks and go over once, a word or two of
    the marginals being null; what is kept of them is what ``least`` leaves.
    """
    known = df.where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)))
    counts = cut(summed_pairs(known, keys, text, least, file_bytes(df) // MERGED).toDF(*keys, "left", "right", "joint"))
    left, right = F.col("left").isNotNull(), F.col("right").isNotNull()
    first = counts.where(left & ~right).select(*keys, "left", F.col("joint").alias("_l"))
    second = counts.where(right & ~left).select(*keys, "right", F.col("joint").alias("_r"))
    whole = counts.where(~left & ~right).select(*keys, F.col("joint").alias("_n"))
    rows = counts.where(left & right).join(first, [*keys, "left"]).join(second, [*keys, "right"]).join(F.broadcast(whole), keys)
    args = [F.col(c).cast("double") for c in ("joint", "_l", "_r", "_n")]
    return rows.select(*keys, "left", "right", "joint", g2(*args).alias("g2"), poisson_surprise(*args).alias("surprise"))


def log_odds(counts: DataFrame, word: str, side: str, n: str) -> DataFrame:
    """(word, z) of two sides (side is true or false) with both sides' sum as the prior; words for which a denominator isn't positive are left out."""
    both = counts.groupBy(word).agg(F.coalesce(F.sum(F.when(F.col(side), F.col(n))), F.lit(0)).cast("double").alias("_a"), F.coalesce(F.sum(F.when(~F.col(side), F.col(n))), F.lit(0)).cast("double").alias("_b"))
    sums = both.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    a, b, na, nb = (F.col(c) for c in ("_a", "_b", "_na", "_nb"))
    prior, total = a + b, na + nb
    da, db = na + total - a - prior, nb + total - b - prior
    z = (F.ln((a + prior) / da) - F.ln((b + prior) / db)) / F.sqrt(1 / (a + prior) + 1 / (b + prior))
    return both.crossJoin(F.broadcast(sums)).where((da > 0) & (db > 0) & (prior > 0)).select(word, z.alias("z"))


def grams(df: DataFrame, seq: str, toks: Column, n: int) -> DataFrame:
    """(seq, at, t1 .. tn) of each n-gram of an array of tokens."""
    size = F.greatest(F.size("_t") - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice("_t", F.lit(k), size).alias(f"t{k}") for k in range(1, n + 1)))  # else the whole array would be copied for each n-gram
    out = df.select(seq, toks.alias("_t")).select(seq, F.posexplode(zipped).alias("at", "_p"))
    return out.select(seq, "at", *(F.col(f"_p.t{k}").alias(f"t{k}") for k in range(1, n + 1)))


def _distinct(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(first places, counts) of the different tuples of codes, each column with its number of codes; in order of the codes."""
    code, size = parts[0]
    for a, n in parts[1:]:
        if size * n >= 1 << 62:
            known, code = np.unique(code, return_inverse=True)
            size = len(known)
        code, size = code * n + a, size * n
    places = len(code).bit_length()
    if size >= 1 << 62 - places:
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        return first, count
    code = code << places | np.arange(len(code))  # numbers are sorted faster than their places
    code.sort()
    new = np.flatnonzero(np.diff(code >> places, prepend=-1))
    return code[new] & (1 << places) - 1, np.diff(new, append=len(code))


def _sums(parts: list[tuple[np.ndarray, int]], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different tuple of codes, the sum of its numbers), codes as in ``_distinct``."""
    code, size = np.zeros(len(c), dtype=np.int64), 1
    for a, n in parts:
        if size * n >= 1 << 62:
            known, code = np.unique(code, return_inverse=True)
            size = len(known)
        code, size = code * n + a, size * n
    places = len(c).bit_length()
    if size < 1 << 62 - places:  # numbers are sorted faster than their places
        code = code << places | np.arange(len(c))
        code.sort()
        order, code = code & (1 << places) - 1, code >> places
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(c)])
    return order[new], np.add.reduceat(c[order], new) if len(new) else c


def word_lists(texts: pa.StringArray) -> pa.ListArray:
    """The words of ``functions.text.tokens`` of texts in lower case, none of them null."""
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges.astype(np.int64) - edges[0]
    first = np.zeros(len(data) + 1, dtype=bool)  # bytes that begin a text
    first[edges] = True
    first = first[: len(data)]
    kind = _KIND[data]
    inside = kind > 0
    p = np.flatnonzero(data == 39)
    p = p[(p > 0) & (p < len(data) - 1)]
    p = p[inside[p - 1] & (kind[p + 1] == 1) & ~first[p] & ~first[p + 1]]
    splits = []
    if len(p):
        ends = np.flatnonzero(np.append(~inside, True) | np.append(first, True))  # of the letters and digits after an apostrophe
        end = ends[np.searchsorted(ends, p + 1, "right")]
        digits = np.append(np.flatnonzero(kind == 2), len(data))
        digit = digits[np.searchsorted(digits, p + 1)]
        chained = np.concatenate([[False], p[1:] == end[:-1]])
        good = np.ones(len(p), dtype=bool)
        for i in np.flatnonzero(chained):  # the word ended with what follows the apostrophe before, if that has no digit
            good[i] = not (good[i - 1] and digit[i - 1] >= end[i - 1])
        splits = digit[good & (digit < end)]
        inside[p[good]] = True
    start = inside & (first | ~np.concatenate([[False], inside[:-1]])) if len(data) else inside
    start[splits] = True
    starts = np.flatnonzero(start)
    kept = data[inside]
    places = np.append(np.flatnonzero(start[inside]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, edges).astype(np.int32)), words)


def tokenized(b: pa.RecordBatch) -> pa.RecordBatch:
    k = b.schema.get_field_index("_t")
    return b.set_column(k, "_t", word_lists(b.column(k)))


def block_counts(df: DataFrame, keys: list[str], toks: Column, n: int, marginals: bool = False, packed: int = 0, lowered: bool = False) -> DataFrame:
    """(keys, t1 .. tn, _c): how often each n-gram occurs in a block of rows; the whole is the sum over blocks. The rows of a block are in order of t2 .. tn, so that they take little room on their way.

    With ``marginals`` (of pairs) there are also rows for each word on the left, each on the right, and all pairs, the other words being null.
    With ``packed`` the rows are (_part, _rows): those of a block by the hash of their words, in so many parts, each as an Arrow batch.
    With ``lowered``, toks is a text in lower case, whose words are found here.
    """
    words = [f"t{k}" for k in range(1, n + 1)]
    src = df.select(*keys, toks.alias("_t")).where(F.col("_t").isNotNull() if lowered else F.size("_t") >= n)
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), *(f"{w} string" for w in words), "_c bigint"])

    def count(parts: list[pa.RecordBatch]) -> tuple:
        rows = pa.Table.from_batches(parts).combine_chunks()
        lists = rows["_t"].chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        words_ = lists.flatten().dictionary_encode(null_encoding="encode")
        code = words_.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(code))  # tokens of the row from here on
        at = np.flatnonzero(left >= n)
        row = np.repeat(np.arange(len(sizes)), sizes)[at]
        ids = [rows[k].chunk(0).dictionary_encode(null_encoding="encode") for k in keys]
        vocabulary = len(words_.dictionary)
        columns = [(i.indices.to_numpy().astype(np.int64)[row], len(i.dictionary)) for i in ids] + [(code[at + k], vocabulary) for k in (*range(1, n), 0)]
        first, c = _distinct(columns)
        owner, of = row[first], [code[at[first] + k] for k in range(n)]
        if marginals:
            held = [owner], [of], [c]
            for sides in ((0,), (1,), ()):
                parts_ = [(a[at_], size) for a, at_, size in ((i.indices.to_numpy().astype(np.int64), owner, len(i.dictionary)) for i in ids)] + [(of[k], vocabulary) for k in sides]
                one, sums = _sums(parts_, c)
                held[0].append(owner[one])
                held[1].append([of[k][one] if k in sides else np.full(len(one), -1) for k in range(n)])
                held[2].append(sums)
            owner, of, c = np.concatenate(held[0]), [np.concatenate(x) for x in zip(*held[1])], np.concatenate(held[2])
        return rows, owner, of, c, words_.dictionary

    def record(rows: pa.Table, owner: np.ndarray, of: list[np.ndarray], c: np.ndarray, dictionary: pa.Array) -> pa.RecordBatch:
        own = [rows[k].chunk(0).take(pa.array(owner)) for k in keys]
        return pa.RecordBatch.from_arrays([*own, *(dictionary.take(pa.array(x, mask=x < 0)) for x in of), pa.array(c)], names=[*keys, *words, "_c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in map(tokenized, batches) if lowered else batches:
            k = b.schema.get_field_index("_t")
            for lo in range(0, len(b), 200):
                part = b.slice(lo, 200)
                held.append(part)
                size += len(part.column(k).flatten())
                if size >= BLOCK:
                    yield from pack(*count(held)) if packed else pieces(record(*count(held)))
                    held, size = [], 0
        if held:
            yield from pack(*count(held)) if packed else pieces(record(*count(held)))

    def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (b.slice(lo, 1 << 16) for lo in range(0, len(b), 1 << 16))  # of long runs Spark would hold all

    def pack(rows: pa.Table, owner: np.ndarray, of: list[np.ndarray], c: np.ndarray, dictionary: pa.Array) -> Iterator[pa.RecordBatch]:
        own = hash_array(dictionary.fill_null("").to_numpy(zero_copy_only=False), categorize=False)
        own = np.append(own, np.uint64(0))  # of no word
        part = np.zeros(len(c), dtype=np.uint64)
        for x in of:
            part = part * np.uint64(1000003) + own[x]
        part = ((part ^ part >> np.uint64(32)) % np.uint64(packed)).astype(np.uint16 if packed < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(packed + 1))
        dealt, full = record(rows, owner[order], [x[order] for x in of], c[order], dictionary), np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([dealt.slice(edges[i], edges[i + 1] - edges[i]).serialize().to_pybytes() for i in full], pa.binary())], names=["_part", "_rows"]
        )

    return src.mapInArrow(run, "_part int, _rows binary" if packed else schema)


def summed_pairs(df: DataFrame, keys: list[str], text: Column, least: int, parts: int) -> DataFrame:
    """(keys, t1, t2, _c): how often pairs and their marginals, as of ``block_counts``, occur, if that is ``least`` times at least; the numbers of all pairs in any case.

    Spark moves few long rows, a block's share for each part, rather than one for each pair of a block; each part is then merged by itself.
    """
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole, words = block_counts(df, keys, F.array(text), 2).schema, ["t1", "t2"]
    schema, names = to_arrow_schema(whole), whole.names

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        codes = [rows[k].chunk(0).dictionary_encode(null_encoding="encode") for k in (*keys, *words)]
        first, total = _sums([(c.indices.to_numpy().astype(np.int64), len(c.dictionary)) for c in codes], rows["_c"].to_numpy())
        return rows.take(pa.array(first)).set_column(len(names) - 1, "_c", pa.array(total))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            for x in b["_rows"]:
                held.append(pa.Table.from_batches([pa.ipc.read_record_batch(x.as_buffer(), schema)]))
                size += len(held[-1])
                if size > 4 * BLOCK:
                    held = [merge(pa.concat_tables(held))]
                    size = 0  # what is merged isn't counted again
        if held:
            out = merge(pa.concat_tables(held))
            keep = out["_c"].to_numpy() >= least
            keep |= reduce(lambda a, w: a & out[w].is_null().to_numpy(), words, np.ones(len(out), dtype=bool))
            yield from out.filter(pa.array(keep)).to_batches(max_chunksize=1 << 16)

    return block_counts(df, keys, F.lower(text), 2, True, parts, lowered=True).repartitionById(parts, "_part").mapInArrow(unpack, whole)


def _discounts(c: DataFrame, modified: bool) -> DataFrame:
    """One row (_d1, _d2, _d3): what a count of 1, 2, or 3 and more gives up; from a row (_n1 .. _n4) of the numbers of n-grams that occur so often."""
    n1, n2, n3, n4 = (F.col(f"_n{k}").cast("double") for k in (1, 2, 3, 4))
    y = F.try_divide(n1, n1 + 2 * n2)
    if not modified:
        d = F.coalesce(y, F.lit(0.5))
        return c.select(*(d.alias(f"_d{k}") for k in (1, 2, 3)))
    zero = F.lit(0.0)
    d1 = F.greatest(zero, 1 - 2 * y * n2 / n1)
    d2 = F.when(n3 > 0, F.greatest(zero, 2 - 3 * y * n3 / n2)).otherwise(d1)
    d3 = F.when(n4 > 0, F.greatest(zero, 3 - 4 * y * n4 / n3)).otherwise(d2)
    known = (n1 > 0) & (n2 > 0)
    return c.select(*(F.when(known, d).otherwise(0.5).alias(f"_d{k}") for k, d in ((1, d1), (2, d2), (3, d3))))


class KneserNey:
    """Smoothed n-gram model: raw counts for the highest order, continuation counts below.

    All n-grams of the corpus are counted, in one shuffle by their last two words, from which every order's counts are made. What is kept of
    them is what the n-grams to be scored need: their own counts, the sums of their contexts, and each order's counts of counts.
    """

    def __init__(self, df: DataFrame, seq: str, toks: Column, order: int = 2, modified: bool = False):
        self.order, self.modified = order, modified
        last_two = [f"t{k}" for k in range(max(order - 1, 1), order + 1)]
        parts = file_bytes(df) // SHARE
        self.blocks = spread(block_counts(df, [], toks, order).repartition(*last_two), parts, *last_two)

    def counts(self, k: int) -> DataFrame:
        """(t1 .. tk, _c) of order k, below the highest how many different words come before."""
        out = self.blocks.groupBy(*[f"t{j}" for j in range(1, self.order + 1)]).agg(F.sum("_c").alias("_c")).where("_c > 0")  # the condition keeps the column, so that all orders read one shuffle
        for n in range(self.order - 1, k - 1, -1):
            out = out.groupBy(*[f"t{j}" for j in range(2, n + 2)]).agg(F.count("*").alias("_c")).toDF(*[f"t{j}" for j in range(1, n + 1)], "_c")
        return out

    def _statistics(self, rows: DataFrame) -> DataFrame:
        """(_k, t1 .. , _known, _gram, _s, _n1 .. _n4, _m3): for each order and each context of the rows the counts of the n-grams of these rows, and sums over the others; all other contexts are one row."""
        few = rows.count() <= BROADCAST_ROWS
        whole = None
        for k in range(self.order, 0, -1):
            names = [f"t{j}" for j in range(1, k + 1)]
            gram = rows.select(*(F.col(f"t{self.order - k + j}").alias(f"t{j}") for j in range(1, k + 1))).distinct().withColumn("_g", F.lit(True))
            out = self.counts(k)
            if k > 1:
                context = gram.select(*names[:-1]).distinct().withColumn("_x", F.lit(True))
                out = out.join(F.broadcast(context) if few else context, names[:-1], "left")
            else:
                out = out.withColumn("_x", F.lit(True))
            out = out.join(F.broadcast(gram) if few else gram, names, "left")
            known, hit = F.coalesce("_x", F.lit(False)), F.coalesce("_g", F.lit(False))
            by = [F.when(known, F.col(t)).alias(t) for t in names[:-1]] + [F.when(hit, F.col(names[-1])).alias(names[-1])]
            by += [F.lit(None).cast("string").alias(f"t{j}") for j in range(k + 1, self.order + 1)]
            out = out.groupBy(F.lit(k).alias("_k"), *by, known.alias("_known"), hit.alias("_gram")).agg(
                F.sum("_c").cast("double").alias("_s"), *(F.count_if(F.col("_c") == n).alias(f"_n{n}") for n in (1, 2, 3, 4)), F.count_if(F.col("_c") >= 3).alias("_m3")
            )
            whole = out if whole is None else whole.unionByName(out)
        return cut(whole)

    def probability(self, rows: DataFrame) -> DataFrame:
        """rows (with t1 .. t<order>) and ``p``, from the lowest order up; where a context was never seen, the order below decides alone."""
        last = f"t{self.order}"
        all_ = self._statistics(rows)
        ones = all_.where("_k = 1")
        words = ones.where("_gram").crossJoin(F.broadcast(ones.agg(F.sum("_s").alias("_whole")))).select(F.col("t1").alias(last), (F.col("_s") / F.col("_whole")).alias("p"))
        out = rows.join(words, last, "left").fillna(0.0, ["p"])
        for k in range(2, self.order + 1):
            names = [f"t{j}" for j in range(self.order - k + 1, self.order + 1)]
            own = all_.where(F.col("_k") == k)
            d = F.broadcast(_discounts(own.agg(*(F.sum(f"_n{n}").alias(f"_n{n}") for n in (1, 2, 3, 4))), self.modified))
            given = F.col("_d1") * F.sum("_n1") + F.col("_d2") * F.sum("_n2") + F.col("_d3") * F.sum("_m3")
            context = own.where("_known").crossJoin(d).groupBy(*[f"t{j}" for j in range(1, k)], "_d1", "_d2", "_d3").agg(F.sum("_s").alias("_all"), given.alias("_given"))
            context = context.select(*(F.col(f"t{j}").alias(names[j - 1]) for j in range(1, k)), "_all", (F.col("_given") / F.col("_all")).alias("_g"))
            less = F.when(F.col("_s") >= 3, F.col("_d3")).when(F.col("_s") >= 2, F.col("_d2")).otherwise(F.col("_d1"))
            gram = own.where("_gram").crossJoin(d).select(*(F.col(f"t{j}").alias(names[j - 1]) for j in range(1, k + 1)), F.greatest(F.col("_s") - less, F.lit(0.0)).alias("_q"))
            out = out.join(gram, names, "left").join(context, names[:-1], "left")
            out = out.withColumn("p", F.when(F.col("_g").isNull(), F.col("p")).otherwise(F.coalesce(F.col("_q") / F.col("_all"), F.lit(0.0)) + F.col("_g") * F.col("p"))).drop("_q", "_g", "_all")
        return out

    def perplexity(self, df: DataFrame, seq: str, toks: Column) -> DataFrame:
        """(seq, n, perplexity) over the n-grams of the highest order."""
        scored = self.probability(cut(grams(df, seq, toks, self.order)))
        return scored.groupBy(seq).agg(F.count("*").alias("n"), F.exp(-F.avg(F.ln(F.greatest("p", F.lit(1e-300))))).alias("perplexity"))
