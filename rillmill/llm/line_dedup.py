"""Line dedup: ranks of a suffix array over line ids, by prefix doubling.

Every document is a sequence of line ids. Level k of the doubling ranks the
suffixes by their first 2^k lines: level 0 by id, and the rank of level k
with the one of the suffix 2^k lines further gives level k + 1. Suffixes of equal rank form an LCP interval of
depth 2^k, and two overlapping ranks of a level tell the interval of any depth
in between. Suffixes that are alone in their interval leave the
doubling, as nothing that begins with so many of their lines is repeated.

A line is deleted if a run of lines around it has at least ``min_chars``
characters and occurs earlier in the corpus, in order of doc_id and line. The
maximal repeated runs are, exactly, the unions of the shortest
long-enough windows from each of their lines on and up to each of their lines.
How far these reach is known within the document; so each is looked up by two
ranks, and the first place of each interval keeps its lines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.llm.shared import cut, release, sheltered, union_all

MIN_CHARS = 50
_PLACE = ["_doc", "_row", "_pos"]


def _row_key(text: str = "text") -> Column:
    return F.xxhash64(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """(_doc, _row, _pos, _a, _b, _chars) for each line; _a and _b are its id of 128 bits, _row tells rows of one doc_id apart."""
    rows = docs.where("doc_id is not null and text is not null")
    one = rows.select(F.col("doc_id").alias("_doc"), _row_key().alias("_row"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    return one.select(*_PLACE, F.xxhash64("_line").alias("_a"), F.xxhash64(F.lit(1), "_line").alias("_b"), F.length("_line").alias("_chars"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """(_a, _b, _r) of the repeated ids: their rank is the number of repeated suffixes whose first line has a smaller id.

    Counts over ranges of ids are added up first, so that no task sorts all of them.
    """
    ids = cut(lines.groupBy("_a", "_b").agg(F.count("*").alias("_c")).where("_c > 1").withColumn("_bucket", F.shiftright("_a", 52)))
    sums = ids.groupBy("_bucket").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_bucket", before.alias("_before"))  # at most 4096 rows
    inside = Window.partitionBy("_bucket").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ids.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(F.broadcast(sums), "_bucket")
    return ranked.select("_a", "_b", (F.col("_in") + F.col("_before")).alias("_r"))


def next_ranks(pairs: DataFrame, shift: int) -> DataFrame:
    """(_r, _next, _rank) of the pairs of ranks that occur more than once: _rank is _r and the number of suffixes of rank _r with a smaller _next.

    A rank of a line that is in most documents has very many successors; they are counted by ranges, of which there are
    4096 at most, and ordered within one.
    """
    named = pairs.groupBy("_r", "_next").agg(F.count("*").alias("_c")).withColumn("_range", F.shiftright("_next", shift))
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = named.groupBy("_r", "_range").agg(F.sum("_c").alias("_s"))
    sums = sums.select("_r", "_range", F.coalesce(F.sum("_s").over(up_to("_r").orderBy("_range")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_c").over(up_to("_r", "_range").orderBy("_next")), F.lit(0))
    named = named.withColumn("_in", inside).where("_c > 1").join(sums, ["_r", "_range"])
    return named.select("_r", "_next", (F.col("_r") + F.col("_before") + F.col("_in")).alias("_rank"))


def _windows(min_chars: int) -> Callable:
    """Arrow function: for each document's repeated lines in order, those within a window, each with the lengths of the windows that begin there."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            off = np.asarray(lists.offsets, dtype=np.int64)
            item = lists.values
            pos, chars, rank = (np.asarray(item.field(k)) for k in range(3))
            off, lo = off - off[0], off[0]
            n = off[-1]
            pos, chars, rank = pos[lo : lo + n].astype(np.int64), chars[lo : lo + n].astype(np.int64), rank[lo : lo + n]
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            new = np.ones(n, dtype=bool)
            new[1:] = (pos[1:] != pos[:-1] + 1) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            stretch = np.cumsum(new) - 1
            last = np.append(begin[1:], n) - 1 if n else begin
            total = np.concatenate([[0], np.cumsum(chars)])
            at = np.arange(n)
            end = np.searchsorted(total[1:], total[:-1] + min_chars)
            ok = end <= last[stretch] if n else end < 0
            start = np.searchsorted(total, total[1:] - min_chars, side="right") - 1
            ok2 = (start >= begin[stretch]) & (total[1:] >= min_chars) if n else start < 0
            pairs = np.unique(np.concatenate([np.stack([at[ok], (end - at + 1)[ok]]), np.stack([start[ok2], (at - start + 1)[ok2]])], axis=1), axis=1)
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, pairs[0], 1)
            np.add.at(cover, pairs[0] + pairs[1], -1)
            used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            bounds = np.searchsorted(pairs[0], np.append(used, n))
            # pairs are sorted by place, and every place of a pair is used
            lens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs[1], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc[used])), b.column(1).take(pa.array(doc[used])), pa.array(pos[used], pa.int32()), pa.array(rank[used], pa.int64()), lens],
                ["_doc", "_row", "_pos", "_r", "_lens"],
            )

    return run


def repeated_windows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_doc, _row, _pos, _len) of the windows that occur earlier.

    Windows of 2^k to 2^(k+1) - 1 lines are looked up as soon as level k is ranked; the
    doubling ends when no longer window is left.
    """
    lines = cut(lines_of(docs))
    repeated = lines.join(first_ranks(lines), ["_a", "_b"])
    lists = repeated.groupBy("_doc", "_row").agg(F.array_sort(F.collect_set(F.struct("_pos", "_chars", "_r"))).alias("_l"))
    rows = cut(lists.mapInArrow(_windows(min_chars), "_doc bigint, _row bigint, _pos int, _r bigint, _lens array<int>"))
    release(lines)
    ranks = rows.select(*_PLACE, "_r")
    shift = max(0, int(rows.agg(F.max("_r")).first()[0] or 0).bit_length() - 12)
    wanted = rows.select(*_PLACE, F.explode("_lens").alias("_len"))
    found, level, cuts = [], 0, []
    while True:
        size = 1 << level
        here = wanted.where((F.col("_len") >= size) & (F.col("_len") < 2 * size)).join(ranks.withColumnRenamed("_r", "_head"), _PLACE)
        if level:
            tail = ranks.select("_doc", "_row", F.col("_pos").alias("_tp"), F.col("_r").alias("_tail"))
            here = here.withColumn("_tp", F.col("_pos") + F.col("_len") - size).join(tail, ["_doc", "_row", "_tp"]).drop("_tp")
        else:
            here = here.withColumn("_tail", F.col("_head"))
        interval = ["_len", "_head", "_tail"]
        first = here.groupBy(*interval).agg(F.min(F.struct(*_PLACE)).alias("_first"), F.count("*").alias("_c")).where("_c > 1")
        found.append(cut(here.join(first, interval).where(F.struct(*_PLACE) > F.col("_first")).select(*_PLACE, "_len")))
        longer = wanted.where(F.col("_len") >= 2 * size)
        if longer.isEmpty():
            return union_all(found)
        # only lines in longer windows go on; equal runs have equal windows, so intervals stay whole
        inside = longer.select("_doc", "_row", F.explode(F.sequence(F.col("_pos"), F.col("_pos") + F.col("_len") - 1)).alias("_pos")).distinct()
        by = Window.partitionBy("_doc", "_row").orderBy("_pos").rangeBetween(size, size)
        pairs = ranks.join(inside, _PLACE).withColumn("_next", F.max("_r").over(by)).where("_next is not null")
        ranks = cut(pairs.join(next_ranks(pairs, shift), ["_r", "_next"]).select(*_PLACE, F.col("_rank").alias("_r")))
        cuts.append(ranks)
        if len(cuts) > 1:
            release(cuts.pop(0))
        wanted, level = longer, level + 1


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later copies of repeated runs of lines deleted from text, and n_chars (if there) counted anew; rows without any line left are dropped.

    Lines are what "\\n" separates; a blank line is a line. Rows with a null
    id or text, and those whose text was empty before, are kept as they are. Rows of one doc_id are
    distinct documents, in order of a hash of their texts; rows that repeat id and text
    are one document and get the same result, and of equal runs within one document the first stays. Whole texts are read, however long. Order among
    documents is the order of doc_id, so the copy with the smallest id stays. All other
    columns are carried along. An empty table gives an empty result.
    """
    names, docs = docs.columns, sheltered(docs)
    found = repeated_windows(docs, min_chars)
    gone = found.select("_doc", "_row", F.explode(F.sequence(F.col("_pos"), F.col("_pos") + F.col("_len") - 1)).alias("_pos"))
    gone = gone.groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_gone"))
    joined = docs.withColumn("_key", _row_key()).join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_row")), "left")
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")))
    out = joined.withColumn("_left", left).where("_left is null or size(_left) > 0")
    out = out.withColumn("_lines", F.when(F.col("_left").isNotNull(), lines))
    text = F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_left", lambda i: F.element_at("_lines", i + 1)), "\n"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns).toDF(*names)
