"""N-gram Jaccard join over count vectors.

The word n-grams of a document are hashed into groups, and the counts of the
groups are a point. Two sets share at most the sum of the coordinates' minima, so a
pair can be similar only if that bound is large enough for its sizes; an
R-tree over the points bounds whole boxes against each other the same way, and
what passes is verified on the n-gram sets.

Points of unrelated documents of like size differ by little in each
coordinate, so one tree over a corpus would have to open nearly all pairs of
boxes. Trees are therefore built over regions, chosen so that no similar pair is lost:
all n-grams are put into one order, rare ones first, and two sets of n and m n-grams
with a similarity of t have one in common among the first n - ceil(t n) + 1 of the one and
the first m - ceil(t m) + 1 of the other. The documents that have an n-gram among
these are led by the least of them, and all that one document leads are a
region. A document with fewer than t n n-grams that occur anywhere else is in none, and
a passage that many documents share brings together only those that consist mostly of such passages.

Frequencies are exact counts over all documents: blocks of documents send
their n-grams by ranges of the hash, and an n-gram that a block has often as one number. Documents
with equal sets are one point, whatever their number. Regions beyond ``BLOCK`` points meet
block by block, so no task's share grows with the data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.shared import cut, lean, release, sheltered
from rillmill.llm.textnum import Chars, Words, chunks, mix64

NGRAM, THRESHOLD = 3, 0.5
GROUPS, BLOCK = 256, 1000
OFTEN = 8
BUCKET_CHARS, BLOCK_GRAMS, BLOCK_DOCS = 1 << 23, 1 << 20, 1 << 15
_BITS = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)
_16 = np.uint64(16)
_LEAF = 32


def gram_sets(texts: list, n: int = NGRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bounds, hashes) by chunks: the sorted distinct n-gram hashes, of 48 bits, of text first + i are hashes[bounds[i]:bounds[i + 1]]."""
    for begin, end in chunks(texts):
        for lo in range(begin, end, 1 << 16):
            hi = min(end, lo + (1 << 16))
            doc, h = Words(Chars(texts[lo:hi])).grams(n)
            both = doc.astype(np.uint64) << _BITS | h >> _16
            both.sort()
            new = np.ones(len(both), dtype=bool)
            new[1:] = both[1:] != both[:-1]
            both = both[new]
            yield lo, np.searchsorted(both >> _BITS, np.arange(hi - lo + 1).astype(np.uint64)), both & _MASK


def set_keys(bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of 128 bits for each set, as two columns, from sums over its elements."""
    parts = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(mix64(h ^ np.uint64(seed)), out=total[1:])
        parts.append(total[bounds[1:]] - total[bounds[:-1]])
    return np.stack(parts, axis=1)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<cQ", a.dtype.char.encode(), a.nbytes) + a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, size = struct.unpack_from("<cQ", blob, at)
        dtype = np.dtype(kind.decode())
        out.append(np.frombuffer(blob, dtype, size // dtype.itemsize, at + 9))
        at += 9 + size
    return out


def squeeze(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes as the first one and their steps, of 32 bits where these fit."""
    steps = np.diff(g)
    return g[:1], steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps


def widen(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first, steps.astype(np.uint64)]), dtype=np.uint64)


def six_bytes(g: np.ndarray) -> bytes:
    return np.ascontiguousarray(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def pack_counts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts cut to 15, two in a byte, and the sum of what was cut off."""
    low = np.minimum(count, 15).astype(np.uint8)
    return low[:, 0::2] << np.uint8(4) | low[:, 1::2], (count - low).sum(axis=1)


def unpack_counts(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> np.uint8(4), packed & np.uint8(15)], axis=2).reshape(len(packed), -1)


def by_group(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first ``key`` columns; each holds one or more groups."""
    rest: list[pa.Table] = []
    last: list = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        ends = [b.column(k)[b.num_rows - 1].as_py() for k in range(key)]
        open_ = np.ones(t.num_rows, dtype=bool)
        for k in range(key):
            open_ &= np.asarray(t.column(k)) == ends[k]
        begin = int(np.argmax(open_))
        if begin or ends != last:
            if rest or begin:
                yield pa.concat_tables([*rest, t.slice(0, begin)])
            rest = []
        rest.append(t.slice(begin))
        last = ends
    if rest:
        yield pa.concat_tables(rest)


def _edges(t: pa.Table, key: int) -> np.ndarray:
    change = np.zeros(t.num_rows, dtype=bool)
    change[:1] = True
    for k in range(key):
        v = np.asarray(t.column(k))
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def _runs(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length of v."""
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(v))


def _block_rows(ids, texts, sizes, h, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of a block of documents: its n-grams by range of the hash, and, as bucket -1, what is known of its documents."""
    bounds = np.append(0, np.cumsum(sizes))
    keys = set_keys(bounds, h)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    same = np.zeros(len(ids), dtype=bool)
    same[1:] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    alone = np.ones(len(ids), dtype=bool)
    alone[order[same]] = False  # lexsort is stable, so the first of equal sets stays
    doc = np.repeat(np.arange(len(ids)), sizes)
    here = alone[doc]
    both = h[here] << _16 | doc[here].astype(np.uint64)
    both.sort()
    g = both >> _16
    runs = _runs(g)
    count = np.diff(runs)
    often = count > OFTEN
    many = np.repeat(often, count)
    yield -1, pack(ids, texts, keys[:, 0], keys[:, 1], sizes.astype(np.uint32), alone, count[often].astype(np.uint32), (both[many] & np.uint64(0xFFFF)).astype(np.uint16))
    cold, hot, hot_count = both[~many], g[runs[:-1]][often], count[often].astype(np.uint32)
    bucket = lambda x: (x >> _16) * np.uint64(buckets) >> np.uint64(32)
    cold_at, hot_at = bucket(cold >> _16), bucket(hot)
    for b in np.union1d(cold_at, hot_at):
        c = cold[np.searchsorted(cold_at, b) : np.searchsorted(cold_at, b, "right")]
        s = slice(np.searchsorted(hot_at, b), np.searchsorted(hot_at, b, "right"))
        yield int(b), pack(*squeeze(c >> _16), (c & np.uint64(0xFFFF)).astype(np.uint16), hot[s], hot_count[s])


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """(_to, _block, _blob): rows of ``_block_rows``; a block's own row goes to -1 - _block."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 + chars // BUCKET_CHARS

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0

        def flush(held):
            nonlocal made
            block = part << 32 | made
            made += 1
            rows = list(_block_rows(*(np.concatenate(x) for x in zip(*held)), buckets))
            to = [b if b >= 0 else -1 - block for b, _ in rows]
            for s in range(0, len(rows), 64):
                part_ = rows[s : s + 64]
                yield pa.RecordBatch.from_arrays([pa.array(to[s : s + 64], pa.int64()), pa.array([block] * len(part_), pa.int64()), pa.array([x for _, x in part_], pa.binary())], ["_to", "_block", "_blob"])

        held, grams, count = [], 0, 0
        for b in (x.slice(s, 512) for x in batches for s in range(0, x.num_rows, 512)):
            ids, texts, hashes = np.asarray(b.column(0)), b.column(1).to_pylist(), np.asarray(b.column(2))
            for lo, bounds, h in gram_sets(texts, n):
                size = np.diff(bounds)
                have = np.flatnonzero(size)
                if held and (grams + len(h) > BLOCK_GRAMS or count + len(have) > BLOCK_DOCS):
                    yield from flush(held)
                    held, grams, count = [], 0, 0
                if len(have):
                    for s in range(0, len(have), BLOCK_DOCS):
                        if s:
                            yield from flush(held)
                            held, grams, count = [], 0, 0
                        some = have[s : s + BLOCK_DOCS]
                        mine = h[bounds[some[0]] : bounds[some[-1] + 1]]
                        held.append((ids[lo + some], hashes[lo + some], size[some], mine))
                        grams, count = grams + len(mine), count + len(some)
        if held:
            yield from flush(held)

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text"))
    return rows.mapInArrow(lean(run), "_to bigint, _block bigint, _blob binary")


def repeated(parts: DataFrame) -> DataFrame:
    """(_block, _kind, _blob): of each block and range the n-grams that occur elsewhere, with the logarithm of their frequency; the blocks' own rows, of kind 0, as they are."""

    def run(batches):
        for t in by_group(batches, 1):
            to, block, blobs = np.asarray(t.column(0)), np.asarray(t.column(1)), t.column(2)
            edges = _edges(t, 1)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if to[lo] < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(block[lo:hi]), pa.array([0] * int(hi - lo), pa.int32()), pa.array(blobs.slice(lo, hi - lo).to_pylist(), pa.binary())], ["_block", "_kind", "_blob"])
                    continue
                cold, who, hot, weight = [], [], [], []
                for r in range(lo, hi):
                    first, steps, d, x, c = unpack(blobs[r].as_py())
                    cold.append(widen(first, steps))
                    who.append(d)
                    hot.append(x)
                    weight.append(c)
                g = np.concatenate([*cold, *hot])
                w = np.concatenate([np.ones(sum(map(len, cold)), dtype=np.uint32), *weight])
                order = np.argsort(g)
                runs = _runs(g[order])
                total = np.add.reduceat(w[order].astype(np.int64), runs[:-1])
                level = np.empty(len(g), dtype=np.uint8)
                level[order] = np.repeat((np.frexp(total)[1] - 1).astype(np.uint8), np.diff(runs))
                at, hot_at = 0, sum(map(len, cold))
                out = []
                for c, d, x in zip(cold, who, hot):
                    ls, hs = level[at : at + len(c)], level[hot_at : hot_at + len(x)]
                    at, hot_at = at + len(c), hot_at + len(x)
                    keep = ls > 0
                    out.append(pack(*squeeze(c[keep]), d[keep], ls[keep], x, hs))
                yield pa.RecordBatch.from_arrays([pa.array(block[lo:hi]), pa.array([1] * len(out), pa.int32()), pa.array(out, pa.binary())], ["_block", "_kind", "_blob"])

    # ranges are dealt out in turn, as by hash some tasks would get several times the mean; the blocks' own rows go by hash
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartitionById(n, F.pmod(F.when(F.col("_to") < 0, F.xxhash64("_to")).otherwise(F.col("_to")), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("_to").mapInArrow(lean(run), "_block bigint, _kind int, _blob binary")


def members(known: DataFrame) -> DataFrame:
    """(doc_id, _text, _set) of each document with words; _text is a hash of its text."""

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                ids, texts, k1, k2, *_ = unpack(blob)
                keys = np.stack([k1, k2], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array([keys[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary())], ["doc_id", "_text", "_set"])

    return known.where("_kind = 0").select("_blob").mapInArrow(lean(run), "doc_id bigint, _text bigint, _set binary")


def prefixes(known: DataFrame, threshold: float) -> DataFrame:
    """(_set, _id, _block, _n, _over, _point, _cells, _grams) of each set of a block that may have a similar one: _cells are the n-grams by which it finds it, _grams all that occur elsewhere."""

    def run(batches):
        for t in by_group(batches, 1):
            edges = _edges(t, 1)
            block, kinds, blobs = np.asarray(t.column(0)), np.asarray(t.column(1)), t.column(2)
            for lo, hi in zip(edges[:-1], edges[1:]):
                assert kinds[lo] == 0
                _, _, k1, k2, n, _, hot_count, hot_doc = unpack(blobs[lo].as_py())
                parts = [unpack(blobs[r].as_py()) for r in range(lo + 1, hi)]
                if not parts:
                    continue
                hot, hot_level = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
                order = np.argsort(hot)
                g = np.concatenate([*(widen(p[0], p[1]) for p in parts), np.repeat(hot[order], hot_count)])
                level = np.concatenate([*(p[3] for p in parts), np.repeat(hot_level[order], hot_count)])
                doc = np.concatenate([*(p[2] for p in parts), hot_doc])
                n = n.astype(np.int64)
                need = np.ceil(threshold * n - 1e-9).astype(np.int64)
                have = np.bincount(doc, minlength=len(n))
                good = (have >= need) & (have > 0)
                keep = good[doc]
                g, level, doc = g[keep], level[keep], doc[keep]
                if not len(g):
                    continue
                order = np.lexsort((g, level, doc))
                cells = g[order].view(np.int64)
                both = doc.astype(np.uint64) << _BITS | g
                both.sort()
                g, doc = both & _MASK, (both >> _BITS).astype(np.int64)
                rows = np.flatnonzero(good)
                bounds = np.append(np.searchsorted(doc, rows), len(doc))
                place = np.zeros(len(n), dtype=np.int64)
                place[rows] = np.arange(len(rows))
                group = (g >> np.uint64(8)) % np.uint64(GROUPS)
                points, over = pack_counts(np.bincount(place[doc] * GROUPS + group.astype(np.int64), minlength=len(rows) * GROUPS).reshape(-1, GROUPS))
                keys = np.stack([k1, k2], axis=1)
                for s in range(0, len(rows), 500):
                    some = range(s, min(len(rows), s + 500))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([keys[rows[i]].tobytes() for i in some], pa.binary()),
                            pa.array(k1[rows[s : s + 500]].view(np.int64)),
                            pa.array([int(block[lo])] * len(some), pa.int64()),
                            pa.array(n[rows[s : s + 500]], pa.int32()),
                            pa.array(over[s : s + 500], pa.int32()),
                            pa.array([points[i].tobytes() for i in some], pa.binary()),
                            pa.array([cells[bounds[i] : bounds[i] + have[rows[i]] - need[rows[i]] + 1] for i in some], pa.list_(pa.int64())),
                            pa.array([six_bytes(g[bounds[i] : bounds[i + 1]]) for i in some], pa.binary()),
                        ],
                        ["_set", "_id", "_block", "_n", "_over", "_point", "_cells", "_grams"],
                    )

    sorted_ = known.repartition("_block").sortWithinPartitions("_block", "_kind")
    return sorted_.mapInArrow(lean(run), "_set binary, _id bigint, _block bigint, _n int, _over int, _point binary, _cells array<bigint>, _grams binary")


class RTree:
    """Boxes over count vectors, bulk-loaded by halving at the median of the coordinate (or size) that varies most against its mean."""

    def __init__(self, rows: np.ndarray, n: np.ndarray, point: np.ndarray, over: np.ndarray):
        self.rows, self.low_n = rows, int(n[rows].min())
        self.high, self.over = point[rows].max(axis=0), int(over[rows].max())
        self.children: list[RTree] = []
        if len(rows) > _LEAF:
            values = np.concatenate([n[rows, None], point[rows]], axis=1).astype(np.float32)
            spread = values.std(axis=0) / np.sqrt(values.mean(axis=0) + 1)
            order = rows[np.argsort(values[:, spread.argmax()], kind="stable")]
            self.children = [RTree(part, n, point, over) for part in (order[: len(rows) // 2], order[len(rows) // 2 :])]


def _join(a: RTree, b: RTree, share: float, out: list) -> None:
    """Pairs of leaves whose boxes don't rule each other out."""
    if int(np.minimum(a.high, b.high).sum(dtype=np.int64)) + min(a.over, b.over) < share * (a.low_n + b.low_n) - 1e-9:
        return
    if not a.children and not b.children:
        out.append((a.rows, b.rows))
    elif a is b:
        left, right = a.children
        _join(left, left, share, out)
        _join(left, right, share, out)
        _join(right, right, share, out)
    elif a.children and (len(a.rows) >= len(b.rows) or not b.children):
        for x in a.children:
            _join(x, b, share, out)
    else:
        for x in b.children:
            _join(a, x, share, out)


def candidates(n: np.ndarray, point: np.ndarray, over: np.ndarray, one: np.ndarray, other: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``one``, or of one of ``one`` and one of ``other``, whose summed minima allow the threshold."""
    share = threshold / (1 + threshold)
    leaves: list = []
    if len(one) and (other is None or len(other)):
        tree = RTree(one, n, point, over)
        _join(tree, tree if other is None else RTree(other, n, point, over), share, leaves)
    left, right = [], []
    for a, b in leaves:
        need = share * (n[a][:, None] + n[b][None, :]) - 1e-9
        ok = np.minimum(n[a][:, None], n[b][None, :]) >= need
        if a is b:
            ok &= np.tri(len(a), k=-1, dtype=bool).T
        i, j = np.nonzero(ok)
        bound = np.minimum(point[a[i]], point[b[j]]).sum(axis=1, dtype=np.int32) + np.minimum(over[a[i]], over[b[j]])
        ok = bound >= need[i, j]
        left.append(a[i[ok]])
        right.append(b[j[ok]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def meet_before(lists: list[np.ndarray], leader: int) -> np.ndarray:
    """For each two rows, whether a leader below ``leader`` leads both, so that they are compared there."""
    sizes = np.array([len(x) for x in lists])
    row = np.repeat(np.arange(len(lists)), sizes)
    value = np.concatenate(lists)
    row, value = row[value < leader], value[value < leader]
    out = np.zeros((len(lists), len(lists)), dtype=bool)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    row, column = row[count[column] > 1], column[count[column] > 1]
    for s in range(0, int(column.max()) + 1 if len(column) else 0, 1024):
        here = (column >= s) & (column < s + 1024)
        if here.any():
            table = np.zeros((len(lists), 1024), dtype=np.float32)
            table[row[here], column[here] - s] = 1
            out |= table @ table.T > 0
    return out


_MEETING = ["_leader", "_i", "_j"]


def meetings(found: DataFrame) -> DataFrame:
    """(_leader, _i, _j, _set, _guest, _n, _over, _block, _point, _regions): which sets meet where; a guest meets only those that are none."""
    posts = found.select("_id", F.explode("_cells").alias("_cell"))
    led = posts.groupBy("_cell").agg(F.min("_id").alias("_leader"), F.max("_id").alias("_last")).where("_leader < _last").select("_cell", "_leader")
    regions = cut(posts.join(led, "_cell").select("_leader", "_id").distinct())
    sizes = regions.groupBy("_leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    placed = regions.join(sizes, "_leader").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # in the meeting of blocks i < j, those of j are the guests
    placed = placed.select("_leader", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).alias("_guest"), "_id")
    of = regions.groupBy("_id").agg(F.collect_list("_leader").alias("_regions"))
    owner = found.groupBy("_set").agg(F.min("_block").alias("_block"))
    sets = found.select("_set", "_id", "_block", "_n", "_over", "_point").join(owner, ["_set", "_block"]).join(of, "_id")
    return placed.join(sets, "_id").select(*_MEETING, "_set", "_guest", "_n", "_over", "_block", "_point", "_regions")


def met_pairs(found: DataFrame, threshold: float) -> DataFrame:
    """(_leader, _i, _j, _set, _block, _partners): sets with pairs that pass the bound, each pair once, in the first region that has both; _partners are joined keys."""
    full = meetings(found).repartition(*_MEETING).sortWithinPartitions(*_MEETING)

    def run(batches):
        for t in by_group(batches, 3):
            t = t.combine_chunks()
            edges = _edges(t, 3)
            where = [np.asarray(t.column(c)) for c in _MEETING]
            guest, block = np.asarray(t.column("_guest")), np.asarray(t.column("_block"))
            n, over = np.asarray(t.column("_n")).astype(np.int64), np.asarray(t.column("_over")).astype(np.int64)
            names = t.column("_set").to_pylist()
            point = unpack_counts(np.frombuffer(b"".join(t.column("_point").to_pylist()), dtype=np.uint8).reshape(-1, GROUPS // 2))
            lists = t.column("_regions").chunk(0)
            off, values = np.asarray(lists.offsets), np.asarray(lists.values)
            at, partners = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo < 2:
                    continue
                rows = np.arange(lo, hi)
                one, other = rows[~guest[lo:hi]], rows[guest[lo:hi]]
                a, b = candidates(n, point, over, one, other if where[1][lo] < where[2][lo] else None, threshold)
                if not len(a):
                    continue
                before = meet_before([values[off[r] : off[r + 1]] for r in rows], int(where[0][lo]))
                ok = ~before[a - lo, b - lo]
                a, b = a[ok], b[ok]
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                begin = np.searchsorted(a, rows)
                end = np.searchsorted(a, rows, "right")
                for r in np.union1d(a, b):
                    at.append(int(r))
                    partners.append(b"".join(names[x] for x in b[begin[r - lo] : end[r - lo]].tolist()))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at]) for c in where] + [pa.array([names[r] for r in at], pa.binary()), pa.array(block[at]), pa.array(partners, pa.binary())], [*_MEETING, "_set", "_block", "_partners"]
                )

    return full.mapInArrow(lean(run), "_leader bigint, _i int, _j int, _set binary, _block bigint, _partners binary")


def _forest(a: list[int], b: list[int], count: int) -> list[tuple[int, int]]:
    """Of the pairs, those that link what the ones before don't."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((x, y))
    return out


def verified(found: DataFrame, pairs: DataFrame, sizes: DataFrame, threshold: float, each_pair: bool = False) -> DataFrame:
    """(_a, _b, jaccard, links) from the n-gram sets of the pairs that are similar.

    Rows without _b tell how many documents with other sets _a is similar to, in
    one meeting; rows with _b are enough pairs to link what is similar, directly or through others. With ``each_pair`` there is
    a row for each similar pair instead, with its similarity.
    """
    grams = found.select("_set", "_block", "_n", "_grams")
    both = pairs.join(grams, ["_set", "_block"]).join(sizes.select("_set", "_size"), "_set")
    both = both.select(*_MEETING, "_set", "_n", "_size", "_partners", "_grams").repartition(*_MEETING).sortWithinPartitions(*_MEETING)

    def run(batches):
        for t in by_group(batches, 3):
            edges = _edges(t, 3)
            names, partners, blobs = (t.column(c).to_pylist() for c in ("_set", "_partners", "_grams"))
            n, size = np.asarray(t.column("_n")).astype(np.int64), np.asarray(t.column("_size"))
            out_a, out_b, out_j, out_n = [], [], [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                place = {names[r]: r - lo for r in range(lo, hi)}
                lists = [from_six_bytes(blobs[r]) for r in range(lo, hi)]
                words, ids = np.unique(np.concatenate(lists), return_inverse=True)
                bounds = np.append(0, np.cumsum([len(x) for x in lists]))
                ids = ids.ravel()
                mark = np.zeros(len(words), dtype=np.int32)
                links = np.zeros(hi - lo, dtype=np.int64)
                left, right = [], []
                for i in range(hi - lo):
                    keys = partners[lo + i]
                    if not keys:
                        continue
                    js = np.array([place[keys[k : k + 16]] for k in range(0, len(keys), 16)])
                    mine = ids[bounds[i] : bounds[i + 1]]
                    mark[mine] = 1
                    shared = np.array([mark[ids[bounds[j] : bounds[j + 1]]].sum() for j in js])
                    mark[mine] = 0
                    similarity = shared / (n[lo + i] + n[lo + js] - shared)
                    ok = similarity >= threshold
                    js = js[ok]
                    links[i] += size[lo + js].sum()
                    links[js] += size[lo + i]
                    left += [i] * len(js)
                    right += js.tolist()
                    if each_pair:
                        out_j += np.round(similarity[ok], 6).tolist()
                chosen = list(zip(left, right)) if each_pair else _forest(left, right, hi - lo)
                out_a += [names[lo + i] for i, _ in chosen]
                out_b += [names[lo + j] for _, j in chosen]
                if not each_pair:
                    some = np.flatnonzero(links).tolist()
                    out_n += [None] * len(chosen) + links[some].tolist()
                    out_a += [names[lo + i] for i in some]
                    out_b += [None] * len(some)
            if each_pair:
                out_n = [None] * len(out_a)
            else:
                out_j = [None] * len(out_a)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()), pa.array(out_j, pa.float64()), pa.array(out_n, pa.int64())], ["_a", "_b", "jaccard", "links"])

    return both.mapInArrow(lean(run), "_a binary, _b binary, jaccard double, links bigint")


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, each_pair: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, _text, _set), sets (_set, _size, _first) with their number of ids and the least of these, and the rows of ``verified``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    docs = sheltered(docs).select(F.col("doc_id").cast("bigint"), "text")
    known = cut(repeated(blocks(docs, n)))
    one = cut(members(known))
    sets = cut(one.select("doc_id", "_set").distinct().groupBy("_set").agg(F.count("*").alias("_size"), F.min("doc_id").alias("_first")))
    found = cut(prefixes(known, threshold))
    release(known)
    pairs = cut(met_pairs(found, threshold))
    links = cut(verified(found, pairs, sets, threshold, each_pair))
    release(pairs)
    release(found)
    return one, sets, links


def classes(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(_set, _root) of the sets that are linked to others: _root is the set with the least id that they are linked to, directly or through others."""
    # as bytes, nodes sort by their least id and then by their set
    node = sets.select("_set", F.concat(F.unhex(F.lpad(F.hex(F.col("_first").bitwiseXOR(F.lit(-(2**63)))), 16, "0")), "_set").alias("_node"))
    edges = links.where("_b is not null").select("_a", "_b").join(node.toDF("_a", "_u"), "_a").join(node.toDF("_b", "_v"), "_b").select("_u", "_v")
    return components(edges).select(F.substring("_v", 9, 16).alias("_set"), F.substring("_root", 9, 16).alias("_root")).distinct()


def similar_documents(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of each document that has at least that Jaccard similarity of word n-gram sets to another one.

    ``links`` is the number of other documents that it is similar to, copies
    included; every similar pair counts, whatever the size of its group. ``class_id`` is the smallest doc_id that it is linked
    to, directly or through others, so copies and near copies have one class. Documents that are similar to no other have no row.

    Words are lower-case and separated by white space; a text of fewer than n words has
    one n-gram of all of them, and the whole text counts, however long it is. Null, empty and blank texts are similar to nothing,
    rows with a null id have nothing to be listed by and are left out, and rows that repeat
    an id and its set of n-grams are one document; an id with two different sets is two documents with a row each. A similarity equal to the threshold is a link. An empty
    table gives an empty result. Columns beside doc_id and text aren't read, whatever their names. N-grams are compared by hashes of 48 bits. The table has
    to be read in the same order each time, as Parquet is, since documents are referred to by their place.
    """
    one, sets, links = similar_sets(docs, n, threshold)
    group = classes(sets, links).join(sets.select(F.col("_set").alias("_root"), F.col("_first").alias("class_id")), "_root").select("_set", "class_id")
    other = links.where("_b is null").groupBy(F.col("_a").alias("_set")).agg(F.sum("links").alias("_other"))
    known = sets.join(group, "_set", "left").join(other, "_set", "left").where("_size > 1 or _other > 0")
    known = known.select("_set", F.coalesce("class_id", "_first").alias("class_id"), (F.col("_size") - 1 + F.coalesce("_other", F.lit(0))).alias("links"))
    return one.select("doc_id", "_set").distinct().join(known, "_set").select("doc_id", "class_id", "links")


def similar_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): the similar pairs of different sets, each by the least doc_id of its two sets; otherwise as ``similar_documents``."""
    _, sets, links = similar_sets(docs, n, threshold, each_pair=True)
    first = sets.select("_set", "_first")
    out = links.join(first.toDF("_a", "_x"), "_a").join(first.toDF("_b", "_y"), "_b")
    return out.select(F.least("_x", "_y").alias("doc_a"), F.greatest("_x", "_y").alias("doc_b"), "jaccard")


def keep_one_of_each_group(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group kept: of those linked by similar pairs, directly or through others, the one with the smallest doc_id stays.

    Rows with null ids or without words are in no group and stay, and rows that repeat an id and its text stay or go
    together; where an id has several texts, each is judged by itself. All columns are carried along. See ``similar_documents`` for the rest.
    """
    one, sets, links = similar_sets(docs, n, threshold)
    late = classes(sets, links).where("_set <> _root").select("_set", F.lit(True).alias("_late"))
    known = sets.join(late, "_set", "left").where("_late or _size > 1")
    gone = one.join(known, "_set").where("_late or doc_id > _first").select(F.col("doc_id").alias("_gone"), "_text").distinct()
    kept = sheltered(docs)
    return kept.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64(kept["text"]) == F.col("_text")), "left_anti").toDF(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(_v, _root) for each end of an edge (_u, _v): the smallest end of its connected component.

    Every node is tied to the smallest of its neighbours, by turns over greater and smaller
    ones, until the edges no longer change; the number of rounds grows with the logarithm of the component's size.
    """
    star = cut(edges.select(F.greatest("_u", "_v").alias("_v"), F.least("_u", "_v").alias("_u")).where("_u <> _v").distinct())
    before = None
    while True:
        both = star.select("_u", "_v").union(star.select(F.col("_v"), F.col("_u")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = both.where("_v > _u").join(least, "_u").select(F.col("_v"), F.col("_m").alias("_u")).where("_u <> _v").distinct()
        small = large.groupBy("_v").agg(F.min("_u").alias("_m"))
        small = large.join(small, "_v").select(F.explode(F.array("_u", "_v")).alias("_v"), F.col("_m").alias("_u")).where("_u <> _v").distinct()
        old, star = star, cut(small)
        release(old)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select("_v", F.col("_u").alias("_root"))
        before = now
