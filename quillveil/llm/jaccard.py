"""Exact similarity join of documents by the Jaccard distance of their 5-word shingle sets, and its connected components.

Two documents link when 100 * intersection >= 75 * union, a distance of at most 0.25. Documents with equal sets are one class.

1. Landmarks. Most documents are at distance 1 from any other, so whole documents as pivots would put every document in every
   region. The first pivots are therefore single shingles, in one order of the whole corpus: by hash, with common ones (counted
   over all documents) last. A document's cell is that of its first shingle. A document within 0.25 has its first shingle
   among the first n - ceil(0.75 n) + 1 of this document's or vice versa, so each document is replicated to those cells and
   linked documents always share one.
2. Regions. In each cell the document with the largest share of common shingles is the pivot (of a group of copies, mostly the
   original). A pivot's region holds the documents of all its cells.
3. Bounds. A set's sketch counts its hashes in about a sixth as many bins; the sum of differences of two sketches is a lower
   bound of the sets' symmetric difference, which linked sets keep under a seventh of their sizes' sum. Documents that no
   other one of their region can reach by this bound and by size leave the region before any text is moved.
4. Windows. In a region the distances to the pivot decide: documents within 0.25 of it are linked to it and need not be
   compared with each other; any other two can only be linked if their distances to the pivot differ by at most 0.25. A region
   of more than `BLOCK` documents is first dealt out for those distances; then the sketches of its rings of distance are dealt
   out in pairs of blocks, and texts only to the pairs where another document can reach them. Each pair is a region of its own
   with a pivot of its own.

Cells travel as packed bytes. No list of pairs of a cell or region is ever made: only links that connect something new.

Edge cases: null, empty and blank texts have the empty set, link to nothing and are their own component; a text of one to four
words is one shingle; equal texts and repeated rows are one class; rows that share a doc_id are one document, which links to
whatever any of its texts link to; an empty table gives no rows; columns other than doc_id and text are not read. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.components import components
from quillveil.llm.store import scratch, stored
from quillveil.llm.text import mix, shingle_sets
from quillveil.llm.workers import lean

K = 5
#: Similarity in hundredths.
LEAST = 75
#: Documents of a region, or of a block of a large one.
BLOCK = 512
#: Common shingles that are put last, at most (8 bytes each, sent to every task); which ones only matters for speed.
COMMON = 1 << 17
COMMON_FROM = 48
#: Ids of documents whose texts are needed are sent to every task up to this number (8 MB), beyond it joined by a shuffle.
SENT = 1 << 20
#: Documents of a class in one part, parts of a class at most, and classes of parts sent to every task at most (24 bytes each).
PART, SALTS, LARGE = 256, 4096, 1 << 16
_ENTRY = np.dtype([("t", "<u4"), ("k", "<i8"), ("n", "<u2"), ("heat", "u1")])
_SIZE_STEPS = 4000
_RINGS = 20
_U = np.uint64


def _signature(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    if not len(own):
        return 0, 0
    return int(mix(own).sum(dtype=_U).astype(np.int64)), int(mix(own + _U(0x51ED270B)).sum(dtype=_U).astype(np.int64))


def sketch(own: np.ndarray) -> np.ndarray:
    """Counts of the hashes in a power of two of bins, 4 to 8 hashes each; a count stops at 255, which keeps it a bound.

    At 16 hashes a bin unrelated sets come close to the bound of linked ones; at 8 they are far above it.
    """
    bins = 1 << max(3, int(len(own)).bit_length() - 3)
    return np.minimum(np.bincount((own & _U(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def signatures(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, the class (a, b) and the sketch of each document's set."""

    def run(batches):
        for batch in batches:
            n, a, b, bins = [], [], [], []
            for own in shingle_sets(batch.column(1), k):
                x, y = _signature(own)
                n.append(len(own))
                a.append(x)
                b.append(y)
                bins.append(sketch(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bins, pa.binary())], names=["doc_id", "n_shingles", "a", "b", "sketch"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_shingles long, a long, b long, sketch binary")


def common_shingles(documents: DataFrame, k: int = K, most: int = COMMON) -> np.ndarray:
    """Sorted hashes of the shingles in the most documents, as far as tasks meet them thrice in some thousand documents."""

    def run(batches):
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def counted():
            if not held:
                return
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["t", "n"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), k):
                key = _signature(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                held.append(own.copy())
                size += len(own)
                if size >= 1 << 22:
                    yield from counted()
                    held, size, seen = [], 0, set()
        yield from counted()

    found = documents.select(F.col("text").cast("string")).mapInArrow(lean(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    return np.sort(found.orderBy(F.desc("n"), "t").limit(most).select("t").toArrow()["t"].to_numpy().view(_U))


def cells(documents: DataFrame, common: np.ndarray, buckets: int, k: int = K) -> DataFrame:
    """Rows (bucket, entries): packed entries of the cells of each document, each class once a task."""
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        often = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(often >> _U(44)).astype(np.int64)] = True
        held: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        size, seen = 0, set()

        def packed():
            if not held:
                return
            all_tokens, entries = np.concatenate(tokens), np.concatenate(held)
            bucket = ((all_tokens & _U(0xFFFFFFFF)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, entries = bucket[order], entries[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts = np.concatenate(([0], cuts))
            blobs = [x.tobytes() for x in np.split(entries, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), k):
                n = len(own)
                if not n:
                    continue
                a, b = _signature(own)
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                first = n - (LEAST * n + 99) // 100 + 1
                hot = maybe[(own >> _U(44)).astype(np.int64)]
                if hot.any():
                    at = np.flatnonzero(hot)
                    place = np.minimum(np.searchsorted(often, own[at]), len(often) - 1)
                    hot[at] = often[place] == own[at]
                heat = int(hot.sum())
                chosen = own[~hot][:first] if heat else own[:first]
                if len(chosen) < first:
                    chosen = np.concatenate((chosen, own[hot][: first - len(chosen)]))
                entry = np.empty(len(chosen), _ENTRY)
                entry["t"], entry["k"] = (chosen >> _U(32)).astype(np.uint32), a
                entry["n"], entry["heat"] = min(65535, int(np.log(n) * _SIZE_STEPS)), 255 * heat // n
                held.append(entry)
                tokens.append(chosen)
                size += len(chosen)
                if size >= 1 << 20:
                    yield from packed()
                    held, tokens, size = [], [], 0
        yield from packed()

    return documents.select(F.col("text").cast("string")).mapInArrow(lean(run), "bucket int, entries binary")


def regions(packed: DataFrame, partitions: int) -> DataFrame:
    """Rows (p, m), distinct: m shares a cell with pivot p. Cells of one class are left out."""
    apart = int(np.log(100 / LEAST) * _SIZE_STEPS) + 2

    def members(blobs: list[bytes]) -> np.ndarray:
        e = np.frombuffer(b"".join(blobs), _ENTRY)
        e = e[np.lexsort((e["k"], ~e["heat"], e["t"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["t"][1:] != e["t"][:-1]) | (e["k"][1:] != e["k"][:-1])
        e = e[fresh]
        first = np.ones(len(e), bool)
        first[1:] = e["t"][1:] != e["t"][:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(e)))
        keep = counts >= 2
        pair = np.flatnonzero(counts == 2)
        keep[pair] = np.abs(e["n"][starts[pair]].astype(int) - e["n"][starts[pair] + 1].astype(int)) <= apart
        rows = np.repeat(keep, counts)
        out = np.empty((int(rows.sum()), 2), np.int64)
        out[:, 0] = np.repeat(e["k"][starts[keep]], counts[keep])
        out[:, 1] = e["k"][rows]
        return out

    def distinct(found: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(found)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        return x[np.concatenate(([True], (x[1:] != x[:-1]).any(1)))] if len(x) else x

    def run(batches):
        bucket, blobs, found, size = None, [], [], 0
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket:
                    if blobs:
                        found.append(members(blobs))
                        size += len(found[-1])
                    bucket, blobs = b, []
                    if size > 1 << 20:
                        found = [distinct(found)]
                        if len(found[0]) > 1 << 19:
                            yield pa.RecordBatch.from_arrays([pa.array(found[0][:, 0]), pa.array(found[0][:, 1])], names=["p", "m"])
                            found = []
                        size = sum(map(len, found))
                blobs.append(blob)
        if blobs:
            found.append(members(blobs))
        if found:
            x = distinct(found)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["p", "m"])

    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "p long, m long").distinct()


def reachable(sizes: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Whether each set can be linked to any other, by size and sketch."""
    out = np.zeros(len(sizes), bool)
    order = np.argsort(sizes, kind="stable")
    bins = np.array([len(sketches[i]) for i in order])
    n = sizes[order]
    ends = np.searchsorted(n, n * 100 // LEAST, "right")
    for level in np.unique(bins):
        at = np.flatnonzero(bins == level)
        last = int(ends[at].max())
        folded = np.stack([sketches[i].astype(np.int16).reshape(-1, level).sum(0) for i in order[at[0] : last]])
        for i in at:
            if ends[i] > i + 1:
                far = np.abs(folded[i + 1 - at[0] : ends[i] - at[0]] - folded[i - at[0]]).sum(1)
                near = far * (100 + LEAST) <= (100 - LEAST) * (n[i + 1 : ends[i]] + n[i])
                if near.any():
                    out[order[i]] = True
                    out[order[i + 1 : ends[i]][near]] = True
    return out


def pruned(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows (p, d, pivot, n, sketch) of regions to the rows (p, d, pivot) that another row of their region can reach."""

    def run(batches):
        ps, ds, pivots = [], [], []
        for (p,), held in _groups(batches, 1):
            table = pa.Table.from_batches(held)
            if len(table) > 1:
                near = reachable(table["n"].to_numpy(), [np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()])
                ds.append(table["d"].to_numpy()[near])
                pivots.append(table["pivot"].to_numpy()[near])
                ps.append(np.full(len(ds[-1]), p))
        if ps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ps), pa.int64()), pa.array(np.concatenate(ds), pa.int64()), pa.array(np.concatenate(pivots), pa.bool_())], names=["p", "d", "pivot"])

    return rows.select("p", "d", "pivot", "n", "sketch").repartition(partitions, "p").sortWithinPartitions("p", "d").mapInArrow(lean(run), "p long, d long, pivot boolean")


def _similar(inter: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    return 100 * inter >= LEAST * (sizes + others - inter)


def _counts(rows: np.ndarray, columns: np.ndarray, n: int, wanted: np.ndarray, width: int) -> np.ndarray:
    """Intersection sizes (wanted x n) from incidences (row, column)."""
    inter = np.zeros((len(wanted), n), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(columns, (a, a + 4096))
        dense = np.zeros((n, min(4096, width - a)), np.float32)
        dense[rows[lo:hi], columns[lo:hi] - a] = 1
        live = dense[wanted]
        if live.any():
            inter += live @ dense.T
    return inter


def local_links(sets: list[np.ndarray], pivot: int | None = None) -> list[tuple[int, int]]:
    """Links that connect all that any links among the sets connect.

    Distances to a pivot come first: the one given, or else the set that shares most. Sets within 0.25 of it are linked
    through it and not compared with each other; the others are compared, in blocks, among themselves and with those of the
    linked ones that the triangle inequality leaves within 0.25 of any of them.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    if n == 2:
        both = np.sort(np.concatenate(sets))
        if _similar(np.array([(both[1:] == both[:-1]).sum()]), sizes[:1], sizes[1:])[0]:
            link(0, 1)
        return out
    doc = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, doc = values[order], doc[order]
    same = values[1:] == values[:-1]
    kept = np.concatenate((same, [False])) | np.concatenate(([False], same))
    values, doc = values[kept], doc[kept]
    if not len(values):
        return out
    column = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
    width = int(column[-1]) + 1
    first = np.searchsorted(column, np.arange(width + 1))
    by_doc = np.argsort(doc, kind="stable")
    doc_at = np.searchsorted(doc[by_doc], np.arange(n + 1))
    if pivot is None:
        pivot = int(np.argmax(np.bincount(doc, minlength=n)))
    own = column[by_doc[doc_at[pivot] : doc_at[pivot + 1]]]
    hits = np.concatenate([doc[first[c] : first[c + 1]] for c in own]) if len(own) else np.zeros(0, int)
    inter = np.bincount(hits, minlength=n)
    linked = _similar(inter, sizes, sizes[pivot])
    linked[pivot] = True
    for i in np.flatnonzero(linked):
        link(pivot, int(i))
    rest = np.flatnonzero(~linked)
    if not len(rest):
        return out
    distance = 1 - inter / (sizes + sizes[pivot] - inter)
    within = np.flatnonzero(linked & (distance >= distance[rest].min() - 0.25 - 1e-9))
    for a in range(0, len(rest), 256):
        part, near = rest[a : a + 256], np.concatenate((rest[a:], within))
        place = np.full(n, -1)
        place[near] = np.arange(len(near))
        mine = place[doc] >= 0
        _, used = np.unique(column[mine], return_inverse=True)
        counts = _counts(place[doc[mine]], used, len(near), place[part], int(used.max()) + 1 if len(used) else 0)
        for i, j in np.argwhere(_similar(counts, sizes[part][:, None], sizes[near][None, :])):
            if part[i] != near[j]:
                link(int(part[i]), int(near[j]))
    return out


def _groups(batches, keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of equal values in the first columns, which come one after another."""
    key, held = None, []
    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        a = 0
        while a < len(heads):
            b = a + 1
            while b < len(heads) and heads[b] == heads[a]:
                b += 1
            if heads[a] != key:
                if held:
                    yield key, held
                key, held = heads[a], []
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield key, held


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    return [s.copy() for s in shingle_sets(column, k)]


def join_units(units: DataFrame, partitions: int, k: int = K) -> DataFrame:
    """Links (u, v) within each unit p of rows (p, d, pivot, text)."""

    def run(batches):
        us, vs = [], []
        for _, held in _groups(batches, 1):
            ids, sets, pivots = [], [], []
            for batch in held:
                ids += batch.column(1).to_pylist()
                pivots += batch.column(2).to_pylist()
                sets += _sets(batch.column(3), k)
            if len(ids) > 1:
                for a, b in local_links(sets, pivots.index(True) if True in pivots else None):
                    us.append(ids[a])
                    vs.append(ids[b])
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = units.select("p", "d", "pivot", "text").repartition(partitions, "p").sortWithinPartitions("p", "d")
    return dealt.mapInArrow(lean(run), "u long, v long")


def pivot_rings(rows: DataFrame, partitions: int, k: int = K) -> DataFrame:
    """Rows (p, salt, d, pivot, text), each salt with its region's pivot, to (p, u, d, ring, linked, n, sketch).

    u is the pivot's id, ring 20 times the distance from it.
    """

    def run(batches):
        for (p, _), held in _groups(batches, 2):
            ids, sets = [], []
            for batch in held:
                ids += batch.column(2).to_pylist()
                sets += _sets(batch.column(3), k)
            own = sets[0]
            rings, linked = [], []
            for s in sets:
                both = np.sort(np.concatenate((own, s)))
                inter = int((both[1:] == both[:-1]).sum())
                union = len(own) + len(s) - inter
                rings.append(_RINGS * (union - inter) // max(1, union))
                linked.append(100 * inter >= LEAST * union)
            columns = [pa.array([p] * len(ids), pa.int64()), pa.array([ids[0]] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(rings, pa.int32()), pa.array(linked)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["p", "u", "d", "ring", "linked", "n", "sketch"])

    dealt = rows.select("p", "salt", "d", "text", "pivot").repartition(partitions, "p", "salt").sortWithinPartitions("p", "salt", F.desc("pivot"), "d", "text")
    return dealt.mapInArrow(lean(run), "p long, u long, d long, ring int, linked boolean, n long, sketch binary").dropDuplicates(["p", "d", "ring", "linked", "sketch"])


def links(documents: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """Links (u, v) between classes, by the smallest doc_id of each, that connect all that any links connect."""
    spark = documents.sparkSession
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    partitions = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 5 // (64 << 20)))
    packed = cells(documents, common_shingles(documents, k), 16 * partitions, k)
    reps = stored(classes.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("d"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    # A region is named by the first half of its pivot's class; classes that share it are all in the region.
    found = regions(packed, partitions).join(reps.select(F.col("a").alias("m"), "d", "n", "sketch"), "m")
    found = stored(found.select("p", "d", (F.col("m") == F.col("p")).alias("pivot"), "n", "sketch"))
    sizes = stored(found.groupBy("p").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK)))
    large = sizes.count()
    of_region = F.broadcast if large <= LARGE else lambda x: x  # what has a row for each large region
    found = found.join(of_region(sizes.select("p", "blocks")), "p", "left") if large else found.withColumn("blocks", F.lit(None).cast("long"))
    members = stored(pruned(found.where("blocks is null"), partitions).withColumn("blocks", F.lit(1).cast("long")).unionByName(found.where("blocks is not null").select("p", "d", "pivot", "blocks")))
    wanted = stored(members.select("d").distinct())
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).join(wanted, "d", "left_semi").dropDuplicates(["d", "text"])
    members = stored(members.join(texts, "d"))
    out = join_units(members.where("blocks = 1"), partitions, k).unionByName(_same_id(classes, reps))
    if not large:
        return out
    members = members.where("blocks > 1")
    salts = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array(F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")))
    rings = stored(pivot_rings(members.withColumn("salt", F.explode(salts)), partitions, k))
    near = rings.where("linked and d <> u").select("u", F.col("d").alias("v"))
    # What is left: unlinked documents against each other and against the linked ones in their window.
    low = rings.where("not linked").groupBy("p").agg(F.min("ring").alias("low"))
    live = rings.join(of_region(low), "p").where((~F.col("linked")) | (F.col("ring") >= F.col("low") - _RINGS // 4 - 1))
    per = live.groupBy("p", "ring", "linked").agg(F.count("*").alias("in_ring")).withColumn("cuts", F.ceil(F.col("in_ring") / BLOCK))
    shapes = per.groupBy("p").agg(F.collect_list(F.struct("ring", "linked", "cuts")).alias("shape"))  # 42 entries at most
    live = live.join(of_region(shapes), "p")
    cuts = F.filter("shape", lambda s: (s["ring"] == F.col("ring")) & (s["linked"] == F.col("linked")))[0]["cuts"]
    live = live.withColumn("own", F.struct("ring", "linked", F.pmod(F.xxhash64("d"), cuts).cast("int").alias("cut")))
    partners = F.flatten(F.transform(F.filter("shape", lambda s: (F.abs(s["ring"] - F.col("ring")) <= _RINGS // 4 + 1) & ~(s["linked"] & F.col("linked"))), lambda s: F.transform(F.sequence(F.lit(0), s["cuts"].cast("int") - 1), lambda c: F.struct(s["ring"].alias("ring"), s["linked"].alias("linked"), c.alias("cut")))))
    units = live.select("p", "d", "n", "sketch", "own", F.explode(partners).alias("other"))
    units = units.select(F.xxhash64("p", F.least("own", "other"), F.greatest("own", "other")).alias("p"), "d", F.lit(False).alias("pivot"), "n", "sketch").dropDuplicates(["p", "d", "sketch"])
    # Only sketches are copied for each pair of blocks; a text moves to those where another document can reach it.
    dealt = stored(pruned(units, partitions).distinct()).join(members.select("d", "text").dropDuplicates(["d", "text"]), "d")
    return out.unionByName(near).unionByName(join_units(dealt, partitions, k))


def _same_id(classes: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) from each doc_id that has texts of several classes to the smallest doc_id of each."""
    rows = classes.where("n_shingles > 0 and doc_id is not null").select("doc_id", "a", "b")
    several = rows.groupBy("doc_id").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("doc_id")
    return rows.join(several, "doc_id").join(reps.select("a", "b", "d"), ["a", "b"]).where("doc_id <> d").select(F.col("doc_id").alias("u"), F.col("d").alias("v"))


def near_duplicates(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id that links lead to.

    Only classes whose component is not their only document's own are joined back, a large class's documents in parts.
    """
    spark = documents.sparkSession
    classes = stored(signatures(documents, k).select("doc_id", "n_shingles", "a", "b", "sketch"))
    with scratch(spark):
        labels = components(stored(links(documents, classes, k)))
        sized = classes.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
        sized = sized.join(labels, F.col("rep") == F.col("node"), "left").select("a", "b", "size", F.coalesce("label", "rep").alias("component"), F.col("rep"))
        sized = stored(sized.where("size > 1 or component <> rep"), outer=True)
    many = F.greatest(F.lit(1), F.floor(F.col("size") / PART))
    parts = sized.select("a", "b", "component", F.explode(F.sequence(F.lit(0), F.least(many, F.lit(SALTS)).cast("int") - 1)).alias("part"))
    large = stored(sized.where(F.col("size") >= 2 * PART).select("a", "b", F.least(many, F.lit(SALTS)).cast("int").alias("parts")))
    rows = classes.select("doc_id", "n_shingles", "a", "b")
    if large.count() <= LARGE:
        rows = rows.join(F.broadcast(large), ["a", "b"], "left")
    else:  # their number grows with the corpus; then a class's rows are split by the join itself
        rows, parts = rows.withColumn("parts", F.lit(1)), parts.where("part = 0")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    return rows.join(parts, ["a", "b", "part"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
