"""Exact n-gram Jaccard self-join by pivots, regions and triangle-inequality windows.

Jaccard distance d = 1 - J is a metric; documents link when d <= r (here r = 1/4).  Documents drawn from a corpus lie at
distance about 1 from any pivot but their own copies, so regions of a few global pivots would each hold everything.
The join therefore narrows the corpus exactly before it chooses pivots:

1. Isolation.  A document that links keeps at least ceil(0.75 n) of its n shingles elsewhere.  Shingles in half of the
   hash range are counted over all documents; a document with more uncovered ones than it may lose is farther than r
   from every other document.
2. Points.  Equal shingle sets are one point of the space.
3. Candidate regions.  Linked sets share a shingle among the n - ceil(0.75 n) + 1 rarest of each, so each shared rare
   shingle marks a candidate set; the candidate set's pivot is its member with the smallest share of unique shingles,
   the most central one.  All points of a pivot's candidate sets form the pivot's region: every linked pair lies
   together in some region, and a point lies in few.
4. Windows.  d(x, pivot) is computed for every point of a region.  Points within r link to the pivot and so to each
   other; what is left are pairs with at least one point beyond r.  For those, with D(x) the symmetric difference of x
   and the pivot, a link needs |D(x) & D(y)| >= (|D(x)| + |D(y)| - (|x| + |y|) / 7) / 2, the triangle inequality of
   the symmetric difference with its slack made explicit; points whose reusable part of D is too small for any partner
   drop out: points beyond r are held against all others of the region, points within r against those beyond.
5. Voronoi regions.  A region of more than ``LEAF`` remaining points chooses pivots among them and measures every point
   against each.  A point's home is the region of its nearest pivot p1; it is replicated into that of every p2 with
   d(x, p2) - d(x, p1) <= 2r, so that by the triangle inequality a linked pair meets in the home of either.  Pairs are
   joined where one of them is at home.  Regions recurse until they fit; then all their pairs are compared.  A region
   that its pivots do not divide, all its points being near each other, is joined in blocks of ``SPLIT`` points.

Sets travel as sorted 64-bit hashes.  Nothing is capped: large regions are salted for steps 4 and 5.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._blobs import bucket_edges, pack_ints, pack_run, pack_table, unpack_ints, unpack_run, unpack_table
from loglattice.llm._graph import components
from loglattice.llm._store import bucket_keys, drop, join_classes, stored, text_bytes
from loglattice.llm._words import blocks, runs, word_hashes

NUMERATOR, DENOMINATOR = 75, 100
SALT = 256
SPLIT = 128
LEAF = 256
PIVOTS = 16  # of a region
DENSE = 0.7  # a region with a part larger than this share is not divided
SPREAD = 16  # parts of a pivot's pairs before its size is known
BLOCK_BYTES = 2 << 20
HALF = np.uint64(1 << 63)


def need(n):
    """The least shared shingles of a set of n with any linked one: ceil(0.75 n)."""
    return -(-n * NUMERATOR // DENOMINATOR)


def linked(shared, n, m):
    return shared * DENOMINATOR >= NUMERATOR * (n + m - shared)


def shingle_sets(column: pa.Array, width: int, most: int = BLOCK_BYTES):
    """(first row, flat sorted distinct shingle hashes, first hash of each row and the total, digest of each row's set) by
    block of rows.  A row of fewer words than ``width`` has its whole sequence as only shingle, and that sequence's digest."""
    for at, offsets, data in blocks(column, most):
        words, first = word_hashes(offsets, data, lower=True)
        places, hashes = runs(words, first, width)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < width))
        row = np.searchsorted(first, places, "right") - 1
        whole = {r: hashlib.blake2b(b" ".join(data[offsets[r] : offsets[r + 1]].tobytes().lower().split()), digest_size=16).digest() for r in short.tolist()}
        if len(short):
            hashes = np.concatenate([hashes, np.frombuffer(b"".join(d[:8] for d in whole.values()), np.uint64)])
            row = np.concatenate([row, short])
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
        cut = np.searchsorted(row, np.arange(len(offsets)))
        yield at, hashes, cut, [whole.get(i) or _digest(hashes[cut[i] : cut[i + 1]]) for i in range(len(cut) - 1)]


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b""


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key) of every row."""

    def run(batches):
        for batch in batches:
            for at, _, cut, keys in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(keys)), pa.array(np.diff(cut), pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "set_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary")


def _half_runs(docs: DataFrame, width: int, keys: list[int], shares: int) -> DataFrame:
    """Per block and bucket of the lower half of the hash range: each hash once, with how often the block holds it
    (1 or 2 for more) and the row that holds it if one does."""
    buckets = len(keys) * shares

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, hashes, cut, _ in shingle_sets(batch.column(1), width):
                row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                low = hashes < HALF
                n, in_half = np.diff(cut), np.bincount(row[low], minlength=len(cut) - 1)
                hashes, row = hashes[low], row[low]
                order = np.argsort(hashes, kind="stable")
                hashes, row = hashes[order], row[order]
                new = np.ones(len(hashes), bool)
                new[1:] = hashes[1:] != hashes[:-1]
                firsts = np.flatnonzero(new)
                times = np.diff(np.append(firsts, len(hashes)))
                covered = np.bincount(row[np.repeat(times > 1, times)], minlength=len(cut) - 1)
                hashes, row = hashes[firsts] << np.uint64(1), np.where(times > 1, 0, row[firsts] + 1).astype(np.uint64)
                name = uuid.uuid5(uuid.NAMESPACE_OID, f"{ids[at]} {len(cut)} {len(hashes)} {hashes[:1]} {hashes[-1:]}").hex
                table = pack_table(ids[at : at + len(cut) - 1], n, in_half, covered)
                cuts, home, out = bucket_edges(hashes, buckets), int(name[:8], 16) % buckets, []
                for k in np.union1d(np.flatnonzero(np.diff(cuts)), [home]).tolist():
                    a, b = cuts[k], cuts[k + 1]
                    out.append((keys[k // shares], k % shares, name, pack_run(hashes[a:b], row[a:b]), table if k == home else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "share", "block", "run", "docs"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, share long, block string, run binary, docs binary")


def _covered(table: pa.Table) -> pa.Table:
    """One bucket: for each block, how many of each row's lone hashes another block holds too."""
    all_hashes, rows, where = [], [], []
    for i, run in enumerate(table.column("run").to_pylist()):
        hashes, row = unpack_run(run, 1)
        all_hashes.append(hashes)
        rows.append(row.astype(np.int64))
        where.append(np.full(len(hashes), i, np.int64))
    hashes = np.concatenate(all_hashes)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.zeros(len(hashes), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:].copy()
    order = order[same]
    row, block = np.concatenate(rows)[order], np.concatenate(where)[order]
    row, block = row[row > 0], block[row > 0]
    held, times = np.unique(block << 32 | row, return_counts=True)
    cuts, out = np.searchsorted(held, np.arange(len(table) + 1) << 32), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = held[a:b] & 0xFFFFFFFF
        out.append(len(own).to_bytes(8, "little") + pack_ints(np.diff(own, prepend=0).astype(np.uint64)) + pack_ints(times[a:b].astype(np.uint64)))
    told = pa.table({"block": table.column("block"), "counts": pa.array(out, pa.binary()), "docs": table.column("docs")})
    return told.filter(pa.array((np.diff(cuts) > 0) | table.column("docs").is_valid().to_numpy(zero_copy_only=False)))


def _survivors(table: pa.Table) -> pa.Table:
    """One block: the documents that may still link."""
    ids, n, in_half, covered = unpack_table(next(d for d in table.column("docs").to_pylist() if d is not None), 4)
    covered = covered.copy()
    for data in table.column("counts").to_pylist():
        size, view = int.from_bytes(data[:8], "little"), memoryview(data)[8:]
        held, view = unpack_ints(view, size)
        times, _ = unpack_ints(view, size)
        covered[np.cumsum(held.astype(np.int64)) - 1] += times.astype(np.int64)
    keep = (n > 0) & (in_half - covered <= n - need(n))
    return pa.table({"doc_id": pa.array(ids[keep], pa.int64())})


def candidates(docs: DataFrame, width: int) -> DataFrame:
    """Step 1: doc_ids that may link."""
    keys, shares = bucket_keys(docs.sparkSession, text_bytes(docs))
    sent = _half_runs(docs, width, keys, shares).repartition(len(keys), "key")
    answers = sent.groupBy("key", "share").applyInArrow(_covered, "block string, counts binary, docs binary")
    return answers.groupBy("block").applyInArrow(_survivors, "doc_id long").distinct()


def _point_blocks(docs: DataFrame, width: int) -> DataFrame:
    """Rows of whole points: their ids, sizes and concatenated sorted shingles."""

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for at, hashes, cut, own in shingle_sets(batch.column(1), width):
                keep = [i for i, key in enumerate(own) if key == wanted[at + i]]
                if not keep:
                    continue
                sizes = np.array([cut[i + 1] - cut[i] for i in keep])
                body = np.concatenate([hashes[cut[i] : cut[i + 1]] for i in keep])
                table = pack_table(ids[at:][keep], sizes)
                name = uuid.uuid5(uuid.NAMESPACE_OID, f"{ids[at]} {len(keep)} {body[0]} {body[-1]}").hex
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table], pa.binary()), pa.array([body.tobytes()], pa.binary())], ["block", "points", "body"])

    return docs.select("doc_id", "text", "set_key").mapInArrow(run, "block string, points binary, body binary")


def _frequency_runs(keys: list[int], shares: int):
    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, times = np.unique(np.frombuffer(body, np.uint64), return_counts=True)
                cuts = bucket_edges(hashes, len(keys) * shares)
                rows = [(keys[k // shares], k % shares, name, pack_run(hashes[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]].astype(np.uint64)), k) for k in np.flatnonzero(np.diff(cuts)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32()), strict=True)], ["key", "share", "block", "run", "bucket"])

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    parts = [unpack_run(r, 1) for r in table.column("run").to_pylist()]
    hashes, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    _, place = np.unique(hashes, return_inverse=True)
    total = np.bincount(place, weights=times).astype(np.uint64)[place]
    out, at = [], 0
    for own, _ in parts:
        out.append(pack_ints(total[at : at + len(own)]))
        at += len(own)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array(out, pa.binary())})


def _marks(buckets: int):
    """One block of points with its shingles' frequencies: each point's reusable part, and its shared rare shingles."""

    def run(points: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes = unpack_table(points.column("points")[0].as_py(), 2)
        body = np.frombuffer(points.column("body")[0].as_py(), np.uint64)
        hashes, place = np.unique(body, return_inverse=True)
        total, cuts = np.zeros(len(hashes), np.int64), bucket_edges(hashes, buckets)
        for k, data in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            total[cuts[k] : cuts[k + 1]] = unpack_ints(memoryview(data), int(cuts[k + 1] - cuts[k]))[0].astype(np.int64)
        frequency, ends = total[place], np.cumsum(sizes)
        kinds, out_ids, out_n, out_unique, out_hash, out_body = [], [], [], [], [], []
        for i, end in enumerate(ends):
            own, often = body[end - sizes[i] : end], frequency[end - sizes[i] : end]
            lone, n = int((often == 1).sum()), int(sizes[i])
            rare = n - need(n) + 1 - lone
            if rare <= 0:
                continue
            shared, often = own[often > 1], often[often > 1]
            picked = shared[np.lexsort((shared, often))[:rare]]
            rows = 1 + len(picked)
            kinds += [0] + [1] * len(picked)
            out_ids += [int(ids[i])] * rows
            out_n += [n] * rows
            out_unique += [lone] * rows
            out_hash += [None, *picked.view(np.int64).tolist()]
            out_body += [shared.tobytes()] + [None] * len(picked)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "x": pa.array(out_ids, pa.int64()), "n": pa.array(out_n, pa.int64()), "lone": pa.array(out_unique, pa.int64()), "shingle": pa.array(out_hash, pa.int64()), "body": pa.array(out_body, pa.binary())})

    return run


def _distances(table: pa.Table) -> pa.Table:
    """One part of a region: every point against the pivot."""
    pivot = table.filter(pa.compute.equal(table.column("x"), table.column("p"))).slice(0, 1)
    if not len(pivot):
        return pa.table({k: pa.array([], t) for k, t in (("p", pa.int64()), ("salt", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("diff", pa.int64()), ("reuse", pa.int64()), ("link", pa.bool_()))})
    base, size = np.frombuffer(pivot.column("body")[0].as_py(), np.uint64), pivot.column("n")[0].as_py()
    p = pivot.column("p")[0].as_py()
    salt, rows = pivot.column("salt")[0].as_py(), [[] for _ in range(7)]
    for x, n, body in zip(table.column("x").to_pylist(), table.column("n").to_pylist(), table.column("body").to_pylist(), strict=True):
        if x == p:
            continue
        own = np.frombuffer(body, np.uint64)
        at = np.searchsorted(base, own)
        at[at == len(base)] = 0
        shared = int((base[at] == own).sum()) if len(base) else 0
        for column, value in zip(rows, (p, salt, x, n, n + size - 2 * shared, size - shared + len(own) - shared, bool(linked(shared, n, size))), strict=True):
            column.append(value)
    kinds = (pa.int64(),) * 6 + (pa.bool_(),)
    return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["p", "salt", "x", "n", "diff", "reuse", "link"])


def _pair_join(table: pa.Table) -> pa.Table:
    """One region, or two blocks of one: a spanning set of the links of its pairs.

    Pairs of one group are connected already; of a pair one point was at home on every level.
    """
    ids, n, diff, reuse, homes, full = (table.column(c).to_numpy() for c in ("x", "n", "diff", "reuse", "homes", "full"))
    _, group = np.unique(table.column("tied").to_numpy(), return_inverse=True)
    part, sets = table.column("part").to_numpy(), [np.frombuffer(b, np.uint64) for b in table.column("body").to_pylist()]
    one, two = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    a, b = [], []
    for i in left:
        others = right[right > i] if one == two else right
        enough = np.minimum(reuse[i], reuse[others]) * 14 >= (diff[i] + diff[others]) * 7 - (n[i] + n[others])
        near = np.minimum(n[i], n[others]) * DENOMINATOR >= NUMERATOR * np.maximum(n[i], n[others])
        for j in others[enough & near & (group[others] != group[i]) & ((homes[others] | homes[i]) == full[i])]:
            if group[i] == group[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if linked(shared, int(n[i]), int(n[j])):
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                group[group == group[j]] = group[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_CELL = "cell string, x long, n long, diff long, reuse long, tied long, homes long"


def _voronoi(level: int):
    """One part of a region with the region's pivots: the regions each point goes to, and its links to pivots."""
    window = 2 * (1 - NUMERATOR / DENOMINATOR) + 1e-9

    def run(table: pa.Table) -> pa.Table:
        head = table.column("head").to_numpy(zero_copy_only=False)
        rows, bodies = table.drop(["body"]).to_pylist(), [np.frombuffer(b, np.uint64) for b in table.column("body").to_pylist()]
        heads = sorted(np.flatnonzero(head).tolist(), key=lambda i: rows[i]["x"])
        out, links = [], []
        for i in np.flatnonzero(~head).tolist() if heads else []:
            own, distance = rows[i], []
            for j in heads:
                pivot = rows[j]
                shared = len(bodies[i]) if own["x"] == pivot["x"] else len(np.intersect1d(bodies[i], bodies[j], assume_unique=True))
                shared = own["n"] if own["x"] == pivot["x"] else shared
                distance.append(1 - shared / (own["n"] + pivot["n"] - shared))
                if own["x"] != pivot["x"] and linked(shared, own["n"], pivot["n"]):
                    links.append((own["x"], pivot["x"]))
                    if own["tied"] == own["x"]:
                        own["tied"] = pivot["tied"]
            home = int(np.argmin(distance))
            for k, j in enumerate(heads):
                if distance[k] - distance[home] <= window:
                    out.append((f"{own['cell']}.{rows[j]['x']}", own["cell"], own["x"], own["n"], own["diff"], own["reuse"], own["tied"], own["homes"] | (1 << level if k == home else 0), None, None))
        out += [(*[None] * 8, a, b) for a, b in links]
        kinds = (pa.string(), pa.string(), *(pa.int64(),) * 8)
        columns = list(zip(*out, strict=True)) if out else [[]] * 10
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "parent", "x", "n", "diff", "reuse", "tied", "homes", "a", "b"])

    return run


def _region_links(cells: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Step 5 over cells(_CELL) with one level of homes: stored tables of links (a, b)."""
    found, level = [], 0
    zero, close = F.lit(0).cast("long"), F.col("tied") == F.split("cell", r"\.")[0].cast("long")  # tied to the first pivot
    while True:
        full = (2 << level) - 1
        sizes = cells.groupBy("cell").agg(F.count("*").alias("m"), (F.min("tied") != F.max("tied")).alias("mixed"), F.count_if(close).alias("near")).withColumn("size", F.col("m"))
        rows = stored(join_classes(cells, sizes, "cell", "m", cells.count()).where("size > 1 and mixed").drop("mixed"), "regions")
        leaf = rows.where(F.col("size") <= LEAF).withColumns({"part": zero, "i": zero, "j": zero, "full": F.lit(full).cast("long")})
        found.append(stored(leaf.join(sets, "x").groupBy("cell").applyInArrow(_pair_join, "a long, b long"), "links"))
        large = rows.where(F.col("size") > LEAF)
        if not large.take(1):
            drop(rows)
            return found
        parts = F.ceil(F.col("size") / SALT).cast("long")
        wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(2), 2 * F.ceil(F.col("size") / LEAF)))
        points = large.withColumn("head", F.lit(False)).withColumn("salt", F.pmod(F.xxhash64("x"), parts))
        heads = large.where(F.pmod(F.xxhash64("x", F.lit(level)), F.col("size")) < wanted).withColumn("head", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        split = points.unionByName(heads).join(sets, "x").groupBy("cell", "salt")
        told = stored(split.applyInArrow(_voronoi(level + 1), "cell string, parent string, x long, n long, diff long, reuse long, tied long, homes long, a long, b long"), "cells")
        found.append(told.where("a is not null").select("a", "b"))
        inner = told.where("a is null")
        most = inner.groupBy("parent", "cell").agg(F.count("*").alias("m")).groupBy("parent").agg(F.max("m").alias("most"))
        whole = large.select("cell", "size").distinct().join(most, F.col("cell") == F.col("parent"), "left")
        dense = stored(whole.where(F.coalesce(F.col("most"), F.col("size")) > DENSE * F.col("size")).select("cell", F.col("size").alias("m"), F.lit(True).alias("is_dense")), "dense")
        # blocks of what is tied to the first pivot meet only blocks of what is not
        near, far = F.ceil(F.col("near") / SPLIT).cast("long"), F.ceil((F.col("size") - F.col("near")) / SPLIT).cast("long")
        own = F.when(close, F.pmod(F.xxhash64("x"), F.greatest(near, F.lit(1)))).otherwise(near + F.pmod(F.xxhash64("x"), F.greatest(far, F.lit(1))))
        others = F.sequence(F.when(close, near).otherwise(zero), near + far - 1)
        sides = F.transform(others, lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
        packed = join_classes(large, dense, "cell", "m", rows.count()).where("is_dense").withColumns({"part": own, "full": F.lit(full).cast("long")})
        paired = packed.withColumn("pair", F.explode(sides)).select("*", "pair.i", "pair.j").drop("pair").join(sets, "x")
        found.append(stored(paired.groupBy("cell", "i", "j").applyInArrow(_pair_join, "a long, b long"), "links"))
        inner = join_classes(inner, dense.withColumnRenamed("cell", "parent"), "parent", "m", told.count()).where("is_dense is null")
        cells = stored(inner.select("cell", "x", "n", "diff", "reuse", "tied", "homes"), "cells")
        drop(rows)
        level += 1


def links(points: DataFrame, spark, size: int) -> DataFrame:
    """Steps 3 to 5: links (a, b) that connect every pair of linked points, perhaps through others."""
    keys, shares = bucket_keys(spark, size)
    found = points.select("block", "body").mapInArrow(_frequency_runs(keys, shares), "key long, share long, block string, run binary, bucket int")
    found = found.repartition(len(keys), "key").groupBy("key", "share").applyInArrow(_frequencies, "block string, bucket int, totals binary")
    marks = points.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_marks(len(keys) * shares), "kind int, x long, n long, lone long, shingle long, body binary")
    marks = stored(marks, "marks")
    drop(points)
    sets = marks.where("kind = 0").select("x", "body")
    regions = marks.where("kind = 1").select("shingle", "x", (F.col("lone") / F.col("n")).alias("edge"))
    pivots = regions.groupBy("shingle").agg(F.min(F.struct("edge", "x")).alias("first"), F.count("*").alias("m")).where("m > 1").select("shingle", F.col("first.x").alias("p"), "m")
    pairs = join_classes(regions.select("shingle", "x"), pivots, "shingle", "m", marks.count()).where("x <> p").select("p", "x").distinct()
    pairs = stored(pairs, "pairs")
    spread = pairs.groupBy("p").agg(F.count("*").alias("m")).select("p", F.ceil(F.col("m") / SALT).cast("long").alias("parts"))
    # a pivot may hold a third of all pairs, so no join goes by the pivot alone
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("x", F.lit(7)), F.lit(SPREAD)))
    sizes = spread.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    salted = dealt.join(sizes, ["p", "deal"]).select("p", "x", F.pmod(F.xxhash64("x"), F.col("parts")).alias("salt"))
    salts = spread.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    heads = salts.select("p", F.col("p").alias("x"), "salt")
    work = salted.unionByName(heads).join(marks.where("kind = 0").select("x", "n", "body"), "x").select("p", "salt", "x", "n", "body")
    measured = stored(work.groupBy("p", "salt").applyInArrow(_distances, "p long, salt long, x long, n long, diff long, reuse long, link boolean"), "measured")
    direct = measured.where("link").select(F.col("p").alias("a"), F.col("x").alias("b"))
    # what may still link: the bound of step 4 against the easiest partner its region has; a point within r needs one
    # beyond it, a point beyond r may link to either
    beyond = lambda c: F.when(~F.col("link"), F.col(c))
    easiest = [f(k(c)).alias(name + end) for k, end in ((beyond, "_far"), (F.col, "_any")) for f, c, name in ((F.min, "diff", "least"), (F.max, "n", "largest"), (F.max, "reuse", "most"))]
    bounds = measured.groupBy("p").agg(*easiest).where("least_far is not null")
    may = "least(reuse, most{0}) * 14 >= (diff + least{0}) * 7 - (n + largest{0})"
    rest = measured.join(bounds.join(salts, "p"), ["p", "salt"]).where(f"if(link, {may.format('_far')}, {may.format('_any')})")
    tied = F.when(F.col("link"), F.col("p")).otherwise(F.col("x")).alias("tied")
    cells = stored(rest.select(F.col("p").cast("string").alias("cell"), "x", "n", "diff", "reuse", tied, F.lit(1).cast("long").alias("homes")), "cells")
    out = direct
    for table in _region_links(cells, sets):
        out = out.unionByName(table)
    out = stored(out, "links")
    for table in (pairs, measured, marks):
        drop(table)
    return out


def classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    docs(doc_id, text, ...): a word is a run of characters other than space and \\x09-\\x0d, A-Z lower-cased; a
    document's set holds its distinct runs of ``width`` words, or its whole sequence if it has fewer.  Documents link at
    Jaccard similarity 0.75 or more, and component_id is the smallest doc_id reachable by links.  Null and empty texts
    have no shingle and link with nothing; a null doc_id's row links with nothing and keeps a null component; repeated
    rows give a row each, and rows of one doc_id are one node.  Words and texts of any length are taken whole; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profiles = stored(_profiles(docs, width), "profiles")
    known = profiles.where("doc_id is not null and n_shingles > 0")
    firsts = known.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("m"))
    full = docs.where("doc_id is not null and text is not null")
    some = stored(candidates(full, width), "candidates")
    # sets of one or two shingles link with their equals only
    reps = firsts.where("n > 2").join(some, firsts["first"] == some["doc_id"], "left_semi").select(F.col("first").alias("doc_id"), "set_key")
    points = stored(_point_blocks(docs.join(reps, "doc_id"), width), "points", "uncompressed")
    labels = components(links(points, spark, text_bytes(full)))
    classed = firsts.join(labels, firsts["first"] == labels["node"], "left").select("set_key", F.coalesce("component", "first").alias("component"), "m")
    keyed = profiles.withColumn("set_key", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")))
    joined = join_classes(keyed, classed, "set_key", "m", profiles.count())
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
