"""Operator 7, n-gram Jaccard join in metric space.

Documents are sets of word shingles; 1 - Jaccard is a metric. Two documents link when their similarity reaches the
threshold (a fraction, compared in whole numbers), and the join gives the classes that links form.

1. Equal sets are one point; rows of one doc_id with different sets are points of their own, joined in the end.
2. How many points have a shingle is counted over all points (hashes packed by range; see substring_dedup). A point
   fewer of whose shingles than the threshold asks for occur elsewhere is at more than the radius from all others.
3. Most points are at distance 1 from most others, so the first pivots are chosen near the points: of the points that
   share one of their rarest shingles, as many as two linked points must have in common one of, the first by hash is
   the pivot. Every two linked points so meet in the region of at least one pivot. The region that a point shares most
   of them with comes first; the others only where that left several classes.
4. A region of up to REGION points is compared by one task: distances to its pivots bound those between points
   (triangle inequality), pairs outside the window, of too different sizes, or joined already are spared, the others
   are compared exactly.
5. A larger region becomes Voronoi cells of new pivots, drawn from its points that no earlier pivot has within the
   radius: a point goes to its nearest pivot, and near a boundary to all pivots that aren't farther by more than twice
   the radius, so that every linked pair meets in the cell of one of them. A cell all of whose points are within the
   radius of its pivot is joined already; the others are regions again, recursively. Where cells don't get smaller
   (points all equally far from each other), the region is dealt by hash into blocks, and points not joined to its
   pivot go to all of them; so a task's size is bounded at any rate and no link is lost.
6. Links (a forest for each region) are joined to components.

Cases: null and empty texts, and those without words, have no shingles and link with nothing; fewer words than a
shingle are one shingle of the whole sequence; copies link; rows that share a doc_id are one vertex; a null doc_id
has a null component and links with nothing; an empty table gives an empty result; other columns aren't carried. A
task holds a chunk whole, and a single text; rows equal in both doc_id and text are of one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import grain, join_hot, staged, text_bytes
from .substring_dedup import _edges, _ranged, _table
from .words import U64, buffers, mix, scan

#: Points of a region, or of a block of it, that one task compares.
REGION = 2000

#: Pivots of a region whose distances to all its points are kept as bounds.
BOUNDS = 4

#: New pivots of a larger region, times that it is cut into cells, and how much its cells may hold together, copies
#: at the boundaries included, for that to be worth while.
SEEDS, DEPTH, SPREAD = 16, 4, 4

SIGNATURE = "doc_id long, chunk long, n long, s1 long, s2 long"
SENT = "part int, chunk long, n int, hashes binary, counts binary"
LEVELS = "chunk long, part int, levels binary"
POINTS = "id long, n long, prefix array<long>, shingles array<long>"

_sent = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_levels = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("levels", pa.binary())])
_points = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, in order in a row, and where each row's begin (n+1)."""
    words = scan(column, lower=True)
    counts = np.diff(words.first)
    rows, hashes = [], []
    for length in sorted({min(size, n) for n in np.unique(counts).tolist() if n}):
        at, h = words.windows(length)
        own = np.minimum(counts[words.doc[at]], size) == length
        rows.append(words.doc[at[own]].astype(np.int32))
        hashes.append(mix(h[own] + U64(length)))
    del words
    if not rows:
        return np.zeros(0, U64), np.zeros(len(counts) + 1, np.int64)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    del rows, hashes
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def set_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mix(h ^ U64(0x5851F42D4C957F2D)), first), _sums(mix(h ^ U64(0x14057B7EF767814F)), first)


#: Bytes of texts whose shingles a task holds at once in the first pass.
GROUP_BYTES = 2 << 20


def _sign(batches, size: int):
    for batch in batches:
        column, at = batch.column("text"), 0
        _, offsets = buffers(column)
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, side="right")) - 1)
            h, first = shingles(column.slice(at, stop - at), size)
            s1, s2 = set_hashes(h, first)
            yield pa.record_batch([batch.column("doc_id")[at:stop], batch.column("chunk")[at:stop], pa.array(np.diff(first)), pa.array(s1), pa.array(s2)], names=["doc_id", "chunk", "n", "s1", "s2"])
            at = stop


def _chosen(docs: pa.Table, keys: pa.Table, size: int):
    """The chunk's points: their ids, and their shingles laid end to end."""
    h, first = shingles(docs["text"], size)
    s1, s2 = set_hashes(h, first)
    wanted = dict(zip(zip(*(keys[c].to_pylist() for c in ("doc_id", "s1", "s2"))), keys["id"].to_pylist()))
    take, ids = [], []
    for i, key in enumerate(zip(docs["doc_id"].to_pylist(), s1.tolist(), s2.tolist())):
        if key in wanted:
            ids.append(wanted.pop(key))
            take.append(i)
    take = np.array(take, np.int64)
    sizes = (first[1:] - first[:-1])[take]
    stop = np.cumsum(sizes)
    return ids, h[np.repeat(first[:-1][take] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)], np.append(0, stop)


def _send(docs: pa.Table, keys: pa.Table, size: int, parts: int) -> pa.Table:
    if not docs.num_rows or not keys.num_rows:
        return _sent.empty_table()
    _, h, _ = _chosen(docs, keys, size)
    ranged, counts = np.unique(_ranged(h, parts), return_counts=True)
    low, counts, e = ranged.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16), _edges(ranged, parts)
    chunk = docs["chunk"][0].as_py()
    return _table([(p, chunk, e[p + 1] - e[p], low[e[p] : e[p + 1]].tobytes(), counts[e[p] : e[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(e)).tolist()], _sent)


def _count(batches):
    """For one hash range: the binary logarithm, rounded up, of the points that have each shingle; 0: one point."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    if not rows:
        return
    _, inverse = np.unique(np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([np.frombuffer(r[4], np.uint16) for r in rows]))
    level = np.ceil(np.log2(total)).astype(np.uint8)[inverse]
    ends = np.cumsum([r[2] for r in rows]).tolist()
    yield from _table([(r[1], r[0], level[e - r[2] : e].tobytes()) for r, e in zip(rows, ends)], _levels).to_batches()


def _place(docs: pa.Table, keys: pa.Table, size: int, parts: int, least: tuple[int, int]) -> pa.Table:
    """The points that may have a link, with their rarest shingles and all that others have too."""
    chosen, levels = keys.filter(pa.compute.is_null(keys["part"])), keys.filter(pa.compute.is_valid(keys["part"]))
    if not docs.num_rows or not chosen.num_rows:
        return _points.empty_table()
    ids, h, first = _chosen(docs, chosen, size)
    level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for _, x in sorted(zip(levels["part"].to_pylist(), levels["levels"].to_pylist())))])
    level = level[np.unique(_ranged(h, parts), return_inverse=True)[1]] if len(h) else level
    rows, signed = [], h.view(np.int64)
    for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()):
        n, shared = b - a, level[a:b] > 0
        needed = -(-least[0] * n // least[1])
        if shared.sum() >= needed:
            order = np.lexsort((h[a:b], level[a:b]))[: n - needed + 1]
            rows.append((i, n, signed[a:b][order[shared[order]]], signed[a:b][shared]))
    return _table(rows, _points)


class Region:
    """Points of one region and the exact comparison of them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, flat: np.ndarray, first: np.ndarray) -> None:
        self.ids, self.n, self.first = ids, n, first
        self.code = np.unique(flat, return_inverse=True)[1]
        self.mark = np.zeros(self.code.max() + 1 if len(flat) else 1, bool)

    def common(self, p: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of point p with others."""
        own = self.code[self.first[p] : self.first[p + 1]]
        self.mark[own] = True
        sizes = self.first[others + 1] - self.first[others]
        stop = np.cumsum(sizes)
        at = np.repeat(self.first[others] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)
        total = np.concatenate([[0], np.cumsum(self.mark[self.code[at]])])
        self.mark[own] = False
        return total[stop] - total[stop - sizes]

    def link(self, least: tuple[int, int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """A forest of links, and each point's component; point 0 is the pivot."""
        a, b = least
        m, radius = len(self.ids), 1 - a / b + 1e-9
        component, waiting, bounds, out = np.arange(m), np.ones(m, bool), [], []
        for p in range(m):
            waiting[p] = False
            other = waiting & (component != component[p]) & (b * self.n >= a * self.n[p]) & (a * self.n <= b * self.n[p])
            for d in bounds:
                other &= np.abs(d - d[p]) <= radius
            if len(bounds) < BOUNDS and m > 8:
                every = self.common(p, np.arange(m))
                bounds.append(1 - every / (self.n + self.n[p] - every))
                other = np.flatnonzero(other)
                both = every[other]
            else:
                other = np.flatnonzero(other)
                both = self.common(p, other) if len(other) else other
            for q in other[b * both >= a * (self.n[other] + self.n[p] - both)].tolist():
                if component[q] != component[p]:
                    out.append((p, q))
                    component[component == component[q]] = component[p]
        return out, component


EDGES = "a long, b long, region long"
_edges_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.int64())])

CELLS = "region long, id long, seed long, far boolean"
_cells_schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("seed", pa.int64()), ("far", pa.bool_())])


def _ordered(table: pa.Table, ahead: np.ndarray) -> Region:
    """The table's points, those ahead first; a point that came twice counts once."""
    ids = table["id"].to_numpy()
    order = np.lexsort((~ahead, ids))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    order = order[np.argsort(~ahead[order], kind="stable")]
    table = table.take(pa.array(order))
    column = table["shingles"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    first = np.asarray(column.offsets).astype(np.int64)
    return Region(ids[order], table["n"].to_numpy(), np.asarray(column.values)[first[0] : first[-1]], first - first[0])


def _link(table: pa.Table, least: tuple[int, int]) -> pa.Table:
    """Links of a region or block; for a block of several, also (id, null, region) of points not joined to the pivot."""
    table = table.combine_chunks()
    region = _ordered(table, table["id"].to_numpy() == table["head"].to_numpy())
    links, component = region.link(least)
    rows = [(int(region.ids[p]), int(region.ids[q]), None) for p, q in links]
    if table["blocks"][0].as_py() > 1:
        name = table["region"][0].as_py()
        rows += [(int(i), None, name) for i in region.ids[component != component[0]].tolist()]
    return _table(rows, _edges_schema)


def _deal(table: pa.Table, least: tuple[int, int]) -> pa.Table:
    """The cells (region, id, seed, far) that a block's points go to: the nearest pivot's, and those of pivots not farther
    by more than twice the radius. far: at more than the radius from that pivot; the others are links."""
    table = table.combine_chunks()
    ahead = table["is_seed"].to_numpy(zero_copy_only=False)
    region, n_seeds = _ordered(table, ahead), len(np.unique(table["id"].to_numpy()[ahead]))
    a, b = least
    every, far, distance = np.arange(len(region.ids)), [], []
    for p in range(n_seeds):
        both = region.common(p, every)
        union = region.n + region.n[p] - both
        distance.append(1 - both / union)
        far.append(b * both < a * union)
    distance, far = np.stack(distance), np.stack(far)
    visits = distance <= distance.min(axis=0) + 2 * (1 - a / b) + 1e-9
    seed, point = np.nonzero(visits)
    name = np.full(len(seed), table["region"][0].as_py())
    return pa.table([pa.array(name), pa.array(region.ids[point]), pa.array(region.ids[seed]), pa.array(far[seed, point])], schema=_cells_schema)


def links(points: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links a, b whose components are those of all pairs that reach the threshold. points: POINTS, written.

    First every point is compared in the region of the pivot it shares most with. Shingles whose points are of one
    class by then can add no link; the regions of all others are compared with all their points.
    """
    entries = points.select("id", F.explode("prefix").alias("s"))
    pivots = entries.groupBy("s").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("p")).where("c > 1")
    pivots = staged(pivots.select("s", "c", F.col("p.id").alias("pivot")), "pivots")
    near = staged(join_hot(entries, pivots, "s", "c").select("s", "pivot", "id"), "near")
    visit = lambda df: df.select(F.col("pivot").alias("region"), F.col("pivot").alias("head"), "id").distinct().withColumn("far", F.lit(True))
    home = near.groupBy("id", "pivot").agg(F.count("*").alias("c")).groupBy("id").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot")).select("pivot", "id")
    first = staged(regions(points, visit(home.unionAll(home.select("pivot", F.col("pivot").alias("id")))), least), "links-home")
    known = components(first).withColumnRenamed("node", "id")
    class_ = F.coalesce("component", "id")
    several = near.join(known, "id", "left").groupBy("s").agg(F.min(class_).alias("a"), F.max(class_).alias("b"), F.count("*").alias("c")).where("a < b").select("s", "c")
    return first.unionAll(regions(points, visit(join_hot(near, staged(several, "several"), "s", "c")), least))


def regions(points: DataFrame, visits: DataFrame, least: tuple[int, int], depth: int = 0) -> DataFrame:
    """Links found in the regions of visits (region, head, id, far), each with its head, a pivot, among its points."""
    visits = staged(visits, "visits")
    payload = points.select("id", "n", "shingles")
    sizes = visits.groupBy("region").agg(F.count("*").alias("c"))
    large = staged(sizes.where(F.col("c") > REGION).withColumn("size", F.col("c")), "large")
    compare = lambda df: df.join(payload, "id").groupBy("region").applyInArrow(lambda t: _link(t, least), EDGES).select("a", "b")
    one = F.lit(1).alias("blocks")
    if large.isEmpty():
        return compare(visits.select("region", "head", "id", one))
    # Large regions are few: of more than REGION visits each.
    found = compare(visits.join(large.select("region"), "region", "left_anti").select("region", "head", "id", one))
    members = staged(join_hot(visits, large, "region", "c"), "members")
    out = staged(found, "links-small")
    whole = members
    if depth < DEPTH:
        cells = _cells(members, payload, least, depth)
        out = out.unionAll(cells.where("not far and id <> seed").select(F.col("id").alias("a"), F.col("seed").alias("b")))
        # Cells that still have points apart from their pivot, of regions that became smaller by them.
        apart = cells.groupBy("region", "seed").agg(F.count("*").alias("c"), F.max("far").alias("far")).where("far")
        total = apart.groupBy("region").agg(F.sum("c").alias("total"), F.max("c").alias("most"))
        worth = large.join(total, "region", "left").withColumn("worth", F.coalesce((F.col("total") <= SPREAD * F.col("size")) & (10 * F.col("most") <= 9 * F.col("size")), F.isnull("total")))
        worth = staged(worth.select("region", "worth"), "worth")
        deeper = staged(apart.join(worth.where("worth"), "region").select("region", "seed", F.xxhash64("region", "seed").alias("cell"), "c"), "cells")
        if not deeper.isEmpty():
            inner = cells.withColumn("cell", F.xxhash64("region", "seed"))
            inner = join_hot(inner, deeper.groupBy("cell").agg(F.sum("c").alias("c")), "cell", "c")
            out = out.unionAll(regions(points, inner.select(F.col("cell").alias("region"), F.col("seed").alias("head"), "id", "far"), least, depth + 1))
        rest = worth.where("not worth").join(large, "region")
        if rest.isEmpty():
            return out
        whole = staged(join_hot(visits, rest.select("region", "size", "c"), "region", "c"), "members")
    return out.unionAll(_blocks(whole, payload, least))


def _block(n):
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _cells(members: DataFrame, payload: DataFrame, least: tuple[int, int], depth: int) -> DataFrame:
    """CELLS of large regions' members, by pivots drawn from those that are far from the region's own."""
    blocks = F.ceil(F.col("size") / REGION).cast("int")
    drawn = members.where("far").groupBy("region", F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(SEEDS)).alias("draw"))
    seeds = staged(drawn.agg(F.min(F.struct(F.xxhash64("id", "region").alias("h"), "id")).alias("p"), F.first("size").alias("size")).select("region", F.col("p.id").alias("id"), "size"), "seeds")
    heads = seeds.select("region", "id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("is_seed"))
    dealt = members.select("region", "id", _block(blocks).alias("block"), F.lit(False).alias("is_seed")).unionByName(heads).join(payload, "id")
    # A pivot is in every block, and goes to its own cells once.
    return staged(dealt.groupBy("region", "block").applyInArrow(lambda t: _deal(t, least), CELLS).distinct(), "dealt")


def _blocks(members: DataFrame, payload: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links of regions in blocks by hash: first with the region's head, then points apart from it with all blocks."""
    compare = lambda df, *by: df.join(payload, "id").groupBy("region", *by).applyInArrow(lambda t: _link(t, least), EDGES)
    grid = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    members = members.withColumn("blocks", F.ceil(F.col("size") / REGION).cast("int")).withColumn("block", _block(F.col("blocks"))).select("region", "head", "id", "blocks", "block")
    large = staged(members.select("region", "head", "blocks").distinct(), "heads")
    heads = grid(large.withColumn("id", F.col("head")), "block", "blocks").select(members.columns)
    first = staged(compare(members.unionAll(heads).distinct(), "block"), "links-blocks")
    apart = first.where("region is not null").select("region", F.col("a").alias("id"))
    groups = staged(apart.groupBy("region").agg(F.ceil(F.count("*") / REGION).cast("int").alias("groups")).join(large, "region"), "groups")
    columns = ["region", "head", "id", "block", "grp"]
    few = F.broadcast(groups.select("region", "groups")) if groups.count() <= 1_000_000 else groups.select("region", "groups")
    rows = grid(members.join(few, "region"), "grp", "groups").select(columns)
    few = F.broadcast(groups) if groups.count() <= 1_000_000 else groups
    outs = grid(apart.join(few, "region").withColumn("grp", _block(F.col("groups"))), "block", "blocks").select(columns)
    tops = grid(grid(groups, "grp", "groups"), "block", "blocks").withColumn("id", F.col("head")).select(columns)
    second = compare(rows.unionAll(outs).unionAll(tops).distinct().withColumn("blocks", F.lit(1)), "block", "grp")
    return first.where("region is null").select("a", "b").unionAll(second.select("a", "b"))


def classes(docs: DataFrame, size: int = 5, least: tuple[int, int] = (75, 100), text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark = docs.sparkSession
    chunks, parts = grain(spark, text_bytes(docs, text))
    # Copies have ids of their own, so a group of them is dealt over all chunks.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64("doc_id", F.crc32(F.col(text).cast("binary"))), F.lit(chunks)).alias("chunk"))
    signed = staged(dealt.mapInArrow(lambda b: _sign(b, size), SIGNATURE), "signatures").withColumn("set", F.struct("s1", "s2", "n"))
    linked = signed.where("n > 0 and doc_id is not null")
    sets = linked.groupBy("set").agg(F.min(F.struct("doc_id", "chunk")).alias("least"), F.count("*").alias("copies"))
    # doc_ids that have several sets; such sets are points with ids by hash.
    repeated = staged(linked.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("set").alias("a"), F.max("set").alias("b")).where("a <> b").select("doc_id", "c"), "repeated")
    any_repeated = not repeated.isEmpty()
    sets = sets.select("set", "least.doc_id", "least.chunk", "copies", F.col("least.doc_id").alias("id"))
    if any_repeated:
        several = repeated.select("doc_id", F.lit(True).alias("several"), "c")
        own = F.when(F.col("several"), F.xxhash64("doc_id", "set")).otherwise(F.col("doc_id"))
        sets = sets.join(several.drop("c"), "doc_id", "left").withColumn("id", own).drop("several")
    sets = staged(sets, "sets")
    stands = sets.select("chunk", "doc_id", "set.s1", "set.s2", "id")
    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.cogroup(stands.groupBy("chunk")).applyInArrow(lambda d, k: _send(d, k, size, parts), SENT)
    levels = sent.repartitionById(parts, F.col("part")).mapInArrow(_count, LEVELS)
    keys = stands.withColumns({"part": F.lit(None).cast("int"), "levels": F.lit(None).cast("binary")}).unionByName(levels, allowMissingColumns=True)
    points = staged(by_chunk.cogroup(keys.groupBy("chunk")).applyInArrow(lambda d, k: _place(d, k, size, parts, least), POINTS), "points")
    edges = links(points, least)
    if any_repeated:
        # Rows of one doc_id with different sets are one vertex.
        shared = join_hot(linked.select("doc_id", "set"), repeated, "doc_id", "c").distinct().join(sets.select("set", "id"), "set").select("doc_id", "id")
        shared = staged(shared, "shared")
        edges = edges.unionAll(join_hot(shared, staged(shared.groupBy("doc_id").agg(F.min("id").alias("b"), F.count("*").alias("c")), "vertices"), "doc_id", "c").select(F.col("id").alias("a"), "b"))
    joined = components(edges).withColumnRenamed("node", "id")
    stood = sets.join(joined, "id", "left").select("set", "copies", "doc_id", F.coalesce("component", "id").alias("component"))
    if any_repeated:
        # The least doc_id of a class isn't its least id.
        stood = staged(stood, "stood")
        lowest = staged(stood.groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("c")), "lowest")
        stood = join_hot(stood, lowest, "component", "c").withColumn("component", F.col("lowest"))
    stood = staged(stood.select("set", "component", "copies"), "stood")
    out = join_hot(linked, stood, "set", "copies").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rest = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionAll(rest)
