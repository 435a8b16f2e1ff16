"""Embedding near-dedup with a robust-pruned flat graph.

1. Equal vectors become one class with a count, so copies cost nothing later.
2. Centroids of a bounded sample cut the classes into clusters; a vector joins
   every cluster whose centroid is almost as near as its nearest one, so
   clusters overlap.  How near is almost is measured: a sample is compared with
   all vectors, and the margin grows until every link of the sample has a
   cluster in common.  A cluster above a size limit is cut into shards by hash:
   a vector is stored in one shard and asks all shards of its clusters.
3. In each shard every vector gets neighbours: near candidates and a few random
   ones, thinned by robust pruning, plus reverse edges.  The adjacency lists of
   a vector's shards are united.
4. Each vector searches from an entry in every connected part of the shard's
   graph, a few random ones and its own place, if it has one there, by
   best-first search with a beam, then expands every vector found in range until
   nothing new is in range.  A shard audits its recall against brute force for a
   sample of its own vectors and one of vectors stored elsewhere, and doubles the
   beam until both recalls are high enough; where the widest beam does not reach
   that, or the graph falls into very many parts, the shard is scanned in full.
5. The links found for that sample are compared with its true ones over all
   clusters.  Below the recall bound clusters overlap more and are searched
   again; if that does not help, or where a vector would be sent to more shards
   than there are clusters or blocks, all classes are compared block by block,
   which is exact.
6. What is found is verified in double precision.  A pair that meets in several
   clusters counts in the first they share.  Only counts and the edges of local
   spanning trees leave a task, so a dense group sends no pairs.

Cases: vectors that are null, zero, or hold null or non-finite components have
no links and are their own component; vectors of other dimension than the first
by vec_id's hash order link with nothing either; rows that share a vec_id
are each a node of its own vector, and those with equal vectors one another's
copies; a row without vec_id comes back alone (no
links, null component, kept) and counts for no other; an empty table gives no
rows; other columns are ignored.

Bounds: 1,024 clusters at most, so beyond some 1.2 million classes clusters grow
with the table and are cut into more shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.storage import drop_staged, small_batches, staged

THRESHOLD = 0.95
SAMPLE = 8192
CLUSTER = 1200
MAX_CLUSTERS = 1024
SHARD = 4000
MARGIN = 0.08
DEGREE, CANDIDATES, RANDOM = 16, 48, 8
ALPHA = 1.2
BEAM, MAX_BEAM = 16, 256
# Vectors that a search opens at once.
OPEN = 4
# How often clusters may overlap more before all classes are compared.
WIDER = 2
RECALL = 0.995
AUDIT = 64
# Vectors compared with all others, and vectors in a block of a full scan.
TRUTH = 1024
SCAN = 16_000
MEDOIDS = 8
_BLOCK = 256
# Entries above which a shard is scanned: this many, and this share of it.
_PARTS, _PARTS_OF = 64, 16


def _unit(column) -> list[bytes | None]:
    """Each vector scaled to length 1 as float64 bytes; None where it links with nothing."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        if not v or any(x is None for x in v):
            out.append(None)
            continue
        a = np.array(v, dtype=np.float64)
        top = np.abs(a).max()
        if not np.isfinite(a).all() or top == 0:
            out.append(None)
            continue
        a = a / top
        out.append((a / np.linalg.norm(a)).tobytes())
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_unit(batch.column("embedding")), pa.binary())], ["vec_id", "unit"])


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), -1)


def _k_means(v: np.ndarray, k: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    return centre


def _homes(centre: np.ndarray, margin: float):
    """The clusters of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = _matrix(batch.column("unit").to_pylist()) @ centre.T
            use = sim >= sim.max(axis=1, keepdims=True) - margin
            homes = [np.flatnonzero(u).tolist() for u in use]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.list_(pa.int32()))], [*batch.schema.names, "homes"])
    return run


def _truth(ids: np.ndarray, sample: np.ndarray, centre: np.ndarray, threshold: float):
    """Of each sampled vector: its links to a batch, and the least margin that gives each of them a common cluster."""

    def gap(v: np.ndarray) -> np.ndarray:
        sim = v @ centre.T
        return sim.max(axis=1, keepdims=True) - sim

    gaps = gap(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member, copies = batch.column("cid").to_numpy(), batch.column("copies").to_numpy()
            if not len(member):
                continue
            links, margin = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
            units = _matrix(batch.column("unit").to_pylist())
            for a in range(0, len(member), _BLOCK):
                v = units[a : a + _BLOCK]
                hit = (sample @ v.T >= threshold) & (ids[:, None] != member[a : a + _BLOCK])
                links += hit @ copies[a : a + _BLOCK]
                who, what = np.nonzero(hit)
                other = gap(v) if len(who) else None
                for b in range(0, len(who), 2000):
                    x, y = who[b : b + 2000], what[b : b + 2000]
                    np.maximum.at(margin, x, np.maximum(gaps[x], other[y]).min(axis=1))
            use = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use]), pa.array(margin[use])], ["cid", "links", "margin"])
    return run


def _scan_blocks(threshold: float):
    """All links between two blocks, or inside one."""

    def run(table: pa.Table) -> pa.Table:
        ids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        v = _matrix(table.column("unit").to_pylist())
        block = table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        label = np.arange(len(ids))
        links = np.zeros(len(ids), dtype=np.int64)
        to, weight = v[right], copies[right]
        for a in range(0, len(left), _BLOCK):
            rows = left[a : a + _BLOCK]
            hit = (v[rows] @ to.T >= threshold) & (ids[rows][:, None] != ids[right])
            links[rows] += hit @ weight
            if low != high:
                links[right] += copies[rows] @ hit
            for i in np.flatnonzero(hit.any(axis=1)):
                near = np.append(label[right[hit[i]]], label[rows[i]])
                if (near != near[0]).any():
                    label[np.isin(label, near)] = near.min()
        use = (links > 0) | (label != np.arange(len(ids)))
        return pa.table({"cid": ids[use], "links": links[use], "root": ids[label[use]], "audited": np.zeros(use.sum(), np.int64), "recalled": np.zeros(use.sum(), np.int64)})
    return run


def _scan(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    blocks = max(1, -(-n // SCAN))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")))
    rows = classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")).withColumn("pair", F.explode(pairs))
    return rows.select("cid", "copies", "unit", "block", "pair.low", "pair.high").groupBy("low", "high").applyInArrow(_scan_blocks(threshold), _FOUND)


def prune(v: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: of each node's candidates the nearest, then the next that no chosen one is much nearer to.

    Returns neighbour indices, -1 where fewer than degree remain.
    """
    sim = np.einsum("bd,bcd->bc", v[node], v[candidates])
    sim[candidates == node[:, None]] = -np.inf
    order = np.argsort(-sim, axis=1, kind="stable")
    candidates, sim = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sim, order, axis=1)
    # A candidate listed twice is taken once.
    by_id = np.argsort(candidates, axis=1, kind="stable")
    again = np.zeros(candidates.shape, dtype=bool)
    ids = np.take_along_axis(candidates, by_id, axis=1)
    np.put_along_axis(again, by_id[:, 1:], ids[:, 1:] == ids[:, :-1], axis=1)
    near = v[candidates]
    far = 2 - 2 * sim
    alive = np.isfinite(sim) & ~again
    out = np.full((len(node), degree), -1, dtype=np.int64)
    rows = np.arange(len(node))
    for r in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, r] = candidates[rows, pick][some]
        to_pick = 2 - 2 * np.einsum("bcd,bd->bc", near, near[rows, pick])
        alive &= ~(some[:, None] & (alpha * to_pick <= far))
        alive[rows, pick] = False
    return out


def build(v: np.ndarray, seed: int = 13) -> list[np.ndarray]:
    """Adjacency lists of one shard."""
    n = len(v)
    rng = np.random.default_rng(seed)
    near = min(CANDIDATES, n)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    for a in range(0, n, _BLOCK):
        node = np.arange(a, min(n, a + _BLOCK))
        sim = v[node] @ v.T
        top = np.argpartition(-sim, near - 1, axis=1)[:, :near] if near < n else np.broadcast_to(np.arange(n), (len(node), n))
        out[node] = prune(v, node, np.concatenate([top, rng.integers(0, n, (len(node), RANDOM))], axis=1))
    source, target = np.repeat(np.arange(n), DEGREE), out.ravel()
    real = target >= 0
    both = np.unique(np.concatenate([source[real] * n + target[real], target[real] * n + source[real]]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    width = max([1, *map(len, lists)])
    out = np.full((len(lists), width), -1, dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def search(queries: np.ndarray, own: np.ndarray, v: np.ndarray, graph: np.ndarray, entries: np.ndarray, beam: int, least: float) -> np.ndarray:
    """Boolean (query, vector) matrix of vectors found with similarity >= least.

    own: each query's own place in v or -1.  Best-first with a beam, then
    expansion of everything in range.
    """
    n, q = len(v), len(queries)
    seen = np.zeros((q, n), dtype=bool)
    opened = np.zeros((q, n), dtype=bool)
    found = np.zeros((q, n), dtype=bool)
    rows = np.arange(q)
    beam_ids = np.full((q, beam), -1, dtype=np.int64)
    beam_sim = np.full((q, beam), -np.inf, dtype=v.dtype)

    def visit(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs not seen before, with similarities; marks them."""
        code = np.unique(who * n + what)
        who, what = code // n, code % n
        new = ~seen[who, what]
        who, what = who[new], what[new]
        seen[who, what] = True
        sim = np.einsum("nd,nd->n", queries[who], v[what])
        hit = sim >= least
        found[who[hit], what[hit]] = True
        return who, what, sim

    def push(who: np.ndarray, what: np.ndarray, sim: np.ndarray) -> None:
        if not len(who):
            return
        count = np.bincount(who, minlength=q)
        width = int(count.max())
        slot = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        ids = np.full((q, width), -1, dtype=np.int64)
        s = np.full((q, width), -np.inf, dtype=v.dtype)
        ids[who, slot], s[who, slot] = what, sim
        ids, s = np.concatenate([beam_ids, ids], axis=1), np.concatenate([beam_sim, s], axis=1)
        keep = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
        beam_ids[:], beam_sim[:] = np.take_along_axis(ids, keep, axis=1), np.take_along_axis(s, keep, axis=1)

    has = np.flatnonzero(own >= 0)
    push(*visit(np.concatenate([np.repeat(rows, len(entries)), has]), np.concatenate([np.tile(entries, q), own[has]])))
    many = min(OPEN, beam)
    while True:
        closed = (beam_ids < 0) | opened[rows[:, None], np.maximum(beam_ids, 0)]
        s = np.where(closed, -np.inf, beam_sim)
        pick = np.argpartition(-s, many - 1, axis=1)[:, :many]
        act, slot = np.nonzero(np.isfinite(np.take_along_axis(s, pick, axis=1)))
        if not len(act):
            break
        at = beam_ids[act, pick[act, slot]]
        opened[act, at] = True
        near = graph[at]
        real = near >= 0
        push(*visit(np.repeat(act, real.sum(axis=1)), near[real]))
    while True:
        who, what = np.nonzero(found & ~opened)
        if not len(who):
            return found
        opened[who, what] = True
        for a in range(0, len(who), 50_000):
            near = graph[what[a : a + 50_000]]
            real = near >= 0
            visit(np.repeat(who[a : a + 50_000], real.sum(axis=1)), near[real])


def parts(graph: np.ndarray) -> np.ndarray:
    """Each vector's connected part, named by its least member; padded symmetric lists."""
    label = np.arange(len(graph))
    near = np.where(graph >= 0, graph, label[:, None])
    while True:
        least = np.minimum(label, label[near].min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _entries(v: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The medoid of every connected part, and random places."""
    _, part = np.unique(parts(graph), return_inverse=True)
    mean = np.zeros((part.max() + 1, v.shape[1]), dtype=v.dtype)
    np.add.at(mean, part, v)
    order = np.lexsort((-np.einsum("nd,nd->n", v, mean[part]), part))
    medoid = order[np.unique(part[order], return_index=True)[1]]
    return np.unique(np.concatenate([medoid, rng.integers(0, len(v), min(MEDOIDS, len(v)) - 1)]))


def choose_beam(v: np.ndarray, graph: np.ndarray, entries: np.ndarray, foreign: np.ndarray, least: float, rng: np.random.Generator) -> tuple[int, int, int]:
    """(beam, links in the samples, links found); beam 0 where the shard must be scanned.

    foreign: vectors stored elsewhere that ask this shard.
    """
    own = rng.choice(len(v), min(AUDIT, len(v)), replace=False)
    away = foreign[rng.choice(len(foreign), min(AUDIT, len(foreign)), replace=False)] if len(foreign) else foreign
    audits = [(x, at, x @ v.T >= least) for x, at in ((v[own], own), (away, np.full(len(away), -1))) if len(x)]
    links = sum(int(truth.sum()) for _, _, truth in audits)
    if len(entries) > max(_PARTS, len(v) // _PARTS_OF):
        return 0, links, links
    beam = BEAM
    while beam <= MAX_BEAM:
        got = [int((search(x, at, v, graph, entries, beam, least) & truth).sum()) for x, at, truth in audits]
        if all(g >= RECALL * truth.sum() for g, (_, _, truth) in zip(got, audits)):
            return beam, links, sum(got)
        beam *= 2
    return 0, links, links


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.filter(table.column("stored"))
    ids = table.column("cid").to_numpy()
    if not len(ids):
        return pa.table({"cid": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64()))})
    lists = build(_matrix(table.column("unit").to_pylist()).astype(np.float32))
    return pa.table({"cid": pa.array(ids), "near": pa.array([ids[x] for x in lists], pa.list_(pa.int64()))})


_FOUND = "cid long, links long, root long, audited long, recalled long"


def _search_shard(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        stored = table.column("stored").to_numpy()
        ids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        exact = _matrix(table.column("unit").to_pylist())
        cluster = int(table.column("cluster")[0].as_py())
        homes = table.column("homes").to_pylist()
        inside = np.flatnonzero(stored)
        empty = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in _FOUND.split(", ")})
        if not len(inside):
            return empty
        v64 = exact[inside]
        v = v64.astype(np.float32)
        member, weight = ids[inside], copies[inside]
        order = np.argsort(member)
        near = table.column("near").to_pylist()
        lists = []
        for i in inside.tolist():
            want = np.array(near[i] or [], dtype=np.int64)
            at = order[np.minimum(np.searchsorted(member[order], want), len(order) - 1)] if len(want) else want
            lists.append(at[member[at] == want])
        graph = _padded(lists)
        rng = np.random.default_rng(len(member))
        entries = _entries(v, graph, rng)
        # The earliest cluster that two vectors share counts their link.
        flat = np.concatenate([np.array(h, dtype=np.int64) for h in homes])
        at = np.repeat(np.arange(len(ids)), [len(h) for h in homes])
        at, flat = at[flat < cluster], flat[flat < cluster]
        earlier = np.zeros((len(ids), cluster // 64 + 1), dtype=np.uint64)
        np.bitwise_or.at(earlier, (at, flat >> 6), np.uint64(1) << (flat & 63).astype(np.uint64))
        own_place = np.full(len(ids), -1, dtype=np.int64)
        own_place[inside] = np.arange(len(inside))
        # Single precision may lose what is just in range.
        least = threshold - 1e-4
        outside = np.flatnonzero(~stored)
        away = outside[rng.choice(len(outside), min(AUDIT, len(outside)), replace=False)]
        beam, truth, recalled = choose_beam(v, graph, entries, exact[away].astype(np.float32), least, rng)

        def look(rows: np.ndarray) -> np.ndarray:
            queries = exact[rows].astype(np.float32)
            return search(queries, own_place[rows], v, graph, entries, beam, least) if beam else queries @ v.T >= least

        links = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids) + len(inside))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        # Stored vectors first and together, so that a link found from one side counts for both.
        groups = [inside, *[outside[a : a + SHARD] for a in range(0, len(outside), SHARD)]]
        for rows in groups:
            if not len(rows):
                continue
            hit = np.concatenate([look(rows[a : a + _BLOCK]) for a in range(0, len(rows), _BLOCK)])
            if rows is inside:
                hit |= hit.T
                np.fill_diagonal(hit, False)
            who, what = np.nonzero(hit)
            for a in range(0, len(who), 200_000):
                x, y = rows[who[a : a + 200_000]], what[a : a + 200_000]
                ok = (np.einsum("nd,nd->n", exact[x], v64[y]) >= threshold) & (ids[x] != member[y])
                x, y = x[ok], y[ok]
                here = ~(earlier[x] & earlier[inside[y]]).any(axis=1)
                np.add.at(links, x[here], weight[y[here]])
                # Only links between different local trees change anything.
                while (root[root] != root).any():
                    root = root[root]
                p, t = root[x], root[inside[y]]
                apart = p != t
                for p, t in set(zip(p[apart].tolist(), t[apart].tolist())):
                    p, t = find(p), find(t)
                    if p != t:
                        root[max(p, t)] = min(p, t)
        roots = np.array([find(i) for i in range(len(ids))])
        use = (links > 0) | (roots != np.arange(len(ids)))
        audited = np.zeros(len(ids), dtype=np.int64)
        recall = np.zeros(len(ids), dtype=np.int64)
        audited[0], recall[0] = truth, recalled
        use[0] = True
        return pa.table({"cid": ids[use], "links": links[use], "root": ids[roots[use]], "audited": audited[use], "recalled": recall[use]})
    return run


def _searched(placed: DataFrame, held: list, threshold: float) -> DataFrame:
    """Links found in the shards of all clusters; held: (cluster, held) rows."""
    sizes = placed.sparkSession.createDataFrame([(r.cluster, -(-r.held // SHARD)) for r in held], "cluster int, shards int")
    each = placed.select("*", F.explode("homes").alias("cluster")).join(F.broadcast(sizes), "cluster")
    own = F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")
    asked = each.withColumn("own", own).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asked = asked.select("cluster", "shard", "cid", "copies", "unit", "homes", (F.col("shard") == F.col("own")).alias("stored"))
    graph = asked.filter("stored").groupBy("cluster", "shard").applyInArrow(_build_shard, "cid long, near array<long>")
    union = graph.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return asked.join(union, "cid", "left").groupBy("cluster", "shard").applyInArrow(_search_shard(threshold), _FOUND)


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 17) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept), recall measured over all vectors).

    vectors: vec_id, embedding (array of numbers).
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = staged(rows.mapInArrow(_units, "vec_id long, unit binary"), "units")
    rows = rows.withColumn("unit", F.when(F.col("vec_id").isNotNull(), F.col("unit")))
    valid = rows.filter("unit is not null")
    sample = valid.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("unit").toArrow().column("unit").to_pylist()
    if not sample:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        return alone, 1.0
    width = len(sample[0])
    merged = valid.filter(F.length("unit") == width).groupBy("unit").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    turn = 0
    while True:
        # A class is named by a hash of its vector; should two share one, the next hash is taken.
        classes = staged(merged.withColumn("cid", F.xxhash64("unit", F.lit(turn))), "classes")
        if not classes.groupBy("cid").count().filter("count > 1").limit(1).count():
            break
        drop_staged(classes)
        turn += 1
    n = classes.count()
    centre = _k_means(_matrix([s for s in sample if len(s) == width]), min(MAX_CLUSTERS, -(-n // CLUSTER)))
    probe = classes.orderBy(F.xxhash64("cid", F.lit(seed)), "cid").limit(TRUTH).select("cid", "unit").toArrow()
    ids = probe.column("cid").to_numpy()
    truth = classes.mapInArrow(_truth(ids, _matrix(probe.column("unit").to_pylist()), centre, threshold), "cid long, links long, margin double")
    # At most TRUTH rows.
    truth = truth.groupBy("cid").agg(F.sum("links").alias("links"), F.max("margin").alias("margin")).toPandas()
    margin = max([MARGIN, *(truth.margin + 1e-9)])
    found, recall = None, 0.0
    for _ in range(1 + WIDER):
        placed = staged(classes.select("unit", "cid", "copies").mapInArrow(_homes(centre, margin), "unit binary, cid long, copies long, homes array<int>"), "homes")
        # At most MAX_CLUSTERS rows.
        sizes = placed.select(F.explode("homes").alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("held")).collect()
        if sum(r.held * -(-r.held // SHARD) for r in sizes) > n * max(len(centre), -(-n // SCAN)):
            drop_staged(placed)
            break
        found = staged(_searched(placed, sizes, threshold), "found")
        drop_staged(placed)
        got = found.filter(F.col("cid").isin(truth.cid.tolist())).agg(F.sum("links")).first()[0] or 0
        recall = got / truth.links.sum() if len(truth) else 1.0
        if recall >= RECALL:
            break
        drop_staged(found)
        margin *= 1.5
    if found is None or recall < RECALL:
        found, recall = staged(_scan(classes, n, threshold), "scanned"), 1.0
    edges = found.filter("root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b"))
    joined = components(edges)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    per = classes.join(links, "cid", "left").join(joined, F.col("cid") == F.col("node"), "left")
    per = per.select("unit", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("comp"))
    lowest = per.groupBy("comp").agg(F.min("least").alias("component_id"))
    per = per.join(lowest, "comp").select("unit", "n_links", "component_id")
    linked = valid.join(per, "unit").select("vec_id", "n_links", "component_id")
    rest = rows.filter(F.col("unit").isNull() | (F.length("unit") != width)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out, recall
