"""Exact threshold pairs of unit vectors by dual traversal of cover trees (operator 3).

Distance is Euclidean on the unit sphere, where cosine >= t is distance <= eps = sqrt(2 - 2 t). A tree
has nested levels with radii 1, 1/2, 1/4 and so on: every node is a vector, its centre, with a covering
radius, and its children, which are centres more than their level's radius apart, divide its vectors.
Two trees are traversed together, a pair of nodes at a time: all pairs of their children are tested at
once, as a product of centres, and those with d(centre, centre) > radius + radius + eps hold no pair and
are pruned; what is left goes on, down to single vectors, and double precision decides.

Over the cluster the upper levels come from a bounded sample (``PIVOTS`` vectors at most): every
vector goes to its nearest pivot, neighbouring pivots are packed into blocks of about ``block_rows``
vectors (a pivot with more is split into parts), and block pairs that survive the bound are tasks. In a
task both blocks get trees of their own. Vectors of a length that the sample misses have no pivot; they
are split into parts, too, and every two parts meet.

Where vectors are so spread that no radius helps (all pairs about a right angle apart), the levels below
1 are single vectors and all blocks meet: work is then quadratic, and a vector is sent to as many tasks as
there are blocks. Blocks grow with the table up to ``block_bytes`` to keep that down.

Equal vectors are one before all that. A task returns counts and a spanning forest, one row per
vector that has a link, never the pairs.

Nulls and odd cases: vectors that are null, zero, or hold nulls or non-finite numbers link with
nothing, as do those of another length than the other's; a null id gets no component and is kept;
rows that repeat an id are one vector for links and components if they are equal, else each of them
counts as a link of the other's links and they share a component; ties at the threshold link; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, salted_join, table

PIVOTS = 1024
LEAF = 16
TILE = 1024
SURE = np.float32(1e-5)  # what single precision may lack


class Node:
    """A centre (a row), the radius that covers ``rows``, and children of at most half of it."""

    __slots__ = ("centre", "radius", "rows", "children", "centres", "radii")

    def __init__(self, centre: int, radius: float, rows: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        inside = children or [self]
        self.centres = np.array([c.centre for c in inside])
        self.radii = np.array([c.radius for c in inside], dtype=np.float32)


def divide(points: np.ndarray, rows: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
    """Centres among ``rows``, each more than ``radius`` from those before, and the rows of each."""
    centres: list[int] = []
    owner = np.full(len(rows), -1)
    near = 1 - radius * radius / 2
    for at in range(0, len(rows), TILE):
        part = np.arange(at, min(at + TILE, len(rows)))
        best, found = np.full(len(part), -2.0), np.full(len(part), -1)
        for begin in range(0, len(centres), 4 * TILE):
            cosines = points[rows[part]] @ points[centres[begin : begin + 4 * TILE]].T
            nearest = cosines.argmax(axis=1)
            value = cosines[np.arange(len(part)), nearest]
            better = value > best
            best[better], found[better] = value[better], nearest[better] + begin
        covered = best >= near
        owner[part[covered]] = found[covered]
        left = part[~covered]
        among, free = points[rows[left]] @ points[rows[left]].T >= near, np.ones(len(left), dtype=bool)
        for i in range(len(left)):
            if free[i]:
                mine = free & among[i]
                mine[i] = True
                owner[left[mine]] = len(centres)
                centres.append(int(rows[left[i]]))
                free &= ~mine
    order = np.argsort(owner, kind="stable")
    return list(zip(centres, np.split(rows[order], np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])))


def build(points: np.ndarray, rows: np.ndarray, centre: int | None = None, cover: float = 2.0) -> Node:
    """A cover tree of the unit vectors ``points[rows]``."""
    centre = int(rows[0]) if centre is None else centre
    if len(rows) == 1:
        return Node(centre, 0.0, rows, [])
    radius = float(np.sqrt(np.maximum(2 - 2 * (points[rows] @ points[centre]), 0)).max()) + 1e-6
    if len(rows) <= LEAF or radius <= 1e-3:
        return Node(centre, radius, rows, [])
    while cover > radius / 2:
        cover /= 2  # levels on which the node would be its own only child
    return Node(centre, radius, rows, [build(points, part, middle, cover) for middle, part in divide(points, rows, cover)])


class Forest:
    """Union-find over arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return self.parent
            self.parent = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            roots = self.roots()
            x, y = roots[a], roots[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def _double_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def dual_pairs(raw: np.ndarray, first: np.ndarray, second: np.ndarray | None, threshold: float, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of rows of ``first`` and ``second`` (or within ``first``, each once) with cosine >= ``threshold``.

    ``seen`` counts the node pairs that were tested and those pruned."""
    unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
    single = unit.astype(np.float32)
    eps = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6
    margin = np.float32(threshold) - SURE * max(1, raw.shape[1] // 64)
    seen = {} if seen is None else seen
    seen.update(tested=0, pruned=0)
    a = build(unit, first)
    stack = [(a, a if second is None else build(unit, second))]

    def decided(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sure = np.concatenate([_double_cosine(raw[p[k : k + 65536]], raw[q[k : k + 65536]]) >= threshold for k in range(0, len(p), 65536)])
        return p[sure], q[sure]

    while stack:
        x, y = stack.pop()
        if not x.children and not y.children:
            for i in range(0, len(x.rows), TILE):
                left = x.rows[i : i + TILE]
                for j in range(i if x is y else 0, len(y.rows), TILE):
                    right = y.rows[j : j + TILE]
                    near = single[left] @ single[right].T >= margin
                    p, q = np.nonzero(np.triu(near, 1) if x is y and i == j else near)
                    if len(p):
                        yield decided(left[p], right[q])
            continue
        kids, others = x.children or [x], y.children or [y]
        for i in range(0, len(kids), TILE):
            left, low = x.centres[i : i + TILE], x.radii[i : i + TILE]
            for j in range(i if x is y else 0, len(others), TILE):
                right, high = y.centres[j : j + TILE], y.radii[j : j + TILE]
                reach = np.minimum(low[:, None] + high[None, :] + np.float32(eps), np.float32(2)) if low.any() or high.any() else np.float32(eps)
                near = single[left] @ single[right].T >= 1 - reach * reach / 2 - SURE
                if x is y and i == j:
                    near = np.triu(near)
                p, q = np.nonzero(near)
                seen["tested"] += near.size
                seen["pruned"] += near.size - len(p)
                alone = np.fromiter((len(kids[i + k].rows) == 1 for k in p), bool, len(p)) & np.fromiter((len(others[j + k].rows) == 1 for k in q), bool, len(q))
                ends = alone & ~((x is y) & (p + i == q + j))
                if ends.any():
                    yield decided(left[p[ends]], right[q[ends]])
                stack += [(kids[i + k], others[j + m]) for k, m in zip(p[~alone].tolist(), q[~alone].tolist())]


def linked(raw: np.ndarray, copies: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many vectors it is linked with (``copies`` each), and the root of its class here."""
    counts, forest = np.zeros(len(raw), dtype=np.int64), Forest(len(raw))
    every = np.arange(len(raw))
    first, second = (every, None) if side is None else (every[side], every[~side])
    if len(first) and (second is None or len(second)):
        for p, q in dual_pairs(raw, first, second, threshold):
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            forest.join(p, q)
    return counts, forest.roots()


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    found: list[np.ndarray | None] = []
    for value in column.to_pylist():
        vector = None
        if value and None not in value:
            vector = np.array(value, dtype=np.float64)
            scale = np.abs(vector).max()
            vector = vector / scale if np.isfinite(scale) and scale > 0 and np.isfinite(vector).all() else None
        found.append(vector)
    return found


def prepared(vectors: DataFrame) -> DataFrame:
    """``(id, same, raw)``: a digest of the numbers and the numbers as doubles (scaled by the largest); null if they cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("raw", pa.binary())])
        for batch in batches:
            found = [None if v is None else (v + 0.0).tobytes() for v in _vectors(batch.column("vector"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in found], pa.binary()), pa.array(found, pa.binary())], schema=schema)

    return vectors.mapInArrow(run, "id long, same binary, raw binary")


def pivot_net(sample: list[bytes], cover: float = 0.5) -> dict[int, np.ndarray]:
    """Centres by vector length, in the order of nested levels: radius 1 first, then those that radius ``cover`` adds."""
    by_length: dict[int, list[np.ndarray]] = defaultdict(list)
    for raw in sample:
        vector = np.frombuffer(raw)
        by_length[len(vector)].append(vector / np.linalg.norm(vector))
    net = {}
    for length, found in by_length.items():
        points = np.array(found)
        chosen: list[int] = []
        radius = 1.0
        while radius >= cover:
            for i in range(len(points)):
                if not chosen or (2 - 2 * (points[chosen] @ points[i])).min() > radius * radius:
                    chosen.append(i)
            radius /= 2
        net[length] = points[chosen]
    return net


def _plan(net: dict[int, np.ndarray], stats: dict[tuple[int, int], tuple[int, float]], eps: float, block_rows: int) -> tuple[dict, dict]:
    """Packs pivots into blocks along a walk from neighbour to neighbour; returns block parts by (length, pivot), and
    for each part the parts it must meet. Pivot -1 of a length stands for vectors without one, a block that only meets itself."""
    place: dict[tuple[int, int], tuple[int, int]] = {}
    blocks: list[tuple[int, np.ndarray | None, float, int]] = []  # length, centre, radius, parts
    parts_of = lambda rows: max(1, -(-rows // block_rows))
    for (length, pivot), (n, _) in stats.items():
        if pivot < 0:
            place[length, pivot] = (len(blocks), parts_of(n))
            blocks.append((length, None, 0.0, parts_of(n)))
    for length, points in net.items():
        left = [i for i in range(len(points)) if (length, i) in stats]
        while left:
            near = np.argsort(-(points[left] @ points[left[0]]), kind="stable")
            order = [left[i] for i in near]
            members, rows, centre, radius = [], 0, points[order[0]], 0.0
            for i in order:
                n, r = stats[length, i]
                if members and rows + n > block_rows:
                    break
                members.append(i)
                rows += n
                radius = max(radius, r + float(np.sqrt(max(2 - 2 * float(centre @ points[i]), 0))))
            for i in members:
                place[length, i] = (len(blocks), parts_of(rows))
            blocks.append((length, centre, radius + 1e-6, parts_of(rows)))
            left = [i for i in left if i not in set(members)]

    def meet(x: int, y: int) -> bool:
        (length, a, p, _), (other, b, q, _) = blocks[x], blocks[y]
        if x == y or length != other or a is None or b is None:
            return x == y
        return float(np.sqrt(max(2 - 2 * float(a @ b), 0))) <= p + q + eps

    meets = {x: [y for y in range(x, len(blocks)) if meet(x, y)] for x in range(len(blocks))}
    return place, {x: [(y, blocks[y][3]) for y in ys] for x, ys in meets.items()}


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block_rows: int = 6000, block_bytes: int = 16 << 20) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per vector.

    Blocks hold ``block_rows`` vectors, and of larger tables a twelfth of them as long as that is ``block_bytes``."""
    context = vectors.sparkSession.sparkContext
    rows = cut(prepared(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))), "vectors")
    usable = rows.where("id is not null and raw is not null")
    reps = cut(usable.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "reps")
    net = pivot_net([r["raw"] for r in reps.orderBy("same").limit(PIVOTS).select("raw").collect()])  # PIVOTS rows at most
    shared = context.broadcast(net)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("raw", pa.binary()), ("length", pa.int32()), ("pivot", pa.int32()), ("distance", pa.float64())])
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            lengths, pivots, distances = [len(r) // 8 for r in raws], [-1] * len(raws), [2.0] * len(raws)
            for length in set(lengths) & set(shared.value):
                at = [i for i, n in enumerate(lengths) if n == length]
                for k in range(0, len(at), 4096):
                    some = at[k : k + 4096]
                    points = np.array([np.frombuffer(raws[i]) for i in some])
                    cosines = (points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]) @ shared.value[length].T
                    best = cosines.argmax(axis=1)
                    for i, p, c in zip(some, best, cosines[np.arange(len(some)), best]):
                        pivots[i], distances[i] = int(p), float(np.sqrt(max(2 - 2 * c, 0)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("raw"), *(pa.array(v, f.type) for v, f in zip((lengths, pivots, distances), list(schema)[3:]))], schema=schema)

    assigned = cut(reps.select("rep", "copies", "raw").mapInArrow(assign, "rep long, copies long, raw binary, length int, pivot int, distance double"), "assigned")
    stats = assigned.groupBy("length", "pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # a row per pivot, or per length without one
    most = max((8 * r["length"] for r in stats), default=8)
    block_rows = max(block_rows, min(sum(r["n"] for r in stats) // 12, block_bytes // most))
    eps = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6
    place, meets = _plan(net, {(r["length"], r["pivot"]): (r["n"], r["radius"]) for r in stats}, eps, block_rows)
    plan = context.broadcast((place, meets, {y: [x for x in meets if any(y == b for b, _ in meets[x]) and x != y] for y in meets}, {b: p for b, p in place.values()}))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector to each pair of block parts it takes part in."""
        schema = pa.schema([("task", pa.string()), ("side", pa.bool_()), ("rep", pa.int64()), ("copies", pa.int64()), ("raw", pa.binary())])
        place, meets, met_by, parts = plan.value
        for batch in batches:
            out: list[tuple] = []
            for rep, copies, raw, length, pivot in zip(*(batch.column(c).to_pylist() for c in ("rep", "copies", "raw", "length", "pivot"))):
                block, n = place[length, pivot]
                own = xxhash.xxh64_intdigest(str(rep)) % n
                out.append((f"{block}.{own}", None, rep, copies, raw))
                out += [(f"{block}.{min(own, q)}-{block}.{max(own, q)}", own < q, rep, copies, raw) for q in range(n) if q != own]
                out += [(f"{block}.{own}-{y}.{q}", True, rep, copies, raw) for y, m in meets[block] if y != block for q in range(m)]
                out += [(f"{x}.{q}-{block}.{own}", False, rep, copies, raw) for x in met_by[block] for q in range(parts[x])]
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def compare(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group.column("raw").to_pylist()), dtype=np.float64).reshape(group.num_rows, -1)
        order = np.argsort(group.column("rep").to_numpy(), kind="stable")
        ids, copies = group.column("rep").to_numpy()[order], group.column("copies").to_numpy()[order]
        side = group.column("side")
        side = None if side.null_count else np.array(side.to_pylist(), dtype=bool)[order]
        counts, roots = linked(raw[order], copies, side, threshold)
        at = np.flatnonzero(counts)
        return pa.table({"rep": ids[at], "n": counts[at], "root": ids[roots[at]]})

    found = cut(assigned.mapInArrow(send, "task string, side boolean, rep long, copies long, raw binary").groupBy("task").applyInArrow(compare, "rep long, n long, root long"), "found")
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of_rep = reps.select("same", "rep", "copies").join(counts, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    joined = salted_join(rows.select("id", "same"), cut(of_rep, "classes"), "same", F.monotonically_increasing_id(), "left")
    usable_row = F.col("id").isNotNull() & F.col("rep").isNotNull()
    links = F.when(usable_row, F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0)
    component = F.when(usable_row, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias("vec_id"), links.cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN lowest USING (vec_id) LEFT JOIN counted USING (vec_id)
"""
