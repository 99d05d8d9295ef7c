"""Problem 7: the most similar vectors of every vector, by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its sample at the median of its projections on
the difference of two random members' surroundings, until few are left. Their depth grows with the
collection, so that a leaf holds about ``TARGET`` vectors at any size: below the fitted levels a
leaf is split further by random planes that its tree shares, each at the leaf's own median, and
more often where the sample shows that a leaf is dense. So what is broadcast stays small.

Every vector of the collection is indexed in its own leaf of each tree. A query searches the forest
through one priority queue shared by all trees: the best node is taken, followed to the leaf on the
query's side, and the other side of each plane on the way is put into the queue with the smallest
margin on its path, negative where the path leaves the query's own side. The searches of a batch
take their steps together. All that meet in a leaf are compared as small integers in one matrix
product, and the candidates that this leaves are ranked again with the exact vectors.

Only vectors of the regular length with finite numbers, not all zero, take part. Equal vectors
under several ids are different ids; rows that repeat an id with the same vector count once, and
an id with several vectors is as near as its nearest one. Null ids are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findwell.llm.arrow import share, shared, slices
from findwell.llm.pairs import pairs_within

DIM = 64
SAMPLE = 16_384  # rows that the trees are fitted on, at most
TREES, LEAF_SAMPLE, PROBES = 4, 32, 12
TARGET = 1024  # vectors that a leaf holds on average, at most
EXACT_BLOCK = 8192  # vectors of a block of the exact search
SLACK = 0.02  # by which the integers may misjudge a cosine
TILE = 4096
_TREE = 52  # a leaf is the number of its tree above this bit, that of its node below


class Forest:
    """Trees as arrays: node n, from 1 at the root, has the children 2n and 2n + 1, the second above its plane.

    Down to level ``fitted`` each node has a normal and a threshold of its own; below, the normal is
    that of the tree and level, the threshold that of the fitted leaf and level.
    """

    def __init__(self, sample: np.ndarray, count: int | None = None, trees: int = TREES, leaf: int = LEAF_SAMPLE, target: int = TARGET, seed: int = 7):
        rng = np.random.default_rng(seed)
        count = len(sample) if count is None else count
        depth = max(0, int(np.ceil(np.log2(max(1, count / target)))))
        self.dim, self.trees = sample.shape[1], trees
        self.fitted = min(depth, max(0, int(np.log2(max(1, len(sample) / leaf)))))
        inner, leaves, below = 2**self.fitted - 1, 2**self.fitted, depth - self.fitted
        self.normal = np.zeros((trees, inner, self.dim), dtype=np.float32)
        self.threshold = np.zeros((trees, inner), dtype=np.float32)
        more = below + 16 if below else 0  # room for dense leaves
        self.planes = rng.standard_normal((trees, more, self.dim)).astype(np.float32)
        self.planes /= np.maximum(np.linalg.norm(self.planes, axis=2, keepdims=True), 1e-30)
        self.cuts = np.zeros((trees, leaves, more), dtype=np.float32)
        self.below = np.full((trees, leaves), below, dtype=np.int64)
        for t in range(trees):
            groups = [sample]
            for node in range(inner):
                rows = groups[node]
                normal = self._direction(rows, rng)
                along = rows @ normal
                self.normal[t, node], self.threshold[t, node] = normal, np.median(along) if len(along) else 0
                left = np.argsort(along, kind="stable")[: len(along) // 2]
                mask = np.zeros(len(rows), dtype=bool)
                mask[left] = True
                groups += [rows[mask], rows[~mask]]
                groups[node] = rows[:0]
            for k, rows in enumerate(groups[inner:]):
                if more and len(rows):
                    along = rows @ self.planes[t].T
                    self.cuts[t, k] = np.median(along, axis=0)
                    sides = (along[:, :below] > self.cuts[t, k, :below]) @ (1 << np.arange(below))
                    together = int(np.unique(sides, return_counts=True)[1].max())
                    held = count * together / len(sample)  # vectors of the densest part, by the sample
                    if together >= 4 and held > 4 * target:
                        self.below[t, k] = below + min(16, int(np.ceil(np.log2(held / target))))

    def _direction(self, rows: np.ndarray, rng) -> np.ndarray:
        """Unit vector between two means, found from two random members in a few rounds."""
        normal = rng.standard_normal(self.dim).astype(np.float32)
        if len(rows) >= 2:
            a, b = rows[rng.choice(len(rows), 2, replace=False)]
            for _ in range(3):
                nearer = rows @ (a - b) > (a @ a - b @ b) / 2
                if nearer.all() or not nearer.any():
                    break
                a, b = rows[nearer].mean(axis=0), rows[~nearer].mean(axis=0)
            if np.linalg.norm(a - b) > 1e-9:
                normal = a - b
        return (normal / np.linalg.norm(normal)).astype(np.float32)

    @property
    def depth(self) -> int:
        """Levels of the deepest path."""
        return self.fitted + int(self.below.max())

    def _margins(self, x: np.ndarray, tree: np.ndarray, node: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin, whether it is an inner node) of one node for each row."""
        top = level < self.fitted
        leaf = (node >> np.maximum(level - self.fitted, 0)) - (1 << self.fitted)
        inner = top | (level - self.fitted < self.below[tree, np.where(top, 0, leaf)])
        margin = np.zeros(len(x), dtype=np.float32)
        if (k := np.flatnonzero(top)).size:
            at = node[k] - 1
            margin[k] = np.einsum("ij,ij->i", x[k], self.normal[tree[k], at]) - self.threshold[tree[k], at]
        if (k := np.flatnonzero(inner & ~top)).size:
            at = level[k] - self.fitted
            margin[k] = np.einsum("ij,ij->i", x[k], self.planes[tree[k], at]) - self.cuts[tree[k], leaf[k], at]
        return margin, inner

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, probes): the leaves that each row's queue gives, first its own in every tree; -1 if there are no more."""
        n, trees, deep = len(x), self.trees, self.depth
        probes = max(probes, trees)
        room = trees + probes * deep
        priority = np.full((n, room), -np.inf, dtype=np.float32)
        queued, of = np.zeros((n, room), dtype=np.int64), np.zeros((n, room), dtype=np.int64)
        priority[:, :trees], queued[:, :trees], of[:, :trees] = np.inf, 1, np.arange(trees)
        found, every = np.full((n, probes), -1, dtype=np.int64), np.arange(n)
        for step in range(probes):
            best = np.argmax(priority, axis=1)
            value = priority[every, best].copy()
            node, tree = queued[every, best].copy(), of[every, best]
            priority[every, best] = -np.inf
            rows = np.flatnonzero(value > -np.inf)
            slot = trees + step * deep
            while rows.size:
                level = np.frexp(node[rows].astype(np.float64))[1].astype(np.int64) - 1
                margin, inner = self._margins(x[rows], tree[rows], node[rows], level)
                done = rows[~inner]
                found[done, step] = tree[done] << _TREE | node[done]
                rows, margin = rows[inner], margin[inner]
                if not rows.size:
                    break
                near = node[rows] * 2 + (margin > 0)
                priority[rows, slot] = np.minimum(value[rows], -np.abs(margin))
                queued[rows, slot], of[rows, slot] = near ^ 1, tree[rows]
                node[rows] = near
                slot += 1
        return found


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors as float64) of the vectors that take part."""
    lengths = np.asarray(pa.compute.list_value_length(column).fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    kept = column.take(pa.array(rows))
    x = np.asarray(kept.flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def _normal_udf(dim):
    def run(batches):
        for batch in slices(batches, 4096):
            rows, x = usable(batch.column("v"), dim)
            keys = batch.column("id").take(pa.array(rows))
            unit = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, dtype=np.float32))])
            yield pa.RecordBatch.from_arrays([keys, unit.cast(pa.binary())], names=["id", "unit"])

    return run


def _matrix(column: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(-1, dim)


def _small(x: np.ndarray) -> np.ndarray:
    """Vectors as bytes on the scale of their largest number."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _packs(leaf, row, home, keys, asks, data):
    """What a batch sends to each leaf: row keys, whether indexed and asked there, vectors."""
    order = np.argsort(leaf, kind="stable")
    leaf, row, home = leaf[order], row[order], home[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
    flags = home.astype(np.int8) | asks[row].astype(np.int8) << 1
    blobs = [[a[i:j].tobytes() for i, j in zip(edges, edges[1:])] for a in (keys[row], flags, data[row])]
    return pa.RecordBatch.from_arrays([pa.array(leaf[edges[:-1]]), *[pa.array(b, pa.binary()) for b in blobs]], names=["leaf", "keys", "flags", "bytes"])


def _rows_of(batch, dim):
    x = _matrix(batch.column("unit"), dim)
    return x, np.asarray(batch.column("rid")), np.asarray(batch.column("asks")).astype(bool)


def _leaf_udf(forest_ref, probes):
    def run(batches):
        forest = shared(Forest, forest_ref)
        for batch in slices(batches, 8192):
            if not batch.num_rows:
                continue
            x, keys, asks = _rows_of(batch, forest.dim)
            leaf, row, home = [], [], []
            for at in range(0, len(x), 1024):
                part, asking = x[at : at + 1024], asks[at : at + 1024]
                for some, steps in ((np.flatnonzero(asking), probes), (np.flatnonzero(~asking), forest.trees)):
                    found = forest.search(part[some], steps)
                    there = found >= 0
                    leaf.append(found[there]), row.append(np.repeat(some + at, found.shape[1]).reshape(found.shape)[there])
                    home.append(np.broadcast_to(np.arange(found.shape[1]) < forest.trees, found.shape)[there])
            yield _packs(*map(np.concatenate, (leaf, row, home)), keys, asks, _small(x))

    return run


def _block_udf(blocks, dim):
    """The same for the exact search: every vector lies in one block, and each asking one goes to all."""

    def run(batches):
        for batch in slices(batches, 8192):
            if not batch.num_rows:
                continue
            x, keys, asks = _rows_of(batch, dim)
            own = keys % blocks
            yield _packs(own, np.arange(len(x)), np.ones(len(x), dtype=bool), keys, asks, x)
            for block in range(blocks):
                if (there := np.flatnonzero(asks & (own != block))).size:
                    yield _packs(np.full(len(there), block), there, np.zeros(len(there), dtype=bool), keys, asks, x)

    return run


def _meet_udf(dim, threshold, top, kind=np.int8):
    """The pairs that a leaf's indexed and asking vectors form: above the threshold, or each asker's best."""

    def run(table):
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.int64)
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), dtype=np.int8)
        x = _matrix(table.column("bytes"), dim, kind).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        asks, stored = np.flatnonzero(flags & 2), np.flatnonzero(flags & 1)
        parts = []
        for a in range(0, len(asks), TILE):
            mine = asks[a : a + TILE]
            best: tuple | None = None
            for b in range(0, len(stored), TILE):
                there = stored[b : b + TILE]
                near = x[mine] @ x[there].T
                if top is None:
                    i, j = np.nonzero(near >= threshold)
                    parts.append((keys[mine[i]], keys[there[j]], near[i, j]))
                    continue
                near[keys[mine][:, None] == keys[there][None, :]] = -2
                k = min(top, near.shape[1])
                j = np.argpartition(-near, k - 1, axis=1)[:, :k]
                new = (keys[there[j]], np.take_along_axis(near, j, axis=1))
                best = new if best is None else tuple(np.concatenate(p, axis=1) for p in zip(best, new))
            if best is not None:
                k = min(top, best[1].shape[1])
                j = np.argpartition(-best[1], k - 1, axis=1)[:, :k]
                parts.append((np.repeat(keys[mine], k), np.take_along_axis(best[0], j, 1).ravel(), np.take_along_axis(best[1], j, 1).ravel()))
        a, b, near = (np.concatenate(p) for p in zip(*parts)) if parts else (keys[:0], keys[:0], x[:0, 0])
        keep = (a != b) & (near > -2)
        a, b, near = a[keep], b[keep], near[keep]
        if top is None:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            a, b, near = pairs[0], pairs[1], np.zeros(pairs.shape[1])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "near": pa.array(near.astype(np.float32))})

    return run


def _exact_udf(dim):
    def run(batches):
        for batch in slices(batches, 8192):
            x, y = (_matrix(batch.column(c), dim).astype(np.float64) for c in ("unit_a", "unit_b"))
            score = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)], names=["a", "b", "score"])

    return run


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, cls, unit) of the usable vectors; unit is the vector at unit length as bytes, cls its hash."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.mapInArrow(_normal_udf(dim), "id string, unit binary").select("id", F.xxhash64("unit").alias("cls"), "unit")


def fit_forest(df: DataFrame, key: str, vector: str, dim: int, sample: int = SAMPLE, **shape) -> Forest:
    """The forest of at most ``sample`` vectors, those whose ids hash lowest: the same every time.

    Rows are thinned by the hash before anything is sent, so that the driver gets about the sample
    and not as much from every partition.
    """
    count = df.count()
    share = min(1 << 30, int((1 << 30) * 1.1 * sample / max(1, count)) + 1)
    thin = df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < share)
    rows = unit_vectors(thin, key, vector, dim).select(F.xxhash64("id").alias("h"), "unit").distinct().orderBy("h", "unit").limit(sample).collect()
    x = np.frombuffer(b"".join(r["unit"] for r in rows), dtype=np.float32).reshape(-1, dim)
    return Forest(x, count, **shape)


def similar_vectors(df: DataFrame, key: str, vector: str, dim: int = DIM, threshold: float | None = None, top: int | None = None, asking=None, probes: int | None = PROBES, sample: int = SAMPLE, slack: float = SLACK, **shape) -> DataFrame:
    """(id_a, id_b, score) by cosine: pairs of at least ``threshold``, or each asking id's ``top``.

    With ``threshold`` each pair comes once, the smaller id first. With ``top`` the rows are
    (asking id, neighbour, score), ties broken by the neighbour's id; ``asking`` is a condition on
    the column id that picks the queries, all rows if left out. The search loses few pairs, those
    whose leaves the queue didn't reach; every pair that comes out has its exact score. ``probes`` of
    None is the exact search: the asking vectors meet all others in blocks, as single-precision numbers,
    and nothing is lost; its work is the product of both numbers. Equal vectors are one in the search
    and meet as members of their class.
    """
    if (threshold is None) == (top is None):
        raise ValueError("either a threshold or top is needed")
    spark = df.sparkSession
    units = unit_vectors(df, key, vector, dim)
    # The same plan for the search and for the exact scores, so that Spark computes it once.
    classes = units.groupBy("cls").agg(F.max("unit").alias("unit"), *([] if asking is None else [F.max(F.coalesce(asking, F.lit(False))).alias("asks")]))
    members = units.select("cls", "id").distinct()
    searched = classes.select(F.col("cls").alias("rid"), "unit", (F.lit(True) if asking is None else F.col("asks")).alias("asks"))
    if probes is None:
        slack, kind, run = 1e-5, np.float32, _block_udf(max(1, -(-df.count() // EXACT_BLOCK)), dim)
    else:
        kind, run = np.int8, _leaf_udf(share(spark, fit_forest(df, key, vector, dim, sample, **shape)), probes)
    packs = searched.mapInArrow(run, "leaf bigint, keys binary, flags binary, bytes binary")
    met = packs.groupBy("leaf").applyInArrow(_meet_udf(dim, None if threshold is None else threshold - slack, top and 3 * top, kind), "a bigint, b bigint, near float")
    pairs = met.groupBy("a", "b").agg(F.max("near").alias("near"))
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
        pairs = pairs.withColumn("r", rank).where(F.col("r") <= 3 * top)
    a = classes.select(F.col("cls").alias("a"), F.col("unit").alias("unit_a"))
    b = classes.select(F.col("cls").alias("b"), F.col("unit").alias("unit_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "unit_a", "unit_b")
    scored = both.mapInArrow(_exact_udf(dim), "a bigint, b bigint, score double")
    mine = members.select(F.col("cls").alias("a"), F.col("id").alias("id_a"))
    if threshold is not None:
        yours = members.select(F.col("cls").alias("b"), F.col("id").alias("id_b"))
        other = scored.where(F.col("score") >= threshold).join(mine, "a").join(yours, "b").select("id_a", "id_b", "score")
        equal = pairs_within(members, ["cls"], "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.lit(1.0).alias("score"))
        met = other.unionByName(equal if threshold <= 1 else equal.limit(0)).where(F.col("id_a") != F.col("id_b"))
        return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "score").groupBy("id_a", "id_b").agg(F.max("score").alias("score"))
    # Of a class only the top + 1 smallest ids can be among the top of any other.
    place = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    yours = members.withColumn("r", place).where(F.col("r") <= top + 1).select(F.col("cls").alias("b"), F.col("id").alias("id_b"))
    asked = (members if asking is None else members.where(F.coalesce(asking, F.lit(False)))).select(F.col("cls").alias("a"), F.col("id").alias("id_a"))
    own = asked.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("score"))
    found = scored.unionByName(own).join(asked, "a").join(yours, "b").where(F.col("id_a") != F.col("id_b"))
    best = found.groupBy("id_a", "id_b").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


def p7_found(spark, d):
    """Pairs of chunk ids whose vectors have a cosine of at least 0.9."""
    chunks = spark.read.parquet(f"{d}/document_chunks.parquet")
    pairs = similar_vectors(chunks, "id", "embedding", threshold=0.9)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p7_nearest(spark, d):
    """The ten most similar chunks of every chunk whose id hashes to a multiple of 50, among all."""
    chunks = spark.read.parquet(f"{d}/document_chunks.parquet")
    near = similar_vectors(chunks, "id", "embedding", top=10, asking=F.pmod(F.crc32("id"), F.lit(50)) == 0, probes=192)
    return near.select(F.col("id_a").alias("chunk_id"), F.col("id_b").alias("similar_id"), "score", "rank")


QUERIES = {"p7_found": p7_found, "p7_nearest": p7_nearest}

SQL = {
    "p7_found": """WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM document_chunks WHERE id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT DISTINCT a.id AS chunk_id_a, b.id AS chunk_id_b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
}
