"""Problem 10: long spans that stand verbatim in more than one text.

Every run of ``GRAM`` characters is a token. Under each of several hash functions the tokens of a
text form a Cartesian tree, and a node (l, c, r) of it is a compact window: all stretches between
l and r that hold c have the same smallest token, c. Nodes too narrow for a stretch of the least
length are left out, which leaves about two windows per hundred characters and function. A window
stands for a range of stretches and sends only the hash of its smallest token.

A stretch of the least length can be shared only if the windows around it are shared under every
function. So each text joins the intervals of its shared windows, those of the further functions
only where the first one found something: where those of all overlap, stretches are hashed whole. Of these, the ones that several texts hold are the result.
Texts meet their collection, never each other, so a passage that a million texts hold costs as much
per text as one that two hold. Stretches held by the same texts are one group; its members are
verified by a cryptographic digest of the characters of one stretch, each member once. Pairs of
texts are made only at the end, and only where pairs are asked for.

Equal texts are one class until the end. Null texts and those under the least length share nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findwell.llm.arrow import slices
from findwell.llm.pairs import pairs_within
from findwell.plans.scratch import materialize

LEAST, GRAM, FUNCTIONS = 300, 100, 3
BLOCK_CHARS, MOST = 1 << 20, 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SEEN = 100_000  # classes that a task remembers to have read


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of a public hash function)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of stretches of a text from prefix sums, for texts of up to the size it was made for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_CHARS + (1 << 16))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sums(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._grow(len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=total[1:])
        return total

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        return _mix((sums[end] - sums[start]) * self.down[start])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` neighbours, by running minima of blocks."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def compact_windows(order: np.ndarray, whole: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of the texts' Cartesian trees that are at least ``width`` wide.

    ``order`` has the tokens' hashes, made distinct by their places in the lowest bits; ``whole``
    says at which places a stretch of ``width`` tokens of one text begins, ``text`` which text a place
    is in, and ``first`` and ``last`` the first and last token of each text. A node is wide enough if
    it is the least of some such stretch, and then so are all above it; so the tree is built from
    these nodes alone, by the stack of the open nodes on its right edge.
    """
    smallest = sliding_minimum(order, width)[whole]
    smallest = smallest[np.concatenate([[True], smallest[1:] != smallest[:-1]])] if len(smallest) else smallest
    c = (smallest & _PLACE).astype(np.int64)
    left, right = first[text[c]], last[text[c]]
    keys, owners = smallest.tolist(), text[c].tolist()
    below, above = np.full(len(c), -1), np.full(len(c), -1)
    stack: list[int] = []
    owner = -1
    for i, (key, mine) in enumerate(zip(keys, owners)):
        if mine != owner:
            stack, owner = [], mine
        while stack and keys[stack[-1]] > key:
            above[stack.pop()] = i
        if stack:
            below[i] = stack[-1]
        stack.append(i)
    left = np.where(below >= 0, c[below] + 1, left)
    right = np.where(above >= 0, c[above] - 1, right)
    return left, c, right


def window_ranges(texts: list[str], hasher: Hasher, least: int = LEAST, gram: int = GRAM, functions=range(FUNCTIONS)):
    """(text number, from, to, signature) of the compact windows of texts of the least length.

    ``from`` to ``to`` are the starts of the stretches of the least length that a window stands for.
    Of neighbouring windows with the same smallest token, as in periodic text, one range is made. The
    lowest two bits of a signature are the number of the hash function.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    sums = hasher.sums("".join(texts))
    starts = np.arange(int(offsets[-1]) - gram + 1)
    tokens = hasher.of(sums, starts, starts + gram)
    width = least - gram + 1
    inside = np.zeros(len(tokens) - width + 2, dtype=np.int32)
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, np.minimum(offsets[1:] - least + 1, len(inside) - 1), -1)
    whole = np.cumsum(inside[:-1]) > 0
    text = np.repeat(np.arange(len(texts)), lengths)
    out = []
    for j in functions:
        hashes = _mix(tokens + np.uint64(0x632BE59BD9B4E019 * (j + 1) & (1 << 64) - 1))
        left, c, right = compact_windows((hashes & ~_PLACE) | starts.astype(np.uint64), whole, text, offsets[:-1], offsets[1:] - gram, width)
        low, high = np.maximum(left, c - width + 1), np.minimum(c, right - width + 1)
        sig = (hashes[c] & ~np.uint64(3)) | np.uint64(j)
        new = np.ones(len(c), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (text[c[1:]] != text[c[:-1]]) | (low[1:] != high[:-1] + 1)
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(c)) - 1 if len(c) else at
        owner = text[c[at]]
        out.append((owner, low[at] - offsets[owner], high[ends] - offsets[owner], sig[at].view(np.int64)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _blocks(batches, chars: int, text_at: int):
    """Rows gathered up to so many characters of their text; one longer text is a block."""
    held: list = []
    size = 0
    for batch in slices(batches, 256):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and size + len(row[text_at]) > chars:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[text_at])
    if held:
        yield held


def _unseen(batches):
    """The rows of a task whose class it hasn't met lately."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, c in enumerate(batch.column("cls").to_pylist()):
            if c not in seen:
                seen.add(c)
                fresh.append(i)
        if len(seen) > _SEEN:
            seen.clear()
        yield batch.take(pa.array(fresh, pa.int64()))


def _windows_udf(least, gram, functions):
    """The windows of texts (cls, text), or, with ranges, those that overlap the ranges found before."""

    def run(batches):
        hasher = Hasher()
        for rows in _blocks(_unseen(batches), BLOCK_CHARS, 1):
            # A very long text is read in parts that overlap by all but one character of a stretch.
            parts = [(r[0], at, r[1][at : at + MOST + least - 1]) for r in rows for at in range(0, max(1, len(r[1]) - least + 1), MOST)]
            before = {r[0]: np.cumsum(np.concatenate([[0], inside(len(r[1]) - least + 1, r[2])])) for r in rows if len(r) > 2}
            for group in [parts] if len(parts) == len(rows) else [[p] for p in parts]:
                text, low, high, sig = window_ranges([p[2] for p in group], hasher, least, gram, functions)
                cls, shift = (np.array([p[i] for p in group], dtype=np.int64)[text] for i in (0, 1))
                low, high = low + shift, high + shift
                if before:
                    keep = np.zeros(len(low), dtype=bool)
                    for k, p in enumerate(group):
                        mine = np.flatnonzero(text == k)
                        keep[mine] = before[p[0]][high[mine] + 1] > before[p[0]][low[mine]]
                    cls, low, high, sig = cls[keep], low[keep], high[keep], sig[keep]
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["sig", "cls", "low", "high"])

    return run


def inside(n: int, ranges) -> np.ndarray:
    """Which of ``n`` starts lie in any of the ranges (low, high)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for r in ranges:
        edge[r["low"]] += 1
        edge[r["high"] + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def overlap(n: int, ranges, functions: int) -> np.ndarray:
    """The starts, of ``n``, that lie in a range (sig, low, high) of every function."""
    by = [[r for r in ranges if r["sig"] & 3 == j] for j in range(functions)]
    return np.flatnonzero(np.logical_and.reduce([inside(n, r) for r in by]))


def _stretches_udf(least, functions):
    def run(batches):
        hasher = Hasher()
        for rows in _blocks(batches, BLOCK_CHARS, 1):
            hashes, owners, places, again = [], [], [], []
            for cls, text, ranges in rows:
                starts = overlap(len(text) - least + 1, ranges, functions)
                if not len(starts):
                    continue
                h = hasher.of(hasher.sums(text), starts, starts + least)
                repeated = np.ones(len(h), dtype=bool)
                repeated[np.unique(h, return_index=True)[1]] = False
                hashes.append(h), owners.append(np.full(len(h), cls)), places.append(starts), again.append(repeated)
            if hashes:
                columns = [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(again))]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "cls", "start", "again"])

    return run


def _digests_udf(least):
    def run(batches):
        for batch in slices(batches, 256):
            cls, marks, digests = [], [], []
            for c, text, groups in zip(*[x.to_pylist() for x in batch.columns]):
                for g in groups:
                    cls.append(c), marks.append(g["mark"])
                    digests.append(hashlib.sha256(text[g["start"] : g["start"] + least].encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(marks, pa.int64()), pa.array(digests, pa.binary())], names=["cls", "mark", "digest"])

    return run


def _shared_ranges(texts: DataFrame, least: int, gram: int, functions: list[int]) -> DataFrame:
    """(cls, ranges): where a class has windows, under each of the functions, whose signature another class has too."""
    windows = materialize(texts.mapInArrow(_windows_udf(least, gram, functions), "sig bigint, cls bigint, low int, high int"), "windows")
    # Tables on both sides of this join, so that Spark can split the partition of a hot signature.
    several = materialize(windows.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("sig"), "several")
    ranges = windows.join(several, "sig", "left_semi").groupBy("cls").agg(F.collect_set(F.struct("sig", "low", "high")).alias("ranges"))
    return ranges.where(F.size(F.array_distinct(F.transform("ranges", lambda r: r["sig"].bitwiseAND(F.lit(3))))) == len(functions))


def shared_stretches(df: DataFrame, key: str, text: str, least: int = LEAST, gram: int = GRAM, functions: int = FUNCTIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, cls) members, (mark, digest, cls) groups, (mark, cls, start) stretches).

    A group is a set of classes of equal texts that share a stretch; ``stretches`` has the start, in
    characters from 0, of every stretch of the least length that a class shares with another one, and
    the mark of its group. Only marks that ``groups`` has are verified.
    """
    if not 0 < gram < least:
        raise ValueError("gram must be under the least length")
    if not 0 < functions <= 4:
        raise ValueError("one to four hash functions")
    long = df.where((F.length(text) >= least) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("cls"), F.col(text).alias("text"))
    texts = long.groupBy("cls").agg(F.max("text").alias("text"))
    chosen = materialize(texts.join(_shared_ranges(long.select("cls", "text"), least, gram, [0]), "cls").select("cls", "text", "ranges"), "chosen")
    located = chosen
    if functions > 1:  # the other functions look only where the first one found something
        more = _shared_ranges(chosen, least, gram, list(range(1, functions))).withColumnRenamed("ranges", "more")
        located = chosen.join(more, "cls").select("cls", "text", F.concat("ranges", "more").alias("ranges"))
    hashes = materialize(located.mapInArrow(_stretches_udf(least, functions), "hash bigint, cls bigint, start int, again boolean"), "hashes")
    # Stretches held by the same classes have the same mark.
    mark = F.bit_xor(F.when(~F.col("again"), F.xxhash64(F.lit(3), F.col("cls")))).alias("mark")
    held = materialize(hashes.groupBy("hash").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), mark).where("lo < hi").select("hash", "mark"), "held")
    stretches = hashes.join(held, "hash").select("mark", "cls", "start", "hash")
    one = stretches.groupBy("mark", "cls").agg(F.min(F.struct("hash", "start")).alias("one")).select("mark", "cls", "one.start")
    listed = one.groupBy("cls").agg(F.collect_list(F.struct("mark", "start")).alias("groups"))
    digests = chosen.select("cls", "text").join(listed, "cls").mapInArrow(_digests_udf(least), "cls bigint, mark bigint, digest binary")
    return long.select("key", "cls").distinct(), materialize(digests, "groups"), stretches.select("mark", "cls", "start")


def sharing_pairs(df: DataFrame, key: str, text: str, **sizes) -> DataFrame:
    """(key_a, key_b): pairs of records that share a stretch, copies of one text included."""
    members, groups, _ = shared_stretches(df, key, text, **sizes)
    classes = pairs_within(groups, ["mark", "digest"], "cls").distinct()
    a = members.select(F.col("cls").alias("a"), F.col("key").alias("key_a"))
    b = members.select(F.col("cls").alias("b"), F.col("key").alias("key_b"))
    other = classes.join(a, "a").join(b, "b").select("key_a", "key_b")
    copies = pairs_within(members, ["cls"], "key").select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    pairs = other.unionByName(copies).where(F.col("key_a") != F.col("key_b"))
    return pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def shared_parts(df: DataFrame, key: str, text: str, least: int = LEAST, **sizes) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every record that shares a stretch with another one.

    Overlapping stretches count once. A text that several records hold is shared as a whole. No pairs
    are made: each class counts the characters under its own shared stretches.
    """
    members, groups, stretches = shared_stretches(df, key, text, least, **sizes)
    several = groups.groupBy("mark", "digest").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
    true = materialize(groups.join(several, ["mark", "digest"], "left_semi").select("mark", "cls").distinct(), "verified")
    starts = stretches.join(true, ["mark", "cls"], "left_semi").select("cls", "start")
    before = F.lag("start").over(Window.partitionBy("cls").orderBy("start"))  # at most the starts of one text
    covered = starts.withColumn("new", F.least(F.lit(least), F.coalesce(F.col("start") - before, F.lit(least)))).groupBy("cls").agg(F.sum("new").alias("part"))
    copies = members.groupBy("cls").agg(F.count("*").alias("held")).where("held > 1")
    lengths = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("cls"), F.length(text).cast("bigint").alias("n_chars"))
    parts = covered.join(copies, "cls", "full_outer")
    rows = lengths.join(parts, "cls").where(F.col("n_chars") >= least)
    shared = F.when(F.col("held").isNotNull(), F.col("n_chars")).otherwise(F.col("part"))
    return rows.groupBy("key", "n_chars").agg(F.max(shared).alias("shared_chars")).withColumn("share", F.col("shared_chars") / F.col("n_chars"))


def p10_found(spark, d):
    """Pairs of documents that have at least 300 characters in a row in common."""
    pairs = sharing_pairs(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p10_share(spark, d):
    """How much of each document stands in others too."""
    return shared_parts(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumnRenamed("key", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_share": p10_share}

_WINDOWS = """w AS (SELECT doc_id, length(text) AS n, unnest(range(1, length(text) - 298)) AS i, text FROM documents WHERE length(text) >= 300 AND doc_id IS NOT NULL),
  h AS (SELECT doc_id, n, i, md5(substr(text, i, 300)) AS h FROM w)"""

SQL = {
    "p10_found": f"WITH {_WINDOWS}, u AS (SELECT DISTINCT doc_id, h FROM h) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_share": f"""WITH {_WINDOWS}, m AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1), c AS (SELECT doc_id, n, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h JOIN m USING (h))
SELECT doc_id, n::BIGINT AS n_chars, sum(CASE WHEN before IS NULL THEN 300 ELSE least(300, i - before) END)::BIGINT AS shared_chars, sum(CASE WHEN before IS NULL THEN 300 ELSE least(300, i - before) END) / n::DOUBLE AS share FROM c GROUP BY doc_id, n""",
}
