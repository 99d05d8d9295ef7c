"""Collection-wide counts for texts that are held in blocks.

A block is one row that stands for some thousands of texts. It sends each of its distinct tokens
once, with the number of its texts that hold it, packed by ranges of the token hash; the task of a
range adds the counts up and sends each block its totals in the block's own order. So no token,
however common, meets more rows than there are blocks, nothing is broadcast, and what is shuffled
is some bytes per distinct token of a block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_TOKENS = 2_000_000
KEPT_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of a public hash function)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shorten(tokens: np.ndarray) -> bytes:
    """Hashes whose lowest 16 bits are 0 as six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def lengthen(blob: bytes) -> np.ndarray:
    """The hashes of :func:`shorten`."""
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_sorted(tokens: np.ndarray) -> bytes:
    """Ascending hashes whose lowest 16 bits are 0 by their differences, four bytes each, the few larger ones in full behind them."""
    gaps = np.diff(tokens >> np.uint64(16), prepend=np.uint64(0))
    large = gaps >= 0xFFFFFFFF
    return np.uint32(len(tokens)).tobytes() + np.where(large, 0xFFFFFFFF, gaps).astype("<u4").tobytes() + gaps[large].astype("<u8").tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The hashes of :func:`pack_sorted`."""
    n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
    gaps = np.frombuffer(blob, dtype="<u4", count=n, offset=4).astype(np.uint64)
    gaps[gaps == 0xFFFFFFFF] = np.frombuffer(blob, dtype="<u8", offset=4 + 4 * n)
    return np.cumsum(gaps, dtype=np.uint64) << np.uint64(16)


def pack_counts(counts: np.ndarray) -> bytes:
    """Positive counts as one byte each, those of 255 and more in full behind them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of :func:`pack_counts`."""
    out = np.frombuffer(blob, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, dtype="<i8", offset=n)
    return out


def pack_marks(marks: np.ndarray) -> bytes:
    """Marks (lowest 16 bits 0) in six bytes each, or by their places in a list of the different ones if that is shorter."""
    known, place = np.unique(marks, return_inverse=True)
    if len(known) < 1 << 16 and 6 * len(known) + 2 * len(marks) < 6 * len(marks):
        return np.uint32(len(known)).tobytes() + shorten(known) + place.astype("<u2").tobytes()
    return np.uint32(0).tobytes() + shorten(marks)


def unpack_marks(blob: bytes) -> np.ndarray:
    """The marks of :func:`pack_marks`."""
    n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
    return lengthen(blob[4 : 4 + 6 * n])[np.frombuffer(blob, dtype="<u2", offset=4 + 6 * n)] if n else lengthen(blob[4:])


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _send_udf(tokens_of, bits, short):
    pack = pack_sorted if short else lambda t: t.tobytes()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, tokens, counts, *marks = tokens_of(batch, i)
                edges = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                edges = [0, *edges, len(tokens)]
                full = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
                parts = [[pack(tokens[edges[k] : edges[k + 1]]) for k in full], [pack_counts(counts[edges[k] : edges[k + 1]]) for k in full]]
                parts += [[pack_marks(m[edges[k] : edges[k + 1]]) for k in full] for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], names=["range", "block", "tokens", "counts", *["marks"] * len(marks)])

    return run


def _add_udf(short, marked):
    unpack = unpack_sorted if short else lambda b: np.frombuffer(b, dtype=np.uint64)

    def add_up(table):
        tokens = [unpack(b) for b in table.column("tokens").to_pylist()]
        counts = np.concatenate([unpack_counts(b, len(t)) for b, t in zip(table.column("counts").to_pylist(), tokens)])
        inverse = np.unique(np.concatenate(tokens), return_inverse=True)[1]
        total = np.bincount(inverse, weights=counts)[inverse].astype(np.int64)
        edges = np.cumsum([0, *[len(t) for t in tokens]])
        blobs = [pack_counts(total[a:b]) for a, b in zip(edges, edges[1:])]
        sizes = pa.array(np.diff(edges).astype(np.int32))
        columns = {"block": table.column("block"), "range": table.column("range"), "n": sizes, "totals": pa.array(blobs, pa.binary())}
        if marked:
            sums = np.zeros(int(inverse.max(initial=-1)) + 1, dtype=np.uint64)
            np.add.at(sums, inverse, np.concatenate([unpack_marks(b) for b in table.column("marks").to_pylist()]))
            sums = sums[inverse]
            shown = [pack_marks(sums[a:b][total[a:b] > 1]) for a, b in zip(edges, edges[1:])]
            columns["marks"] = pa.array(shown, pa.binary())
        return pa.table(columns)

    return add_up


def with_totals(blocks: DataFrame, tokens_of, size: str, short: bool = False, marked: bool = False, keep=None) -> DataFrame:
    """``blocks`` with totals: for each token of the block, how many texts of all blocks hold it.

    ``tokens_of(batch, i)`` gives the number of block ``i`` of a batch, its distinct token hashes in
    ascending order and the number of its texts that hold each; column ``size`` is about how
    many tokens it has. Hashes whose lowest 16 bits are 0 may be sent ``short``. With ``marked`` a
    fourth array has for each token the sum of hashes (lowest 16 bits 0) of the block's texts that hold
    it, and the totals have the sums over all blocks: tokens held by the same texts have the same
    mark. ``keep`` may write the totals down and return them. ``blocks`` must give the same rows each time it is read.
    """
    amount = blocks.agg(F.sum(size)).collect()[0][0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, amount / RANGE_TOKENS)))))
    more, kind = (["marks"], ", marks binary") if marked else ([], "")
    sent = blocks.mapInArrow(_send_udf(tokens_of, bits, short), "range int, block bigint, tokens binary, counts binary" + kind)
    added = sent.groupBy("range").applyInArrow(_add_udf(short, marked), "block bigint, range int, n int, totals binary" + kind)
    added = keep(added) if keep else added
    reply = added.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "n", "totals", *more))).alias("__t"))
    field = lambda t: F.struct(t["n"].alias("n"), t["totals"].alias("counts"), *[t[m].alias(m) for m in more])
    return blocks.join(reply, "block").withColumn("totals", F.transform("__t", field)).drop("__t")


def totals_of(batch, i) -> np.ndarray:
    """The totals of block ``i``, in the order of its tokens."""
    return np.concatenate([unpack_counts(t["counts"], t["n"]) for t in batch.column("totals")[i].as_py()] or [np.zeros(0, dtype=np.int64)])


def marks_of(batch, i, totals: np.ndarray) -> np.ndarray:
    """The marks of the tokens of block ``i``; 0 for those that one text alone holds."""
    marks = np.zeros(len(totals), dtype=np.uint64)
    marks[totals > 1] = np.concatenate([unpack_marks(t["marks"]) for t in batch.column("totals")[i].as_py()] or [marks[:0]])
    return marks


def numbers(batch, name: str, i: int, kind) -> np.ndarray:
    """A list column of block ``i`` as numbers."""
    return np.asarray(batch.column(name)[i].values).astype(kind, copy=False)
