"""Problem 2: records that share most of their content, by prefixes of token combinations.

A record is the set of its sequences of ``shingle`` words. Exact counts over all current records say
how many hold each sequence, and a mark (a sum of the holders' hashes) which: sequences with the
same mark are held by the same records and are one token, whose weight is their number. So a
passage that a million records share is one heavy token, and what a record alone holds is none.

Tokens are ordered by how many records hold them, rarest first. Two sets with ``threshold`` of their
union in common share a first token in this order, and all they share stands behind it: so in
either set the weight from that token on is at least what the two must have in common. A record is
looked up under its prefix, the tokens for which that can be: of the smaller of two records it is
enough to take those that leave 2t / (1 + t) of its sequences, of the larger those that leave t. A
token of some weight that few hold is a key alone, and one that may be all that is shared. Others are
keys in pairs, and not in all pairs: see :class:`Combinations`. A record whose pairs would pass
``BUDGET`` per sequence is looked up under single tokens, and so are the others where they look for such
records; so no pair is lost. Keys of pairs are exchanged packed, six bytes each, by ranges of the key;
those that very many records hold are joined block against block.

Records that meet are compared by sketches first, a bit or more for each token, which tell how many
tokens each has that the other lacks, at least. Few are left, and only these send their tokens
and weights and are verified on all of them. Records of equal sets are one class until
the end, so exact copies never meet as pairs before.

A null title or content is an empty one; records of fewer than ``least_words`` words take no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.llm.arrow import list_array, slices
from findwell.llm.blocks import WORD, WordHashes, lengthen, marks_of, mix, numbers, pack_counts, pack_sorted, shorten, totals_of, unpack_counts, unpack_sorted, with_totals
from findwell.llm.pairs import BLOCK, block_count, pairs_within
from findwell.operators.state import current_rows
from findwell.plans.scratch import materialize, release, tidy

SHINGLE, THRESHOLD, LEAST_WORDS = 5, 0.8, 20
HEAVY_FROM = 2  # weight from which a token makes a pair with any other
RARE = 16  # holders up to which a token of that weight is a key alone
BUDGET, SPARE = 16, 256  # pairs per sequence of a record, and to begin with; packed, six bytes each
BLOCK_WORDS, BLOCK_RECORDS = 1_000_000, 60_000
WAVES = 4  # parts in which keys are exchanged, so that a part of them is on disk twice
RANGE_KEYS = 2_000_000
BROADCAST = 1_000_000  # numbers of classes (8 bytes each) sent to all tasks; more are joined as a table
_KEPT = ~np.uint64(0xFFFF)  # hashes of 48 bits: two of a record's sequences are confused once in 10**10 records
_BLOCK = "block bigint, ids array<string>, classes array<bigint>, sizes array<int>, lengths array<int>, words binary, wide boolean, vocabulary array<bigint>, size bigint"
_KEYS = "kind tinyint, key bigint, cls bigint, n int, bound int, wide boolean, often boolean, tokens binary, sketch binary"
PACKED, SET, ALONE, COMMON = -1, 0, 1, 2  # kinds of rows: keys of a block's classes, a class with its tokens, and its keys of one token
PAIR, LARGER, SMALLER = range(3)  # for which partner a key is; a pair that was met


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct sequences of texts whose word hashes lie in one row.

    Ordered by text and hash. A text of fewer words than a sequence has is one sequence.
    """
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.concatenate([words, np.zeros(shingle, dtype=np.uint64)])
    total = np.zeros(len(words), dtype=np.uint64)
    left = ends[text] - np.arange(len(words))
    for i in range(shingle):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1))
        total += np.where(left > i, mix(padded[i : i + len(words)] * factor + np.uint64(i)), np.uint64(0))
    first = np.arange(len(words)) == (ends - lengths)[text]
    keep = (left >= shingle) | (first & (lengths[text] < shingle))
    text, total = text[keep], mix(total[keep]) & _KEPT
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    return text[new], total[new]


def _class_of(tokens: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def _number(block, at):
    """The number of a record by its block and place there; a class has that of one of its records. Works on columns too."""
    if isinstance(block, Column):
        return F.shiftleft(F.shiftright(block, 32), 36) + F.shiftleft(block.bitwiseAND(F.lit(0xFFFFFFFF)), 16) + at
    return (block >> 32 << 36) + ((block & 0xFFFFFFFF) << 16) + at


def _pack_udf(shingle, least_words):
    def run(batches):
        from pyspark import TaskContext

        hashes, part = WordHashes(), TaskContext.get().partitionId()
        number, ids, rows = 0, [], []
        held = 0

        def pack():
            words = np.array([w for r in rows for w in r], dtype=np.uint64)
            lengths = np.array([len(r) for r in rows], dtype=np.int64)
            text, tokens = shingle_hashes(words, lengths, shingle)
            sizes = np.bincount(text, minlength=len(rows))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            classes = [_class_of(tokens[a:b]) for a, b in zip(edges, edges[1:])]
            vocabulary, local = np.unique(words, return_inverse=True)
            wide = len(vocabulary) > 1 << 16
            columns = [
                pa.array([part << 32 | number], pa.int64()), list_array([len(ids)], pa.array(ids, pa.string()), pa.string()), list_array([len(ids)], classes, pa.int64()),
                list_array([len(ids)], sizes, pa.int32()), list_array([len(ids)], lengths, pa.int32()), pa.array([local.astype(np.uint32 if wide else np.uint16).tobytes()], pa.binary()), pa.array([wide]),
                list_array([len(vocabulary)], vocabulary.view(np.int64), pa.int64()), pa.array([len(tokens)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in slices(batches, 512):
            for key, title, content in zip(*[c.to_pylist() for c in batch.columns]):
                words = [w.lower() for w in WORD.findall(f"{title or ''}\n{content or ''}")]
                if len(words) >= max(1, least_words):
                    ids.append(key)
                    rows.append([hashes[w] for w in words])
                    held += len(words)
                if held >= BLOCK_WORDS or len(ids) == BLOCK_RECORDS:
                    yield pack()
                    number, ids, rows, held = number + 1, [], [], 0
        if ids:
            yield pack()

    return run


def _block_tokens(batch, i, shingle):
    vocabulary = numbers(batch, "vocabulary", i, np.int64).view(np.uint64)
    words = np.frombuffer(batch.column("words")[i].as_py(), dtype=np.uint32 if batch.column("wide")[i].as_py() else np.uint16)
    return shingle_hashes(vocabulary[words], numbers(batch, "lengths", i, np.int64), shingle)


def _class_hashes(classes: np.ndarray) -> np.ndarray:
    return mix(classes.view(np.uint64) + np.uint64(0x51ED)) & _KEPT


def _tokens_of(shingle):
    def tokens_of(batch, i):
        text, tokens = _block_tokens(batch, i, shingle)
        tokens, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        marks = np.zeros(len(tokens), dtype=np.uint64)
        np.add.at(marks, inverse, _class_hashes(numbers(batch, "classes", i, np.int64))[text])
        return batch.column("block")[i].as_py(), tokens, counts, marks

    return tokens_of


def _key(*marks: np.ndarray) -> np.ndarray:
    """One key per row of marks, whatever their order."""
    total = np.full(len(marks[0]), len(marks), dtype=np.uint64)
    for m in marks:
        total += mix(m)
    return mix(total).view(np.int64)


def _spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x): of each range i all its numbers x."""
    size = np.maximum(0, stop - start)
    ends = np.cumsum(size)
    i = np.repeat(np.arange(len(size)), size)
    return i, np.arange(len(i)) - (ends - size)[i] + start[i]


class Combinations:
    """Of the ordered tokens of many sets those pairs one of which two similar sets must share.

    The tokens below weight ``HEAVY_FROM`` fall into groups by their mark, of which there are ``groups`` for
    each set. Take shared tokens in their order until one is heavy, or has its group or a heavy one before
    it: this pair is what both sets are looked up under. What is shared before it has a group each, so
    it weighs no more than the heaviest of each group (``before``), and all else stands behind.
    ``held_by`` tells where each set begins, ``left`` is the weight from each token on, ``need`` what must be
    shared, by set; tokens that aren't ``common`` are not shared. Groups are so few that a token of
    each weighs less than ``need``; a token that weighs as much by itself is left to others.
    """

    def __init__(self, marks, weight, left, text, held_by, common, need, groups):
        least = need[text] if len(text) else left
        light = np.flatnonzero(common & (weight < HEAVY_FROM))
        group = (mix(marks[light] ^ np.uint64(0xA5A5)) >> np.uint64(33)).astype(np.int64) % groups[text[light]]
        order = np.lexsort((light, group, text[light]))
        light, group = light[order], group[order]
        new = np.ones(len(light), dtype=bool)
        new[1:] = (text[light[1:]] != text[light[:-1]]) | (group[1:] != group[:-1])
        number = np.cumsum(new)
        top = np.maximum.accumulate(number * HEAVY_FROM + weight[light]) - number * HEAVY_FROM  # heaviest of its group so far
        gain = np.zeros(len(text), dtype=np.int64)
        gain[light] = top - np.where(new, 0, np.concatenate([[0], top[:-1]]))
        before = np.cumsum(gain) - gain
        before -= before[held_by[text]] if len(text) else before
        self.before = before
        may = common & (left + before >= least)
        some = may[light]
        self.light, number = light[some], number[some]
        self.stop = np.searchsorted(number, number, side="right")  # where the group ends
        first = common & (left >= least)  # may be the first shared one
        heavy = np.flatnonzero(first & (weight >= HEAVY_FROM))
        ends = [f + 1 + int(np.searchsorted(-left[f + 1 : held_by[text[f] + 1]], weight[f] - least[f], side="right")) for f in heavy]
        self.heavy, self.ends = heavy, np.array(ends, dtype=np.int64)
        self.firsts = np.flatnonzero(first & (weight < HEAVY_FROM))
        self.later = np.flatnonzero(may & (weight >= HEAVY_FROM))
        self.range = np.searchsorted(self.firsts, held_by[text[self.later]]), np.searchsorted(self.firsts, self.later)
        self.text = text

    def counts(self, sets: int) -> np.ndarray:
        """How many pairs each set has, before they are made."""
        out = np.zeros(sets) + np.bincount(self.text[self.light], weights=self.stop - np.arange(len(self.light)) - 1, minlength=sets)
        out += np.bincount(self.text[self.heavy], weights=self.ends - self.heavy - 1, minlength=sets)
        return out + np.bincount(self.text[self.later], weights=self.range[1] - self.range[0], minlength=sets)

    def places(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (f, g) of the pairs of the sets marked in ``of``."""
        at = np.flatnonzero(of[self.text[self.light]])
        i, x = _spans(at + 1, self.stop[at])
        some = of[self.text[self.heavy]]
        j, y = _spans(self.heavy[some] + 1, self.ends[some])
        third = of[self.text[self.later]]
        k, z = _spans(self.range[0][third], self.range[1][third])
        return np.concatenate([self.light[at[i]], self.heavy[some][j], self.firsts[z]]), np.concatenate([self.light[x], y, self.later[third][k]])


def _sketch_bits(n: int) -> int:
    return 1 << max(6, int(n).bit_length() + 1)


def sketch(tokens: np.ndarray, n: int) -> bytes:
    """A bit for each token, at its hash."""
    bits = np.zeros(_sketch_bits(n), dtype=np.uint8)
    bits[(mix(tokens) >> np.uint64(20)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def missing(a: bytes, b: bytes) -> tuple[int, int]:
    """At least how many tokens of each of two sets the other lacks, by their sketches."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in (a, b))
    while len(x) != len(y):
        x, y = (z if len(z) <= min(len(x), len(y)) else z[: len(z) // 2] | z[len(z) // 2 :] for z in (x, y))
    both = int(np.bitwise_count(x & y).sum())
    return int(np.bitwise_count(x).sum()) - both, int(np.bitwise_count(y).sum()) - both


def _sides(sizes, threshold):
    """(side, level, need) by class for all under which pairs are looked up: sets meet at the level of the smaller one. A need of 0: nothing at this level."""
    lowest = np.ceil(threshold * sizes - 1e-9).astype(np.int64)  # size of the smallest partner
    level, bottom = (np.floor(np.log2(np.maximum(1, x))).astype(np.int64) for x in (sizes, lowest))
    yield SMALLER, level, np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64)
    for down in range(int((level - bottom).max(initial=0)) + 1):
        at = np.maximum(0, level - down)
        least = np.ceil(threshold / (1 + threshold) * (sizes + np.maximum(lowest, 1 << at)) - 1e-9).astype(np.int64)
        yield LARGER, at, np.where(level - down >= bottom, np.maximum(lowest, least), 0)


def _keys_udf(shingle, threshold, rare, budget, spare, block, bits, rest=False):
    """The classes with their keys; with ``rest`` only the single common tokens of those that have pairs, which wide ones look for."""

    def done(rows):
        columns = [pa.array(np.concatenate(rows[name])) for name in list(rows)[:-2]]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(rows[name], pa.binary()) for name in list(rows)[-2:]]], names=list(rows))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text, tokens = _block_tokens(batch, i, shingle)
                at = np.unique(tokens, return_inverse=True)[1]
                df = totals_of(batch, i)
                marks, df = marks_of(batch, i, df)[at], df[at]
                classes, sizes = numbers(batch, "classes", i, np.int64), numbers(batch, "sizes", i, np.int64)
                own = df.astype(np.uint64) * _class_hashes(classes)[text]
                chosen = np.zeros(len(classes), dtype=bool)
                chosen[numbers(batch, "chosen", i, np.int64)] = True
                met = (df > 1) & (marks != own) & chosen[text]  # held by another class too
                text, marks, df = text[met], marks[met], df[met]
                order = np.lexsort((marks, df, text))
                text, marks, df = text[order], marks[order], df[order]
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (marks[1:] != marks[:-1]) | (df[1:] != df[:-1])
                starts = np.flatnonzero(new)
                weight = np.diff(np.append(starts, len(text)))
                text, marks, df = text[starts], marks[starts], df[starts]
                number = batch.column("block")[i].as_py()
                size, first_class = sizes[text], _number(number, 0)
                need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)  # of a set that isn't smaller than the other
                held_by = np.searchsorted(text, np.arange(len(classes) + 1))  # where each class begins
                before = np.cumsum(weight) - weight
                total = np.append(np.cumsum(weight), 0)[held_by[1:] - 1] - np.append(before, 0)[np.minimum(held_by[:-1], len(before))]
                left = total[text] - (before - before[held_by[text]]) if len(text) else before
                rare_one = (df <= rare) & (weight >= HEAVY_FROM)
                rows: dict[str, list] = {c.split()[0]: [] for c in _KEYS.split(", ")}

                def add(kind, key, cls, n, bound, wide=False, often=False, tokens=None, sketches=None):
                    k = len(key)
                    for name, x, dtype in (("kind", kind, np.int8), ("cls", cls, np.int64), ("n", n, np.int32), ("bound", bound, np.int32), ("wide", wide, bool), ("often", often, bool)):
                        rows[name].append(np.broadcast_to(np.asarray(x, dtype=dtype), k))
                    rows["key"].append(key)
                    rows["tokens"] += tokens or [None] * k
                    rows["sketch"] += sketches or [None] * k

                sides, many, reach = [], np.zeros(len(classes)), left.copy()
                for side, level, least in _sides(sizes, threshold):
                    c = Combinations(marks, weight, left, text, held_by, ~rare_one & (least > 0)[text], least, np.maximum(1, (threshold * 2.0**level / 2).astype(np.int64)))
                    sides.append((side, level, c))
                    many += c.counts(len(classes))
                    reach = np.maximum(reach, left + c.before)
                wide = many > budget * sizes + spare
                one = np.flatnonzero((left >= need[text]) & (wide[text] != rest)) if len(text) else np.zeros(0, dtype=np.int64)
                add(COMMON, _key(marks[one]), first_class + text[one], size[one], left[one], wide=wide[text[one]], often=df[one] > block)
                if rest:
                    if rows["key"]:
                        yield done(rows)
                    continue
                looked = np.flatnonzero((total >= need) & (held_by[1:] > held_by[:-1]))
                packed, spans = shorten(marks), list(zip(held_by[looked].tolist(), held_by[looked + 1].tolist()))
                add(SET, np.zeros(len(looked), dtype=np.int64), first_class + looked, sizes[looked], total[looked], sketches=[sketch(marks[a:b], n) for (a, b), n in zip(spans, sizes[looked])], tokens=[np.uint32(b - a).tobytes() + packed[6 * a : 6 * b] + pack_counts(weight[a:b]) for a, b in spans])
                for side in (LARGER, SMALLER):
                    made = [(level, *c.places(~wide)) for s, level, c in sides if s == side]
                    f, g = (np.concatenate([m[x] for m in made]) for x in (1, 2))
                    which = np.concatenate([level[text[x]] for level, x, _ in made])
                    pair_keys = _key(marks[f], marks[g], mix(which.astype(np.uint64))).view(np.uint64) & _KEPT
                    order = np.lexsort((text[f], pair_keys))
                    pair_keys, of = pair_keys[order], text[f][order]
                    once = np.ones(len(of), dtype=bool)
                    once[1:] = (pair_keys[1:] != pair_keys[:-1]) | (of[1:] != of[:-1])
                    pair_keys, of = pair_keys[once], of[once].astype("<u2")
                    edges = [0, *np.searchsorted(pair_keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(pair_keys)]
                    full = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
                    blobs = [pack_sorted(pair_keys[edges[k] : edges[k + 1]]) + of[edges[k] : edges[k + 1]].tobytes() for k in full]
                    add(PACKED, np.array(full, dtype=np.int64), number, side, 0, tokens=blobs)
                one = np.flatnonzero((reach >= need[text]) & (rare_one | (weight >= need[text]))) if len(text) else one
                add(ALONE, _key(marks[one]), first_class + text[one], size[one], reach[one], often=df[one] > block)
                if rows["key"]:
                    yield done(rows)

    return run


def _meet_udf(block):
    def meet(table):
        keys, cls = {}, {}
        for side in (LARGER, SMALLER):
            some = [(b, p) for b, p, n in zip(table.column("cls").to_pylist(), table.column("tokens").to_pylist(), table.column("n").to_pylist()) if n == side]
            sizes = [int(np.frombuffer(p, dtype="<u4", count=1)[0]) for _, p in some]
            k = [unpack_sorted(p[: len(p) - 2 * n]) for (_, p), n in zip(some, sizes)]
            c = [_number(b, np.frombuffer(p[len(p) - 2 * n :], dtype="<u2").astype(np.int64)) for (b, p), n in zip(some, sizes)]
            k, c = np.concatenate(k or [np.zeros(0, dtype=np.uint64)]), np.concatenate(c or [np.zeros(0, dtype=np.int64)])
            order = np.argsort(k, kind="stable")
            keys[side], cls[side] = k[order], c[order]
        x, y = keys[LARGER], keys[SMALLER]
        start, stop = np.searchsorted(y, x, side="left"), np.searchsorted(y, x, side="right")
        mine = np.searchsorted(x, x, side="right") - np.searchsorted(x, x, side="left")
        hot = np.maximum(stop - start, mine) > block
        hot &= stop > start
        i, j = _spans(start, np.where(hot, start, stop))
        a, b = cls[LARGER][i], cls[SMALLER][j]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        asked = np.isin(y, x[hot])  # keys of very many rows go on as rows
        side = np.repeat([PAIR, LARGER, SMALLER], [len(pairs), int(hot.sum()), int(asked.sum())]).astype(np.int8)
        one = np.concatenate([pairs[:, 0], x[hot].view(np.int64), y[asked].view(np.int64)])
        return pa.table({"side": side, "a": one, "b": np.concatenate([pairs[:, 1], cls[LARGER][hot], cls[SMALLER][asked]])})

    return meet


def _likely_udf(threshold):
    def run(batches):
        for batch in slices(batches, 16384):
            kept = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b", "total_a", "total_b")])
            for k, (a, b, n, m, v, w) in enumerate(rows):
                x, y = missing(a, b)
                if min(v - x, w - y) >= threshold / (1 + threshold) * (n + m) - 1e-9:
                    kept.append(k)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"])

    return run


def _similar_udf(threshold):
    def tokens(blob):
        k = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
        return lengthen(blob[4 : 4 + 6 * k]), unpack_counts(blob[4 + 6 * k :], k)

    def run(batches):
        for batch in slices(batches, 2048):
            kept, share = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("tokens_a", "tokens_b", "n_a", "n_b")])
            for k, (a, b, n, m) in enumerate(rows):
                (x, v), (y, w) = tokens(a), tokens(b)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                common = int(np.minimum(v[i], w[j]).sum())
                if common >= threshold * (n + m - common) - 1e-9:
                    kept.append(k), share.append(common / (n + m - common))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(share, pa.float64())], names=["a", "b", "similarity"])

    return run


def _meetings(left: DataFrame, right: DataFrame, hot: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): classes of ``left`` and not larger ones of ``right`` that meet under a key and may share enough.

    ``hot`` (key, held) lists the keys of more than ``block`` rows. Their rows are spread over blocks
    by the hash of the class, and each block of one side meets each of the other under a key of its
    own, so that no task holds a hot key whole.
    """
    a = left.select("key", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bound").alias("bound_a"))
    smaller = F.col("bound") >= F.ceil(2 * threshold / (1 + threshold) * F.col("n") - 1e-9)
    b = right.where(smaller).select("key", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("bound").alias("bound_b"))
    need = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9
    order = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    enough = order & (F.least("bound_a", "bound_b") >= need) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)

    def spread(rows: DataFrame, cls: str, mine: str, others: str) -> DataFrame:
        of: Column = block_count(F.col("held"), block)
        placed = rows.join(hot, "key").withColumn(mine, F.pmod(F.xxhash64(F.lit(11), F.col(cls)), of).cast("int"))
        return placed.withColumn(others, F.explode(F.sequence(F.lit(0), of - 1))).drop("held")

    cold = a.join(hot, "key", "left_anti").join(b.join(hot, "key", "left_anti"), "key")
    many = spread(a, "a", "__i", "__j").join(spread(b, "b", "__j", "__i"), ["key", "__i", "__j"]).drop("__i", "__j")
    return cold.unionByName(many).where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(records: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, rare: int = RARE, budget: int = BUDGET, spare: int = SPARE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((id, cls) members, (a, b, similarity) pairs of classes that are at least that similar).

    ``records`` has a unique id STRING, title and content. A class is a set of sequences that one
    or more records have; two classes of a pair are different sets. Empty tables give no rows.
    ``rare``, ``budget``, ``spare`` and ``block`` change the keys, never the result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    with tidy(records.sparkSession):
        rows = records.where(F.col("id").isNotNull()).select("id", "title", "content")
        blocks = materialize(rows.mapInArrow(_pack_udf(shingle, least_words), _BLOCK), "blocks")
        each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "classes")).alias("at", "m")).select("block", "at", F.col("m.ids").alias("id"), F.col("m.classes").alias("cls"))
        first = materialize(each.groupBy("cls").agg(F.min(F.struct("block", "at")).alias("w")).select("cls", "w.block", "w.at"), "classes")
        members = each.select("id", "cls").join(first.select("cls", _number(F.col("block"), F.col("at")).alias("number")), "cls").select("id", F.col("number").alias("cls"))
        chosen = first.groupBy("block").agg(F.collect_list("at").alias("chosen"))
        totals: list[DataFrame] = []
        counted = with_totals(blocks.drop("ids"), _tokens_of(shingle), "size", short=True, marked=True, keep=lambda df: totals.append(materialize(df, "totals")) or totals[0])
        counted = counted.join(chosen, "block")
        amount = blocks.agg(F.sum("size")).collect()[0][0] or 0
        bits = max(4, int(np.ceil(np.log2(max(1, amount / RANGE_KEYS)))))
        settings = (shingle, threshold, rare, budget, spare, block, bits)
        waves = max(1, min(WAVES, amount // RANGE_KEYS))
        parts = [counted.where(F.pmod(F.xxhash64("block"), F.lit(waves)) == w) for w in range(waves)]
        keys = reduce(DataFrame.unionByName, [materialize(part.mapInArrow(_keys_udf(*settings), _KEYS), "keys") for part in parts])
        hot = materialize(keys.where("often").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block), "hot")
        columns, sizes = ["key", "cls", "n", "bound", "wide"], keys.where(F.col("kind") == SET).select("cls", "n")
        alone, wide = (keys.where(F.col("kind") == kind).select(columns) for kind in (ALONE, COMMON))
        met = [_meetings(alone, alone, hot.where(F.col("kind") == ALONE).select("key", "held"), threshold, block)]
        if not wide.isEmpty():
            others = materialize(counted.mapInArrow(_keys_udf(*settings, rest=True), _KEYS).select(*columns, "often"), "others")
            every = wide.unionByName(others.select(columns))
            often = keys.where((F.col("kind") == COMMON) & F.col("often")).select("key").unionAll(others.where("often").select("key"))
            there = materialize(often.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block), "hot")
            met += [_meetings(wide, every, there, threshold, block), _meetings(others.select(columns), wide, there, threshold, block)]
        packed = keys.where(F.col("kind") == PACKED).select("key", "cls", "n", "tokens")
        release(totals[0])
        met_in = [materialize(packed.where(F.col("key") % waves == w).groupBy("key").applyInArrow(_meet_udf(block), "side tinyint, a bigint, b bigint"), "met") for w in range(waves)]
        packed = reduce(DataFrame.unionByName, met_in)
        met.append(packed.where(F.col("side") == PAIR).select("a", "b"))
        rows = packed.where(F.col("side") != PAIR).select("side", F.col("a").alias("key"), F.col("b").alias("cls"))
        if not rows.isEmpty():
            rows = materialize(rows.join(sizes, "cls").withColumn("bound", F.col("n")), "rows")
            there = rows.groupBy("key", "side").agg(F.count(F.lit(1)).alias("held")).groupBy("key").agg(F.max("held").alias("held"))
            met.append(_meetings(rows.where(F.col("side") == LARGER), rows.where(F.col("side") == SMALLER), there, threshold, block))
        pairs = reduce(DataFrame.unionByName, met).distinct()
        a, b = (keys.where(F.col("kind") == SET).select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bound").alias(f"total_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b").mapInArrow(_likely_udf(threshold), "a bigint, b bigint")
        pairs = materialize(pairs, "pairs")
        asked = materialize(pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct(), "asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST else asked
        sets = keys.where(F.col("kind") == SET).select("cls", "n", "tokens").join(asked, "cls", "left_semi")
        a, b = (sets.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
    return members, both.select("a", "b", "tokens_a", "tokens_b", "n_a", "n_b").mapInArrow(_similar_udf(threshold), "a bigint, b bigint, similarity double")


def near_copy_pairs(records: DataFrame, **settings) -> DataFrame:
    """(id_a, id_b, similarity): the pairs of records, records of equal sets included."""
    members, similar = near_copies(records, **settings)
    a, b = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    other = similar.join(a, "a").join(b, "b").select("x", "y", "similarity")
    same = pairs_within(members, ["cls"], "id").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("similarity"))
    return other.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def _current(spark, d):
    stored = spark.read.parquet(f"{d}/stored_documents.parquet")
    return current_rows(stored, {"title": F.col("title"), "content": F.col("content")})


def p2_found(spark, d):
    """Pairs of current records whose three-word sequences have 0.6 of their union in common."""
    return near_copy_pairs(_current(spark, d), shingle=3, threshold=0.6).select("id_a", "id_b")


def p2_links(spark, d):
    """Of each current record its class of equal sets (five words) and its links of 0.8 to other classes."""
    members, similar = near_copies(_current(spark, d))
    ends = similar.select(F.col("a").alias("cls")).unionAll(similar.select("b"))
    counts = ends.groupBy("cls").agg(F.count("*").alias("links"))
    first = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return members.join(first, "cls").join(counts, "cls", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p2_found": p2_found, "p2_links": p2_links}

SQL = {
    "p2_found": r"""WITH cur AS (SELECT id, coalesce(title, '') AS title, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST) AS r FROM stored_documents WHERE id IS NOT NULL) WHERE r = 1),
  w AS (SELECT id, regexp_extract_all(lower(title || chr(10) || coalesce(content, '')), '[\p{L}\p{N}]+') AS w FROM cur),
  s AS (SELECT DISTINCT id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT id, w, unnest(range(len(w) - 2)) AS i FROM w WHERE len(w) >= 20)),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p2_links": r"""WITH cur AS (SELECT id, coalesce(title, '') AS title, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST) AS r FROM stored_documents WHERE id IS NOT NULL) WHERE r = 1),
  w AS (SELECT id, regexp_extract_all(lower(title || chr(10) || coalesce(content, '')), '[\p{L}\p{N}]+') AS w FROM cur),
  s AS (SELECT DISTINCT id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT id, w, unnest(range(len(w) - 4)) AS i FROM w WHERE len(w) >= 20)),
  k AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY id), m AS (SELECT h, min(id) AS class_id, count(*) AS copies FROM k GROUP BY h),
  r AS (SELECT s.id, g, n FROM s JOIN k USING (id) JOIN m ON m.class_id = s.id),
  c AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id GROUP BY ALL HAVING count(*) >= 0.8 * (max(a.n) + max(b.n) - count(*)) - 1e-9), l AS (SELECT a, count(*) AS links FROM c GROUP BY a)
SELECT k.id, class_id, copies, coalesce(links, 0) AS links FROM k JOIN m USING (h) LEFT JOIN l ON l.a = class_id""",
}
