"""Problem 8: encoding a corpus with a byte-level BPE tokenizer by corpus-level merge replay.

The distinct words of a block of texts are laid out in one chain of symbols. An inverted index
leads from each token pair to the places where it stands; the merges are applied in rank order,
each to all its places at once, and only the neighbours of a merged pair are looked at again. The
ids of the words then replace the words in the texts. Each task replays the merges for the words
it hasn't met before, so nothing is shuffled and no vocabulary of the corpus is gathered.

Null and empty texts give an empty list; every other text, blank ones included, is encoded as it
is, and text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm.arrow import list_array, share, shared, slices

TOKENIZER = "byte_bpe_50k.json"
KEPT_WORDS = 400_000  # words whose ids a task remembers; beyond it starts anew, which costs time only


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of an installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files of byte-level BPE.

    Bytes that print in Latin-1 stand for themselves, the others for the characters from U+0100 on.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """The merges of a vocabulary: ids of the single bytes, and of each pair its rank and its id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.bytes = [ids[c] for c in byte_names()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.result = [ids[a + b] for a, b in pairs]


def replay(words: list[bytes], table: MergeTable) -> list[list[int]]:
    """The token ids of each word, found by replaying the merges over all words together."""
    single, rank_of, result = table.bytes, table.rank, table.result
    sym: list[int] = []
    starts = []
    for w in words:
        starts.append(len(sym))
        sym += [single[b] for b in w]
        sym.append(-1)  # ends the word; no pair holds it
    after = list(range(1, len(sym) + 1))
    before = list(range(-1, len(sym) - 1))
    places: dict[int, list[int]] = defaultdict(list)
    get = rank_of.get
    for p in range(len(sym) - 1):
        a, b = sym[p], sym[p + 1]
        if a >= 0 and b >= 0 and (r := get(a << 20 | b)) is not None:
            places[r].append(p)
    ranks = list(places)
    heapq.heapify(ranks)
    while ranks:
        rank = heapq.heappop(ranks)
        new = result[rank]
        for p in sorted(places.pop(rank)):
            q = after[p]
            if sym[p] < 0 or sym[q] < 0 or get(sym[p] << 20 | sym[q]) != rank:
                continue  # a neighbour took one of the two
            sym[p], sym[q] = new, -2
            after[p] = n = after[q]
            before[n] = p
            if (b := sym[n]) >= 0 and (r := get(new << 20 | b)) is not None:
                if r not in places:
                    heapq.heappush(ranks, r)
                places[r].append(p)
            o = before[p]
            if o >= 0 and (a := sym[o]) >= 0 and (r := get(a << 20 | new)) is not None:
                if r not in places:
                    heapq.heappush(ranks, r)
                places[r].append(o)
    ends = [*starts[1:], len(sym)]
    return [[s for s in sym[a:b] if s >= 0] for a, b in zip(starts, ends)]


def _encode_udf(table_ref, pattern: str):
    def run(batches):
        import regex

        table, find = shared(MergeTable, table_ref), regex.compile(pattern).findall
        known: dict[str, list[int]] = {}
        for batch in slices(batches, 400):
            texts = batch.column("__text").to_pylist()
            parts = [find(t) if t else [] for t in texts]
            fresh = list(set(chain.from_iterable(parts)).difference(known))
            if len(known) > KEPT_WORDS:
                known, fresh = {}, list(set(chain.from_iterable(parts)))
            known.update(zip(fresh, replay([w.encode() for w in fresh], table)))
            get, lengths, flat = known.__getitem__, [], []
            for words in parts:
                at = len(flat)
                flat.extend(chain.from_iterable(map(get, words)))
                lengths.append(len(flat) - at)
            ids = list_array(lengths, np.fromiter(flat, dtype=np.int32, count=len(flat)), pa.int32())
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], ids], names=[*names, "ids"])

    return run


def encode_texts(df: DataFrame, text: str, keep: list[str], path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` and ids ARRAY<INT>, row by row. The vocabulary, of fixed size, is broadcast.

    ``path`` is the file of a byte-level BPE tokenizer and ``pattern`` what splits its text into
    words; both default to the installed byte_bpe_50k.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    table = share(df.sparkSession, MergeTable(path or tokenizer_path()))
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", ids array<int>"
    return rows.mapInArrow(_encode_udf(table, pattern), schema)


def p8_ids(spark, d):
    """The ids of every document's text by byte_bpe_50k, without special tokens."""
    return encode_texts(spark.read.parquet(f"{d}/documents.parquet"), "text", ["doc_id"])


QUERIES = {"p8_ids": p8_ids}
