"""Problem 9: evaluation texts inside training texts, by suffix arrays over shards of the corpus.

Each task puts the words of a shard of documents in one row and sorts the places where a match can
begin by the words that follow (a suffix array, by prefix doubling). Every suffix of every
evaluation item is then found by binary search, all of them at once, and the matches that lie on
one diagonal are joined to the longest verbatim match. The corpus is read once per block of items
and never shuffled; only the hits are.

Words are maximal runs of letters and digits in lower case. An item matches if ``least`` of its
words in a row stand in the document, or all its words if it has fewer. Items and documents that
are null or without words match nothing.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm.arrow import share, shared, slices
from findwell.plans.scratch import materialize

LEAST = 12
SHARD_WORDS = 1 << 18
BLOCK_CHARS = 16_000_000  # of evaluation text broadcast at once; more items take more passes

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


class Items:
    """A block of evaluation items as word numbers; 0 stands for every word that no item has."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        ids, runs, heads = [], [], []
        for item, text in rows:
            run = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(0, len(run) - least) + 1 if run else 0):
                ids.append(item)
                heads.append((at, min(least, len(run))))
                runs.append(run[at : at + least] + [0] * max(0, least - len(run)))
        self.item = np.array(ids, dtype=np.int64)
        self.at = np.array([a for a, _ in heads], dtype=np.int64)
        self.need = np.array([n for _, n in heads], dtype=np.int64)
        self.words = np.array(runs, dtype=np.int32).reshape(len(runs), least)
        self.shortest = int(self.need.min()) if len(runs) else least


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` words from there on, by prefix doubling."""
    rank = words.astype(np.int64)
    reach = 1
    while reach < depth:
        behind = np.zeros_like(rank)
        behind[:-reach] = rank[reach:]
        key = rank * (int(rank.max()) + 1) + behind
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bounds(words: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """First place in the suffix array not below each item suffix, and first place above it."""
    found = []
    columns = np.arange(items.least)
    inside = columns < items.need[:, None]
    for upper in (False, True):
        low, high = np.zeros(len(items.item), dtype=np.int64), np.full(len(items.item), len(array), dtype=np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = array[np.minimum(mid, len(array) - 1)]
            differ = np.where(inside, words[at[:, None] + columns] - items.words, 0)
            first = np.argmax(differ != 0, axis=1)
            sign = np.sign(differ[np.arange(len(first)), first])
            right = open_ & ((sign < 0) | (upper & (sign == 0)))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        found.append(low)
    return found[0], found[1]


def search_shard(texts: list[list[int]], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, item, longest match in words) for the word numbers of a shard's documents."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = np.zeros(int(offsets[-1]) + 2 * items.least, dtype=np.int64)
    for o, t in zip(offsets, texts):
        words[o : o + len(t)] = t
    # A match can begin only where as many known words follow as the shortest item needs.
    unknown = np.concatenate([[0], np.cumsum(words == 0)])
    reach = np.arange(int(offsets[-1]))
    starts = reach[unknown[reach + items.shortest] == unknown[reach]]
    nothing = np.zeros(0, dtype=np.int64)
    if not len(starts) or not len(items.item):
        return nothing, nothing, nothing
    array = suffix_array(words, starts, items.least)
    low, high = _bounds(words, array, items)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return nothing, nothing, nothing
    place = array[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    doc = np.searchsorted(offsets, place, side="right") - 1
    # Matches of neighbouring suffixes on one diagonal of one document are one longer match.
    item, at, need = items.item[which], items.at[which], items.need[which]
    order = np.lexsort((at, place - at, item))
    item, at, need, doc, diagonal = item[order], at[order], need[order], doc[order], (place - at)[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    longest = need[head] + np.diff(np.concatenate([head, [len(new)]])) - 1
    return doc[head], item[head], longest


def _search_udf(items_ref):
    def run(batches):
        items = shared(Items, items_ref)
        number = items.vocabulary.get
        ids: list[int] = []
        texts: list[list[int]] = []
        held = 0

        def flush():
            doc, item, longest = search_shard(texts, items)
            keys = np.array(ids, dtype=np.int64)[doc] if len(doc) else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(item), pa.array(longest)], names=["doc_id", "item_id", "longest"])

        for batch in slices(batches, 1000):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and key is not None:
                    ids.append(key)
                    texts.append([number(w.lower(), 0) for w in _WORD.findall(text)])
                    held += len(texts[-1])
                if held >= SHARD_WORDS:
                    yield flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield flush()

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, chars: int):
    """The items in blocks of bounded size, so that a broadcast never grows with their number."""
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint"), F.col(text))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 16
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, longest): every document with a passage of an item, and the match's words.

    Items are a stated query set searched against all documents in blocks of bounded size. Rows
    with a null id are left out; ids that occur twice count once. Empty tables give no row.
    """
    if least < 1:
        raise ValueError("least must be positive")
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("bigint").alias("k"), F.col(text).alias("t"))
    schema = "doc_id bigint, item_id bigint, longest bigint"
    found, last = [], None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        if last is not None:  # several blocks: each is searched and its broadcast dropped before the next
            found[-1] = materialize(found[-1], "leaks")
            last.unpersist()
        last = share(spark, Items(block, least))
        found.append(rows.mapInArrow(_search_udf(last), schema))
    if not found:
        return spark.createDataFrame([], schema)
    hits = reduce(DataFrame.unionAll, found)
    return hits.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def remove_leaks(documents: DataFrame, leaks: DataFrame, doc_id="doc_id") -> DataFrame:
    """The documents without any leaked passage; rows with a null id stay."""
    bad = leaks.select(F.col("doc_id").alias("__leaked")).distinct()
    return documents.join(bad, F.col(doc_id) == F.col("__leaked"), "left_anti")


def _tables(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")


def p9_found(spark, d):
    """Documents that hold a passage of an evaluation item."""
    return find_leaks(*_tables(spark, d)).select("doc_id", "item_id")


def p9_report(spark, d):
    """Per item that leaked: in how many documents, and its longest verbatim match in words."""
    return find_leaks(*_tables(spark, d)).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest").alias("longest"))


def p9_clean(spark, d):
    """Ids of the documents that stay once every affected document is removed."""
    documents, benchmark = _tables(spark, d)
    return remove_leaks(documents.select("doc_id"), find_leaks(documents, benchmark))


QUERIES = {"p9_found": p9_found, "p9_report": p9_report, "p9_clean": p9_clean}

_HITS = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
  b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
  k AS (SELECT item_id, w, least(12, len(w)) AS k, unnest(range(len(w) - least(12, len(w)) + 1)) AS i FROM b WHERE len(w) > 0), g AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM k),
  s AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k), h AS (SELECT DISTINCT doc_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM s),
  hit AS (SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (k, g))"""

SQL = {
    "p9_found": f"WITH {_HITS} SELECT doc_id, item_id FROM hit",
    "p9_report": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
  b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
  k AS (SELECT item_id, w, least(12, len(w)) AS k, unnest(range(len(w) - least(12, len(w)) + 1)) AS q FROM b WHERE len(w) > 0), g AS (SELECT item_id, k, q, array_to_string(w[q + 1 : q + k], ' ') AS g FROM k),
  s AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k), h AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM s),
  m AS (SELECT DISTINCT doc_id, item_id, k, p - q AS diagonal, q FROM h JOIN g USING (k, g)),
  r AS (SELECT doc_id, item_id, k, count(*) AS run FROM (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, k, diagonal ORDER BY q) AS island FROM m) GROUP BY doc_id, item_id, k, diagonal, island)
SELECT item_id, count(DISTINCT doc_id) AS documents, max(k + run - 1)::BIGINT AS longest FROM r GROUP BY item_id""",
    "p9_clean": f"WITH {_HITS} SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM hit)",
}
