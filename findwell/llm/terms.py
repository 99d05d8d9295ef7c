"""Problem 4: how distinctive a term is for a record.

Weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)), the probabilistic
relevance weighting: tf saturates with k1 and longer records are discounted with b. An infinite k1
is its limit without saturation or discount, where the weight is idf * tf. The idf is either
``probabilistic``, ln(1 + (N - df + 0.5) / (df + 0.5)), or ``plain``, ln(N / df).

Terms are words of three or more letters without digits in title and content, in lower case. The
document frequencies and the average length come from all current records. A record without
terms counts in N and has no rows; a null title or content is an empty one. Ties keep all terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm.arrow import list_array, slices
from findwell.llm.blocks import WORD, WordHashes, numbers, totals_of, with_totals
from findwell.operators.state import current_rows
from findwell.plans.scratch import materialize

BLOCK_TERMS = 400_000
_SCHEMA = "block bigint, ids array<string>, held array<int>, lengths array<int>, terms array<int>, tf array<int>, words array<string>, size bigint, length_sum bigint, records bigint"


def terms_of(title: str | None, content: str | None) -> Counter:
    """Term counts of a record."""
    words = map(str.lower, WORD.findall(f"{title or ''}\n{content or ''}"))
    return Counter(w for w in words if len(w) >= 3 and w.isalpha())


def _pack_udf():
    def run(batches):
        from pyspark import TaskContext

        hashes, part = WordHashes(), TaskContext.get().partitionId()
        number, ids, bags, size = 0, [], [], 0

        def pack():
            words = sorted({w for b in bags for w in b}, key=hashes.__getitem__)
            place = {w: i for i, w in enumerate(words)}
            flat, tf = [place[w] for b in bags for w in b], [n for b in bags for n in b.values()]
            sums = [sum(b.values()) for b in bags]
            columns = [
                pa.array([part << 32 | number], pa.int64()), list_array([len(ids)], pa.array(ids, pa.string()), pa.string()),
                list_array([len(bags)], [len(b) for b in bags], pa.int32()), list_array([len(bags)], sums, pa.int32()),
                list_array([len(flat)], flat, pa.int32()), list_array([len(tf)], tf, pa.int32()), list_array([len(words)], words, pa.string()),
                pa.array([len(words)], pa.int64()), pa.array([sum(sums)], pa.int64()), pa.array([len(ids)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in slices(batches, 512):
            for key, title, content in zip(*[c.to_pylist() for c in batch.columns]):
                ids.append(key)
                bags.append(terms_of(title, content))
                size += len(bags[-1])
                if size >= BLOCK_TERMS:
                    yield pack()
                    number, ids, bags, size = number + 1, [], [], 0
        if ids:
            yield pack()

    return run


def _tokens(batch, i):
    hashes = WordHashes()
    tokens = np.array([hashes[w] for w in batch.column("words")[i].as_py()], dtype=np.uint64)
    held = np.bincount(numbers(batch, "terms", i, np.int64), minlength=len(tokens))
    return batch.column("block")[i].as_py(), tokens, held


def _weigh_udf(records, average, k1, b, idf, least_held, select):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                df_of_word = totals_of(batch, i)
                term, tf = numbers(batch, "terms", i, np.int64), numbers(batch, "tf", i, np.float64)
                held, length = numbers(batch, "held", i, np.int64), numbers(batch, "lengths", i, np.float64)
                doc = np.repeat(np.arange(len(held)), held)
                df = df_of_word[term].astype(np.float64)
                rarity = np.log(records / df) if idf == "plain" else np.log1p((records - df + 0.5) / (df + 0.5))
                damped = tf if np.isinf(k1) else tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / average))
                weight = np.round(damped * rarity, 6)
                keep = df >= least_held
                if select is not None:
                    best = np.full(len(held), -np.inf)
                    np.maximum.at(best, doc[keep], weight[keep])
                    keep &= (weight == best[doc]) & (df >= select[0]) & (df <= select[1])
                at = np.flatnonzero(keep)
                for cut in range(0, len(at), 50_000):
                    k = at[cut : cut + 50_000]
                    ids, words = (batch.column(n)[i].values.take(pa.array(x)) for n, x in (("ids", doc[k]), ("words", term[k])))
                    yield pa.RecordBatch.from_arrays([ids, words, pa.array(tf[k].astype(np.int32)), pa.array(df[k].astype(np.int64)), pa.array(weight[k])], names=["id", "term", "tf", "df", "weight"])

    return run


def term_weights(stored: DataFrame, k1: float = 1.2, b: float = 0.75, idf: str = "probabilistic", least_held: int = 1, best_held: tuple[int, int] | None = None) -> DataFrame:
    """(id, term, tf, df, weight) of the terms of all current records, weights rounded to 6 decimals.

    Terms that fewer than ``least_held`` records hold are left out. With ``best_held`` = (low, high)
    only each record's terms of greatest weight come out, if from low to high records hold them.
    """
    now = current_rows(stored, {"title": F.col("title"), "content": F.col("content")}).select("id", "title", "content")
    blocks = materialize(now.mapInArrow(_pack_udf(), _SCHEMA), "terms")
    records, words = blocks.agg(F.sum("records"), F.sum("length_sum")).collect()[0]
    records = records or 0
    average = max(1.0, (words or 0) / max(1, records))
    weighed = with_totals(blocks, _tokens, "size").select("ids", "held", "lengths", "terms", "tf", "words", "totals")
    return weighed.mapInArrow(_weigh_udf(records, average, k1, b, idf, least_held, best_held), "id string, term string, tf int, df bigint, weight double")


def p4_found(spark, d):
    """The terms of greatest weight of each record, if two to eight records hold them."""
    stored = spark.read.parquet(f"{d}/stored_documents.parquet")
    return term_weights(stored, k1=float("inf"), idf="plain", least_held=2, best_held=(2, 8)).select("id", "term")


def p4_weights(spark, d):
    """The probabilistic weight of every term of every current record."""
    return term_weights(spark.read.parquet(f"{d}/stored_documents.parquet"))


QUERIES = {"p4_found": p4_found, "p4_weights": p4_weights}

_COUNTS = r"""cur AS (SELECT id, coalesce(title, '') AS title, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST) AS r FROM stored_documents WHERE id IS NOT NULL) WHERE r = 1),
  t AS (SELECT id, unnest(regexp_extract_all(lower(title || chr(10) || coalesce(content, '')), '[\p{L}\p{N}]+')) AS term FROM cur),
  tf AS (SELECT id, term, count(*)::INT AS tf FROM t WHERE regexp_full_match(term, '\p{L}{3,}') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(*) AS n, (SELECT sum(tf) FROM tf) / count(*)::DOUBLE AS av FROM cur), len AS (SELECT id, sum(tf) AS len FROM tf GROUP BY id)"""

SQL = {
    "p4_found": f"""WITH {_COUNTS}, w AS (SELECT id, term, df, round(tf * ln(n / df::DOUBLE), 6) AS w FROM tf JOIN df USING (term), n WHERE df > 1)
SELECT id, term FROM (SELECT *, max(w) OVER (PARTITION BY id) AS m FROM w) WHERE w = m AND df BETWEEN 2 AND 8""",
    "p4_weights": f"""WITH {_COUNTS} SELECT id, term, tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)), 6) AS weight FROM tf JOIN df USING (term) JOIN len USING (id), n""",
}
