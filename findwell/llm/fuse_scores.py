"""Problem 3: one ranking from several scores on different scales.

Each score is replaced by its rank within the group, from 0 (lowest) to 1. The correlation matrix
of these ranks is one distributed aggregate, each pair of scores over the rows that hold both; its
first principal component, turned so that the scores count in their declared directions on the
whole, gives the loadings, and items are ordered by their projection on it. A score that goes
against the others keeps the loading that the component gives it, even one against its direction.

A null or NaN score is the lowest, tied with the other nulls of its group; a score missing from a whole
group moves nothing there. A hit stored again counts once, with the greatest of each score. Rows
with a null group or item are left out. Ties in the end go to the smaller item. Empty tables
give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findwell.plans.scratch import materialize

HOT_ROWS = 100_000  # rows of a group, or of one value of it, that a single task may hold
BROADCAST = 10_000  # groups listed to all tasks; more are joined as a table
_BOUNDS = [i / 64 for i in range(1, 64)]


def _plain_ranks(df: DataFrame, group: str, scores: list[str]) -> DataFrame:
    whole = Window.partitionBy(group)
    rank = {s: F.rank().over(whole.orderBy(F.col(s).asc_nulls_first())).cast("bigint") - 1 for s in scores}
    return df.withColumns({f"__r_{s}": c for s, c in rank.items()} | {"__n": F.count(F.lit(1)).over(whole)})


def _split_ranks(df: DataFrame, group: str, scores: list[str], few: bool, hot_rows: int) -> DataFrame:
    """The same ranks for groups too large for one task: counted by value, summed by ranges of values.

    Nulls have rank 0 and are joined with nothing; a value that very many rows hold is looked up in a
    table of such values alone, small enough to be sent to all tasks, so that it is no join key.
    """
    small = F.broadcast if few else (lambda x: x)
    out = df.join(small(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))), group)
    for s in scores:
        counts = df.where(F.col(s).isNotNull()).groupBy(F.col(group), F.col(s).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        bounds = df.groupBy(group).agg(F.percentile_approx(s, _BOUNDS, 1000).alias("__b"), F.count_if(F.col(s).isNull()).alias("__nulls"))
        part = F.size(F.filter("__b", lambda x: x < F.col("__v")))
        placed = counts.join(small(bounds), group).withColumn("__p", part).drop("__b")
        sums = placed.groupBy(group, "__p").agg(F.sum("__c").alias("__s"))
        before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__below", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
        within = Window.partitionBy(group, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
        ranks = placed.withColumn("__w", F.coalesce(F.sum("__c").over(within), F.lit(0))).join(small(sums), [group, "__p"])
        name = f"__r_{s}"
        ranks = ranks.select(F.col(group).alias("__g"), "__v", "__c", (F.col("__nulls") + F.col("__below") + F.col("__w")).alias(name))
        held = (F.col(group) == F.col("__g")) & (F.col(s) == F.col("__v"))
        columns = [*out.columns, name]
        nulls = out.where(F.col(s).isNull()).withColumn(name, F.lit(0).cast("bigint"))
        seen = out.where(F.col(s).isNotNull()).join(ranks.where(F.col("__c") > hot_rows), held, "left").drop("__g", "__v", "__c")
        rest = seen.where(F.col(name).isNull()).drop(name).join(ranks.where(F.col("__c") <= hot_rows), held)
        out = nulls.select(columns).unionByName(seen.where(F.col(name).isNotNull()).select(columns)).unionByName(rest.select(columns))
    return out


def _without_copies(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    return df.groupBy(group, item).agg(*[F.max(s).alias(s) for s in scores])


def rank_within(df: DataFrame, group: str, scores: list[str], hot_rows: int = HOT_ROWS, item: str | None = None) -> DataFrame:
    """``df`` with rank_<score> in [0, 1] within the group: ties share the lowest, nulls are lowest.

    With ``item`` the rows of a group and item are one first, with the greatest of each score.
    Groups of more than ``hot_rows`` rows are ranked in parts that no single task holds whole. All
    others are moved once, by group.
    """
    hot = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(group), "hot")
    many = hot.count()
    once = (lambda x: _without_copies(x, group, item, scores)) if item else (lambda x: x)
    if many:
        listed = F.broadcast(hot) if many <= BROADCAST else hot
        large, small = df.join(listed, group, "left_semi"), df.join(listed, group, "left_anti")
        ranked = _split_ranks(once(large), group, scores, many <= BROADCAST, hot_rows).unionByName(_plain_ranks(once(small.repartition(group)), group, scores))
    else:
        ranked = _plain_ranks(once(df.repartition(group)), group, scores)
    share = {f"rank_{s}": F.coalesce(F.try_divide(F.col(f"__r_{s}"), F.col("__n") - 1), F.lit(0.0)) for s in scores}
    return ranked.withColumns(share).drop("__n", *[f"__r_{s}" for s in scores])


def component(ranks: DataFrame, scores: list[str], directions: list[int]) -> np.ndarray:
    """Loadings of the first principal component of the ranks' correlation matrix, oriented.

    ``ranks`` has rank_<score> and has_<score>. Two scores are correlated over the rows that hold both;
    scores that no two rows hold together, or one that is the same everywhere, go with none.
    """
    n = len(scores)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    turned = [F.col(f"rank_{s}") * d for s, d in zip(scores, directions)]
    moments = []
    for i, j in pairs:
        x, y = (F.when(F.col(f"has_{scores[i]}") & F.col(f"has_{scores[j]}"), t) for t in (turned[i], turned[j]))
        moments += [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    row = [0.0 if m is None or np.isnan(m) else m for m in ranks.agg(*moments).collect()[0]] if pairs else []
    matrix = np.eye(n)
    for k, (i, j) in enumerate(pairs):
        together, x, y = row[3 * k : 3 * k + 3]
        if x > 0 and y > 0:
            matrix[i, j] = matrix[j, i] = together / (x * y)
    first = np.linalg.eigh(matrix)[1][:, -1]
    if not (matrix - np.eye(n)).any():  # nothing goes with anything: no direction is the first
        first = np.full(n, 1 / np.sqrt(n))
    return (first if first.sum() >= 0 else -first) * np.array(directions)


def fused_ranking(df: DataFrame, group: str, item: str, scores: list[str], directions: list[int] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, fused) for every item of every group; a greater ``fused`` comes first.

    ``directions`` declares for each score whether more is better (1) or worse (-1).
    """
    directions = directions or [1] * len(scores)
    number = lambda s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group), F.col(item), *[number(s).alias(s) for s in scores])
    held = [F.col(s).isNotNull().alias(f"has_{s}") for s in scores]
    ranks = materialize(rank_within(rows, group, scores, hot_rows, item).select(group, item, *[f"rank_{s}" for s in scores], *held), "ranks")
    loads = component(ranks, scores, directions)
    fused: Column = reduce(lambda a, b: a + b, [F.col(f"rank_{s}") * float(x) for s, x in zip(scores, loads)])
    return ranks.select(group, item, F.round(fused, 9).alias("fused"))


SCORES = ["keyword_score", "semantic_score", "score"]


def _fused(spark, d):
    return fused_ranking(spark.read.parquet(f"{d}/search_results.parquet"), "search_id", "document_id", SCORES)


def p3_found(spark, d):
    """The first document of each search by the first component of its three ranked scores."""
    best = _fused(spark, d).groupBy("search_id").agg(F.min(F.struct((-F.col("fused")).alias("f"), "document_id")).alias("b"))
    return best.select("search_id", "b.document_id")


def p3_ranking(spark, d):
    """The order of each search's documents by the first component; place 0 is first."""
    placed = rank_within(_fused(spark, d).withColumn("back", -F.col("fused")), "search_id", ["back"])
    return placed.select("search_id", "document_id", "fused", F.round("rank_back", 9).alias("place"))


QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}

_HITS = """h AS (SELECT search_id, document_id, max(keyword_score) AS k, max(semantic_score) AS s, max(score) AS c FROM search_results WHERE search_id IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL),
  r AS (SELECT search_id, document_id, k, s, c, percent_rank() OVER (PARTITION BY search_id ORDER BY k NULLS FIRST) AS rk, percent_rank() OVER (PARTITION BY search_id ORDER BY s NULLS FIRST) AS rs, percent_rank() OVER (PARTITION BY search_id ORDER BY c NULLS FIRST) AS rc FROM h)"""

SQL = {
    "p3_found": f"""WITH {_HITS} SELECT search_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(rk + rs + rc, 9) DESC, document_id) AS p FROM r) WHERE p = 1""",
    "p3_ranking": f"""WITH RECURSIVE {_HITS},
  m AS (SELECT corr(rk, rs) FILTER (k IS NOT NULL AND s IS NOT NULL) AS ks, corr(rk, rc) FILTER (k IS NOT NULL AND c IS NOT NULL) AS kc, corr(rs, rc) FILTER (s IS NOT NULL AND c IS NOT NULL) AS sc FROM r),
  p AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c UNION ALL
    SELECT i + 1, x / sqrt(x * x + y * y + z * z), y / sqrt(x * x + y * y + z * z), z / sqrt(x * x + y * y + z * z) FROM (SELECT i, a + ks * b + kc * c AS x, ks * a + b + sc * c AS y, kc * a + sc * b + c AS z FROM p, m WHERE i < 1000)),
  f AS (SELECT search_id, document_id, round(rk * a + rs * b + rc * r.c1, 9) AS fused FROM (SELECT r.search_id, r.document_id, rk, rs, rc, p.a, p.b, p.c AS c1 FROM r, p WHERE p.i = 1000) r)
SELECT search_id, document_id, fused, round(percent_rank() OVER (PARTITION BY search_id ORDER BY -fused), 9) AS place FROM f""",
}
