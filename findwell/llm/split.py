"""Problem 1: splitting oversized texts at natural boundaries.

Words are runs without blanks, tabs, CR and LF, numbered from 0. A piece ends at a paragraph end,
else at a sentence end, else at the limit; the next piece repeats its last ``overlap`` words.
Which of several ends of the same kind is taken is the policy:

``deepest``  lexical cohesion: the similarity of the blocks of words before and after each possible
             end is followed through the window, and the end at the deepest valley is taken (the
             later one if valleys tie).
``last``     the last one, which makes the pieces as long as possible.

Nulls give no piece, texts within the limit give none unless ``whole`` asks for the single piece.
"""

from __future__ import annotations

import re
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm.arrow import list_array, slices
from findwell.operators.state import current_rows

LIMIT, FLOOR, OVERLAP, BLOCK = 200, 100, 20, 20

_WORD = re.compile(r"[^ \t\r\n]+")
_SENTENCE_END = re.compile(r"""[.!?]["')\]]?\Z""")
_LETTERS = re.compile(r"[^\W\d_]{3,}")


class Cohesion:
    """Cosine of the counts of terms of the blocks of words that meet after a word.

    The two blocks are slid from end to end: a step moves one word into each and one out, so a
    text costs as much as it has words, whatever the size of the blocks.
    """

    def __init__(self, words: list[str], block: int):
        self.terms = [_LETTERS.findall(w.lower()) for w in words]
        self.block, self.end = block, -1
        self.before: Counter = Counter()
        self.after: Counter = Counter()
        self.dot = self.square_before = self.square_after = 0
        for i in range(min(block, len(words))):
            self._add(i, 1, False)

    def _add(self, i: int, sign: int, before: bool) -> None:
        """Put a word into one of the blocks, or take it out."""
        mine, other = (self.before, self.after) if before else (self.after, self.before)
        for t in self.terms[i]:
            n = mine[t]
            square = (2 * n + sign) * sign
            if before:
                self.square_before += square
            else:
                self.square_after += square
            mine[t] = n + sign
            self.dot += sign * other[t] if t in other else 0

    def at(self, end: int) -> float:
        """The cosine of the blocks before and after the end of word ``end``."""
        if end < self.end:  # the next piece begins behind the end of the last one
            self._rewind(end)
        while self.end < end:
            self.end += 1
            here = self.end
            self._add(here, -1, False)
            self._add(here, 1, True)
            if here + self.block < len(self.terms):
                self._add(here + self.block, 1, False)
            if here - self.block >= 0:
                self._add(here - self.block, -1, True)
        return self.dot / sqrt(self.square_before * self.square_after) if self.dot else 0.0

    def _rewind(self, end: int) -> None:
        """The blocks around an earlier end, from nothing."""
        self.before, self.after = Counter(), Counter()
        self.dot = self.square_before = self.square_after = 0
        self.end = end
        for i in range(max(0, end + 1 - self.block), end + 1):
            self._add(i, 1, True)
        for i in range(end + 1, min(len(self.terms), end + 1 + self.block)):
            self._add(i, 1, False)


def deepest_valley(similar: list[float]) -> int:
    """Place of the deepest valley: the largest sum of climbs to the nearest peak on either side."""
    best, place = -1.0, 0
    for i, here in enumerate(similar):
        left = right = here
        for x in reversed(similar[:i]):
            if x < left:
                break
            left = x
        for x in similar[i + 1 :]:
            if x < right:
                break
            right = x
        if (depth := left + right - 2 * here) >= best:
            best, place = depth, i
    return place


def split_words(text: str, limit: int = LIMIT, floor: int = FLOOR, overlap: int = OVERLAP, policy: str = "last", block: int = BLOCK):
    """(spans of the words, [(first, last), ...] of the pieces) of one text.

    A piece holds at most ``limit`` words and, unless it is the last one, more than ``floor``.
    """
    if not 0 <= overlap <= floor < limit:
        raise ValueError("0 <= overlap <= floor < limit is needed")
    spans = [m.span() for m in _WORD.finditer(text)]
    pieces, start, n, cohesion = [], 0, len(spans), None
    while n - start > limit:
        ends = range(start + floor, start + limit)
        paragraphs = [e for e in ends if text.count("\n", spans[e][1], spans[e + 1][0]) >= 2]
        choice = paragraphs or [e for e in ends if _SENTENCE_END.search(text, max(spans[e][0], spans[e][1] - 2), spans[e][1])]
        if policy == "deepest":
            cohesion = cohesion or Cohesion([text[a:b] for a, b in spans], block)
            choice = choice or list(ends)
            end = choice[deepest_valley([cohesion.at(e) for e in choice])]
        else:
            end = choice[-1] if choice else ends[-1]
        pieces.append((start, end))
        start = end + 1 - overlap
    if n:
        pieces.append((start, n - 1))
    return spans, pieces


def _pieces_udf(limit, floor, overlap, policy, whole, with_text):
    fields = [pa.field("first_word", pa.int32()), pa.field("last_word", pa.int32())] + [pa.field("content", pa.string())] * with_text

    def run(batches):
        for batch in slices(batches, 512):
            counts, first, last, parts = [], [], [], []
            for text in batch.column("__text").to_pylist():
                spans, pieces = split_words(text, limit, floor, overlap, policy) if text else ([], [])
                if len(spans) <= limit and not whole:
                    pieces = []
                counts.append(len(pieces))
                first += [a for a, _ in pieces]
                last += [b for _, b in pieces]
                if with_text:
                    parts += [text[spans[a][0] : spans[b][1]] for a, b in pieces]
            values = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())] + [pa.array(parts, pa.string())] * with_text, fields=fields)
            names = [n for n in batch.schema.names if n != "__text"]
            columns = [batch.column(n) for n in names] + [list_array(counts, values, values.type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "pieces"])

    return run


def split_texts(df: DataFrame, text: str, keep: list[str], limit: int = LIMIT, floor: int = FLOOR, overlap: int = OVERLAP, policy: str = "last", whole: bool = False, with_text: bool = True) -> DataFrame:
    """``keep`` and the column pieces: array of (first_word, last_word[, content]) per row.

    Row by row, without a shuffle; whole texts of any length are cut. A null or blank text has
    no pieces, nor has one of at most ``limit`` words unless ``whole``. Texts too short in
    characters to pass the limit aren't sent to Python.
    """
    t = F.col(text) if whole else F.when(F.length(text) > 2 * limit, F.col(text))
    rows = df.select(*keep, t.alias("__text"))
    kind = "array<struct<first_word:int,last_word:int" + (",content:string" if with_text else "") + ">>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + f", pieces {kind}"
    return rows.mapInArrow(_pieces_udf(limit, floor, overlap, policy, whole, with_text), schema)


def current_pieces(stored: DataFrame, policy: str = "last", with_text: bool = False, **sizes) -> DataFrame:
    """(id, chunk_index, first_word, last_word[, content]) of the current contents over the limit.

    Every state is cut where it lies and only its pieces are shuffled to find the current state of
    the id, so contents never move. Ids without an oversized current content give no row.
    """
    cut = split_texts(stored, "content", ["id", "updated_at", "created_at"], policy=policy, with_text=with_text, **sizes)
    rows = current_rows(cut, {"pieces": F.col("pieces")}).select("id", F.posexplode("pieces").alias("chunk_index", "p"))
    return rows.select("id", "chunk_index", "p.*")


def p1_found(spark, d):
    """Pieces of every current content of more than 200 words, by their word numbers."""
    return current_pieces(spark.read.parquet(f"{d}/stored_documents.parquet"))


def p1_topics(spark, d):
    """The same contents cut at the deepest valleys of lexical cohesion, with the pieces' text."""
    return current_pieces(spark.read.parquet(f"{d}/stored_documents.parquet"), policy="deepest", with_text=True)


QUERIES = {"p1_found": p1_found, "p1_topics": p1_topics}

SQL = {
    "p1_found": r"""WITH RECURSIVE cur AS (SELECT id, coalesce(title, '') AS title, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST) AS r FROM stored_documents WHERE id IS NOT NULL) WHERE r = 1),
  w AS (SELECT id, regexp_extract_all(content, '[^ \t\r\n]+[ \t\r\n]*', 0) AS w FROM cur),
  e AS (SELECT id, len(w) AS n, list_filter(range(len(w)), lambda i: length(w[i + 1]) - length(replace(w[i + 1], chr(10), '')) >= 2) AS pe,
    list_filter(range(len(w)), lambda i: regexp_matches(w[i + 1], '[.!?]["'')\]]?[ \t\r\n]*$')) AS se FROM w WHERE len(w) > 200),
  p AS (SELECT id, n, pe, se, 0 AS chunk_index, 0::BIGINT AS s,
      CASE WHEN n <= 200 THEN n - 1 ELSE coalesce(list_max(list_filter(pe, lambda x: x BETWEEN 100 AND 199)), list_max(list_filter(se, lambda x: x BETWEEN 100 AND 199)), 199) END AS t FROM e
    UNION ALL SELECT id, n, pe, se, chunk_index + 1, t - 19,
      CASE WHEN n - (t - 19) <= 200 THEN n - 1 ELSE coalesce(list_max(list_filter(pe, lambda x: x BETWEEN t + 81 AND t + 180)), list_max(list_filter(se, lambda x: x BETWEEN t + 81 AND t + 180)), t + 180) END FROM p WHERE t < n - 1)
SELECT id, chunk_index::INT AS chunk_index, s::INT AS first_word, t::INT AS last_word FROM p""",
    "p1_topics": r"""WITH RECURSIVE cur AS (SELECT id, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST) AS r FROM stored_documents WHERE id IS NOT NULL) WHERE r = 1),
  w AS (SELECT id, regexp_extract_all(content, '[^ \t\r\n]+[ \t\r\n]*', 0) AS w FROM cur), l AS (SELECT id, len(w) AS n, w FROM w WHERE len(w) > 200),
  x AS (SELECT id, n, unnest(range(n)) AS i, unnest(w) AS word FROM l),
  tok AS (SELECT id, n, i, unnest(regexp_extract_all(lower(regexp_extract(word, '^[^ \t\r\n]+')), '[\p{L}\p{Nl}\p{No}]{3,}')) AS t FROM x),
  a AS (SELECT id, e, t, count(*) AS m FROM (SELECT id, n, t, i + unnest(range(20)) AS e FROM tok) WHERE e < n - 1 GROUP BY ALL),
  b AS (SELECT id, e, t, count(*) AS m FROM (SELECT id, t, i - unnest(range(1, 21)) AS e FROM tok) WHERE e >= 0 GROUP BY ALL),
  na AS (SELECT id, e, sum(m * m)::BIGINT AS q FROM a GROUP BY ALL), nb AS (SELECT id, e, sum(m * m)::BIGINT AS q FROM b GROUP BY ALL),
  dot AS (SELECT a.id, a.e, sum(a.m * b.m)::BIGINT AS d FROM a JOIN b ON a.id = b.id AND a.e = b.e AND a.t = b.t GROUP BY ALL),
  c AS (SELECT x.id, x.i AS e, CASE WHEN length(word) - length(replace(word, chr(10), '')) >= 2 THEN 2 WHEN regexp_matches(word, '[.!?]["'')\]]?[ \t\r\n]*$') THEN 1 ELSE 0 END AS kind,
    coalesce(d / sqrt((na.q * nb.q)::DOUBLE), 0.0) AS v FROM x LEFT JOIN dot ON dot.id = x.id AND dot.e = x.i LEFT JOIN na ON na.id = x.id AND na.e = x.i LEFT JOIN nb ON nb.id = x.id AND nb.e = x.i),
  g AS (SELECT id, list(kind ORDER BY e) AS kind, list(v ORDER BY e) AS v FROM c GROUP BY id), z AS (SELECT g.*, l.n, l.w FROM g JOIN l USING (id)),
  p AS (SELECT id, -1 AS chunk_index, 0::BIGINT AS s, 19::BIGINT AS t FROM z
    UNION ALL SELECT id, chunk_index + 1, s, CASE WHEN n - s <= 200 THEN n - 1 ELSE list_reverse(es)[list_position(list_reverse(depth), list_max(depth))] END FROM (
      SELECT *, list_transform(range(1, len(vs) + 1), lambda i: vs[coalesce(list_max(list_filter(range(1, i), lambda k: vs[k] < vs[k + 1])), 0) + 1] + vs[coalesce(list_min(list_filter(range(i, len(vs)), lambda k: vs[k + 1] < vs[k])), len(vs))] - 2 * vs[i]) AS depth FROM (
      SELECT *, list_transform(es, lambda e: v[e + 1]) AS vs FROM (
      SELECT *, CASE WHEN len(p2) > 0 THEN p2 WHEN len(p1) > 0 THEN p1 ELSE range(s + 100, s + 200) END AS es FROM (
      SELECT *, list_filter(range(s + 100, s + 200), lambda e: kind[e + 1] = 1) AS p1, list_filter(range(s + 100, s + 200), lambda e: kind[e + 1] = 2) AS p2 FROM (
      SELECT p.id, chunk_index, t - 19 AS s, n, kind, v FROM p JOIN z USING (id) WHERE t < n - 1))))))
SELECT p.id, chunk_index::INT AS chunk_index, s::INT AS first_word, t::INT AS last_word, rtrim(array_to_string(w[s + 1 : t + 1], ''), chr(32) || chr(9) || chr(10) || chr(13)) AS content FROM p JOIN z USING (id) WHERE chunk_index >= 0""",
}
