"""Queries that take whole tables, against brute force on small ones."""

import datetime

import pytest

from findwell import suite

TITLES = ["für été", "fur", "x86", "x87 straße", "données", "donnees", "Привет", "привёт", "検索", "検査", "v1.2", "naïve", "ab", "ba", "abc"]
ASKED = ["fúr étè", "x88 straβe", "donneés", "приветт", "検案 ab", "v1.3, naive", "well-known x86", "zzzzzzzzz", "abd"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, t = str(tmp_path_factory.mktemp("tables")), datetime.datetime(2025, 1, 1)
    stored = [(f"d{k}", title, f"word{k} fur, {title}", None, t, t) for k, title in enumerate(TITLES)]
    spark.createDataFrame(stored, "id string, title string, content string, metadata string, created_at timestamp, updated_at timestamp").write.parquet(f"{d}/stored_documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query_text string").write.parquet(f"{d}/search_queries.parquet")
    return d


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def run(spark, tables, name):
    return [tuple(r) for r in suite.queries()[name](spark, tables).collect()]


def test_fuzzy_terms_of_the_whole_vocabulary(spark, tables):
    vocabulary, asked = ({r["term"] for r in suite.queries()[name](spark, tables).collect()} for name in ("q_vocabulary", "q_corpus_stats"))
    assert {"été", "x87", "検索", "v1.2", "naïve"} <= vocabulary and {"étè", "x88", "known", "v1.3"} <= asked
    got = run(spark, tables, "q_fuzzy_terms")
    want = {(a, t) for a in asked for t in vocabulary if edits(a, t) <= 2}
    assert set(got) == want and len(got) == len(want)
    assert {("étè", "été"), ("x88", "x86"), ("приветт", "привёт"), ("検案", "検索"), ("naive", "naïve")} <= want


def best(word, known):
    near = [(t, edits(word, t), n) for t, n in known.items() if t != word and edits(word, t) <= 2]
    return sorted(near, key=lambda x: (-x[2] / (x[1] + 1.0), x[0].encode()))


def test_suggestions_from_the_whole_vocabulary(spark, tables):
    known, words = dict(run(spark, tables, "q_term_df")), {w for q in ASKED for w in q.split()}
    want = {(w, t, e, n, n / (e + 1.0), k) for w in words - set(known) for k, (t, e, n) in enumerate(best(w, known)[:3], 1)}
    got = run(spark, tables, "q_suggest")
    assert set(got) == want and len(got) == len(want)
    assert {"fúr", "étè", "donneés", "приветт", "検案", "v1.3,"} <= {x[0] for x in want}


def test_all_queries_are_checked(spark, tables):
    known, want = dict(run(spark, tables, "q_term_df")), set()
    for k, q in enumerate(ASKED):
        near = {w: best(w, known) for w in q.split() if w not in known}
        want.add((k, " ".join(near[w][0][0] if near.get(w) else w for w in q.split()), " ".join(w for w in q.split() if w in near)))
    assert set(run(spark, tables, "q_spell_check")) == want
