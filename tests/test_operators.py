import datetime as dt

import pytest
from pyspark.sql import functions as F

from findwell.config import RankingConfig, SearchConfig, SearchQuery, load_config, save_config, Config
from findwell.operators import fusion, keyword, spelling, store, vector_search
from findwell.operators.chunks import chunk_documents
from findwell.operators.incremental import Ledger, changed_since, oldest_open, pending_from_mark, pending_states
from findwell.operators.keyword import KeywordIndex
from findwell.operators.ranking import ranked
from findwell.operators.state import current_contents, current_rows

T = [dt.datetime(2025, 1, d) for d in range(1, 10)]


def rows(df, *names):
    return sorted(tuple(r[n] for n in (names or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    docs = [("1", "machine learning", "a text about other things"), ("2", "notes", "machine learning machine"), ("3", "notes", "learning a machine"), ("4", "", ""), ("5", None, None)]
    return KeywordIndex.build(spark.createDataFrame(docs, "id string, title string, content string"))


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_title_and_phrase_come_first(spark, index):
    hits = keyword.top(keyword.boosted(index, ask(spark, "machine learning")), 10)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == ["1", "2", "3"]


def test_coverage_counts_words_with_repetitions(spark, index):
    one = dict(rows(keyword.boosted(index, ask(spark, "machine zebra"), phrase_boost=1), "id", "score"))
    two = dict(rows(keyword.boosted(index, ask(spark, "machine"), phrase_boost=1), "id", "score"))
    assert one["2"] == pytest.approx(two["2"] / 4)


def test_no_words_no_hits(spark, index):
    assert rows(keyword.boosted(index, ask(spark, "", "!!", "absent"))) == []
    assert rows(keyword.match_any(index, ask(spark, ""))) == []
    assert keyword.top(keyword.match_any(index, ask(spark, "machine")), 0).count() == 0


def test_phrases_need_neighbours_in_one_field(spark, index):
    assert rows(keyword.phrase_hits(index, ask(spark, "machine learning", "learning machine", "machine"))) == [(0, "1"), (0, "2"), (1, "2")]


def test_fuzzy_finds_typos(spark, index):
    assert {r["id"] for r in keyword.boosted(index, ask(spark, "machin lerning"), fuzzy=True).collect()} == {"1", "2", "3"}


def test_statistics(spark, index):
    df = dict(rows(index.term_frequencies()))
    assert df["machine"] == 3 and df["notes"] == 2
    assert rows(index.corpus_stats(spark.createDataFrame([("machine",), ("nix",)], "term string")), "term", "df", "documents") == [("machine", 3, 5), ("nix", 0, 5)]
    assert index.without(spark.createDataFrame([("1",)], "id string")).document_count().first()[0] == 4


def test_suggestions(spark):
    dictionary = spark.createDataFrame([("graph", 5), ("grape", 20), ("group", 1), ("graphs", 2)], "term string, df bigint")
    got = rows(spelling.suggest(spark.createDataFrame([("grap",)], "term string"), dictionary), "suggestion", "distance", "rank")
    assert got == [("grape", 1, 1), ("graph", 1, 2), ("graphs", 2, 3)]
    checked = rows(spelling.check(ask(spark, "Grap graph zzzzz", ""), dictionary))
    assert checked == [(0, "grape graph zzzzz", "grap zzzzz"), (1, "", "")]


def test_lists_are_disjoint_and_pages_make_the_whole(spark):
    k = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0), (0, "a", 1.5)], "query_id int, id string, score double")
    s = spark.createDataFrame([(0, "a", 0.9), (0, "c", 0.8), (0, "d", 0.01)], "query_id int, id string, score double")
    fused = fusion.split_by_source(k, s)
    assert rows(fused, "id", "source", "score", "semantic_score") == [("a", "keyword", 2.0, 0.9), ("b", "keyword", 1.0, 0.0), ("c", "semantic", 0.8, 0.8), ("d", "semantic", 0.01, 0.01)]
    assert rows(fusion.above(fused, 0, 0.05), "id") == [("a",), ("b",), ("c",)]
    pages = [r for o in range(3) for r in rows(fusion.page(fused, o, 1), "id", "source", "rank")]
    assert sorted(pages) == [("a", "keyword", 1), ("b", "keyword", 1), ("c", "semantic", 1), ("d", "semantic", 1)]
    with pytest.raises(ValueError):
        fusion.page(fused, -1, 1)
    empty = fusion.split_by_source(k.limit(0), s.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("strategy", ["arrow", "expr"])
def test_nearest(spark, strategy):
    vs = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b2", [0.0, 1.0]), ("n", None), ("short", [1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(vs, "id string, embedding array<float>")
    q = spark.createDataFrame([(7, [0.6, 0.8]), (8, None)], "query_id int, vector array<float>")
    got = vector_search.nearest(vectors, q, 2, strategy=strategy)
    assert [(r["query_id"], r["id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(7, "b", 1), (7, "b2", 2)]
    assert vector_search.nearest(vectors, q, 0, strategy=strategy).count() == 0
    assert vector_search.nearest(vectors.limit(0), q, 2, strategy=strategy).count() == 0


@pytest.mark.parametrize("n, size, overlap", [(0, 3, 1), (3, 3, 1), (4, 3, 1), (10, 4, 2), (7, 3, 5), (9, 3, 0)])
def test_chunks_make_the_text_again(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("d", " ".join(words)), (None, "x")], "id string, content string")
    got = [r["content"].split() for r in chunk_documents(df, size=size, overlap=overlap).orderBy("chunk_index").collect()]
    step = max(1, size - overlap)
    again = got[0] + [w for a, c in zip(got, got[1:]) for w in c[len(a) - step :]] if n else []
    assert again == words and all(len(c) <= size for c in got) and len(got) == (1 if n <= size else -(-(n - size) // step) + 1)


def ranking_of(spark, query, config, **doc):
    row = {"title": "budget.txt", "content": "Budget data.", "metadata": {"source_path": "/home/user/reports/budget.txt", "author": "John"}} | doc
    df = spark.createDataFrame([(row["title"], row["content"], row["metadata"])], "title string, content string, metadata map<string,string>")
    return ranked(df, F.lit(query), config, as_of=F.lit("2025-01-31 00:00:00").cast("timestamp")).first()


def test_ranking_worked_by_hand(spark):
    plain = RankingConfig(recency_enabled=False, quality_enabled=False)
    assert ranking_of(spark, "budget", plain)["rank_score"] == pytest.approx(267)
    r = ranking_of(spark, "budget", RankingConfig(recency_enabled=False))
    assert r["rank_score"] == pytest.approx(347.1)
    assert r["breakdown"]["match_type"] == "exact" and r["breakdown"]["multipliers"] == {"query_quality": pytest.approx(1.3)}


def test_ranking_of_empty_rows(spark):
    for doc in ({"title": None, "content": None, "metadata": None}, {"title": "", "content": ""}):
        for query in ("budget", "", '"'):
            assert ranking_of(spark, query, RankingConfig(size_enabled=True), **doc)["rank_score"] == pytest.approx(0)


def test_recent_files_rank_higher(spark):
    ns = str(int(dt.datetime(2025, 1, 30, 12, tzinfo=dt.timezone.utc).timestamp()) * 10**9)
    new = ranking_of(spark, "budget", RankingConfig(), metadata={"source_mtime": ns})
    assert new["breakdown"]["multipliers"]["recency"] == 1.2
    assert ranking_of(spark, "budget", RankingConfig(), metadata={"source_mtime": "x"})["breakdown"]["multipliers"]["recency"] == 1.0


def test_current_rows_ties_nulls_and_empty_tables(spark):
    schema = "id string, v string, updated_at timestamp, created_at timestamp"
    data = [("a", "old", T[1], T[0]), ("a", "new", None, T[3]), ("a", "new", None, T[3]), ("b", None, None, None), (None, "x", T[1], T[1])]
    got = current_rows(spark.createDataFrame(data, schema), {"v": F.col("v")})
    assert sorted(map(tuple, got.collect()), key=str) == [("a", T[3], "new"), ("b", None, None)]
    assert current_rows(spark.createDataFrame([], schema), {"v": F.col("v")}).count() == 0


def test_current_contents_are_the_current_rows(spark):
    schema = "id string, v string, w int, updated_at timestamp, created_at timestamp, __key int, __rows int"
    data = [("a", "old", 1, T[1], T[0]), ("a", "new", 2, None, T[3]), ("a", "new", 2, None, T[3]), ("b", None, None, None, None), ("b", "x", 1, None, None), (None, "x", 1, T[1], T[1]), ("c", "é" * 9, None, T[2], None), ("c", "z", 1, T[1], None)]
    df = spark.createDataFrame([(*d, 0, 1) for d in data], schema)
    want = current_rows(df, {"v": F.col("v"), "w": F.col("w")}).drop("effective_at")
    for size in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", size)
        try:
            assert sorted(map(str, current_contents(df, ["v", "w"]).collect())) == sorted(map(str, want.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert current_contents(df.limit(0), ["v"]).count() == 0


def changes(spark, states, log, runs):
    return (
        spark.createDataFrame(states, "id string, updated_at timestamp, created_at timestamp, arrived_at timestamp, version string"),
        spark.createDataFrame(log, "run_id int, id string, updated_at timestamp, outcome string"),
        spark.createDataFrame(runs, "run_id int, status string, started_at timestamp, finished_at timestamp, high_mark timestamp"),
    )


def test_pending_states(spark):
    states = [("a", T[1], T[0], T[2], ""), ("a", T[3], T[0], T[1], ""), ("b", None, T[1], T[1], ""), ("b", None, T[1], T[5], ""), ("c", T[1], T[1], T[1], ""), ("d", T[2], T[2], T[2], ""), ("e", None, None, None, ""), (None, T[1], T[1], T[1], "")]
    log = [(1, "a", T[1], "indexed"), (1, "b", T[1], " Indexed"), (2, "c", T[1], "indexed"), (1, "d", T[2], "error"), (9, "d", T[2], "indexed"), (1, "gone", T[1], "indexed"), (1, None, None, None)]
    runs = [(1, "Succeeded\n", T[0], T[1], T[2]), (2, "failed", T[3], None, T[2]), (3, None, T[4], None, None)]
    tables = changes(spark, states, log, runs)
    assert {r["id"] for r in pending_states(*tables).collect()} == {"a", "c", "d", "e"}
    assert oldest_open(tables[2]).first()[0] == T[2]
    assert {r["id"] for r in pending_states(*tables, reread_from=T[2]).collect()} == {"a", "d", "e"}
    assert sorted(r["id"] for r in pending_from_mark(*tables).collect()) == ["a", "c", "d", "e"]
    assert pending_states(*changes(spark, [], [], [])).count() == 0 and pending_from_mark(*changes(spark, [], [], [])).count() == 0


@pytest.mark.parametrize("runs, mark", [
    ([], None), ([(1, "failed", 0, 1, 0)], None), ([(1, "succeeded", 1, 2, 1)], 1),
    ([(1, "failed", 1, 2, 1), (2, "succeeded", 3, 4, 3)], 3),  # a later success covered it
    ([(1, "failed", 1, 2, 4), (2, "succeeded", 3, 4, 3)], 1),  # it meant to cover more
    ([(1, "aborted", 1, None, None), (2, "SUCCEEDED ", 3, 4, 3)], 1),  # nothing says that it is over
    ([(1, "failed", 1, 2, None), (2, "succeeded", 3, 4, 3)], 3), ([(1, "succeeded", 1, 2, 1), (2, "running", 3, None, None)], 1),
    ([(1, "failed", 0, 1, 0), (2, "succeeded", 2, 3, 2), (3, "failed", 4, 5, 4)], 2), ([(1, "succeeded", 1, 2, None)], 1),
])
def test_oldest_open_run(spark, runs, mark):
    at = lambda k: None if k is None else T[k]
    table = changes(spark, [], [], [(i, s, *map(at, times)) for i, s, *times in runs])[2]
    assert oldest_open(table).first()[0] == at(mark)


def test_the_mark_is_a_filter_of_the_scan(spark, tmp_path):
    path = str(tmp_path / "states")
    changes(spark, [("a", T[1], T[0], T[2], "")], [], [])[0].write.parquet(path)
    plan = changed_since(spark.read.parquet(path), T[2])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(arrived_at" in plan


def test_a_run_that_dies_before_its_commit_is_repeated(spark, tmp_path):
    states = changes(spark, [("a", T[1], T[0], T[2], ""), ("b", T[1], T[0], T[2], "")], [], [])[0]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    batch = ledger.pending(states)
    assert batch.count() == 2
    assert ledger.commit(batch.where("id = 'a'"), "r1")
    assert not ledger.commit(batch, "r1")  # what was committed first holds
    assert [r["id"] for r in ledger.pending(states).collect()] == ["b"]
    newer = states.withColumn("updated_at", F.lit(T[4]))
    assert {r["id"] for r in ledger.pending(newer).collect()} == {"a", "b"}
    (tmp_path / "ledger" / "_new-dead" / "taken").mkdir(parents=True)  # a commit that died
    assert [r["id"] for r in ledger.pending(states).collect()] == ["b"]


def test_runs_begin_at_the_mark_and_carry_over_what_was_left(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = changes(spark, [("a", T[1], T[0], T[1], ""), ("b", T[1], T[0], T[1], ""), ("c", T[0], T[0], T[0], "")], [], [])[0]
    given = ledger.pending(first)
    ledger.commit(given.where("id <> 'b'"), "r1", given, T[2])
    assert ledger.mark() == T[2] and [r["id"] for r in ledger.left_over().collect()] == ["b"]
    late = first.unionByName(changes(spark, [("a", T[0], T[0], T[3], ""), ("d", T[1], T[0], T[3], ""), ("b", T[3], T[0], T[4], "")], [], [])[0])
    given = ledger.pending(late)
    assert {(r["id"], r["version"]) for r in given.collect()} == {("d", T[1]), ("b", T[3])}
    ledger.commit(given, "r2", given, T[5])
    assert ledger.pending(late).count() == 0 and ledger.left_over().count() == 0


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read("t") is None and s.disk_bytes() == 0
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    s.write({"t": a})
    s.write({"t": store.update(s.read("t"), spark.createDataFrame([(2, "z")], "id int, v string"))})
    s.write({"t": store.delete(s.read("t"), spark.createDataFrame([(1,), (99,)], "id int"))})
    assert rows(s.read("t")) == [(2, "z")]
    s.vacuum(0)
    assert rows(s.read("t")) == [(2, "z")] and s.disk_bytes() > 0
    s.append({"t": spark.createDataFrame([(3, "w")], "id int, v string"), "u": a})
    assert rows(s.read("t")) == [(2, "z"), (3, "w")] and s.read("u").count() == 2
    s.vacuum(0)
    assert rows(s.read("t")) == [(2, "z"), (3, "w")]


def test_deletions_hide_older_rows_alone(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), {"t": "id", "u": "owner"})
    made = lambda names, *data: spark.createDataFrame(data, names)
    s.append({"t": made("id int, v string", (1, "x"), (2, "y")), "u": made("n int, owner int", (7, 1), (8, 2)), "free": made("id int", (1,))})
    base = s.version()
    s.remove(made("id int", (1,), (99,)))
    s.append({"t": made("id int, v string", (1, "again"))})
    assert rows(s.read("t")) == [(1, "again"), (2, "y")] and rows(s.read("u")) == [(8, 2)] and rows(s.read("free")) == [(1,)]
    assert rows(s.read("t", base)) == [(1, "x"), (2, "y")]  # an older version stays as it was
    with pytest.raises(store.Conflict):
        s.write({"t": s.read("t")}, base)
    assert not s.publish(base, add={"t": [s.stage("t", made("id int, v string", (5, "lost")))]})
    assert rows(s.read("t")) == [(1, "again"), (2, "y")]
    s.compact()
    assert rows(s.read("t")) == [(1, "again"), (2, "y")] and rows(s.read("u")) == [(8, 2)] and s.manifest()["deleted"] == []
    staged = s.stage("t", made("id int, v string", (6, "w")))
    s.vacuum(3600)  # what isn't published yet is kept
    assert s.publish(s.version(), add={"t": [staged]}) and s.read("t").count() == 3
    (tmp_path / "s" / "_manifests" / ".dead").write_text("{")  # a writer that died
    assert s.read("t").count() == 3


def test_query_settings():
    assert SearchQuery("x", 0).validated().limit == 10 and SearchQuery("x", 500).validated().limit == 100
    assert SearchQuery("x", keyword=False, semantic=False).validated().semantic
    assert SearchQuery("x", min_score=0.3, min_semantic_score=0.2).least(SearchConfig()) == (0.3, 0.2)
    for bad in (SearchQuery(""), SearchQuery("x", offset=-1)):
        with pytest.raises(ValueError):
            bad.validated()


def test_config_file(tmp_path):
    path = str(tmp_path / "c.yaml")
    save_config(Config(SearchConfig(chunk_size=7), RankingConfig(tag=1.0), ("/x",)), path)
    c = load_config(path)
    assert c.search.chunk_size == 7 and c.ranking.tag == 1.0 and c.directories == ("/x",)
    (tmp_path / "d.yaml").write_text("search:\n  chunk_size: 0\n  other: 1\nwatch:\n  directories: [docs]\n")
    c = load_config(str(tmp_path / "d.yaml"))
    assert c.search.chunk_size == 512 and c.directories == (str(tmp_path / "docs"),)
