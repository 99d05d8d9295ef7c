import io
import json
import os
import sys
import threading
import time
import types
import urllib.request
import zipfile

import numpy
import pytest
from pyspark.sql import functions as F

from findwell.config import Config, SearchConfig, SearchQuery, load_config
from findwell.operators import ranking
from findwell.operators.keyword import KeywordIndex
from findwell.plans import cli
from findwell.plans.engine import SearchEngine
from findwell.plans.scratch import materialize
from findwell.plans.server import Service, serve
from findwell.sources import extract, vector_file
from findwell.sources.writers import as_lines, as_text
from findwell.streaming import watch as W

TOPICS = ["glacier", "violin", "harbour", "saffron", "lantern", "cobalt", "meadow", "anvil"]


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def office(kind: str, text: str) -> bytes:
    if kind == "docx":
        types = f'<Types><Override ContentType="{extract.DOCX_MAIN}" PartName="/word/main.xml"/></Types>'
        return archive(**{extract.CONTENT_TYPES: types, "word/main.xml": f'<w:p w:x="1"><w:t>{text}</w:t><w:t xml:space="preserve"> end </w:t></w:p>'})
    if kind == "pptx":
        return archive(**{"ppt/slides/slide1.xml": f"<a:t>{text}</a:t>", "ppt/slides/slide2.xml": "<a:t>end</a:t>", "ppt/other.xml": "<a:t>no</a:t>"})
    if kind == "odp":
        return archive(**{"content.xml": f"<text:h>end</text:h><text:p>{text}</text:p>"})
    if kind == "ods":
        return archive(**{"content.xml": f"<text:p>{text}</text:p><text:span>end</text:span>"})
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="inlineStr"><is><t>end</t></is></c></row></sheetData></worksheet>'
    return archive(**{"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst><si><t>{text}</t></si></sst>"})


@pytest.mark.parametrize("kind, want", [("docx", "some text end"), ("pptx", "some text end"), ("odp", "some text end"), ("ods", "some text end"), ("xlsx", "some text\t\t7\nend")])
def test_office_formats(kind, want):
    assert extract.extract_bytes(office(kind, "some text"), "." + kind.upper()) == want


def test_plain_and_broken_files(spark):
    assert extract.extract_bytes(b"a\xff\xffb\xe2\x82", ".unknown") == "a�b�"
    for ext in ("docx", "odt", "xlsx", "pptx", "odp", "ods"):
        with pytest.raises(extract.ExtractError):
            extract.extract_bytes(b"no zip", ext)
    df = spark.createDataFrame([(bytearray(b"a\xff\xffb"), "txt"), (bytearray(b"x"), "docx"), (None, "md")], "c binary, e string")
    got = df.select(extract.extracted(F.col("c"), F.col("e")).alias("r")).select("r.*").collect()
    assert got[0]["text"] == "a�b" and got[1]["error"] and got[2]["text"] is None
    assert df.select(extract.plain_text(F.col("c")).alias("t")).first()["t"] == "a�b"


def test_vector_file(spark, tmp_path):
    path = str(tmp_path / "v" / "index.bin")
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("ü", [3.0, 4.0])], "id string, embedding array<float>")
    vector_file.save(df, path, 2)
    assert sorted(map(tuple, vector_file.load(spark, path, 2).collect())) == sorted(map(tuple, df.collect()))
    assert vector_file.load(spark, str(tmp_path / "none"), 2).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vector_file.load(spark, path, 3).collect()
    folder = str(tmp_path / "parts")
    many = spark.range(25).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("embedding")).repartition(3)
    assert vector_file.save_parts(many, folder, 2) == 25 and len(os.listdir(folder)) == 3
    assert sorted(map(tuple, vector_file.load(spark, folder, 2).collect())) == sorted(map(tuple, many.collect()))
    vector_file.save_numbered(many, str(tmp_path / "n"), 2)
    assert sorted(map(tuple, vector_file.load_numbered(spark, str(tmp_path / "n")).collect())) == sorted(map(tuple, many.collect()))
    assert vector_file.load_numbered(spark, str(tmp_path / "nothing")).count() == 0
    assert len(list(vector_file.read_parts(b"".join(vector_file.encode([("a", [1.0])] * 5, 1, 5)), rows=2))) == 3


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = SearchEngine(spark, str(tmp_path_factory.mktemp("store")), Config(SearchConfig(dimensions=8, chunk_size=16, chunk_overlap=4)))
    docs = [(f"doc-{i}", f"Note {i}", f"The {t} stands beside the old mill. A second {t} line follows number {i}.") for i, t in enumerate(TOPICS)]
    e.index(spark.createDataFrame(docs, "id string, title string, content string"))
    return e


def test_every_topic_is_found(spark, engine):
    queries = spark.createDataFrame(list(enumerate(TOPICS)), "query_id int, query string")
    got = engine.search_many(queries, SearchQuery("-", 3, semantic=False)).where("rank = 1").collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(i, f"doc-{i}") for i in range(len(TOPICS))}


def test_search_response(engine):
    r = engine.search(SearchQuery("saffron mill", limit=2), rerank=True)
    assert r["keyword"][0]["document"]["id"] == "doc-3" and r["total_keyword"] == len(TOPICS) and [x["rank"] for x in r["keyword"]] == [1, 2]
    assert not {x["document"]["id"] for x in r["keyword"]} & {x["document"]["id"] for x in r["semantic"]}
    assert "doc-3" in as_text(r) and as_lines(r).startswith(f"{r['total_keyword'] + r['total_semantic']} documents")


def test_fuzzy_retry_and_suggestions(engine):
    r = engine.search(SearchQuery("safron", semantic=False), auto_fuzzy=True)
    assert r["auto_fuzzy"] and r["keyword"][0]["document"]["id"] == "doc-3" and r["suggestions"] == ["saffron"]
    assert engine.search(SearchQuery("qqqqqqqq", semantic=False), auto_fuzzy=True)["total_keyword"] == 0


def test_replace_delete_status(spark, engine):
    engine.index(spark.createDataFrame([("extra", "Extra", "unique zephyr text"), ("extra2", None, None)], "id string, title string, content string"))
    engine.index(spark.createDataFrame([("extra", "Extra", "another text")], "id string, title string, content string"))
    assert engine.search(SearchQuery("zephyr", semantic=False))["total_keyword"] == 0
    assert engine.get("extra")["content"] == "another text"
    assert engine.status()["documents"] == len(TOPICS) + 2
    engine.delete(spark.createDataFrame([("extra",), ("extra2",), ("unknown",)], "id string"))
    assert engine.status()["documents"] == len(TOPICS)
    with pytest.raises(KeyError):
        engine.get("extra")
    engine.compact(0)
    assert engine.status()["documents"] == len(TOPICS)
    assert engine.search(SearchQuery("saffron", semantic=False))["total_keyword"] == 1


def test_stored_counts_are_those_of_the_documents(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4)))
    docs = lambda *rows: spark.createDataFrame(rows, "id string, title string, content string")
    e.index(docs(("a", "red", "red green blue"), ("b", "x_y", "green")), as_of="2025-01-01 00:00:00")
    e.index(docs(("a", "red", "yellow yellow"), ("c", None, None)), as_of="2025-02-01 00:00:00")
    e.delete(docs(("b", "", ""), ("unknown", "", "")))

    def counted():
        index = e.keyword_index()
        plain = KeywordIndex(index.postings, index.lengths)
        for name in ("dictionary", "sizes"):
            assert {tuple(r) for r in getattr(index, name)().select(sorted(getattr(index, name)().columns)).collect()} == {tuple(r) for r in getattr(plain, name)().select(sorted(getattr(plain, name)().columns)).where(F.lit(True)).collect() if 0 not in r[1:2]}
        assert {tuple(r) for r in e._summed("rank_terms").collect()} == {tuple(r) for r in ranking.corpus_stats(e.documents()).collect()}
        assert {r["term"]: r["df"] for r in index.term_frequencies().collect()} == {"red": 1, "yellow": 1}

    counted()
    assert [(r["id"], str(r["created_at"])[:10], str(r["updated_at"])[:10]) for r in e.documents().orderBy("id").collect()] == [("a", "2025-01-01", "2025-02-01"), ("c", "2025-02-01", "2025-02-01")]
    e.compact(0)
    counted()
    assert e.chunk("a_0")["content"] == "yellow yellow"
    with pytest.raises(KeyError):
        e.chunk("b_0")


def test_one_search_gives_what_many_give(spark, engine):
    asked = ["saffron mill", "the old mill", "violin violin", "number 3", "note", "qqq", "beside the"]
    pages = engine.search_many(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), SearchQuery("-", 5)).collect()
    for k, text in enumerate(asked):
        one = engine.search(SearchQuery(text, 5))
        for source in ("keyword", "semantic"):
            many = sorted((r for r in pages if r["query_id"] == k and r["source"] == source), key=lambda r: r["rank"])
            assert [r["id"] for r in many] == [r["document"]["id"] for r in one[source]]
            assert all(abs(a["score"] - b["score"]) < 1e-9 and abs(a["semantic_score"] - b["semantic_score"]) < 1e-6 for a, b in zip(many, one[source]))


def test_two_writers_of_one_store(spark, tmp_path):
    a, b = (SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4))) for _ in range(2))
    docs = lambda *rows: spark.createDataFrame(rows, "id string, title string, content string")
    a.index(docs(("x", "", "one")))
    publish, once = b.store.publish, []

    def late(*args, **more):
        if not once:  # the other writer is faster
            once.append(1)
            a.index(docs(("x", "", "two"), ("y", "", "two")))
        return publish(*args, **more)

    b.store.publish = late
    b.index(docs(("x", "", "three")))
    assert {(r["id"], r["content"]) for r in a.documents().collect()} == {("x", "three"), ("y", "two")}
    assert {r["term"]: r["df"] for r in a.keyword_index().term_frequencies().collect()} == {"three": 1, "two": 1}


def test_a_common_term_is_spread_over_files(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("string"), F.lit("t").alias("title"), F.concat(F.lit("the "), F.col("id").cast("string")).alias("content"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = KeywordIndex.build(rows).write(str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in index.postings.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    common = [r["n"] for r in index.postings.where("term = 'the'").groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes) and len(common) > 1


def test_a_removal_alone_is_seen(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4, debounce_ms=200)), config_path=str(tmp_path / "c.yaml"))
    folder = tmp_path / "files"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.txt").write_text(f"file {name}")
    e.watch(str(folder))

    def until(n):
        end = time.time() + 90
        while time.time() < end and e.status()["documents"] != n:
            time.sleep(0.5)
        return e.status()["documents"] == n

    try:
        assert until(3)
        (folder / "b.txt").unlink()
        assert until(2)
        assert load_config(str(tmp_path / "c.yaml")).directories == (str(folder),)
    finally:
        e.unwatch(str(folder))
    assert load_config(str(tmp_path / "c.yaml")).directories == () and e.status()["documents"] == 2


def test_only_what_has_settled_is_taken(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4)))
    folder, w = tmp_path / "files", e.watcher
    folder.mkdir()
    (folder / "old.txt").write_text("was here before")
    w._last[str(folder)] = {"before": None, "done": None, "ignored": materialize(w._listing(str(folder)), "ignored")}
    (folder / "a.txt").write_text("first")
    assert not w.tick(str(folder))  # nothing to compare with
    (folder / "a.txt").write_text("longer than before")
    w.tick(str(folder))
    assert e.status()["documents"] == 0  # still being written
    w.tick(str(folder))
    assert [r["content"] for r in e.documents().collect()] == ["longer than before"]
    assert not w.tick(str(folder))
    (folder / "a.txt").unlink()
    w.tick(str(folder))
    assert e.status()["documents"] == 1  # may come back
    w.tick(str(folder))
    assert e.status()["documents"] == 0
    w._last.clear()
    assert not w.tick(str(folder))


def test_one_file(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4)))
    (tmp_path / "a b.txt").write_text("a file")
    (tmp_path / "x.bin").write_text("no")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert e.index_file(str(tmp_path / "a b.txt")) and not e.index_file(str(tmp_path / "a b.txt"))
    for bad in ("x.bin", "bad.docx"):
        with pytest.raises(ValueError):
            e.index_file(str(tmp_path / bad))
    e.delete_files(spark.createDataFrame([(str(tmp_path / "a b.txt"),)], "path string"))
    assert e.status()["documents"] == 0
    with pytest.raises(ValueError):
        SearchEngine(spark, str(tmp_path / "s"), Config(SearchConfig(vector_search="faster")))


def test_service(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4)))
    s = Service(e)
    ask = lambda method, path, thing=None: s.answer(method, path, b"" if thing is None else json.dumps(thing).encode())
    assert ask("GET", "/health") == (200, {"status": "ok"})
    assert ask("POST", "/api/v1/documents", {"id": "a/b", "title": "Opal", "content": "an opal text", "metadata": {"n": 1, "tags": "x"}}) == (201, {"id": "a/b", "status": "indexed"})
    status, made = ask("POST", "/api/v1/documents", {"content": "no id"})
    assert status == 201 and ask("GET", f"/api/v1/documents/{made['id']}")[1]["content"] == "no id"
    assert ask("GET", "/api/v1/documents/a%2Fb")[1]["metadata"] == {"n": "1", "tags": "x"}
    status, found = ask("POST", "/api/v1/search", {"query": "opal", "limit": 3, "semantic_enabled": False})
    assert status == 200 and [x["document"]["id"] for x in found["keyword"]] == ["a/b"]
    assert ask("DELETE", "/api/v1/documents/a%2Fb") == (200, {"status": "deleted"})
    assert ask("GET", "/api/v1/documents/a%2Fb")[0] == 404 and ask("GET", "/api/v1/status")[1]["documents"] == 1
    for method, path, body, code in [
        ("POST", "/api/v1/search", {"query": ""}, 400), ("POST", "/api/v1/search", {"query": "x", "limit": "3"}, 400), ("POST", "/api/v1/search", None, 400), ("GET", "/nothing", None, 404),
        ("POST", "/api/v1/watch/directories", {"path": str(tmp_path / "none")}, 404), ("POST", "/api/v1/watch/directories", {}, 400), ("DELETE", "/api/v1/watch/directories?path=/none", None, 404),
    ]:
        assert ask(method, path, body)[0] == code, (method, path, body)
    assert ask("GET", "/api/v1/watch/directories") == (200, {"directories": []})
    server = serve(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/health", timeout=10) as got:
            assert json.load(got) == {"status": "ok"}
    finally:
        server.shutdown()


def test_pages_of_a_pdf_and_a_model(spark, tmp_path, monkeypatch):
    """With stand-ins for the two libraries that aren't here: the reader of PDF files and the model's runtime."""
    pdf = types.ModuleType("pypdf")
    pdf.PdfReader = lambda stream, *a, **k: types.SimpleNamespace(pages=[types.SimpleNamespace(extract_text=lambda t=t: t) for t in (stream.read().decode(), None, "last page")], is_encrypted=False)
    monkeypatch.setitem(sys.modules, "pypdf", pdf)
    text = extract.extract_bytes(b"first page", "pdf")
    assert "first page" in text and "last page" in text and text.index("first") < text.index("last")

    class Session:
        def __init__(self, *_, **__):
            pass

        def get_inputs(self):
            return [types.SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

        def run(self, _, given):
            ids = given["input_ids"].astype("float32")
            return [numpy.stack([ids, given["attention_mask"] * 2.0], axis=2)]

    from findwell.functions.embedders import OnnxEmbedder

    model = OnnxEmbedder("x.onnx", dimensions=2, max_tokens=4)
    ids = numpy.array([[101, 7, 102, 0]])
    got = model.pooled(Session(), ids)
    want = numpy.array([[70.0, 2.0]]) / numpy.hypot(70, 2)
    assert numpy.allclose(got, want)
    with pytest.raises(ValueError):
        OnnxEmbedder("x.onnx", dimensions=3).pooled(Session(), ids)


def test_folder_is_followed(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "store"), Config(SearchConfig(dimensions=4)))
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    (folder / "a_one.txt").write_text("the amber file")
    (folder / "sub" / "b.docx").write_bytes(office("docx", "the basalt file"))
    (folder / "broken.docx").write_bytes(b"x")
    (folder / "c.bin").write_text("ignored")
    assert e.sync_directory(str(folder)) == {"indexed": 2, "deleted": 0, "failed": 1}
    assert e.search(SearchQuery("basalt", semantic=False))["total_keyword"] == 1
    assert e.sync_directory(str(folder))["indexed"] == 0
    time.sleep(1.1)
    (folder / "a_one.txt").write_text("the agate file")
    (folder / "sub" / "b.docx").unlink()
    e.watch(str(folder), once=True).awaitTermination(120)
    assert e.search(SearchQuery("agate", semantic=False))["total_keyword"] == 1
    assert e.search(SearchQuery("basalt amber", semantic=False))["total_keyword"] == 0
    assert e.watcher.directories() == [str(folder)]
    e.watcher.remove(str(folder))
    assert e.status()["documents"] == 1
    with pytest.raises(KeyError):
        e.watcher.remove(str(folder))


def test_events_settle_before_they_are_applied(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    rows = [("/r/a.txt", "create", 0), ("/r/a.txt", "write", 200), ("/r/b.txt", "write", 0), ("/r/b.txt", "remove", 300), ("/r/c.exe", "create", 0), ("/o/d.txt", "create", 0), ("/r/e.txt", "chmod", 0), ("/r/late.txt", "create", 100_000)]
    for k, part in enumerate((rows[:4], rows[4:], [("/r/end.txt", "create", 400_000)])):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"path": p, "op": o, "ms": m}) for p, o, m in part))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order in which the stream reads them
    stream = spark.readStream.schema("path string, op string, ms long").option("maxFilesPerTrigger", 1).json(str(src))
    events = W.relevant(stream.withColumn("ts", F.timestamp_millis("ms")), ["/r"], ["txt"])
    seen = {"index": [], "delete": []}
    q = W.watch_events(
        events, lambda df: seen["index"].extend(r["path"] for r in df.collect()), lambda df: seen["delete"].extend(r["path"] for r in df.collect()),
        str(tmp_path / "cp"), late="1 second", once=True,
    )
    q.awaitTermination(120)
    assert seen == {"index": ["/r/a.txt", "/r/late.txt"], "delete": ["/r/b.txt"]}


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "x.md").write_text("a topaz text")
    out = io.StringIO()
    for args in (["index", str(folder)], ["search", "topaz", "--min-score", "0", "--output", "compact"], ["search", "topaz", "--min-score", "0", "--output", "json"], ["status"], ["version"]):
        assert cli.main(["--store", str(tmp_path / "s"), *args], spark, out) == 0
    assert "x.md" in out.getvalue() and "'indexed': 1" in out.getvalue()
    config, folders = str(tmp_path / "c.yaml"), []
    for args, code in ((["add", str(folder)], 0), (["remove", "/none"], 1), (["list"], 0), (["remove", str(folder)], 0), (["list"], 0)):
        shown = io.StringIO()
        assert cli.main(["--config", config, "watch", *args], spark, shown) == code
        folders.append(shown.getvalue().strip())
    assert folders[2] == str(folder) and folders[4] == ""
    parsed = cli.parser().parse_args(["search", "x"])
    assert cli.least_scores(parsed, None) == (0.0, 0.49, 0.49) and cli.least_scores(parsed, Config()) == (0.0, 0.0, 0.05)
    assert cli.least_scores(cli.parser().parse_args(["search", "x", "--min-score", "0.2", "--min-semantic-score", "0.3"]), None) == (0.2, 0.0, 0.3)
    assert cli.main(["--store", str(tmp_path / "s"), "delete", "--path", str(folder / "x.md")], spark, out) == 0
    out = io.StringIO()
    cli.main(["--store", str(tmp_path / "s"), "status"], spark, out)
    assert "'documents': 0" in out.getvalue()
