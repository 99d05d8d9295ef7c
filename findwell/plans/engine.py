"""The search engine: indexing, searching, deleting and watching over one store.

Everything is a plan over the store's tables. A search keeps (query, id, score) until the page is
cut and only then joins the documents. What searches need of the collection as a whole, document
counts of terms and sizes of fields, is stored as differences that each change adds.
"""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.config import Config, SearchQuery, save_config
from findwell.functions.hashing import MockEmbedder
from findwell.functions.paths import extension_allowed, file_id
from findwell.functions.text import preprocess
from findwell.operators import fusion, keyword, ranking, spelling, vector_search
from findwell.operators.chunks import chunk_documents
from findwell.operators.keyword import POSTINGS, KeywordIndex
from findwell.operators.store import Store, counts
from findwell.plans.scratch import materialize, release
from findwell.sources import files
from findwell.streaming.watch import Watcher

SCHEMAS = {
    "documents": "id string, title string, content string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id string, document_id string, chunk_index int, content string, embedding array<float>",
    "postings": POSTINGS.format("string"), "lengths": "field string, id string, len int",
    "dictionary": "field string, term string, df bigint", "sizes": "field string, n bigint, words bigint", "rank_terms": "term string, df bigint",
}
KEYS = {"documents": "id", "chunks": "document_id", "postings": "id", "lengths": "id"}
# Tables of differences, which are added up when they are read: keys and numbers.
SUMS = {"dictionary": (["field", "term"], ["df"]), "sizes": (["field"], ["n", "words"]), "rank_terms": (["term"], ["df"])}
ORDER = {"postings": keyword.by_term, "dictionary": lambda d: d.sortWithinPartitions("term"), "rank_terms": lambda d: d.sortWithinPartitions("term")}
VECTOR_SEARCHES = ("memory", "expr")
KEPT_VECTORS = 1000  # of queries, by the driver


class SearchEngine:
    """``embedder`` has ``dimensions`` and ``embed(text column) -> vector column``, and may have ``vectors(texts)``."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder=None, extractors: dict | None = None, config_path: str | None = None):
        self.spark, self.config, self.extractors, self.config_path = spark, config or Config(), extractors, config_path
        if self.config.search.vector_search not in VECTOR_SEARCHES:
            raise ValueError(f"unknown vector search {self.config.search.vector_search!r}: {', '.join(VECTOR_SEARCHES)}")
        self.store = Store(spark, path, KEYS)
        self.embedder = embedder or MockEmbedder(self.config.search.dimensions)
        self.watcher = Watcher(spark, self.sync_directory, f"{path.rstrip('/')}/_checkpoints", self.config.recursive, self.config.search.debounce_ms)
        self._vectors: OrderedDict[str, np.ndarray] = OrderedDict()

    # tables

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        found = self.store.read(name, version)
        return self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found

    def _summed(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        by, numbers = SUMS[name]
        rows = self._table(name) if rows is None else rows
        return rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in numbers]).where(F.col(numbers[0]) > 0)

    def documents(self) -> DataFrame:
        return self._table("documents")

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def keyword_index(self) -> KeywordIndex:
        return KeywordIndex(self._table("postings"), self._table("lengths"), self._summed("dictionary"), self._summed("sizes"))

    # indexing

    def _differences(self, documents: DataFrame, index: KeywordIndex, sign: int) -> dict[str, DataFrame]:
        """What documents add to the stored counts, or take away."""
        rows = {"dictionary": index.dictionary(), "sizes": index.sizes(), "rank_terms": ranking.corpus_stats(documents)}
        signed = {name: df.select(*SUMS[name][0], *[(F.col(n) * sign).cast("bigint").alias(n) for n in SUMS[name][1]]) for name, df in rows.items()}
        return {name: df.coalesce(1) if name == "sizes" else df.sortWithinPartitions("term") for name, df in signed.items()}

    def _stage(self, tables: dict[str, DataFrame]) -> dict[str, list[str]]:
        with ThreadPoolExecutor(4) as some:  # small tables don't wait for large ones
            jobs = {name: some.submit(self.store.stage, name, df) for name, df in tables.items()}
        return {name: [job.result()] for name, job in jobs.items()}

    def _retract(self, ids: DataFrame, base: int) -> tuple[str | None, dict[str, list[str]], DataFrame | None]:
        """Staged: the delete vector of those of the documents (id) that the version has, and what they take from the counts."""
        old = materialize(self._table("documents", base).join(ids, "id", "left_semi"), "old")
        if old.isEmpty():
            release(old)
            return None, {}, None
        index = KeywordIndex.build(old)
        index = KeywordIndex(materialize(index.postings, "old"), materialize(index.lengths, "old"))
        return self.store.stage("_deleted", old.select("id")), self._stage(self._differences(old, index, -1)), old

    def index(self, documents: DataFrame, as_of=None) -> None:
        """Add documents (title, content; id and metadata optional), replacing those of the same id.

        A missing id is the hash of title and content; of rows with the same id one is taken. Texts are
        cleaned, cut into chunks and embedded, each distinct chunk once; all tables change together. A
        replaced document keeps the time at which it was created. If another writer was faster, what
        was replaced is worked out again and the last one holds.
        """
        c, names = self.config.search, set(documents.columns)
        title = F.coalesce(F.col("title"), F.lit("")) if "title" in names else F.lit("")
        content = F.coalesce(F.col("content"), F.lit(""))
        made = F.sha2(F.concat_ws("\u0000", title, content), 256)
        now = (F.current_timestamp() if as_of is None else F.lit(as_of)).cast("timestamp")
        none = F.expr("cast(map() as map<string,string>)")
        rows = documents.select(
            F.coalesce(F.col("id").cast("string"), made).alias("id") if "id" in names else made.alias("id"), title.alias("title"), preprocess(content).alias("content"),
            (F.coalesce("metadata", none) if "metadata" in names else none).alias("metadata"), now.alias("created_at"), now.alias("updated_at"),
        ).dropDuplicates(["id"])
        new = materialize(rows, "documents")
        parts = chunk_documents(new, size=c.chunk_size, overlap=c.chunk_overlap)
        texts = parts.select("content").distinct().withColumn("embedding", self.embedder.embed(F.col("content")))
        chunks = parts.join(texts, "content").select("chunk_id", "document_id", "chunk_index", "content", "embedding")
        index = KeywordIndex.build(new)
        index = KeywordIndex(materialize(index.postings, "postings"), materialize(index.lengths, "lengths"))
        staged = self._stage({"chunks": chunks, "postings": keyword.by_term(index.postings), "lengths": index.lengths, **self._differences(new, index, 1)})
        plain = self._stage({"documents": new})
        while True:
            base = self.store.version()
            deleted, less, old = self._retract(new.select("id"), base)
            add = {name: [*staged.get(name, []), *less.get(name, [])] for name in staged}
            if old is None:
                add |= plain
            else:
                before = old.select("id", F.col("created_at").alias("first"))
                kept = new.join(before, "id", "left").withColumn("created_at", F.coalesce("first", "created_at")).drop("first").select(new.columns)
                add |= self._stage({"documents": kept})
            if self.store.publish(base, add=add, delete=deleted):
                break
        for table in (new, index.postings, index.lengths):
            release(table)

    def made_id(self, title: str | None, content: str | None) -> str:
        """The id that a document without one gets."""
        return hashlib.sha256("\0".join((title or "", content or "")).encode()).hexdigest()

    def compact(self, min_age_s: float = 3600) -> None:
        """Merge what many changes have left in many small folders, and delete files that nothing names."""
        self.store.compact(SUMS, ORDER)
        self.store.vacuum(min_age_s)

    def delete(self, ids: DataFrame) -> None:
        """Remove documents (id) from all tables; unknown ids don't matter. Only what they took part in is counted again."""
        ids = ids.select("id").distinct()
        while True:
            base = self.store.version()
            deleted, less, _ = self._retract(ids, base)
            if deleted is None or self.store.publish(base, add=less, delete=deleted):
                return

    def get(self, document_id: str):
        row = self.documents().where(F.col("id") == document_id).first()
        if row is None:
            raise KeyError(document_id)
        return row

    def chunk(self, chunk_id: str):
        """A chunk by its id."""
        row = self.chunks().where(F.col("chunk_id") == chunk_id).first()
        if row is None:
            raise KeyError(chunk_id)
        return row

    def sync_directory(self, folder: str, present: DataFrame | None = None, ignored: DataFrame | None = None, settled: DataFrame | None = None) -> dict[str, int]:
        """Index what is new or changed below a folder and forget what is gone.

        A watcher gives tables (path, mtime, size): ``settled`` of the files to take, ``ignored`` of files to
        leave as they are, and ``present`` of files that aren't gone.
        """
        listed = files.listing(self.spark, folder, list(self.config.search.extensions), self.config.recursive)
        same = ["path", "mtime", "size"]
        todo = listed if settled is None else listed.join(settled.select(same), same, "left_semi")
        todo = todo if ignored is None else todo.join(ignored.select(same), same, "left_anti")
        read = materialize(files.read(files.changed(todo, self.documents()), self.extractors), "files")  # each file extracted once
        lost = materialize(files.gone(listed if present is None else present, self.documents(), folder), "gone")
        n, failed, m = read.where("error is null").count(), read.where("error is not null").count(), lost.count()
        if n:
            self.index(files.as_documents(read.where("error is null")))
        if m:
            self.delete(lost)
        for table in (read, lost):
            release(table)
        return {"indexed": n, "deleted": m, "failed": failed}

    def index_file(self, path: str) -> bool:
        """Index one file; False if the store has it as it is. A wrong extension or an unreadable file is an error."""
        if not self.spark.range(1).select(extension_allowed(F.lit(path), list(self.config.search.extensions))).first()[0]:
            raise ValueError(f"the extension of {path} isn't allowed")
        rows = files.changed(files.one(self.spark, path), self.documents())
        got = files.read(rows, self.extractors).collect()  # a row at most
        if not got:
            return False
        if got[0]["error"]:
            raise ValueError(f"{path}: {got[0]['error']}")
        self.index(files.as_documents(self.spark.createDataFrame(got, "path string, mtime timestamp, size bigint, text string, error string")))
        return True

    def index_files(self, paths: DataFrame) -> None:
        """Index the listed files (path) as they are now."""
        wanted = [r["path"] for r in paths.select("path").toLocalIterator()]
        for at in range(0, len(wanted), 1000):
            rows = self.spark.read.format("binaryFile").load(wanted[at : at + 1000])
            rows = rows.select(files.local_path("path").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
            self.index(files.read_documents(rows, self.extractors)[0])

    def delete_files(self, paths: DataFrame) -> None:
        self.delete(paths.select(file_id("path").alias("id")))

    # searching

    def search_many(self, queries: DataFrame, query: SearchQuery | None = None) -> DataFrame:
        """Pages of many queries (query_id, query) at once; ``query`` has the settings they share."""
        settings = (query or SearchQuery("-")).validated()
        return fusion.hydrate(fusion.page(self._fused(queries, settings), settings.offset, settings.limit), self.documents())

    def _fused(self, queries: DataFrame, q: SearchQuery) -> DataFrame:
        c = self.config.search
        none = self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, score double")
        lexical = semantic = none
        if q.keyword:
            hits = keyword.search(self.keyword_index(), queries, c.title_boost, c.phrase_boost, fuzzy=q.fuzzy, fuzziness=c.fuzziness)
            lexical = keyword.top(hits, c.candidates).select("query_id", "id", "score")
        if q.semantic:
            asked = queries.select("query_id", self.embedder.embed(F.col("query")).alias("vector"))
            near = vector_search.nearest(self.chunks(), asked, c.candidates, key="chunk_id", strategy=self._strategy())
            semantic = fusion.by_document(near.select("query_id", F.col("id").alias("chunk_id"), "score"), self.chunks())
        return fusion.above(fusion.split_by_source(lexical, semantic), *q.least(c))

    def _strategy(self) -> str:
        return {"memory": "arrow", "expr": "expr"}[self.config.search.vector_search]

    def _vector(self, query: str) -> np.ndarray:
        """The vector of a query, remembered for the last ``KEPT_VECTORS``."""
        if query not in self._vectors:
            if hasattr(self.embedder, "vectors"):
                found = self.embedder.vectors([query])[0]
            else:
                found = self.spark.sql("SELECT :q AS query", {"q": query}).select(self.embedder.embed(F.col("query"))).first()[0]
            self._vectors[query] = np.asarray(found, dtype=np.float32)
            if len(self._vectors) > KEPT_VECTORS:
                self._vectors.popitem(last=False)
        self._vectors.move_to_end(query)
        return self._vectors[query]

    def _counts(self, base: int, terms: list[str], matching: list[str]) -> dict[tuple, int]:
        """Stored counts by (table, field or None, term or None), of a query's few terms: one scan without a shuffle."""
        some = lambda name, *columns: self._table(name, base).select(F.lit(name).alias("table"), *columns)
        none = F.lit(None).cast("string")
        rows = some("sizes", "field", none.alias("term"), "n", "words")
        if matching:
            rows = rows.unionAll(some("rank_terms", none.alias("field"), "term", F.col("df").alias("n"), F.lit(0).cast("bigint").alias("words")).where(F.col("term").isin(matching)))
        if terms:
            rows = rows.unionAll(some("dictionary", "field", "term", F.col("df").alias("n"), F.lit(0).cast("bigint").alias("words")).where(F.col("term").isin(terms) & (F.col("field") != "any")))
        out: dict[tuple, int] = {}
        for r in rows.collect():  # the differences of a few terms, as many as there were changes since the last compaction
            key = (r["table"], r["field"], r["term"])
            out[key] = out.get(key, 0) + r["n"]
            out[*key, "words"] = out.get((*key, "words"), 0) + r["words"]
        return out

    def _one_fused(self, q: SearchQuery) -> tuple[list[dict], dict[str, int], int]:
        """The fused hits of one query (at most the candidates of either list), the document counts of its terms, and of all.

        The query is known here, so its terms are filters of the scans and its counts constants. Both
        kinds of hits are looked for at the same time.
        """
        c, spark = self.config.search, self.spark
        one = spark.sql("SELECT 0 AS query_id, :q AS query", {"q": q.query})
        base = self.store.version()
        wanted = keyword.query_terms(one)
        if q.keyword and q.fuzzy:
            near = keyword.fuzzy_terms(self.keyword_index(), wanted, c.fuzziness)
            wanted = spark.createDataFrame(near.collect(), near.schema)
        elif q.keyword:
            wanted = wanted.withColumn("asked", F.col("term"))
        terms = sorted({r["term"] for r in wanted.select("term").collect()}) if q.keyword else []
        matching = one.select(ranking.query_tokens("query").alias("terms")).first()["terms"]
        counted = self._counts(base, terms, matching)
        found = {f: (counted.get(("sizes", f, None), 0), counted.get(("sizes", f, None, "words"), 0)) for f in keyword.FIELDS}
        known = [(f, t, df, *found[f]) for t in terms for f in keyword.FIELDS if (df := counted.get(("dictionary", f, t), 0)) > 0]

        def lexical() -> dict[str, float]:
            if not known:
                return {}
            table = spark.createDataFrame(known, "field string, term string, df bigint, n bigint, total bigint").withColumn("average", F.col("total") / F.col("n")).drop("total")
            weighed = F.broadcast(wanted.join(F.broadcast(table), "term"))  # rows of one query's terms
            postings = self._table("postings", base).where(F.col("term").isin(sorted({k[1] for k in known})))
            hits = KeywordIndex(postings, postings).hits(weighed)
            boosted = max(c.title_boost, c.phrase_boost) > 1
            scored = keyword.boosted_hits(hits, c.title_boost, c.phrase_boost) if boosted else hits.groupBy("query_id", "id").agg(F.sum(F.col("s") * F.col("times")).alias("score"))
            return {r["id"]: r["score"] for r in scored.orderBy(F.desc("score"), "id").limit(c.candidates).select("id", "score").collect()}

        def semantic() -> dict[str, float]:
            best: dict[str, float] = {}
            for r in vector_search.best_of(self._table("chunks", base), self._vector(q.query), c.candidates, key="chunk_id").collect():
                document = r["id"].rpartition("_")[0]  # chunk ids are the document's id and a number
                best[document] = max(best.get(document, r["score"]), r["score"])
            return best

        with ThreadPoolExecutor(2) as both:
            jobs = [both.submit(job) if on else None for job, on in ((lexical, q.keyword), (semantic, q.semantic))]
        words, meaning = (job.result() if job else {} for job in jobs)
        least = dict(zip(("keyword", "semantic"), q.least(c)))
        fused = [
            {"id": i, "source": s, "score": x, "keyword_score": words.get(i, 0.0), "semantic_score": meaning.get(i, 0.0)}
            for s, i, x in [("keyword", i, x) for i, x in words.items()] + [("semantic", i, x) for i, x in meaning.items() if i not in words]
            if least[s] <= 0 or x >= least[s]
        ]
        fused.sort(key=lambda r: (r["source"], -r["score"], r["id"].encode()))
        return fused, {t: n for t in matching if (n := counted.get(("rank_terms", None, t), 0)) > 0}, found["content"][0]

    def search(self, query: SearchQuery | str, rerank: bool = False, auto_fuzzy: bool = False) -> dict:
        """One search as a response: two lists with their totals, suggestions, time taken.

        Three jobs: the counts of its terms, the hits of both kinds, the documents of the page.
        """
        q = (SearchQuery(query) if isinstance(query, str) else query).validated()
        began = time.time()
        fused, frequencies, documents = self._one_fused(q)
        if auto_fuzzy and not q.fuzzy and not fused:
            again = self.search(replace(q, fuzzy=True), rerank)
            return again | {"auto_fuzzy": bool(again["total_keyword"] + again["total_semantic"])}
        lists: dict[str, list] = {s: [r for r in fused if r["source"] == s] for s in ("keyword", "semantic")}
        sizes = {f"total_{s}": len(hits) for s, hits in lists.items()}
        lists = {s: hits[q.offset : q.offset + q.limit] for s, hits in lists.items()}
        wanted = [r["id"] for hits in lists.values() for r in hits]
        rows = self.documents().where(F.col("id").isin(wanted))  # a page of each list
        if rerank:
            counted = F.create_map(*[F.lit(x) for pair in frequencies.items() for x in pair]).cast("map<string,bigint>") if frequencies else F.expr("cast(map() as map<string,bigint>)")
            rows = ranking.ranked(rows, F.lit(q.query), self.config.ranking, documents=F.lit(documents), frequencies=counted)
        known = {r["id"]: r.asDict(True) for r in rows.collect()} if wanted else {}
        for s, hits in lists.items():
            hits = [r for r in hits if r["id"] in known]
            if rerank:
                hits = sorted((r | {"score": known[r["id"]]["rank_score"]} for r in hits), key=lambda r: (-r["score"], r["id"].encode()))
            lists[s] = [
                {"document": {k: known[r["id"]][k] for k in ("id", "title", "content", "metadata", "created_at", "updated_at")}, "rank": k, "score": r["score"], "keyword_score": r["keyword_score"], "semantic_score": r["semantic_score"]}
                for k, r in enumerate(hits, 1)
            ]
        said = self.suggest(q.query) if q.fuzzy else []
        return lists | sizes | {"query": q.query, "query_time_ms": int((time.time() - began) * 1000), "suggestions": said, "auto_fuzzy": False}

    def suggest(self, query: str) -> list[str]:
        """The corrected query, if correcting changes it."""
        c = self.config.search
        one = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        row = spelling.check(one, self.keyword_index().term_frequencies(), distance=c.suggest_distance, frequency=c.suggest_frequency).first()
        return [row["corrected"]] if row and row["misspelled"] and row["corrected"] != query.lower() else []

    def status(self) -> dict:
        row = counts(documents=self.documents(), chunks=self.chunks(), postings=self._table("postings")).first().asDict()
        c = self.config.search
        settings = {"vector_search": c.vector_search, "dimensions": self.embedder.dimensions, "chunk_size": c.chunk_size, "chunk_overlap": c.chunk_overlap, "path": self.store.path}
        return row | {"vectors": row["chunks"], "disk_bytes": self.store.disk_bytes(), "directories": self.watcher.directories(), "config": settings}

    # folders

    def watch(self, folder: str, once: bool = False, sync: bool = True):
        """Follow a folder, and remember it in the configuration file if there is one."""
        query = self.watcher.add(folder, once, sync)
        self._remember()
        return query

    def unwatch(self, folder: str) -> None:
        self.watcher.remove(folder)
        self._remember()

    def watch_configured(self) -> list:
        """Follow the folders of the configuration."""
        return [self.watcher.add(folder) for folder in self.config.directories]

    def _remember(self) -> None:
        self.config = replace(self.config, directories=tuple(self.watcher.directories()))
        if self.config_path:
            save_config(self.config, self.config_path)
