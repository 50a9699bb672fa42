"""Ingest, search, ask and reports over one store, as batch plans."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.analyzer import terms
from .functions.chunker import ChunkOptions
from .functions.paths import parent_directory
from .operators import access, answers, context, evaluation, fusion, ingest, lexical, models, parsing, search, semantic
from .operators.parsing import declared_groups
from .operators.search import SearchOptions
from .sources.corpus import files
from .sources.settings import directory_settings
from .sources.snapshots import Snapshots
from .sources.tables import kept



@dataclass(frozen=True)
class SearchResult:
    candidates: DataFrame
    passages: DataFrame
    counts: DataFrame


def redacted(traces: DataFrame) -> DataFrame:
    """Traces without the counts before the permission filter and the flag that tells of them,
    which would show that unreadable documents match."""
    channels = F.transform("channels", lambda c: F.struct(c["channel"].alias("channel"), F.lit(None).cast("long").alias("raw_hits"), c["after_acl"].alias("after_acl")))
    return traces.withColumn("channels", channels).withColumn("flags", F.array_remove("flags", "acl-starvation"))


class DependencyError(RuntimeError):
    """A model that a search cannot do without failed."""

    def __init__(self, endpoint: str, message: str):
        super().__init__(f"{endpoint}: {message}")
        self.endpoint = endpoint


class Retriever(Protocol):
    """What can stand in for the engine wherever questions are asked."""

    def search(self, queries: DataFrame, principals: DataFrame, o: SearchOptions = ...) -> SearchResult: ...

    def evaluate(self, questions: DataFrame, principals: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Measures per variant and question, and the summary per variant, which is stored.

        ``questions``: ``id, query, user, expected_docs, expected_sections, must_not_docs``; one
        with expected sections is scored by them.  Unknown users and variants are errors.
        """
        variants = evaluation.chosen_variants(names)
        lost = evaluation.unknown_users(questions, principals)
        if lost:
            raise ValueError(f"unknown users: {', '.join(lost)}")
        sections = F.coalesce(F.size("expected_sections") > 0, F.lit(False))
        asked = kept(questions.select(F.col("id").alias("qid"), "query", F.col("user").alias("principal"), sections.alias("by_section"), "expected_docs", "expected_sections", "must_not_docs"), "questions")
        expected = asked.select("qid", F.explode(F.when(F.col("by_section"), F.col("expected_sections")).otherwise(F.col("expected_docs"))).alias("key"))
        must_not = asked.select("qid", F.explode("must_not_docs").alias("path"))
        rows = None
        for name, o in variants.items():
            found = self.search(asked.select("qid", "query", "principal"), principals, o)
            ranked = search.first_places(found.candidates, "path").withColumnRenamed("path", "key").join(asked.filter("not by_section").select("qid"), "qid")
            ranked = ranked.unionByName(search.first_places(found.candidates, "section_id").withColumnRenamed("section_id", "key").join(asked.filter("by_section").select("qid"), "qid"))
            seen = found.candidates.select("qid", "path").unionByName(found.passages.select("qid", "path")).distinct()
            leaked = evaluation.leaks(seen, must_not).groupBy("qid").agg(F.count(F.lit(1)).alias("leaks"))
            degraded = found.candidates.groupBy("qid").agg(F.bool_or("rerank_failed").alias("degraded"))
            measured = asked.select("qid").join(evaluation.metrics(ranked, expected, "key"), "qid", "left").join(leaked, "qid", "left").join(degraded, "qid", "left")
            part = measured.select(F.lit(name).alias("variant"), "qid", "recall_5", "recall_10", "mrr_10", F.coalesce("leaks", F.lit(0)).alias("leaks"), F.coalesce("degraded", F.lit(False)).alias("degraded"))
            rows = part if rows is None else rows.unionByName(part)
        rows = kept(rows, "measured")
        summed = evaluation.summary(rows)
        self.snapshots.append("evaluations", summed.withColumn("at", F.lit(datetime.datetime.now(datetime.timezone.utc))))
        return rows, summed

    def document(self, principals: DataFrame, path: str) -> DataFrame: ...


class Engine:
    """``embed(texts)``, ``rerank(query, texts)`` and ``chat(messages)`` are callables."""

    def __init__(self, spark: SparkSession, store: str, embed: Callable, dimensions: int, rerank: Callable | None = None, chat: Callable | None = None, root_groups: tuple[str, ...] = ()):
        self.spark, self.embed, self.dimensions, self.rerank, self.chat = spark, embed, dimensions, rerank, chat
        self.root_groups = list(root_groups)
        self.snapshots = Snapshots(spark, store, dimensions)

    def ingest(self, corpus: str, o: ChunkOptions = ChunkOptions(), again: bool = False) -> DataFrame:
        """Bring the store up to the corpus; returns ``path, status``.

        Only documents that are new or whose content changed are parsed, chunked and
        embedded; one whose groups alone changed gets them; all else is carried over.
        Documents with a permission problem, or whose vectors fail, are not in the new
        snapshot, nor is an older copy of them.  ``again``: as if the store were empty.
        A second run at the same time is refused.
        """
        with self.snapshots.writing():
            return self._ingest(corpus, o, again)

    def reindex(self, corpus: str, o: ChunkOptions = ChunkOptions()) -> DataFrame:
        """Everything anew; traces and users are no part of the index and stay."""
        return self.ingest(corpus, o, again=True)

    def _ingest(self, corpus: str, o: ChunkOptions, again: bool) -> DataFrame:
        begun = datetime.datetime.now(datetime.timezone.utc)
        found = kept(files(self.spark, corpus).select("*", *declared_groups(F.col("text"))), "files")
        settings = kept(directory_settings(self.spark, corpus, found.select(parent_directory(F.col("path")).alias("directory"))), "settings")
        directories = access.effective_groups(found.select(parent_directory(F.col("path")).alias("directory")), settings, self.root_groups)
        placed = found.withColumn("directory", parent_directory(F.col("path"))).join(directories, "directory", "left")
        groups = F.array_sort(F.array_distinct(F.coalesce("declared_groups", "groups")))
        now = kept(
            placed.select("path", "directory", "text", "hash", ingest.content_hash(F.col("text")).alias("content_hash"), groups.alias("groups"), F.coalesce(F.when(F.col("broken"), "directory settings are broken"), F.col("problem")).alias("problem")),
            "found",
        )
        old = {} if again else {name: df for name in ("docs", "chunks", "sections", "postings") if (df := self.snapshots.read(name)) is not None}
        before = old["docs"] if old else now.select("path", "hash", "content_hash", "groups").limit(0)
        status = kept(ingest.manifest_diff(before, now), "status")
        good = now.filter("problem is null").select("path", "directory", "text", "hash", "content_hash", "groups")
        # equal bytes or equal content: sections, chunks and vectors are those of the last run
        carried = status.filter("status = 'skipped'").select("path")
        if old:
            moved = good.join(status.filter("status = 'acl-updated'").select("path"), "path", "left_semi").join(before.select("path", F.col("hash").alias("old_hash")), "path")
            carried = carried.unionByName(moved.filter("hash = old_hash").select("path"))
        carried = kept(carried, "carried")
        changed = kept(good.join(carried, "path", "left_anti"), "changed")
        parsed = kept(parsing.chunks(changed, o), "chunks")
        bad = parsed.filter("error is not null").select("path", "error")
        fresh = parsed.filter("error is null").drop("error")
        if old:
            reusable = ingest.reusable_vectors(old["chunks"], fresh).filter("reused").select("chunk_id")
            vectors = old["chunks"].join(reusable, "chunk_id", "left_semi").select("chunk_id", "vec")
            reused = fresh.join(vectors, "chunk_id", "left")
        else:
            reused = fresh.withColumn("vec", F.lit(None).cast("array<float>"))
        reused = kept(reused, "reused")
        made = kept(models.embedded(reused.filter("vec is null"), "chunk_id", "index_text", self.embed, self.dimensions), "vectors")
        failed = made.filter("error is not null").join(reused.select("chunk_id", "path"), "chunk_id").select("path", "error").unionByName(bad)
        failed = kept(failed.groupBy("path").agg(F.min("error").alias("error")), "failed")
        filled = reused.join(made.filter("error is null").select("chunk_id", F.col("vec").alias("new_vec")), "chunk_id", "left").withColumn("vec", F.coalesce("vec", "new_vec")).drop("new_vec")
        new_chunks = kept(filled.join(failed, "path", "left_anti"), "new")
        fine = changed.join(failed, "path", "left_anti")
        stay = lambda df: df.join(carried, "path", "left_semi")
        both = lambda name, new: new.unionByName(stay(old[name]).select(new.columns)) if old else new
        new_docs = fine.join(parsing.titles(fine), "path", "left").select("path", F.col("directory").alias("collection"), "title", "raw_links", "hash", "content_hash", "groups", F.lit(begun).alias("ingested_at"))
        if old:
            own = good.select("path", F.col("groups").alias("now_groups"))
            kept_docs = stay(old["docs"]).join(own, "path").withColumn("groups", F.col("now_groups")).select(new_docs.columns)
            new_docs = new_docs.unionByName(kept_docs)
        docs = kept(new_docs, "docs")
        links = kept(ingest.resolved_links(docs), "links")
        chunks = both("chunks", new_chunks)
        posted = lexical.index_tables(new_chunks.select("chunk_id", "index_text"), "chunk_id", "index_text")["postings"]
        if old:
            posted = posted.unionByName(old["postings"].join(stay(old["chunks"]).select("chunk_id"), "chunk_id", "left_semi").select(posted.columns)).sortWithinPartitions("term", "chunk_id")
        index = lexical.completed({"postings": kept(posted, "postings")}, "chunk_id")
        final = status.join(failed.select("path", F.lit(True).alias("failed"), "error"), "path", "left").join(now.select("path", "problem"), "path", "left")
        final = kept(final.select("path", F.when(F.col("failed"), "error").otherwise(F.col("status")).alias("status"), F.coalesce("error", "problem").alias("error")), "final")
        collections = access.collection_groups(docs.select(F.col("collection").alias("directory")), settings, self.root_groups)
        number = self.snapshots.write({"docs": docs, "chunks": chunks, "sections": both("sections", parsing.sections(fine)), "links": ingest.document_links(links), "collections": collections, "status": final, **index})
        ended = datetime.datetime.now(datetime.timezone.utc)
        report = ingest.report(final, new_chunks, links.filter("target is null"))
        errors = final.filter("status = 'error'").agg(F.array_sort(F.slice(F.array_sort(F.collect_list(F.struct("path", "error"))), 1, 100)).alias("errors"))
        totals = report.crossJoin(errors).crossJoin(changed.agg(F.count(F.lit(1)).alias("parsed")))  # one row each
        run = totals.select(F.lit(number).alias("run"), F.lit(begun).alias("at"), F.lit(int((ended - begun).total_seconds() * 1000)).alias("elapsed_ms"), F.lit(0).alias("index_lag"), "*")
        self.snapshots.append("reports", run)
        return final.select("path", "status")

    def reports(self, n: int = 20) -> DataFrame:
        """The reports of the last runs, newest first."""
        return self.snapshots.log("reports").orderBy(F.desc("run")).limit(n)

    def search(self, queries: DataFrame, principals: DataFrame, o: SearchOptions = SearchOptions()) -> SearchResult:
        """Candidates and passages of ``qid, query, principal`` rows.

        ``principals``: ``principal, groups, admin``.  Principals without groups are cut
        off before any model is called; texts are joined after the permission filter.
        A query that is empty or longer than 1,000 characters is an error.
        """
        wrong = queries.filter(F.coalesce(~F.length("query").between(1, 1000), F.lit(True))).select("qid").limit(1).collect()
        if wrong:
            raise ValueError(f"query {wrong[0].qid} must have from 1 to 1,000 characters")
        docs, chunks, posted = (self.snapshots.read(t) for t in ("docs", "chunks", "postings"))
        index = lexical.Index(posted, self.snapshots.read("terms"), self.snapshots.read("collection"))
        may = principals.filter(F.col("admin") | (F.size("groups") > 0))
        asked = kept(queries.select(F.col("qid").cast("string").alias("qid"), "query", "principal").join(may.select("principal"), "principal", "left_semi"), "asked")
        owner = asked.select("qid", "principal")
        readable = docs.select("path", "groups")
        place = chunks.select("chunk_id", "path")
        n = o.channel_k * o.overfetch
        raw = {}
        if "lexical" in o.channels:
            words = asked.select("qid", F.explode(terms(F.col("query"))).alias("term")).distinct()
            raw["lexical"] = lexical.top(lexical.scores(lexical.narrowed(index, words), "chunk_id", words), "chunk_id", n)
        if "semantic" in o.channels:
            vectors = kept(models.embedded(asked.select("qid", "query"), "qid", "query", self.embed, self.dimensions), "asked-vectors")
            problem = vectors.filter("error is not null").select("error").limit(1).collect()
            if problem:
                raise DependencyError("embed", problem[0].error)
            numbered = chunks.select("chunk_id", "vec").withColumn("number", F.xxhash64("chunk_id"))
            q_numbers = vectors.select("qid", "vec", F.xxhash64("qid").alias("number"))
            near = semantic.nearest(q_numbers.select("number", "vec"), numbered.select("number", "vec"), "number", "vec", n, self.dimensions)
            raw["semantic"] = near.join(numbered.select("number", "chunk_id"), "number").join(q_numbers.select(F.col("number").alias("q"), F.col("qid").alias("real")), F.col("q") == near["qid"]).select(F.col("real").alias("qid"), "chunk_id", "score", "rank")
        parts = [search.channel(hits, name, owner, place, readable, principals, o) for name, hits in raw.items()]
        ranked, counts = parts[0]
        for more, numbers in parts[1:]:
            ranked, counts = ranked.unionByName(more), counts.unionByName(numbers)
        ranked = kept(ranked, "ranked")
        found = kept(search.candidates(ranked, self.snapshots.read("links"), place, readable, principals, o), "found")
        # the permission filter again, right before texts are read
        allowed = access.readable_hits(found, readable, principals)
        texts = kept(allowed.join(chunks.drop("path", "vec"), "chunk_id").join(asked.select("qid", "query"), "qid"), "candidates")
        if self.rerank is not None and o.rerank:
            scored = kept(models.rerank_scores(texts.select("qid", "query", "chunk_id", "pos", F.col("index_text").alias("text")), self.rerank), "scores")
        else:
            scored = texts.select("qid", "chunk_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("failed"))
        state = scored.groupBy("qid").agg(F.bool_or("failed").alias("failed"))
        ordered = fusion.reranked(texts, scored, "chunk_id").join(state, "qid", "left").withColumn("rerank_failed", F.coalesce("failed", F.lit(False)))
        chosen = fusion.selected(ordered, o.final_k, o.least, F.coalesce(~F.col("failed"), F.lit(False))).select("qid", "chunk_id", "place")
        shown = kept(ordered.drop("failed").join(chosen, ["qid", "chunk_id"], "left").withColumn("selected", F.col("place").isNotNull()), "shown")
        picked = shown.filter("selected").select("qid", "chunk_id", F.col("place").alias("priority"))
        pool = context.pool(picked, fusion.neighbours(chunks.select("chunk_id", "section_id", "ordinal"))).join(owner, "qid")
        pool = access.readable_hits(pool.join(place, "chunk_id"), readable, principals).join(chunks.drop("path", "vec"), "chunk_id")
        runs = context.passages(context.packed(pool, o.budget), "qid", "path", "section_id")
        order = Window.partitionBy("qid").orderBy("priority", "path", "char_start")
        passages = runs.withColumn("n", F.row_number().over(order)).join(docs.select("path", "title"), "path").join(self.snapshots.read("sections").select("section_id", "trail"), "section_id", "left")
        return SearchResult(shown, passages.select("qid", "n", "path", "title", "trail", "chunks", "char_start", "char_end", "text"), counts)

    def ask(self, queries: DataFrame, principals: DataFrame, system: str, o: SearchOptions = SearchOptions(), none_found: str = "No readable source answers this.", empty: str = "The model gave no answer.", chat_options: dict | None = None) -> DataFrame:
        """``qid, answer, cited, invalid, citations, flag, error``: answers with checked citations.

        Citations stand as ``[n]`` in the answer, ``citations`` are the passages cited.
        Without passages the fixed text comes out and no model is called.
        ``chat_options`` go to the model with every call.
        """
        found = self.search(queries, principals, o)
        entry = F.struct("n", "path", "title", "trail", "char_start", "char_end", "text")
        blocks = kept(found.passages.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("p")), "blocks")
        asked = queries.select(F.col("qid").cast("string").alias("qid"), "query").join(blocks, "qid", "left")
        chat, options = self.chat, dict(chat_options or {})

        def run(frames):
            for frame in frames:
                replies = []
                for message in frame["message"]:
                    try:
                        replies.append((chat([{"role": "system", "content": system}, {"role": "user", "content": message}], **options), None))
                    except Exception as problem:  # noqa: BLE001
                        replies.append((None, str(problem)[:500]))
                frame["reply"], frame["error"] = [r[0] for r in replies], [r[1] for r in replies]
                yield frame[["qid", "reply", "error"]]

        message = answers.user_message(answers.sources_block(F.col("p")), F.col("query"))
        replied = asked.filter("p is not null").select("qid", message.alias("message")).mapInPandas(run, "qid string, reply string, error string")
        told = kept(replied, "replies").join(blocks, "qid")
        text = answers.stripped_thinking(F.coalesce("reply", F.lit("")))
        said = told.select("qid", "p", "error", text.alias("text"), F.size("p").alias("passages"))
        good, bad = answers.checked_citations(F.col("text"), F.col("passages"))
        said = said.select("qid", "p", "error", answers.rewritten(F.col("text"), F.col("passages")).alias("answer"), good.alias("cited"), bad.alias("invalid"))
        flag = F.when(F.col("error").isNotNull(), "model failed").otherwise(answers.flag(F.col("answer"), F.col("cited")))
        blank = answers.trimmed(F.col("answer")) == ""
        cited = F.when(blank, F.slice("p", 1, 0)).otherwise(F.transform("cited", lambda n: F.element_at("p", n.cast("int"))))
        said = said.select("qid", F.when(blank, F.lit(empty)).otherwise(F.col("answer")).alias("answer"), "cited", "invalid", cited.alias("citations"), flag.alias("flag"), "error")
        silent = asked.filter("p is null").select("qid", F.lit(none_found).alias("answer"), F.lit("no evidence").alias("flag"))
        return said.unionByName(silent.select("*", *[F.array().cast(said.schema[c].dataType).alias(c) for c in ("cited", "invalid", "citations")], F.lit(None).cast("string").alias("error")))

    def evaluate(self, questions: DataFrame, principals: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Measures per variant and question, and the summary per variant, which is stored.

        ``questions``: ``id, query, user, expected_docs, expected_sections, must_not_docs``; one
        with expected sections is scored by them.  Unknown users and variants are errors.
        """
        variants = evaluation.chosen_variants(names)
        lost = evaluation.unknown_users(questions, principals)
        if lost:
            raise ValueError(f"unknown users: {', '.join(lost)}")
        sections = F.coalesce(F.size("expected_sections") > 0, F.lit(False))
        asked = kept(questions.select(F.col("id").alias("qid"), "query", F.col("user").alias("principal"), sections.alias("by_section"), "expected_docs", "expected_sections", "must_not_docs"), "questions")
        expected = asked.select("qid", F.explode(F.when(F.col("by_section"), F.col("expected_sections")).otherwise(F.col("expected_docs"))).alias("key"))
        must_not = asked.select("qid", F.explode("must_not_docs").alias("path"))
        rows = None
        for name, o in variants.items():
            found = self.search(asked.select("qid", "query", "principal"), principals, o)
            ranked = search.first_places(found.candidates, "path").withColumnRenamed("path", "key").join(asked.filter("not by_section").select("qid"), "qid")
            ranked = ranked.unionByName(search.first_places(found.candidates, "section_id").withColumnRenamed("section_id", "key").join(asked.filter("by_section").select("qid"), "qid"))
            seen = found.candidates.select("qid", "path").unionByName(found.passages.select("qid", "path")).distinct()
            leaked = evaluation.leaks(seen, must_not).groupBy("qid").agg(F.count(F.lit(1)).alias("leaks"))
            degraded = found.candidates.groupBy("qid").agg(F.bool_or("rerank_failed").alias("degraded"))
            measured = asked.select("qid").join(evaluation.metrics(ranked, expected, "key"), "qid", "left").join(leaked, "qid", "left").join(degraded, "qid", "left")
            part = measured.select(F.lit(name).alias("variant"), "qid", "recall_5", "recall_10", "mrr_10", F.coalesce("leaks", F.lit(0)).alias("leaks"), F.coalesce("degraded", F.lit(False)).alias("degraded"))
            rows = part if rows is None else rows.unionByName(part)
        rows = kept(rows, "measured")
        summed = evaluation.summary(rows)
        self.snapshots.append("evaluations", summed.withColumn("at", F.lit(datetime.datetime.now(datetime.timezone.utc))))
        return rows, summed

    def document(self, principals: DataFrame, path: str) -> DataFrame:
        """``principal`` and metadata of a document for those who may read it; unknown and
        unreadable are the same: no row."""
        docs = self.snapshots.read("docs").filter(F.col("path") == path)
        hits = docs.select("path").crossJoin(principals.select("principal"))  # one document
        return access.readable_hits(hits, docs.select("path", "groups"), principals).join(docs, "path")

    def trace(self, result: SearchResult, queries: DataFrame, kind: str = "search") -> DataFrame:
        """One stored trace per query: counts of the channels and the 20 first candidates, whole;
        ``traces`` shows them."""
        first = result.candidates.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("final_pos", "chunk_id", "selected"))), 1, 20).alias("candidates"), F.bool_or("rerank_failed").alias("failed"))
        counted = result.counts.groupBy("qid").agg(F.collect_list(F.struct("channel", "raw_hits", "after_acl")).alias("channels"), F.bool_or("starved").alias("starved"))
        run, at = uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc)
        flags = F.array_compact(F.array(F.when(F.col("starved"), "acl-starvation"), F.when(F.col("failed"), "rerank-failed")))
        told = queries.select(F.col("qid").cast("string").alias("qid"), "query", "principal").join(counted, "qid", "left").join(first, "qid", "left")
        told = told.select(F.concat(F.lit(run + "-"), "qid").alias("id"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), "qid", "query", "principal", "channels", "candidates", flags.alias("flags"))
        self.snapshots.append("traces", told)
        return told

    def traces(self, principals: DataFrame, n: int = 50) -> DataFrame:
        """``viewer`` and the newest ``n`` traces it may see: an administrator all of them whole, others
        their own without what was counted before the permission filter."""
        held = self.snapshots.log("traces")
        seen = redacted(held.join(principals.filter(~F.col("admin")).select("principal"), "principal", "left_semi").withColumn("viewer", F.col("principal")))
        whole = held.crossJoin(F.broadcast(principals.filter("admin").select(F.col("principal").alias("viewer")).limit(1000)))  # a copy for each administrator
        order = Window.partitionBy("viewer").orderBy(F.desc("at"), F.desc("id"))
        return seen.unionByName(whole).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).drop("n")
