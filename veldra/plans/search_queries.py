"""Searches over all current chunks, their expansion by links, packing and evaluation.

Questions are the titles of every fiftieth current document by its MD5, each asked
by one principal in turn, with the vector of the document's first chunk as the
question's.  The steps are those that the engine runs over its store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analyzer import terms
from ..operators import access, context, evaluation, fusion, ingest, lexical, search, semantic
from ..sources.tables import current_keys, current_rows, kept, table
from .access_queries import DOCUMENT_GROUPS, _groups
from .common import PRINCIPALS, current_sql, principals, terms_cte
from .ingest_queries import LINKS, _docs
from .lexical_queries import TOKENS, made_once

DIMENSIONS = 64
#: Questions of even number are scored by sections, the others by documents.
EVERY = 50
#: A channel takes the best of every part, so that its parts are few: 12, more where one would hold
#: over 128 thousand chunks, fewer where one would hold less than 16 thousand.
TASKS, LEAST_ROWS, MOST_ROWS = 12, 1 << 14, 1 << 17


def _number(column, digits: int):
    return F.conv(F.substring(F.md5(F.encode(column, "UTF-8")), 1, digits), 16, 10).cast("long")


def _chunks(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """Current chunks of the documents.  Texts and vectors move once, to the latest row of their
    chunk; whether it has a document is found from narrow rows and told there."""
    rows = table(spark, folder, "chunks")
    place = current_keys(rows, "chunk_id", ["doc_path"]).filter("doc_path is not null")
    held = place.join(documents.select(F.col("path").alias("doc_path")), "doc_path", "left_semi").select("chunk_id")
    columns = ["chunk_id", "doc_path", "section_id", "ordinal", "index_text", "vec", "ingested_at"]
    found = current_rows(rows.select(*columns), "chunk_id").filter("doc_path is not null").join(held, "chunk_id", "left_semi")
    return found.drop("ingested_at").withColumnRenamed("doc_path", "path").withColumn("number", _number("chunk_id", 15))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """``qid, query, principal, number``: every fiftieth document, its principal by turns."""
    who = principals(spark, folder).agg(F.array_sort(F.collect_list("principal")).alias("names"))  # the groups in use and two more
    docs = _docs(spark, folder).filter("title is not null and title <> ''").withColumn("number", _number("path", 8)).filter(F.col("number") % EVERY == 0)
    turn = (F.floor(F.col("number") / EVERY) % F.size("names") + 1).cast("int")
    return docs.crossJoin(F.broadcast(who)).select(F.col("path").alias("qid"), F.col("title").alias("query"), F.element_at("names", turn).alias("principal"), "number")  # one row


def parts_of(rows: int) -> int:
    """Over how many parts a search spreads so many chunks."""
    return max(1, min(TASKS, rows // LEAST_ROWS), -(-rows // MOST_ROWS))


class Store:
    """What an ingest leaves of a folder's tables: chunks of documents, their groups, links and index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.principals = principals(spark, folder)
        self.documents = kept(_groups(spark, folder), "groups")
        self.chunks = kept(_chunks(spark, folder, self.documents), "chunks")  # a hit leads to a document
        self.links = kept(ingest.document_links(ingest.resolved_links(_docs(spark, folder))), "links")
        self.place = self.chunks.select("chunk_id", "path")
        self.index = lexical.built_blocks(self.chunks.select("chunk_id", "index_text"), "chunk_id", "index_text")
        self.tasks = parts_of(self.chunks.count())


def store_of(spark: SparkSession, folder: str) -> Store:
    return made_once(spark, folder, "store", lambda: Store(spark, folder))


class Searched:
    """The frames of one search over a store, ranked hits written once."""

    def __init__(self, spark: SparkSession, folder: str, o: search.SearchOptions = search.SearchOptions()):
        store = store_of(spark, folder)
        self.principals, self.documents, self.chunks, self.links, self.place = store.principals, store.documents, store.chunks, store.links, store.place
        self.questions = kept(_questions(spark, folder), "questions")
        owners, n = self.questions.select("qid", "principal"), o.channel_k * o.overfetch
        words = self.questions.select("qid", F.explode(terms(F.col("query"))).alias("term")).distinct()
        lex = lexical.best(store.index, "chunk_id", words, n, tasks=store.tasks)
        heads = self.chunks.filter(F.col("chunk_id").endswith("::0")).select("chunk_id", "number", "vec")
        first = kept(self.questions.select("qid", F.concat("qid", F.lit("::0")).alias("chunk_id")).join(heads, "chunk_id"), "first")
        self.vectors = first.select("qid", F.col("vec").alias("asked"))
        near = semantic.nearest(first.select("number", "vec"), self.chunks.select("number", "vec"), "number", "vec", n, DIMENSIONS, store.tasks)
        near = kept(near.withColumnRenamed("qid", "q").join(first.select(F.col("number").alias("q"), "qid"), "q").drop("q"), "semantic")
        sem = near.join(self.chunks.select("number", "chunk_id"), "number")
        both = [hits.select("qid", F.lit(name).alias("channel"), "chunk_id", "score", "rank") for name, hits in (("lexical", lex), ("semantic", sem))]
        hits = kept(search.placed(both[0].unionByName(both[1]), owners, self.place), "hits")  # both channels meet places and groups once
        self.ranked = kept(search.readable(hits, self.documents, self.principals), "ranked")
        self.counts = search.counted(hits, self.ranked, o)

    def variants(self, variants: dict[str, search.SearchOptions]) -> DataFrame:
        """Candidates of every variant in their final order, in one pass: the variant is part of the
        query (``<variant>|<qid>``).  The reranker is the cosine of chunk and question."""
        entry = lambda name, o: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, o.channels)).alias("channels"))
        every = self.ranked.withColumn("v", F.explode(F.array(*[entry(name, o) for name, o in variants.items()]))).filter(F.array_contains("v.channels", F.col("channel")))
        ranked = every.withColumn("qid", F.concat_ws("|", "v.name", "qid")).drop("v")
        o = search.SearchOptions()
        found = kept(search.fused(ranked, o).select("qid", "principal", "chunk_id", "path", "pos"), "fused")
        of = lambda flag: F.substring_index("qid", "|", 1).isin(*[name for name, v in variants.items() if getattr(v, flag)])
        added = search.expanded(found.filter(of("graph")), ranked.filter(of("graph")), self.links, self.place, self.documents, self.principals, o).drop("via")
        met = found.unionByName(added).withColumn("question", F.substring(F.col("qid"), F.length(F.substring_index("qid", "|", 1)) + 2, F.length("qid")))
        met = met.join(self.chunks.select("chunk_id", "section_id", "vec"), "chunk_id").join(self.vectors.withColumnRenamed("qid", "question"), "question", "left")
        score = F.when(of("rerank"), semantic.cosine(F.col("vec"), F.col("asked"), DIMENSIONS))
        order = Window.partitionBy("qid").orderBy(F.col("rerank").isNull(), F.desc("rerank"), "pos")
        return met.withColumn("rerank", score).drop("vec", "asked", "question").withColumn("final_pos", F.row_number().over(order))

    def passages(self, shown: DataFrame, o: search.SearchOptions = search.SearchOptions()) -> DataFrame:
        """``qid, principal, path`` of what the passages are made of: selected chunks and those beside them."""
        chosen = fusion.selected(shown, o.final_k).select("qid", "chunk_id", F.col("place").alias("priority"))
        pool = context.pool(chosen, fusion.neighbours(self.chunks.select("chunk_id", "section_id", "ordinal")))
        hits = pool.join(shown.select("qid", "principal").distinct(), "qid").join(self.place, "chunk_id")
        return access.readable_hits(hits, self.documents, self.principals).select("qid", "principal", "path")


def graph_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that the links of the first documents add to the candidates of every question."""
    o = search.SearchOptions()
    found = Searched(spark, folder, o)
    added = search.candidates(found.ranked, found.links, found.place, found.documents, found.principals, o).filter("via is not null")
    return added.select("qid", "principal", "chunk_id", "path", F.array_join("via", ",").alias("via"), "pos")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Per variant and question: recall, reciprocal rank and leaks."""
    found = Searched(spark, folder)
    by_section = F.floor(F.col("number") / EVERY) % 2 == 0
    asked = found.questions.withColumn("by_section", by_section)
    linked = asked.join(found.links.withColumnRenamed("src", "qid"), "qid").select("qid", "by_section", F.col("dst").alias("key"))
    own = asked.select("qid", "by_section", F.col("qid").alias("key")).unionByName(linked).filter("not by_section").select("qid", "key")
    first = found.chunks.select(F.regexp_replace("chunk_id", "::0$", "").alias("qid"), "section_id").join(asked.filter("by_section"), "qid").filter("section_id is not null").select("qid", F.col("section_id").alias("key"))
    names = list(evaluation.VARIANTS)
    each = lambda df: df.withColumn("variant", F.explode(F.array(*map(F.lit, names)))).withColumn("qid", F.concat_ws("|", "variant", "qid")).drop("variant")
    asked, expected = kept(each(asked.select("qid", "by_section")), "asked"), each(own.unionByName(first))
    shown = kept(found.variants(evaluation.VARIANTS), "shown")
    ranking = search.first_places(shown, "path").withColumnRenamed("path", "key").join(asked.filter("not by_section").select("qid"), "qid")
    ranking = ranking.unionByName(search.first_places(shown, "section_id").withColumnRenamed("section_id", "key").join(asked.filter("by_section").select("qid"), "qid"))
    seen = kept(shown.select("qid", "principal", "path").unionByName(found.passages(shown)).distinct(), "seen")
    must_not = seen.join(access.unreadable(seen.select("principal", "path").distinct(), found.documents, found.principals), ["principal", "path"], "left_semi")
    leaked = evaluation.leaks(seen, must_not).groupBy("qid").agg(F.count(F.lit(1)).alias("leaks"))
    scored = asked.select("qid").join(evaluation.metrics(ranking, expected, "key"), "qid", "left").join(leaked, "qid", "left")
    variant = F.substring_index("qid", "|", 1)
    return scored.select(variant.alias("variant"), F.substring(F.col("qid"), F.length(variant) + 2, F.length("qid")).alias("qid"), "recall_5", "recall_10", "mrr_10", F.coalesce("leaks", F.lit(0)).alias("leaks"), F.lit(False).alias("degraded"))


def eval_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every question under every variant."""
    return _scored(spark, folder).select("variant", "qid", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr_10")], "leaks")


def eval_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of every variant."""
    summed = evaluation.summary(_scored(spark, folder))
    return summed.select("variant", "questions", "scored", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr_10")], "leaks", "degraded")


def channel_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw and readable hits of both channels for every question, and whether one starved."""
    return Searched(spark, folder).counts


def pack_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every section that a budget of 1,000 tokens keeps: those of 150 tokens or
    more are selected, the ones beside them neighbours."""
    columns = ["chunk_id", "doc_path", "section_id", "ordinal", "text", "tokens", "char_start", "char_end", "ingested_at"]
    rows = current_rows(table(spark, folder, "chunks").select(*columns), "chunk_id").filter("section_id is not null and doc_path is not null")
    chosen = rows.filter("tokens >= 150").select(F.concat_ws("|", "doc_path", "section_id").alias("qid"), "chunk_id", F.col("ordinal").alias("priority"))
    pool = context.pool(chosen, fusion.neighbours(rows.withColumn("section_id", F.concat_ws("|", "doc_path", "section_id"))))
    held = pool.join(rows.drop("ingested_at", "tokens"), "chunk_id")
    return context.packed(held, 1000, ("doc_path", "section_id")).select("qid", "chunk_id", "total")


SEARCHED = f"""
{PRINCIPALS}, {DOCUMENT_GROUPS}, {LINKS},
both_ways as (select distinct src, dst from (select path src, target dst from resolved where target is not null and target <> path union all select target, path from resolved where target is not null and target <> path)),
may as (select distinct p.principal, d.path from (select path, unnest(groups) grp from document_groups) d join (select principal, unnest(groups) grp from principals where not admin) p using (grp)
  union select p.principal, d.path from document_groups d, principals p where p.admin),
cur as (select *, doc_path cpath, ('0x' || substr(md5(chunk_id), 1, 15))::bigint num from {current_sql("chunks", "chunk_id")} where doc_path in (select path from docs_now)),
names_of as (select list_sort(list(principal)) names from principals),
q as (select path qid, title, h, names[(h // 50) % len(names) + 1] principal from (select *, ('0x' || substr(md5(path), 1, 8))::bigint h from now_docs where title is not null and title <> ''), names_of where h % 50 = 0),
{terms_cte("cocc", "cur", "chunk_id", "index_text")},
{terms_cte("qocc", "q", "qid", "title")},
cposted as (select chunk_id, term, count(*) tf from cocc group by 1, 2),
csizes as (select chunk_id, sum(tf) size from cposted group by 1),
ccoll as (select count(*) n, avg(size) mean_size from csizes),
cfreq as (select term, count(*) df from cposted group by 1),
qterms as (select distinct qid, term from qocc),
lexraw as (select qid, chunk_id, row_number() over (partition by qid order by score desc, chunk_id) rank from (
  select qid, chunk_id, round(sum(ln(n / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 6) score
  from qterms join cfreq using (term) join cposted using (term) join csizes using (chunk_id), ccoll group by 1, 2) qualify rank <= 200),
unit0 as (select chunk_id, num, list_transform(vec, lambda x: x::double) v from cur where len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
unit as (select chunk_id, num, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from unit0),
qvec as (select qid, u.* from q join unit u on u.chunk_id = qid || '::0'),
semraw as (select a.qid, b.chunk_id, row_number() over (partition by a.qid order by round(list_dot_product(a.v, b.v), 6) desc, b.num) rank from qvec a, unit b where a.num <> b.num qualify rank <= 200),
rawhits as (select 'lexical' channel, * from lexraw union all select 'semantic', * from semraw),
ranked as (
  select channel, qid, q.principal, chunk_id, cpath path, row_number() over (partition by channel, qid order by rank) as rank
  from rawhits join q using (qid) join cur using (chunk_id) join may on may.principal = q.principal and may.path = cpath),
variants as (select * from (values ('lexical', true, false, false, false), ('semantic', false, true, false, false), ('hybrid', true, true, false, false), ('hybrid+rerank', true, true, true, false), ('hybrid+rerank+graph', true, true, true, true)) t(variant, lex, sem, re, gr)),
sides as (select variant, r.* from ranked r, variants where rank <= 50 and ((channel = 'lexical' and lex) or (channel = 'semantic' and sem))),
fused0 as (select variant, qid, principal, chunk_id, path, min(rank) filter (channel = 'lexical') l, min(rank) filter (channel = 'semantic') s from sides group by all),
fused as (select *, row_number() over (partition by variant, qid order by coalesce(1.0::double / (60 + l), 0) + coalesce(1.0::double / (60 + s), 0) desc, coalesce(l, 2147483647), coalesce(s, 2147483647), chunk_id) pos from fused0 qualify pos <= 40),
fdocs as (select qid, principal, path, min(pos) pos from fused where variant = 'hybrid+rerank+graph' group by all),
sources as (select * from fdocs qualify row_number() over (partition by qid order by pos) <= 5),
reached as (
  select s.qid, s.principal, b.dst path, string_agg(s.path, ',' order by s.pos) via from sources s join both_ways b on b.src = s.path join may m on m.principal = s.principal and m.path = b.dst
  where not exists (from fdocs f where f.qid = s.qid and f.path = b.dst) group by 1, 2, 3),
bestrank as (select qid, path, chunk_id, min(rank) rank from ranked group by 1, 2, 3),
picked as (select r.*, b.chunk_id, b.rank, row_number() over (partition by r.qid, r.path order by b.rank is null, b.rank, b.chunk_id) n from reached r left join bestrank b on b.qid = r.qid and b.path = r.path qualify n <= 2),
capped as (select *, row_number() over (partition by qid order by best, path, n) place from (select *, min(coalesce(rank, 2147483647)) over (partition by qid, path) best from picked) qualify place <= 10),
added as (select qid, principal, coalesce(chunk_id, path || '::0') chunk_id, path, via, 40 + place pos from capped where coalesce(chunk_id, path || '::0') in (select chunk_id from cur)),
cand as (select variant, qid, principal, chunk_id, path, pos from fused union all select 'hybrid+rerank+graph', qid, principal, chunk_id, path, pos from added),
shown0 as (select c.*, cur.section_id, case when re then round(list_dot_product(a.v, u.v), 6) end score from cand c join variants using (variant) join cur using (chunk_id) left join qvec a on a.qid = c.qid left join unit u on u.chunk_id = c.chunk_id),
shown as (select *, row_number() over (partition by variant, qid order by score is null, score desc, pos) final_pos from shown0)"""
EVALUATED = f"""
{SEARCHED},
expected as (
  select qid, qid as key from q where (h // 50) % 2 = 1
  union select q.qid, dl.target from q join resolved dl on dl.path = q.qid where (h // 50) % 2 = 1 and dl.target is not null and dl.target <> dl.path
  union select q.qid, cur.section_id from q join cur on cur.chunk_id = qid || '::0' where (h // 50) % 2 = 0 and section_id is not null),
places as (
  select variant, qid, key, row_number() over (partition by variant, qid order by first_at) as rank from (
    select variant, s.qid, case when (h // 50) % 2 = 0 then section_id else path end as key, min(final_pos) first_at from shown s join q using (qid) where case when (h // 50) % 2 = 0 then section_id else path end is not null group by 1, 2, 3)),
measured as (
  select v.variant, e.qid, count(*) filter (p.rank <= 5) / count(*) r5, count(*) filter (p.rank <= 10) / count(*) r10, coalesce(1 / min(p.rank) filter (p.rank <= 10), 0) m
  from expected e cross join variants v left join places p on p.variant = v.variant and p.qid = e.qid and p.key = e.key group by 1, 2),
leaked as (
  select s.variant, s.qid, count(distinct s.path) n from shown s where not exists (from may m where m.principal = s.principal and m.path = s.path) group by 1, 2),
per_question as (select v.variant, q.qid, m.r5, m.r10, m.m, coalesce(l.n, 0) leaks from q cross join variants v left join measured m on m.variant = v.variant and m.qid = q.qid left join leaked l on l.variant = v.variant and l.qid = q.qid)"""
PACKED = f"""
cur as (select * from {current_sql("chunks", "chunk_id")} where section_id is not null and doc_path is not null),
pool0 as (
  select doc_path, section_id, chunk_id, ordinal, text, char_start, char_end, ordinal prio, true sel from cur where tokens >= 150
  union all
  select b.doc_path, b.section_id, b.chunk_id, b.ordinal, b.text, b.char_start, b.char_end, min(a.ordinal), false
  from cur a join cur b on a.doc_path = b.doc_path and a.section_id = b.section_id and abs(a.ordinal - b.ordinal) <= 1 and a.chunk_id <> b.chunk_id
  where a.tokens >= 150 and not coalesce(b.tokens >= 150, false) group by all),
pool as (select *, row_number() over (partition by doc_path, section_id order by sel desc, prio, chunk_id desc) place from pool0),
prefix as (select a.*, b.place m from pool a join pool b on a.doc_path = b.doc_path and a.section_id = b.section_id and a.place <= b.place),
isl as (select *, ordinal - row_number() over (partition by doc_path, section_id, m order by ordinal) island from prefix),
cut as (select *, max(char_end) over (partition by doc_path, section_id, m, island order by ordinal rows between unbounded preceding and 1 preceding) e from isl),
merged as (select doc_path, section_id, m, island, string_agg(case when e is null then text when char_start < e then substr(text, e - char_start + 1) else chr(10) || chr(10) || text end, '' order by ordinal) t from cut group by 1, 2, 3, 4),
totals as (select doc_path, section_id, m, sum({TOKENS.replace("{0}", "t")})::bigint total from merged group by 1, 2, 3),
kept as (select doc_path, section_id, max(m) m, max_by(total, m) total from totals where total <= 1000 group by 1, 2)"""


def queries() -> dict:
    return {f.__name__: f for f in (graph_expand, channel_counts, eval_questions, eval_variants, pack_budget)}


def oracle_sql() -> dict[str, str]:
    return {
        "graph_expand": f"with recursive {SEARCHED} select qid, principal, chunk_id, path, via, pos from added",
        "channel_counts": f"with recursive {SEARCHED}, raw as (select qid, channel, count(*) raw_hits from rawhits join cur using (chunk_id) group by 1, 2), seen as (select qid, channel, count(*) n from ranked group by 1, 2) select qid, channel, raw_hits, coalesce(n, 0) as after_acl, raw_hits >= 200 and coalesce(n, 0) < 50 as starved from raw left join seen using (qid, channel)",
        "eval_questions": f"with recursive {EVALUATED} select variant, qid, round(r5, 6) as recall_5, round(r10, 6) as recall_10, round(m, 6) as mrr_10, leaks from per_question",
        "eval_variants": f"with recursive {EVALUATED} select variant, count(*) as questions, count(r5) as scored, round(avg(r5), 6) as recall_5, round(avg(r10), 6) as recall_10, round(avg(m), 6) as mrr_10, sum(leaks)::bigint as leaks, 0::bigint as degraded from per_question group by 1",
        "pack_budget": f"with {PACKED} select p.doc_path || '|' || p.section_id as qid, p.chunk_id, k.total from pool p join kept k on k.doc_path = p.doc_path and k.section_id = p.section_id where p.place <= k.m",
    }
