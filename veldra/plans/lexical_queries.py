"""Queries of the full-text channel and of permissions on its hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import terms
from ..functions.tokens import estimated_tokens
from ..operators import access, lexical
from ..sources.tables import released, spread, table
from .common import PRINCIPALS, READABLE, principals, readable_documents, terms_cte, title_of


_MADE: dict[tuple, object] = {}


def made_once(spark: SparkSession, folder: str, name: str, make):
    """What an engine makes at ingest and searches then share: made once per session and state of
    the folder's tables."""
    session = (spark.sparkContext.applicationId, released())
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files.listStatus(place)))
    held = (session, folder, name, state)
    if held not in _MADE:
        for old in [k for k in _MADE if k[0] != session]:
            del _MADE[old]
        _MADE[held] = make()
    return _MADE[held]


def index_of(spark: SparkSession, folder: str) -> lexical.Index:
    """The index of all documents."""
    return made_once(spark, folder, "documents", lambda: lexical.built(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text"))


def analyze_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of every document with their frequency."""
    return lexical.postings(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens of every document and of every stored chunk version."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("item"), estimated_tokens(F.col("text")).alias("tokens"))
    chunks = spread(table(spark, folder, "chunks").select("chunk_id", "index_text")).select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("item"), estimated_tokens(F.col("index_text")).alias("tokens"))
    return docs.unionByName(chunks)


def postings_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and idf of every term."""
    index = index_of(spark, folder)
    return index.terms.crossJoin(index.collection).select("term", "df", "occurrences", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").filter("doc_id % 50 = 0")
    return documents.select(F.col("doc_id").alias("qid"), F.explode(terms(title_of(F.col("text")))).alias("term")).distinct()


def _hits(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return lexical.top(lexical.scores(index_of(spark, folder), "doc_id", _asked(spark, folder)), "doc_id", n)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents for the title of every document whose id is divisible by 50."""
    return _hits(spark, folder, 10).select("qid", "doc_id", "score", "rank")


def _channel(spark: SparkSession, folder: str):
    who = principals(spark, folder)
    hits = _hits(spark, folder, 200)
    # each question of the stated set by each principal (the groups in use); hits only meet their own question
    asking = table(spark, folder, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid")).crossJoin(who.select("principal"))
    hits = hits.join(asking, "qid").withColumn("path", F.col("doc_id").cast("string"))
    return access.channel(hits, readable_documents(spark, folder), who, n=50, overfetch=4)


def bm25_acl(spark: SparkSession, folder: str) -> DataFrame:
    """Those hits as each principal may see them, ranked after the filter."""
    return _channel(spark, folder)[0].select("qid", "principal", "doc_id", "score", "rank")


def bm25_acl_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hits before and after the filter, and starved channels."""
    return _channel(spark, folder)[1].select("qid", "principal", "raw_hits", "after_acl", "starved")


POSTED = f"""
{terms_cte("occ", "documents", "doc_id", "text")},
posted as (select doc_id, term, count(*) tf from occ group by 1, 2)"""
HITS = f"""
{POSTED},
titles as (select doc_id qid, regexp_extract(text, '(?m)^#+[ \\t]+([^\\r\\n]+)', 1) title from documents where doc_id % 50 = 0),
{terms_cte("asked_occ", "titles", "qid", "title")},
asked as (select distinct qid, term from asked_occ),
sizes as (select doc_id, sum(tf) size from posted group by 1),
coll as (select count(*) n, avg(size) mean_size from sizes),
freq as (select term, count(*) df from posted group by 1),
scored as (
  select qid, doc_id, round(sum(ln(n / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 6) score
  from asked join freq using (term) join posted using (term) join sizes using (doc_id), coll group by 1, 2),
ranked as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scored)"""
CHANNEL = f"""
{PRINCIPALS}, {READABLE}, {HITS},
raw as (select qid, principal, doc_id, score, rank from ranked, principals where rank <= 200),
kept as (select r.* from raw r join access a on a.principal = r.principal and a.doc_id = r.doc_id)"""
TOKENS = r"""
(length({0}) - length(regexp_replace({0}, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g'))
 + len(regexp_extract_all(regexp_replace({0}, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', ' ', 'g'), '[\p{L}\p{Nd}]{1,4}'))
 + len(regexp_extract_all(regexp_replace({0}, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', ' ', 'g'), '[\p{L}\p{Nd}]+')))"""


def queries() -> dict:
    return {f.__name__: f for f in (analyze_terms, token_estimate, postings_stats, bm25_topk, bm25_acl, bm25_acl_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "analyze_terms": f"with {POSTED} select doc_id, term, tf from posted",
        "token_estimate": f"select 'documents' as src, doc_id::varchar as item, {TOKENS.replace('{0}', 'text')} as tokens from documents union all select 'chunks', chunk_id, {TOKENS.replace('{0}', 'index_text')} from chunks",
        "postings_stats": f"with {POSTED}, n as (select count(distinct doc_id) n from posted) select term, count(*) as df, sum(tf)::bigint as occurrences, round(ln(any_value(n) / count(*)), 6) as idf from posted, n group by term",
        "bm25_topk": f"with {HITS} select qid, doc_id, score, rank from ranked where rank <= 10",
        "bm25_acl": f"with {CHANNEL} select qid, principal, doc_id, score, row_number() over (partition by qid, principal order by rank) as rank from kept qualify row_number() over (partition by qid, principal order by rank) <= 50",
        "bm25_acl_counts": f"with {CHANNEL}, a as (select qid, principal, count(*) raw_hits from raw group by 1, 2), b as (select qid, principal, count(*) n from kept group by 1, 2) select qid, principal, raw_hits, coalesce(n, 0) as after_acl, raw_hits = 200 and coalesce(n, 0) < 50 as starved from a left join b using (qid, principal)",
    }
