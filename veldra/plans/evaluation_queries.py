"""Queries of evaluation, answers and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analyzer import RUNS, resolved_forms, terms
from ..operators import access, answers, evaluation, lexical
from ..operators.skew import every_salt, salt
from ..sources.tables import current_rows, kept, spread, table
from .common import current_sql, forms_sql, principals, readable_documents, terms_cte, title_of
from .lexical_queries import CHANNEL, HITS, _channel, _hits, index_of
from .retrieval_queries import FUSED, _ranked


def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and reciprocal rank of the title queries, expecting the documents of that title."""
    own = table(spark, folder, "documents").select("doc_id", title_of(F.col("text")).alias("title")).filter("title <> ''")
    asked = own.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "title")
    expected = asked.join(own, "title").select("qid", "doc_id")
    found = evaluation.metrics(_hits(spark, folder, 50), expected, "doc_id")
    return found.select("qid", *[F.round(c, 6).alias(c) for c in found.columns if c != "qid"])


def leak_count(spark: SparkSession, folder: str) -> DataFrame:
    """Hits per principal and how many of them it may not read, by another join than the filter's."""
    who, documents = principals(spark, folder), readable_documents(spark, folder)
    hits = kept(_channel(spark, folder)[0].select(F.concat_ws("|", "qid", "principal").alias("qid"), "principal", "path"), "hits")
    must_not = hits.join(access.unreadable(hits.select("principal", "path").distinct(), documents, who), ["principal", "path"], "left_semi")
    bad = evaluation.leaks(hits, must_not).groupBy("principal").agg(F.count(F.lit(1)).alias("leaks"))
    return hits.join(who.filter("not admin"), "principal", "left_semi").groupBy("principal").agg(F.count(F.lit(1)).alias("hits")).join(bad, "principal", "left").na.fill(0, ["leaks"])


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stages: how many, mean, and latency percentiles of each type."""
    events = table(spark, folder, "events")
    sums = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return sums.join(evaluation.percentiles(events, "event_type", "value", 0.5, 0.95), "event_type")


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """What thresholds on the reranker's score would lose: questions are titles, answerable where
    another document has the same."""
    titled = table(spark, folder, "documents").select("doc_id", title_of(F.col("text")).alias("title"))
    asked = titled.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "title")
    answers_of = kept(asked.filter("title <> ''").join(titled, "title").filter("doc_id <> qid").select("qid", "doc_id").distinct(), "answers")
    scored = _ranked(spark, folder).select("qid", "doc_id", F.col("rerank").alias("score"), F.col("final_pos").alias("pos"))
    scored = scored.join(answers_of.withColumn("expected", F.lit(True)), ["qid", "doc_id"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    questions = asked.select("qid").join(answers_of.select("qid").distinct().withColumn("answerable", F.lit(True)), "qid", "left").select("qid", F.coalesce("answerable", F.lit(False)).alias("answerable"))
    return evaluation.threshold_sweep(scored, questions, [0, 0.1, 0.2, 0.4, 0.8])


def term_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Exact-term probe: every run of CJK letters, and every word, of the titles is asked for;
    precision and recall (capped by 10) of the 10 best documents against those whose
    text contains it.

    A term stands within one run of its text, which is posted whole (a CJK run in
    pairs), so a text holds a term if one of its own terms contains it.  A probe of
    several terms is looked for in the texts that hold all of them.
    """
    index, documents = index_of(spark, folder), table(spark, folder, "documents").select("doc_id", "text")
    plain = lambda text: F.lower(resolved_forms(text))
    titles = documents.filter("doc_id % 50 = 0").select(F.explode(F.regexp_extract_all(plain(title_of(F.col("text"))), F.lit(RUNS), F.lit(0))).alias("qid")).distinct()
    asked = kept(titles.select("qid", F.explode(terms(F.col("qid"))).alias("term")).distinct(), "asked")
    wanted = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("terms"))
    ranked = lexical.top(lexical.scores(index, "doc_id", asked), "doc_id", 10).select("qid", "doc_id")
    # own terms that contain an asked one share its first two characters (or its only one) with it
    grams = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(n)))
    sought = asked.select("term").distinct().withColumn("gram", F.substring("term", 1, 2))
    vocabulary = index.terms.select(F.col("term").alias("own")).withColumn("gram", F.explode(F.array_distinct(F.concat(grams(F.col("own"), 1), grams(F.col("own"), 2)))))
    within = vocabulary.join(sought, "gram").filter(F.contains("own", "term")).select("own", "term").distinct()
    holding = index.postings.select(F.col("term").alias("own"), "doc_id").join(within, "own").select("term", "doc_id").distinct()
    held = asked.withColumn("salt", every_salt(16)).join(holding.withColumn("salt", salt(16, "doc_id")), ["term", "salt"]).groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    all_terms = kept(held.join(wanted, "qid").filter("n = terms").select("qid", "doc_id", "terms"), "held")
    per_text = all_terms.filter("terms > 1").groupBy("doc_id").agg(F.collect_list("qid").alias("probes"))  # at most the probes, for a text
    found = per_text.join(documents, "doc_id").withColumn("plain", plain(F.col("text"))).select("doc_id", F.explode(F.filter("probes", lambda p: F.contains("plain", p))).alias("qid"))
    relevant = all_terms.filter("terms = 1").select("qid", "doc_id").unionByName(found).withColumn("held", F.lit(1))
    counts = relevant.join(ranked.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "full_outer").groupBy("qid").agg(F.count("held").alias("relevant"), F.count("hit").alias("hits"), F.count_if(F.col("held").isNotNull() & F.col("hit").isNotNull()).alias("good"))
    met = wanted.join(counts, "qid", "left").na.fill(0, ["relevant", "hits", "good"])
    precision = F.when(F.col("hits") > 0, F.col("good") / F.col("hits")).otherwise(0.0)
    recall = F.when(F.col("relevant") > 0, F.col("good") / F.least(F.lit(10), "relevant")).otherwise(1.0)
    return met.select(F.col("qid").alias("probe"), "relevant", "hits", "good", F.round(precision, 6).alias("precision_10"), F.round(recall, 6).alias("recall_10"))


#: Pairs of CJK letters, and the heading that a question is made of.
PAIR = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2}$"
FIRST_HEADING = r"(?sm)\A(.*?)^#+[ \t]+[^\r\n]+"


def bias_check(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a title question's distinct CJK pairs that texts hold: the documents of
    that title (mean, best) against all documents (mean) and the best other one.

    The heading that gives the question is left out of the texts.
    """
    documents = table(spark, folder, "documents").select("doc_id", "text", title_of(F.col("text")).alias("title"))
    questions = documents.filter("doc_id % 50 = 0 and title <> ''").select(F.col("doc_id").alias("qid"), "title")
    titles = questions.select("title").distinct()
    grams = titles.select("title", F.explode(F.array_distinct(F.filter(terms(F.col("title")), lambda t: t.rlike(PAIR)))).alias("term"))
    sizes = grams.groupBy("title").agg(F.count(F.lit(1)).alias("pairs"))
    bodies = spread(documents.select("doc_id", F.regexp_replace("text", FIRST_HEADING, "$1").alias("text")))
    held = lexical.postings(bodies, "doc_id", "text").select("doc_id", "term").join(grams, "term").groupBy("title", "doc_id").agg(F.count(F.lit(1)).alias("found"))
    own = titles.join(documents.select("title", "doc_id"), "title").withColumn("own", F.lit(True))
    share = F.col("found") / F.col("pairs")
    met = held.join(own, ["title", "doc_id"], "left").join(sizes, "title")
    sums = met.groupBy("title").agg(F.sum(share).alias("total"), F.sum(F.when(F.col("own"), share)).alias("own_total"), F.max(F.when(F.col("own"), share)).alias("own_best"), F.max(F.when(F.col("own").isNull(), share)).alias("other_best"))
    answers_of = own.groupBy("title").agg(F.count(F.lit(1)).alias("answers"))
    full = questions.join(answers_of, "title").join(sizes, "title", "left").join(sums, "title", "left").crossJoin(documents.agg(F.count(F.lit(1)).alias("n")))
    part = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return full.select("qid", F.coalesce("pairs", F.lit(0)).alias("pairs"), part(F.col("own_total") / F.col("answers")).alias("answer_mean"), part(F.col("own_best")).alias("answer_best"), part(F.col("total") / F.col("n")).alias("all_mean"), part(F.col("other_best")).alias("other_best"))


def trace_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 newest traces, newest first; of one time the later id."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "user_id")


def trace_redact(spark: SparkSession, folder: str) -> DataFrame:
    """Traces as a user who is no administrator sees them: own ones only for errors,
    and without the raw counts."""
    events = table(spark, folder, "events")
    raw = F.get_json_object("props", "$.k").cast("int")
    visible = F.when(F.col("event_type") == "error", F.lit(None).cast("int")).otherwise(raw)
    return events.select("event_id", visible.alias("raw_hits"), F.when(F.col("event_type") != "error", F.lit("acl-starvation")).alias("flag"))


def trace_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Traces per hour and type (extension)."""
    events = table(spark, folder, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return events.groupBy(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that every document cites in brackets, its codes and list numbers taken for
    citations, and the text with these rewritten."""
    coded = F.regexp_replace(F.regexp_replace("text", r"[A-Z]+-(\d+)", "[ $1 ]"), r"(?m)^(\d+)\. ", "【$1， 7】")
    texts = table(spark, folder, "documents").select("doc_id", coded.alias("text")).filter("text is not null")
    good, bad = answers.checked_citations(F.col("text"), F.lit(99))
    whole = F.md5(F.encode(answers.rewritten(F.col("text"), F.lit(99)), "UTF-8"))
    return texts.select("doc_id", F.array_join(good, ",").alias("cited"), F.array_join(bad, ",").alias("invalid"), whole.alias("answer_hash"))


def strip_think(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as answers whose quoted blocks are thinking, without it."""
    texts = table(spark, folder, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"(?m)^> ", "<think>"), r"(?m)^- ", "</think>").alias("text"))
    return texts.select("doc_id", F.md5(F.encode(answers.stripped_thinking(F.col("text")), "UTF-8")).alias("answer_hash"))


def neutralize_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose table rows are made sources tags, neutralized."""
    texts = table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"\|---\|---\|", "</ Sources >").alias("text"))
    return texts.select("doc_id", F.md5(F.encode(answers.neutral_sources(F.col("text")), "UTF-8")).alias("text_hash"))


#: Tokens within which the chunks of a block begin.
BLOCK_TOKENS = 6000


def prompt_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Sources blocks of all chunks of every document's sections, as a model would get them.

    A section whose chunks exceed a token budget has several blocks: each takes the
    chunks that begin within its share of the running total.
    """
    chunks = current_rows(table(spark, folder, "chunks").select("chunk_id", "doc_path", "section_id", "ordinal", "text", "tokens", "ingested_at"), "chunk_id").filter("doc_path is not null")
    sections = current_rows(table(spark, folder, "sections").select("section_id", "trail", "ingested_at"), "section_id").select("section_id", "trail")
    docs = current_rows(table(spark, folder, "docs").select("path", "title", "ingested_at"), "path").select(F.col("path").alias("doc_path"), "title")
    order = Window.partitionBy("doc_path", "section_id").orderBy("ordinal", "chunk_id")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = chunks.withColumn("block", F.floor(before / BLOCK_TOKENS).cast("int"))
    placed = cut.withColumn("n", F.row_number().over(Window.partitionBy("doc_path", "section_id", "block").orderBy("ordinal", "chunk_id")))
    full = placed.join(sections, "section_id", "left").join(docs, "doc_path", "left")
    grouped = full.groupBy("doc_path", "section_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "title", "trail", "text"))).alias("passages"))
    return grouped.select("doc_path", "section_id", "block", F.size("passages").alias("chunks"), F.md5(F.encode(answers.sources_block(F.col("passages")), "UTF-8")).alias("prompt_hash"))


_NEUTRAL = r"regexp_replace({}, '(?i)<(\s*/?\s*sources\s*)>', '＜\1＞', 'g')"


def queries() -> dict:
    return {f.__name__: f for f in (recall_mrr, leak_count, eval_summary, threshold_sweep, term_probe, bias_check, trace_recent, trace_redact, trace_windows, citations, strip_think, neutralize_sources, prompt_blocks)}


def oracle_sql() -> dict[str, str]:
    return {
        "recall_mrr": f"with {HITS}, tt as (select doc_id, regexp_extract(text, '(?m)^#+[ \\t]+([^\\r\\n]+)', 1) title from documents), e as (select q.doc_id qid, d.doc_id from tt q join tt d using (title) where q.doc_id % 50 = 0 and title <> ''), m as (select e.qid, r.rank from e left join (select * from ranked where rank <= 50) r on r.qid = e.qid and r.doc_id = e.doc_id) select qid, round(count(*) filter (rank <= 5) / count(*), 6) as recall_5, round(count(*) filter (rank <= 10) / count(*), 6) as recall_10, round(coalesce(1 / min(rank) filter (rank <= 10), 0), 6) as mrr_10 from m group by 1",
        "leak_count": f"with {CHANNEL}, seen as (select qid, principal, doc_id from kept join principals p using (principal) where not p.admin qualify row_number() over (partition by qid, principal order by rank) <= 50) select s.principal, count(*) as hits, count(*) filter (a.doc_id is null) as leaks from seen s left join access a on a.principal = s.principal and a.doc_id = s.doc_id group by 1",
        "eval_summary": "select event_type, count(*) as n, round(avg(value), 6) as mean_value, list_sort(list(value))[least(count(value), floor(0.5 * count(value))::bigint + 1)] as p50, list_sort(list(value))[least(count(value), floor(0.95 * count(value))::bigint + 1)] as p95 from events group by 1",
        "threshold_sweep": f"with {FUSED}, tt as (select doc_id, regexp_extract(text, '(?m)^#+[ \\t]+([^\\r\\n]+)', 1) title from documents), ans as (select distinct q.doc_id qid, d.doc_id from tt q join tt d using (title) where q.doc_id % 50 = 0 and title <> '' and d.doc_id <> q.doc_id), qs as (select doc_id qid, doc_id in (select qid from ans) answerable from documents where doc_id % 50 = 0), sel as (select f.qid, f.rerank score, a.doc_id is not null expected from final f left join ans a on a.qid = f.qid and a.doc_id = f.doc_id where f.rerank is not null qualify row_number() over (partition by f.qid order by final_pos) <= 8), ts as (select unnest([null, 0, 0.1, 0.2, 0.4, 0.8]::double[]) threshold), per as (select t.threshold, q.qid, q.answerable, count(s.qid) filter (t.threshold is null or s.score >= t.threshold) kept, count(s.qid) filter (expected and (t.threshold is null or s.score >= t.threshold)) found, count(s.qid) filter (expected) any_ from ts t cross join qs q left join sel s on s.qid = q.qid group by 1, 2, 3) select threshold, count(*) filter (answerable and found > 0) as hit, count(*) filter (answerable and any_ > 0 and found = 0) as lost, count(*) filter (answerable and kept = 0) as answerable_empty, count(*) filter (not answerable and kept = 0) as control_empty, round(avg(kept), 6) as mean_kept, count(*) filter (answerable) as answerable, count(*) filter (not answerable) as control from per group by 1",
        "term_probe": f"with {HITS}, texts as (select doc_id, lower({forms_sql('text')}) t from documents), runs0 as (select distinct unnest(regexp_extract_all(lower({forms_sql('title')}), '[a-z0-9]+(?:[-_./][a-z0-9]+)*|[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]+')) probe from titles), {terms_cte('pocc', 'runs0', 'probe', 'probe')}, pterms as (select distinct probe, term from pocc), rel as (select probe, doc_id from runs0 join texts on contains(t, probe)), pscored as (select probe, doc_id, round(sum(ln(n / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 6) score from pterms join freq using (term) join posted using (term) join sizes using (doc_id), coll group by 1, 2), best as (select probe, doc_id from pscored qualify row_number() over (partition by probe order by score desc, doc_id) <= 10), g as (select probe, count(*) hits, count(rel.doc_id) good from best left join rel using (probe, doc_id) group by 1), r as (select probe, count(*) relevant from rel group by 1) select probe, coalesce(relevant, 0) as relevant, coalesce(hits, 0) as hits, coalesce(good, 0) as good, round(case when hits > 0 then good / hits else 0 end, 6) as precision_10, round(case when relevant > 0 then coalesce(good, 0) / least(10, relevant) else 1 end, 6) as recall_10 from runs0 left join r using (probe) left join g using (probe)",
        "bias_check": f"with d as (select doc_id, regexp_extract(text, '(?m)^#+[ \\t]+([^\\r\\n]+)', 1) title, regexp_replace(text, '(?m)^#+[ \\t]+[^\\r\\n]+', '') body from documents), {terms_cte('tt', 'd', 'doc_id', 'title')}, {terms_cte('bt', 'd', 'doc_id', 'body')}, q as (select doc_id qid, title from d where doc_id % 50 = 0 and title <> ''), g as (select distinct qid, term from q join tt on doc_id = qid where regexp_full_match(term, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]{{2}}')), b as (select distinct doc_id, term from bt), s as (select qid, count(*) pairs from g group by 1), f as (select qid, doc_id, count(*) found from g join b using (term) group by 1, 2), c as (select q.qid, coalesce(s.pairs, 0) pairs, d.title = q.title own, coalesce(f.found / s.pairs, 0) x from q cross join d left join s on s.qid = q.qid left join f on f.qid = q.qid and f.doc_id = d.doc_id) select qid, any_value(pairs) as pairs, round(avg(x) filter (own), 6) as answer_mean, round(max(x) filter (own), 6) as answer_best, round(avg(x), 6) as all_mean, round(coalesce(max(x) filter (not own), 0), 6) as other_best from c group by 1",
        "trace_recent": "select event_id, event_type, user_id from events order by ts desc, event_id desc limit 50",
        "trace_redact": "select event_id, case when event_type <> 'error' then json_extract_string(props, '$.k')::int end as raw_hits, case when event_type <> 'error' then 'acl-starvation' end as flag from events",
        "trace_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from events group by 1, 2",
        "citations": r"with t as (select doc_id, replace(replace(replace(regexp_replace(regexp_replace(text, '[A-Z]+-(\d+)', '[ \1 ]', 'g'), '(?m)^(\d+)\. ', '【\1， 7】', 'g'), '](', chr(1)), '］(', chr(2)), '】(', chr(3)) x from documents where text is not null), p as (select doc_id, x, string_split_regex(x, '[\[［【]\s*(\p{Nd}+(?:\s*[,，、]\s*\p{Nd}+)*)\s*[\]］】]') between_, list_transform(regexp_extract_all(x, '[\[［【]\s*(\p{Nd}+(?:\s*[,，、]\s*\p{Nd}+)*)\s*[\]］】]', 1), lambda g: list_transform(string_split_regex(translate(g, '０１２３４５６７８９', '0123456789'), '\s*[,，、]\s*'), lambda v: coalesce(try_cast(v as bigint), 0))) groups from t), r as (select doc_id, list_sort(list_distinct(flatten(groups))) n, array_to_string(list_transform(range(1, len(between_) + 1), lambda i: between_[i] || case when i <= len(groups) then array_to_string(list_transform(list_filter(groups[i], lambda v: v between 1 and 99), lambda v: '[' || v || ']'), '') else '' end), '') a from p) select doc_id, array_to_string(list_filter(n, lambda v: v between 1 and 99), ',') as cited, array_to_string(list_filter(n, lambda v: v not between 1 and 99), ',') as invalid, md5(replace(replace(replace(a, chr(1), ']('), chr(2), '］('), chr(3), '】(')) as answer_hash from r",
        "strip_think": r"with t as (select doc_id, regexp_replace(regexp_replace(text, '(?m)^> ', '<think>', 'g'), '(?m)^- ', '</think>', 'g') x from documents), o as (select doc_id, regexp_replace(regexp_replace(x, '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 's') y from t) select doc_id, md5(regexp_replace(case when contains(y, '</think>') then substr(y, instr(y, '</think>') + 8) else y end, '^[\t-\r\x1c-\x20\x{3000}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{1680}]+|[\t-\r\x1c-\x20\x{3000}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{1680}]+$', '', 'g')) as answer_hash from o",
        "neutralize_sources": r"select doc_id, md5(regexp_replace(regexp_replace(text, '\|---\|---\|', '</ Sources >', 'g'), '(?i)<(\s*/?\s*sources\s*)>', '＜\1＞', 'g')) as text_hash from documents",
        "prompt_blocks": rf"with c as (select *, coalesce(sum(tokens) over (partition by doc_path, section_id order by ordinal, chunk_id rows between unbounded preceding and 1 preceding), 0) before from {current_sql('chunks', 'chunk_id')} where doc_path is not null), b as (select *, (before // {BLOCK_TOKENS})::int block from c), p as (select *, row_number() over (partition by doc_path, section_id, block order by ordinal, chunk_id) n from b), f as (select p.doc_path, p.section_id, block, n, {_NEUTRAL.format('d.title')} title, {_NEUTRAL.format('s.trail')} trail, {_NEUTRAL.format('p.text')} t from p left join {current_sql('sections', 'section_id')} s using (section_id) left join {current_sql('docs', 'path')} d on d.path = p.doc_path) select doc_path, section_id, block, count(*)::int as chunks, md5('<sources>' || chr(10) || string_agg('[' || n || '] ' || coalesce(title, '') || '｜' || coalesce(trail, '') || chr(10) || coalesce(t, ''), chr(10) || chr(10) order by n) || chr(10) || '</sources>') as prompt_hash from f group by 1, 2, 3",
    }
