"""Search with filters and routes, the vector index, batches and what a report shows, as queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.operators import batch, facts, failures, index, local_batch, ranks, report, search
from corpusgrid.operators.runs import BatchRun
from corpusgrid.operators.scope import ScopedStore, batches
from corpusgrid.plans.papers import FACTS, LINES, PAGES, SECTIONS, pages
from corpusgrid.plans.retrieval import BM25, TOKENS, table
from corpusgrid.session import materialise, shared_dir

SECTION = "case page_number % 4 when 1 then 'Introduction' when 2 then 'Methods' when 3 then 'Results' else 'References' end"
PASSAGES = "pa as (select source_file || ':' || page_number passage_id, source_file, {section} section, text from pages)".format(section=SECTION)


def page_passages(spark, sf) -> DataFrame:
    """Each page as a passage with a section by its number."""
    rows = pages(spark, sf)
    return rows.select(F.concat_ws(":", "source_file", "page_number").alias("passage_id"), "source_file", F.expr(SECTION).alias("section"), "text")


def filtered(spark, sf):
    """Passages by section: without references, with them, and those of two named sections."""
    rows, each = page_passages(spark, sf), ["passage_id", "section"]
    plain = search.passages(rows).select(*each, F.lit("plain").alias("filter"))
    whole = search.passages(rows, references=True).select(*each, F.lit("whole").alias("filter"))
    named = search.passages(rows, sections=["results", " Methods "]).select(*each, F.lit("named").alias("filter"))
    return plain.unionByName(whole).unionByName(named).groupBy("filter", "section").agg(F.count(F.lit(1)).alias("n"), F.min("passage_id").alias("first"))


FILTERED = f"""with {PAGES}, {PASSAGES},
u as (select 'plain' "filter", * from pa where section <> 'References' union all select 'whole', * from pa union all select 'named', * from pa where section in ('Results', 'Methods'))
select "filter", section, count(*) n, min(passage_id) "first" from u group by 1, 2"""


def statistical_hits(spark, sf):
    """The best passages for 'p value' and for 'p = 0.0n' of every line number n."""
    n = F.col("l_linenumber").cast("long")
    asked = table(spark, sf, "lineitem").select(n.alias("qid"), F.concat(F.lit("p = 0.0"), n).alias("text")).distinct()
    general = table(spark, sf, "lineitem").agg(F.lit(0).cast("long").alias("qid"), F.lit("P value").alias("text"))
    out = search.search(page_passages(spark, sf), asked.unionByName(general))
    return out.select("qid", "route", "passage_id", F.col("rank").cast("long").alias("rank"))


STATISTICAL = f"""with {PAGES}, {PASSAGES}, q as (select distinct l_linenumber::bigint qid, 'p = 0.0' || l_linenumber as q from lineitem union all select 0, 'p value'),
h as (select qid, passage_id, q, (length(text) - length(replace(lower(text), q, ''))) // length(q) times, length(text) length from pa join q on section <> 'References' and (qid = 0 or contains(text, q)))
select qid, 'statistical' route, passage_id, rank from (select *, row_number() over (partition by qid order by times desc, length, passage_id) rank from h) where rank <= 10"""


def routed(spark, sf):
    """Every benchmark item as a query: odd items whole, even ones as a phrase of three of their tokens in quotes, every tenth blank."""
    words = F.slice(X.tokens(F.col("text")), 1, 3)
    said = F.when(F.col("item_id") % 10 == 0, " ").when(F.col("item_id") % 2 == 0, F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"'))).otherwise(F.col("text"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), said.alias("text"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("source_file"), F.col("lang").alias("section"), "text")
    return search.search(rows, asked, references=True).select("qid", "route", "passage_id", "score", F.col("rank").cast("long").alias("rank"))


ROUTED = f"""with {BM25}, ph as (select item_id qid, ' ' || array_to_string(list_slice({TOKENS.format('text')}, 1, 3), '  ') || ' ' p from benchmark where item_id % 2 = 0 and item_id % 10 <> 0),
sp as (select doc_id, len(t) dl, ' ' || array_to_string(t, '  ') || ' ' s from d),
pt as (select qid, doc_id, dl, (length(s) - length(replace(s, p, ''))) // length(p) tf from sp join ph on contains(s, p)),
pd as (select qid, count(*) df from pt group by 1),
pi as (select qid, av, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end idf from pd, st),
al as (select qid, 'phrase' route, doc_id passage_id, round(-(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) score from pt join pi using (qid)
       union all select qid, 'terms', doc, score from sc where qid % 2 = 1)
select qid, route, passage_id, score, rank from (select *, row_number() over (partition by qid order by score, passage_id) rank from al) where rank <= 10"""


def _build(spark, sf):
    """A build over all documents, encoded by the given vectors; of the cache a third is valid, a third of an older text, a third missing."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    name = index.fingerprint(dimension=64)
    digest = F.sha2(F.when(F.col("passage_id") % 3 == 0, F.coalesce("text", F.lit(""))).otherwise("older"), 256)
    cache = docs.join(known, "passage_id").where("passage_id % 3 < 2").select("passage_id", F.lit(name).alias("encoder"), digest.alias("text_hash"), F.lit(64).alias("dimension"), F.col("vector").cast("array<float>").alias("vector"))
    return index.build(docs, cache, lambda rows: rows.join(known, "passage_id").select("passage_id", "vector"), name, 64)


def index_state(spark, sf):
    return index.state(_build(spark, sf)[1])


def index_rows(spark, sf):
    return _build(spark, sf)[0].select("passage_id", "text_hash", F.size("vector").cast("long").alias("dimension"))


INDEX_STATE = """with d as (select doc_id, vec_id is not null has, doc_id % 3 = 0 and vec_id is not null cached from documents left join embeddings on vec_id = doc_id),
s as (select count(*) total, count_if(cached)::bigint cached, count_if(has and not cached)::bigint encoded, count_if(not has)::bigint failed from d)
select *, case when total = 0 then 'EMPTY' when failed = 0 then 'READY' when cached + encoded = 0 then 'NOT_READY' else 'PARTIAL' end state from s"""
INDEX_ROWS = "select doc_id passage_id, sha256(coalesce(text, '')) text_hash, len(embedding)::bigint dimension from documents join embeddings on vec_id = doc_id"


def removed(spark, sf):
    """Documents by source and language after the removal of one source."""
    rows = table(spark, sf, "documents").withColumnRenamed("source", "source_file")
    return index.without_source(rows, "src1").groupBy("source_file", "lang").agg(F.count(F.lit(1)).alias("n"))


REMOVED = "select source source_file, lang, count(*) n from documents where source is distinct from 'src1' group by 1, 2"


def _batch(spark, sf):
    """Inputs with their status, and documents with that of their first input's label."""
    inputs = batch.identified(table(spark, sf, "documents"), "doc_id", "text")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("pending")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    documents = inputs.where("duplicate_of is null").join(labels, "doc_id").select("document_id", status.alias("status"))
    return batch.statuses(inputs, documents), documents


def input_statuses(spark, sf):
    return _batch(spark, sf)[0].select("doc_id", "status")


def batch_outcome(spark, sf):
    return batch.outcome(*_batch(spark, sf))


BATCH = """with i as (select doc_id, text, min(doc_id) over (partition by text) f from documents),
l as (select doc_id f, case when max(toxic) = 1 then 'failed' when max(quality) = 1 then 'completed' else 'pending' end status from labels group by 1),
s as (select i.doc_id, case when i.doc_id <> f then 'duplicate' else coalesce(status, 'pending') end status from i left join l using (f)),
dd as (select status from l join i using (f) where doc_id = f)
"""
OUTCOME = BATCH + """select (select count(*) from s) inputs, (select count_if(status = 'duplicate')::bigint from s) duplicates, 0::bigint skipped, count(*) documents,
count_if(status = 'completed')::bigint completed, count_if(status = 'failed')::bigint failed, case when count_if(status = 'failed') > 0 then 'completed_with_errors' else 'completed' end status from dd"""


def sentence_keys(spark, sf):
    """How many sentences of each document say the same as another of it."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(report.sentence_key(F.col("s"))).alias("keys"))


KEYS = r"""with s as (select doc_id, unnest(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) s from documents),
k as (select doc_id, regexp_replace(translate(regexp_replace(s, '^(?i:methods?|methodology|materials\s+and\s+methods?)\s+', ''), '；。：，！？', ';.:,!?'), '\s*([,;:.!?])\s*', '\1', 'g') k from s)
select doc_id, count(*) n, count(distinct lower(trim(regexp_replace(k, '[.!?;]+$', '')))) "keys" from k group by 1"""


def page_segments(spark, sf):
    return report.segments(pages(spark, sf), ["source_file", "page_number"]).withColumn("segment", F.col("segment").cast("long"))


SEGMENTS = f"""with {PAGES}, p as (select *, string_split(text, chr(10)) l from pages)
select source_file, page_number, unnest([1, 2])::bigint segment, unnest([l[1] || ' ' || l[2] || ' ' || l[3], l[5]]) as text from p"""


def evidence_items(spark, sf):
    rows = facts.facts(pages(spark, sf))
    rows = rows.select(F.col("source_file").alias("document_id"), (F.col("page_number") * 10 + F.col("sentence_no")).alias("position"), F.lit("results").alias("section"), "category", "quote", F.array("page_number").alias("pages"))
    out = report.merged_evidence(rows)
    return out.select("document_id", "quote", F.array_join("pages", ",").alias("pages"), F.array_join("categories", ",").alias("categories"), F.col("rank").cast("long").alias("rank"))


EVIDENCE = "with " + PAGES + FACTS + """, m as (select source_file, quote, page_number, min(sentence_no) s, string_agg(category, ',' order by category) categories from fa group by 1, 2, 3)
select source_file document_id, quote, page_number::varchar pages, categories, rank from (select *, row_number() over (partition by source_file order by page_number, s) rank from m) where rank <= 8"""


def samples(spark, sf):
    rows = facts.facts(pages(spark, sf))
    return report.sample_sizes(rows.select(F.col("source_file").alias("document_id"), (F.col("page_number") * 10 + F.col("sentence_no")).alias("position"), "category", F.col("page_number").alias("page"), F.lit(False).alias("table"), F.col("quote").alias("text")))


SAMPLES = "with " + PAGES + FACTS + r""", s as (select source_file, page_number, regexp_extract(quote, '\d+ participants') sample from fa where category = 'sample_size')
select source_file document_id, arg_min(sample, (length(sample), page_number)) sample from s group by 1"""


def kept_tokens(spark, sf):
    """Protected tokens of each page, and whether its last line alone would keep them."""
    last = F.element_at(F.split("text", "\n"), -1)
    rows = pages(spark, sf)
    return rows.select("source_file", "page_number", F.array_join(report.protected_tokens(F.col("text")), "|").alias("tokens"), report.preserved(last, F.col("text")).alias("whole"), report.preserved(F.col("text"), last).alias("cut"))


KEPT = "with " + PAGES + r""", t as (select source_file, page_number, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)(p\s*[<=>]\s*0?\.\d+|\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:weeks?|days?|months?))', 1), regexp_extract_all(text, '(\b\d+(?:\.\d+)?\b)', 1)), lambda x: lower(replace(x, ' ', ''))))) t from pages)
select source_file, page_number, array_to_string(t, '|') tokens, true whole, false cut from t"""


def _words_of(docs: DataFrame) -> DataFrame:
    """An extractor: the number of words; texts of fewer than 100 characters fail."""
    return docs.select("document_id", F.size(F.split("content", " ")).cast("string").alias("result"), F.when(F.length("content") < 100, "too_short").alias("error"))


def _resumed(spark, sf) -> BatchRun:
    """A batch over nine tenths of the documents, paused after 50 of them, opened again with all inputs, and run to its end in waves."""
    docs = table(spark, sf, "documents")
    name = F.concat_ws("-", "source", "lang")
    run = BatchRun(spark, f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}")
    run.open(docs.where("doc_id % 10 <> 3"), name, F.col("text"), "doc_id")
    run.run(_words_of, pause_after=50)
    run.open(docs, name, F.col("text"), "doc_id")
    run.run(_words_of, wave=10_000)
    return run


def resumed_inputs(spark, sf):
    run = _resumed(spark, sf)
    old = run.store.read(run.store.at(1), "inputs").select("alias", F.col("input_id").alias("old"))
    rows = run.inputs().join(old, "alias", "left")
    return rows.select("position", "alias", "document_id", "status", F.coalesce(F.col("input_id") == F.col("old"), F.lit(False)).alias("kept_id"))


RESUMED = """with i as (select doc_id position, source || '-' || lang as n, text, row_number() over (partition by source, lang order by doc_id) k, row_number() over (partition by text order by doc_id) copy from documents),
c as (select source || '-' || lang as n, count(*) old from documents where doc_id % 10 <> 3 group by 1)
select position, i.n || case when k > 1 then ' #' || k else '' end alias, 'doc_' || sha256(text) document_id, case when copy > 1 then 'duplicate' when length(text) < 100 then 'failed' else 'completed' end status, k <= coalesce(old, 0) kept_id from i left join c using (n)"""


def resumed_documents(spark, sf):
    return _resumed(spark, sf).documents().select("document_id", "position", "alias", F.col("n_inputs").cast("long").alias("n_inputs"), "status", F.coalesce("error", F.lit("")).alias("error"), F.col("result").cast("long").alias("result"))


RESUMED_DOCUMENTS = """with i as (select doc_id position, text, source || '-' || lang || case when row_number() over (partition by source, lang order by doc_id) > 1 then ' #' || row_number() over (partition by source, lang order by doc_id) else '' end alias, row_number() over (partition by text order by doc_id) copy, count(*) over (partition by text) n_inputs from documents)
select 'doc_' || sha256(text) document_id, position, alias, n_inputs, case when length(text) < 100 then 'failed' else 'completed' end status, case when length(text) < 100 then 'too_short' else '' end error, len(string_split(text, ' ')) result from i where copy = 1"""


def resumed_state(spark, sf):
    return _resumed(spark, sf).state()


RESUMED_STATE = """with d as (select text, count(*) n from documents group by 1) select sum(n)::bigint inputs, sum(n - 1)::bigint duplicates, 0 skipped, count(*) documents, count_if(length(text) >= 100)::bigint completed, count_if(length(text) < 100)::bigint failed,
case when count_if(length(text) < 100) > 0 then 'completed_with_errors' else 'completed' end status from d"""


def positional(spark, sf):
    """Documents with their label; a document without one takes the label at its own place."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    out = ranks.positional(labels, table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "doc_id", "doc_id")
    return out.select("doc_id", "source", F.col("row.doc_id").alias("label_of"), F.col("row.quality").alias("quality"), F.coalesce("matched", F.lit("none")).alias("matched"))


POSITIONAL = """with d as (select doc_id, source, row_number() over (order by doc_id) i from documents), l as (select *, row_number() over (order by doc_id) i from labels)
select d.doc_id, source, coalesce(k.doc_id, p.doc_id) label_of, coalesce(k.quality, p.quality)::bigint quality, case when k.doc_id is not null then 'key' when p.doc_id is not null then 'position' else 'none' end matched
from d left join l k on k.doc_id = d.doc_id left join l p on p.i = d.i"""


def inherited(spark, sf):
    """Orders whose priority or flag is blank take the first line item's that has one."""
    final = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("note"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("flag"))
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.when(F.col("l_quantity") > 10, F.concat("l_returnflag", F.lit("-"), "l_linenumber")).otherwise("").alias("note"), F.when(F.col("l_discount") > 0.03, F.concat("l_linestatus", F.lit("/"), "l_linenumber")).alias("flag"))
    return failures.inherited(final, parts, "o_orderkey", "at", ["note", "flag"]).withColumn("inherited", F.array_join("inherited", ","))


INHERITED = """with p as (select l_orderkey, arg_min(l_returnflag || '-' || l_linenumber, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) filter (where l_quantity > 10) note, arg_min(l_linestatus || '/' || l_linenumber, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) filter (where l_discount > 0.03) flag from lineitem group by 1),
f as (select o_orderkey, case when o_orderkey % 2 = 0 then '' else o_orderpriority end note, case when o_orderkey % 3 <> 0 then o_orderstatus end flag from orders)
select f.o_orderkey, case when f.note = '' then coalesce(p.note, f.note) else f.note end note, coalesce(f.flag, p.flag) flag, concat_ws(',', case when f.note = '' and p.note is not null then 'note' end, case when f.flag is null and p.flag is not null then 'flag' end) inherited from f left join p on l_orderkey = o_orderkey"""


def traced(spark, sf):
    """Each line item as a call, whose error, status and answer follow from its columns: how the calls of a supplier ended."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_partkey") % 12
    error = F.when(n == 0, "Rate Limit of key").when(n == 1, "read timed out").when(n == 2, "connection reset by peer").when(n == 3, "the model does not exist").when(n == 4, "bad JSON").when(n.isin(5, 6), "answered with an error")
    status = F.when(n == 5, 400 + F.col("l_suppkey") % 5).when(n == 6, 503)
    calls = li.select("l_suppkey", error.alias("error"), F.lit("").alias("code"), status.alias("status"), F.lit("ProviderError").alias("kind"), F.when(n == 7, "").otherwise("{}").alias("content"), (~n.isin(7, 8)).alias("parsed"), F.when(n == 9, F.array(F.lit("UNKNOWN_EVIDENCE_ID"))).when(n == 10, F.array(F.lit("ODD"))).alias("warnings"))
    return failures.trace(calls).groupBy("l_suppkey", "stage", "outcome").agg(F.count(F.lit(1)).alias("calls"))


TRACED = """with c as (select l_suppkey, l_partkey % 12 n, 400 + l_suppkey % 5 st from lineitem)
select l_suppkey, case when n <= 6 then 'request' when n <= 8 then 'parse' when n <= 10 then 'validate' else 'done' end stage,
case n when 0 then 'RATE_LIMIT' when 1 then 'TIMEOUT' when 2 then 'CONNECTION_ERROR' when 3 then 'INVALID_PROVIDER_CONFIG' when 4 then 'MALFORMED_PROVIDER_RESPONSE' when 5 then case when st in (401, 403) then 'AUTH_ERROR' else 'PROVIDER_4XX' end when 6 then 'PROVIDER_5XX'
when 7 then 'EMPTY_RESPONSE' when 8 then 'INVALID_JSON' when 9 then 'UNKNOWN_EVIDENCE_ID' when 10 then 'OTHER_VALIDATION_FAILURE' else 'VALID' end outcome, count(*) calls from c group by all"""


def scoped(spark, sf):
    """Every language of the documents as a batch, one of which is written anew after the contexts were made; and a context of a batch that is not there."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("batch_id"), F.col("doc_id").cast("string").alias("passage_id"), F.col("source").alias("source_file"), F.lit("Methods").alias("section"), "text")
    store = ScopedStore(spark, f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}")
    store.put(docs)
    first = docs.agg(F.min("batch_id")).first()[0]
    contexts = batches(docs).select(F.xxhash64("batch_id").alias("context_id"), "batch_id", "digest").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("context_id"), F.lit("none").alias("batch_id"), F.lit("").alias("digest")))
    contexts = materialise(contexts, "contexts")
    store.put(docs.where((F.col("batch_id") == first) & (F.length("text") > 200)))
    rows = store.passages(contexts).groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch_id").alias("batches"))
    return store.states(contexts).join(rows, "context_id", "left").select("batch_id", "state", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("batches", F.lit(0)).alias("batches"))


SCOPED = """select lang batch_id, case when lang = (select min(lang) from documents) then 'stale' else 'present' end state, case when lang = (select min(lang) from documents) then 0 else count(*) end n, case when lang = (select min(lang) from documents) then 0 else 1 end batches from documents group by lang
union all select 'none', 'missing', 0, 0"""


def whole_batch(spark, sf):
    """Every order as an input of form-fed pages, from extraction to selection; the index finds the passages of one quantity."""
    p = pages(spark, sf).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\f").alias("content"))
    inputs = p.select(F.substring("source_file", 7, 20).cast("long").alias("key"), F.col("source_file").alias("name"), "content")
    out = local_batch.process(spark, f"{shared_dir(spark)}/local-{uuid.uuid4().hex}", inputs, F.col("name"), F.col("content"), "key", passage_size=300, export=False)
    found = out.index.phrases(spark.createDataFrame([(1, "study included 7 participants")], "qid long, text string"))
    hits = found.join(out.passages.select(F.col("passage_id").alias("doc"), "source_file"), "doc").groupBy(F.col("source_file").alias("document_id")).agg(F.sum("times").alias("hits"))
    counts = out.pages.groupBy(F.col("source_file").alias("document_id")).agg(F.count(F.lit(1)).alias("n_pages"))
    rows = out.selection.join(counts, "document_id", "left").join(hits, "document_id", "left")
    return rows.select("document_id", "name", "status", "n_pages", "verified", "sections", F.col("score").cast("long").alias("score"), F.col("selection_rank").cast("long").alias("selection_rank"), "layout", F.coalesce("hits", F.lit(0)).alias("hits"))


WHOLE = "with " + LINES + SECTIONS + """, c as (select source_file, string_agg(text, chr(12) order by page_number) content, count(*) n_pages, count_if(contains(text, 'study included 7 participants')) hits from pages group by 1),
d as (select 'doc_' || sha256(content) document_id, arg_min(source_file, source_file[7:]::bigint) as "name", any_value(n_pages) n_pages, any_value(hits) hits from c group by 1),
s as (select d.*, n_pages * 5 verified, (select count(*) from ss where ss.source_file = d.name and ss.text <> '') sections from d),
r as (select *, (10 + least(verified, 20) * 2 + least(sections, 8))::bigint score from s)
select document_id, name, 'completed' status, n_pages, verified, sections, score, case when row_number() over (order by score desc, document_id) <= 10 then row_number() over (order by score desc, document_id) end selection_rank, 'vertical' layout, hits from r"""


QUERIES = {
    "bat04_local_batch": whole_batch,
    "jon11_positional": positional, "mr09_inherited_fields": inherited, "qa10_trace": traced, "flt05_batch_scope": scoped,
    "bat02_resumed_inputs": resumed_inputs, "bat02_resumed_documents": resumed_documents, "snk11_batch_state": resumed_state,
    "src08_passage_filters": filtered, "top02_statistical_hits": statistical_hits, "ret01_routed_search": routed, "ret08_index_state": index_state, "snk09_index_rows": index_rows, "snk10_remove_source": removed,
    "bat03_statuses": input_statuses, "agg18_batch_outcome": batch_outcome, "txt20_sentence_keys": sentence_keys, "txt05_segments": page_segments, "agg14_merged_evidence": evidence_items, "comp02_sample_sizes": samples, "mr12_protected_tokens": kept_tokens,
}
ORACLE = {
    "bat04_local_batch": WHOLE,
    "jon11_positional": POSITIONAL, "mr09_inherited_fields": INHERITED, "qa10_trace": TRACED, "flt05_batch_scope": SCOPED,
    "bat02_resumed_inputs": RESUMED, "bat02_resumed_documents": RESUMED_DOCUMENTS, "snk11_batch_state": RESUMED_STATE,
    "src08_passage_filters": FILTERED, "top02_statistical_hits": STATISTICAL, "ret01_routed_search": ROUTED, "ret08_index_state": INDEX_STATE, "snk09_index_rows": INDEX_ROWS, "snk10_remove_source": REMOVED,
    "bat03_statuses": BATCH + "select doc_id, status from s", "agg18_batch_outcome": OUTCOME, "txt20_sentence_keys": KEYS, "txt05_segments": SEGMENTS, "agg14_merged_evidence": EVIDENCE, "comp02_sample_sizes": SAMPLES, "mr12_protected_tokens": KEPT,
}
