"""Structure, fact, identity and report queries with their SQL.

The tables have no papers, so these queries compose them from line items, with the same expressions in Spark and in SQL: an order is a
document, its line items are its pages, each with a heading (one of four kinds by page number), two sentences, a blank line and another sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.operators import batch, comparison, evidence, facts, mapreduce, quotes, structure, summary
from corpusgrid.plans.retrieval import table

PAGE = """case page_number % 4 when 1 then 'Introduction' when 2 then '2) Methods' when 3 then 'Results' else 'Funding' end || chr(10) ||
'The study included ' || cast(l_quantity as bigint) || ' participants.' || chr(10) || 'The effect was significant with p = 0.0' || l_linenumber || '.' || chr(10) || chr(10) ||
'Samples were stored at ' || (l_partkey % 90) || ' C for ' || (l_suppkey % 9 + 1) || ' days.'"""
PAGES = f"""li as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) page_number from lineitem),
pages as (select 'order-' || l_orderkey source_file, page_number, {PAGE} as text from li)"""
LINES = PAGES + r""",
ls as (select source_file, page_number, unnest(range(5)) line_no, unnest(string_split(text, chr(10))) line from pages),
hs as (select *, case line when 'Introduction' then 'introduction' when '2) Methods' then 'methods' when 'Results' then 'results' when 'Funding' then 'excluded' end kind from ls),
cs as (select *, last_value(kind ignore nulls) over (partition by source_file order by page_number, line_no rows unbounded preceding) section from hs)"""


def pages(spark, sf) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("page_number", F.row_number().over(order))
    return rows.select(F.concat(F.lit("order-"), F.col("l_orderkey")).alias("source_file"), F.col("page_number").cast("long").alias("page_number"), F.expr(PAGE).alias("text"))


def carry(spark, sf):
    rows = structure.carried(structure.page_lines(pages(spark, sf)))
    return rows.groupBy("source_file", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def units(spark, sf):
    return structure.units(pages(spark, sf)).select("source_file", "page_number", "section", "text")


UNITS = "with " + LINES + """, us as (select *, sum((kind is not null or line = '')::int) over (partition by source_file, page_number order by line_no rows unbounded preceding) u from cs)
select source_file, page_number, case when section is null or section = 'excluded' then 'Unknown' else upper(section[1]) || section[2:] end section, string_agg(line, ' ' order by line_no) as text from us where kind is null and line <> '' group by source_file, page_number, u, section"""


def sections(spark, sf):
    return structure.sections(pages(spark, sf))


SECTIONS = ", ss as (select source_file, section, arg_min(line, page_number * 10 + line_no) filter (where kind is not null) title, coalesce(string_agg(line, chr(10) order by page_number, line_no) filter (where kind is null), '') as text, min(page_number) page_start, max(page_number) page_end from cs where section is not null and section <> 'excluded' and line <> '' group by 1, 2)"""


def passages(spark, sf):
    return structure.passages(pages(spark, sf), 300).select("passage_id", "source_file", "section", "text", "page_start", "page_end", "ordinal")


def chunks(spark, sf):
    return structure.chunks(pages(spark, sf), 400, 50)


PASSAGES = "with recursive " + LINES + """, us as (select *, sum((kind is not null or line = '')::int) over (partition by source_file, page_number order by line_no rows unbounded preceding) u from cs),
un as (select source_file, page_number, case when section is null or section = 'excluded' then 'Unknown' else upper(section[1]) || section[2:] end section, string_agg(line, ' ' order by line_no) as text, u from us where kind is null and line <> '' group by source_file, page_number, u, section),
pc as (select *, row_number() over (partition by source_file order by page_number, u) i from un),
r as (select source_file, i, 1 ordinal, section, text, page_number page_start, page_number page_end from pc where i = 1 union all
  select p.source_file, p.i, case when f then r.ordinal else r.ordinal + 1 end, p.section, case when f then r.text || ' ' || p.text else p.text end, case when f then r.page_start else p.page_number end, p.page_number
  from (select r.*, r.section = q.section and length(r.text) + 1 + length(q.text) <= 300 f from r join pc q on q.source_file = r.source_file and q.i = r.i + 1) r join pc p on p.source_file = r.source_file and p.i = r.i + 1),
w as (select source_file, ordinal, arg_max(section, i) section, arg_max(text, i) as text, max(page_start) page_start, max(page_end) page_end from r group by 1, 2)
select 'passage_' || sha256(concat_ws('|', source_file, section, page_start, page_end, ordinal, text))[1:24] passage_id, source_file, section, text, page_start::int page_start, page_end::int page_end, ordinal from w"""
CHUNKS = "with recursive " + PAGES + """, pc as (select *, row_number() over (partition by source_file order by page_number) i from pages),
r as (select source_file, i, 1 chunk, text, page_number page_start, page_number page_end from pc where i = 1 union all
  select p.source_file, p.i, case when f then r.chunk else r.chunk + 1 end, case when f then r.text || chr(10) || p.text else right(r.text, 50) || chr(10) || p.text end, case when f then r.page_start else greatest(p.page_number - 1, 1) end, p.page_number
  from (select r.*, length(r.text) + 1 + length(q.text) <= 400 f from r join pc q on q.source_file = r.source_file and q.i = r.i + 1) r join pc p on p.source_file = r.source_file and p.i = r.i + 1)
select source_file, chunk, arg_max(text, i) as text, arg_max(page_start, i)::int page_start, max(page_end)::int page_end from r group by 1, 2"""


def awkward(spark, sf) -> DataFrame:
    """Documents as pages whose layout has changed: narrow no-break spaces, a broken word, words cut at line ends, or nothing, in turn."""
    text, turn = F.col("text"), F.col("doc_id") % 4
    changed = F.when(turn == 0, F.replace(text, F.lit(" "), F.lit("\u202f"))).when(turn == 1, F.replace(text, F.lit(" in "), F.lit(" i n "))).when(turn == 2, F.replace(text, F.lit("tion "), F.lit("ti-\non "))).otherwise(text)
    return table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_file"), F.lit(1).cast("long").alias("page_number"), changed.alias("text"), text.alias("shown"))


def raw_quotes(spark, sf):
    """Every line of a document is looked for in its changed page."""
    p = awkward(spark, sf)
    lines = p.select("source_file", "page_number", F.explode(F.split("shown", "\n")).alias("quote")).where("trim(quote) <> ''")
    return quotes.raw_quotes(lines, p).select("source_file", F.sha2("quote", 256).alias("quote"), F.sha2("raw_quote", 256).alias("raw_quote"), "verified")


RAW_QUOTES = """with l as (select distinct doc_id, unnest(string_split(text, chr(10))) q from documents)
select 'doc-' || doc_id source_file, sha256(q) quote, sha256(case doc_id % 4 when 0 then replace(q, ' ', chr(8239)) when 1 then replace(q, ' in ', ' i n ') when 2 then replace(q, 'tion ', 'ti-' || chr(10) || 'on ') else q end) raw_quote, true verified from l where trim(q, ' ') <> ''"""


def raw_facts(spark, sf):
    """Facts of the pages, read from mended text, with the quote as the page has it: `participants` is cut at a line's end there."""
    p = pages(spark, sf)
    raw = p.withColumns({"shown": F.col("text"), "text": F.replace("text", F.lit("participants"), F.lit("partici-\npants"))})
    out = quotes.raw_facts(raw, shown=F.col("shown"))
    return out.select("source_file", "page_number", "category", "quote", "raw_quote", F.array_join("flags", ",").alias("flags"))


def long_parts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return structure.long_page_parts(docs, 1000, 100).select("doc_id", F.col("part").cast("long").alias("part"), "text")


LONG = "select doc_id, part, substring(text, part * 900 + 1, 1000) as text from (select doc_id, text, unnest(range(ceil((length(text) - 1000) / 900.0)::bigint + 1)) part from documents where length(text) > 1000)"


def found(spark, sf):
    return facts.facts(pages(spark, sf)).withColumn("sentence_no", F.col("sentence_no").cast("long"))


FACTS = """, se as (select source_file, page_number, unnest(range(3)) sentence_no, unnest([string_split(text, chr(10))[1] || ' ' || string_split(text, chr(10))[2], string_split(text, chr(10))[3], string_split(text, chr(10))[5]]) quote from pages),
fa as (select *, case sentence_no when 0 then 'sample_size' when 1 then 'p_value' else 'temperature' end category from se union all
       select *, case sentence_no when 1 then 'major_result' else 'time' end category from se where sentence_no > 0)"""
FACT_ROWS = "with " + PAGES + FACTS + " select source_file, page_number, sentence_no, category, quote, 'unknown' source_type, true verified from fa"


RAW_FACTS = "with " + PAGES + FACTS + """ select source_file, fa.page_number, category, quote, case sentence_no when 0 then string_split(text, chr(10))[1] || chr(10) || replace(string_split(text, chr(10))[2], 'participants', 'partici-' || chr(10) || 'pants') when 1 then string_split(text, chr(10))[3] else string_split(text, chr(10))[5] end raw_quote, '' flags
from fa join pages using (source_file, page_number)"""


def fact_sections(spark, sf):
    p = pages(spark, sf)
    return facts.in_sections(facts.facts(p), structure.sections(p)).groupBy("section", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("documents"))


IN_SECTIONS = "with " + LINES + SECTIONS + FACTS + """,
b as (select fa.source_file, page_number, sentence_no, category, arg_max(section, (page_start, section)) s from fa join ss on ss.source_file = fa.source_file and contains(ss.title || ' ' || replace(ss.text, chr(10), ' '), quote) group by all),
j as (select fa.*, s from fa left join b using (source_file, page_number, sentence_no, category))
select coalesce(s, 'unknown') section, category, count(*) n, count(distinct source_file) documents from j group by 1, 2"""


def quote_page(spark, sf):
    p = pages(spark, sf)
    s = structure.sections(p)
    quotes = s.select("source_file", "section", F.explode(F.split("text", "\n")).alias("quote")).where("quote <> ''").distinct()
    return facts.on_page(quotes, s, p)


QUOTE = "with " + LINES + SECTIONS + """, q as (select distinct source_file, section, unnest(string_split(text, chr(10))) quote from ss)
select q.source_file, q.section, quote, min(page_number) page_number from q join ss using (source_file, section) join pages on pages.source_file = q.source_file and page_number between page_start and page_end where contains(pages.text, quote) and quote <> '' group by 1, 2, 3"""


def locate(spark, sf):
    p = pages(spark, sf)
    last = F.element_at(F.split("text", "\n"), -1)
    order = Window.partitionBy("source_file").orderBy("page_number")
    quotes = p.select("source_file", F.concat_ws(" ", last, F.lead(F.element_at(F.split("text", "\n"), 1)).over(order)).alias("quote")).distinct()
    return facts.located(quotes, p)


LOCATE = "with " + PAGES + """, n as (select *, replace(text, chr(10), ' ') as f, lead(text) over w nt, concat_ws(' ', string_split(text, chr(10))[5], string_split(lead(text) over w, chr(10))[1]) quote from pages window w as (partition by source_file order by page_number)),
t as (select source_file, page_number, regexp_replace(text, '\\s+', ' ', 'g') a, regexp_replace(concat_ws(' ', text, nt), '\\s+', ' ', 'g') b from n),
m as (select q.source_file, quote, count_if(contains(a, quote)) c, min(case when contains(a, quote) then page_number end) one, min(case when contains(b, quote) then page_number end) two from (select distinct source_file, quote from n) q join t using (source_file) group by 1, 2)
select source_file, quote, case when c = 1 then 'exact' when c > 1 then 'ambiguous' when two is not null then 'cross_page' else 'unmatched' end status, case when c > 0 then one else two end page_number from m""".replace("\\\\", "\\")


def statistical(spark, sf):
    from corpusgrid.operators import lexical

    return lexical.statistical(pages(spark, sf), "p = 0.03").select("source_file", "page_number")


def compare(spark, sf):
    """The comparison row of each paper, its lists as one cell each."""
    out = comparison.compare(pages(spark, sf))
    lists = [f.name for f in out.schema.fields if f.dataType.typeName() == "array"]
    return out.select("source_file", "title", "sample_size", *(F.array_join(F.transform(c, lambda x: x.cast("string")), " | ").alias(c) for c in lists))


COMPARE = "with " + LINES + SECTIONS + FACTS + """,
b as (select fa.source_file, page_number, sentence_no, category, arg_max(section, (page_start, section)) s from fa join ss on ss.source_file = fa.source_file and contains(ss.title || ' ' || replace(ss.text, chr(10), ' '), quote) group by all),
j as (select fa.*, coalesce(s, 'unknown') s from fa left join b using (source_file, page_number, sentence_no, category)),
me as (select source_file, 'Methods ' || string_split(text, chr(10))[2] sentence from (select source_file, min(page_number) page_number from ls where line = '2) Methods' group by 1) join pages using (source_file, page_number)),
u as (select source_file, 'c' f, quote v, min(page_number * 10 + sentence_no) o from j where category in ('temperature', 'time') and s = 'methods' group by all union all
  select source_file, 's', quote, min(page_number * 10 + sentence_no) from j where category = 'p_value' and s in ('methods', 'results') group by all union all
  select source_file, 'r', quote, min(page_number * 10 + sentence_no) from j where category = 'major_result' and s = 'results' group by all),
w as (select source_file, string_agg(v, ' | ' order by o) filter (where f = 'c') experimental_conditions, string_agg(v, ' | ' order by o) filter (where f = 's') statistical_information, string_agg(v, ' | ' order by o) filter (where f = 'r') major_results from u group by 1),
z as (select source_file, arg_min(regexp_extract(quote, '\\d+ participants', 0), (length(regexp_extract(quote, '\\d+ participants', 0)), page_number)) sample_size, string_agg(page_number::varchar, ' | ' order by page_number) source_pages from fa where sentence_no = 0 group by 1)
select source_file, 'Introduction' title, sample_size, '' method_keywords, coalesce(sentence, '') method_evidence, coalesce(experimental_conditions, '') experimental_conditions, coalesce(statistical_information, '') statistical_information, coalesce(major_results, '') major_results,
'' conclusions, '' limitations, source_pages, 'year | doi | research_object' missing_fields from z left join w using (source_file) left join me using (source_file)"""


def select_papers(spark, sf):
    p = pages(spark, sf)
    f = facts.facts(p).groupBy("source_file").agg(F.count_if("verified").alias("verified"))
    s = structure.sections(p).where("section <> 'references' and text <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("sections"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey")).alias("source_file"), F.col("o_orderpriority").alias("batch"), (F.col("o_orderstatus") == "P").alias("failed"))
    papers = f.join(s, "source_file", "left").join(o, "source_file").select(F.col("source_file").alias("document_id"), "batch", "failed", F.lit(2).alias("metadata"), "verified", F.coalesce("sections", F.lit(0)).alias("sections"), F.lit(0).alias("flags"))
    return batch.selection(papers, 10, ["batch"]).select("document_id", "batch", F.col("score").cast("long").alias("score"), F.col("selection_rank").cast("long").alias("selection_rank"))


SELECT = "with " + LINES + SECTIONS + """, pp as (select source_file document_id, count(*) * 5 verified from pages group by 1), sc as (select source_file document_id, count(*) sections from ss where text <> '' group by 1),
pa as (select document_id, o_orderpriority batch, o_orderstatus = 'P' failed, (20 + least(verified, 20) * 2 + least(coalesce(sections, 0), 8))::bigint score from pp left join sc using (document_id) join orders on document_id = 'order-' || o_orderkey)
select document_id, batch, score, case when not failed and row_number() over (partition by batch, failed order by score desc, document_id) <= 10 then row_number() over (partition by batch, failed order by score desc, document_id) end selection_rank from pa"""


def layout(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("papers"))
    return n.withColumn("layout", batch.layout(F.col("papers"))).groupBy("papers", "layout").agg(F.count(F.lit(1)).alias("batches"))


def plan(spark, sf):
    n = table(spark, sf, "documents").select("doc_id", (F.floor(F.greatest(F.length("text") - 8000, F.lit(0)) / 7500) + 1).alias("n_chunks"))
    return batch.request_plan(n)


def groups(spark, sf):
    c = table(spark, sf, "conversations").withColumn("at", F.col("turn"))
    return structure.budget_groups(c, "conv_id", "at", F.length("text"), 600).groupBy("conv_id").agg(F.max("group").alias("last_group"), F.count(F.lit(1)).alias("n"))


GROUPS = """with recursive t as (select *, row_number() over (partition by conv_id order by turn) i, length(text) s from conversations),
r as (select conv_id, i, s total, 0 g from t where i = 1 union all
      select t.conv_id, t.i, case when r.total + t.s > 600 then t.s else r.total + t.s end, r.g + (r.total + t.s > 600)::int from r join t on t.conv_id = r.conv_id and t.i = r.i + 1)
select conv_id, max(g)::bigint last_group, count(*) n from r group by 1"""


def contract(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", evidence.contract(F.split("text", "\n"), 40, 400).alias("problem"))
    return c.na.fill("ok", ["problem"])


CONTRACT = r"""with d as (select doc_id, string_split(text, chr(10)) x from documents), c as (select *, list_transform(x, lambda v: lower(trim(regexp_replace(v, '\s+', ' ', 'g')))) k from d)
select doc_id, case when len(x) > 40 then 'too_many' when len(list_filter(x, lambda v: length(v) > 400)) > 0 then 'too_long' when list_contains(k, '') then 'blank' when len(list_distinct(k)) < len(k) then 'repeated' else 'ok' end problem from c"""


def identity(spark, sf):
    return batch.identified(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "document_id", "duplicate_of", "n_inputs")


IDENTITY = "select doc_id, 'doc_' || sha256(text) document_id, nullif(min(doc_id) over (partition by text), doc_id) duplicate_of, count(*) over (partition by text) n_inputs from documents"


def manifest(spark, sf):
    return batch.counts(batch.identified(table(spark, sf, "documents"), "doc_id", "text"))


def alias(spark, sf):
    return batch.aliases(table(spark, sf, "documents").select("doc_id", "source", "lang"), F.concat_ws("-", "source", "lang"), "doc_id").select("doc_id", "alias")


ALIAS = "select doc_id, source || '-' || lang || case when row_number() over (partition by source, lang order by doc_id) > 1 then ' #' || row_number() over (partition by source, lang order by doc_id) else '' end alias from documents"


def resume(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source")
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("pending").alias("status"))
    return batch.pending(docs, done)


RESUME = "select doc_id document_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1 or quality = 1)"


def upsert(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("source"), F.col("c_name").alias("name"))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("source"), F.col("s_name").alias("name"))
    return batch.upsert(target, rows, "source", ["id", "source", "name"])


UPSERT = "select c_custkey id, c_nationkey::bigint source, c_name \"name\" from customer where c_nationkey not in (select s_nationkey from supplier) union all select s_suppkey, s_nationkey, s_name from supplier where s_name <> ''"


def changed(spark, sf):
    p = pages(spark, sf)
    kept = p.where(~F.contains("text", F.lit("p = 0.07")))
    indexed = batch.changed_sources(kept, spark.createDataFrame([], "source_file string, digest string"))
    return batch.changed_sources(p, indexed)


CHANGED = "with " + PAGES + " select source_file, sha256(string_agg(text, chr(10) order by page_number)) digest from pages group by 1 having count_if(contains(text, 'p = 0.07')) > 0"


def repeated(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(X.lines(F.col("text"))).alias("line")).withColumn("line", X.collapse(F.col("line"))).where("line <> ''")
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


REPEATED = r"select doc_id, trim(regexp_replace(l, '\s+', ' ', 'g')) line, count(*) n from (select doc_id, unnest(string_split(text, chr(10))) l from documents) where trim(regexp_replace(l, '\s+', ' ', 'g')) <> '' group by 1, 2 having count(*) >= 3"


def collapsed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))


def split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


SPLIT = r"""with s as (select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents)
select doc_id, len(s) n, list_max(list_transform(s, lambda x: length(x))) longest from s"""


def bounded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.bounded(F.col("text"), 200).alias("text"))


BOUNDED = "with m as (select *, chr(10) || '[…中间文本已省略…]' || chr(10) k from documents) select doc_id, case when length(text) <= 200 then text else text[1:(200 - length(k)) // 2] || k || right(text, 200 - length(k) - (200 - length(k)) // 2) end as text from m"


def stems(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", X.safe_stem(F.concat_ws(" / ", "c_name", "n_name", "c_mktsegment")).alias("stem"))


STEMS = r"select c_custkey, trim(regexp_replace(c_name || ' / ' || n_name || ' / ' || c_mktsegment, '[^\w\-]+', '_', 'g'), '_')[1:80] stem from customer join nation on c_nationkey = n_nationkey"


def histogram(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * 100).cast("long").alias("x"), (F.col("l_discount") > 0.05).alias("flag"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cell = F.least(F.expr("(x - lo) * 15 div (hi - lo)"), F.lit(14))
    return rows.join(F.broadcast(ends)).groupBy(cell.cast("long").alias("bin"), "flag").agg(F.count(F.lit(1)).alias("n"))


HISTOGRAM = "with r as (select trunc(l_extendedprice * 100)::bigint x, l_discount > 0.05 flag from lineitem), e as (select min(x) lo, max(x) hi from r) select least((x - lo) * 15 // (hi - lo), 14)::bigint bin, flag, count(*) n from r, e group by 1, 2"


def three_filters(spark, sf):
    """Rows that pass each state of the value filter: none given, blanks given, values given."""
    d = table(spark, sf, "documents")
    states = {"all": None, "nothing": [" ", ""], "some": [" src1", "src2 ", "src1"]}
    return d.groupBy("lang").agg(*(F.count_if(X.value_filter(F.col("source"), v)).alias(k) for k, v in states.items()))


def extractive(spark, sf):
    return summary.extractive(structure.sections(pages(spark, sf)))


def methods(spark, sf):
    p = pages(spark, sf)
    return comparison.method_evidence(p, comparison.placed_facts(p)).select("source_file", F.col("n").cast("long").alias("n"), "sentence")


METHODS = "with " + LINES + """, m as (select source_file, min(page_number) page_number from ls where line = '2) Methods' group by 1)
select source_file, 1 n, 'Methods ' || string_split(text, chr(10))[2] sentence from m join pages using (source_file, page_number)"""


def metadata(spark, sf):
    return summary.metadata(pages(spark, sf))


def cleaned(spark, sf):
    out = summary.cleaned(pages(spark, sf), 3)
    return out.select("source_file", "page_number", "display_text", F.array_join("flags", ",").alias("flags"))


CLEANED = "with " + LINES + """, o as (select source_file, line, count(*) c from ls where line <> '' group by 1, 2 having count(*) >= 3), k as (select ls.*, c is not null and (line_no < 3 or line_no >= 2) head from ls left join o using (source_file, line))
select source_file, page_number, coalesce(string_agg(line, chr(10) order by line_no) filter (where not head), '') display_text, case when bool_or(head) then 'repeated_header_footer' else '' end flags from k group by 1, 2"""


def mapped(spark, sf):
    """Map over the chunks with the offline provider: what was said, and how many claims the text bears out."""
    out = mapreduce.map_chunks(structure.chunks(pages(spark, sf), 400, 50))
    return out.select("source_file", "chunk", F.coalesce("problem", F.lit("ok")).alias("problem"), F.size(F.filter("claims", lambda c: c["verified"])).alias("verified"), "requests")


def reduced(spark, sf):
    return mapreduce.reduce_notes(mapreduce.map_chunks(structure.chunks(pages(spark, sf), 400, 50)))


def usage(spark, sf):
    """Token and character ledger of the map step by paper."""
    out = mapreduce.called(structure.chunks(pages(spark, sf), 400, 50), "text", mapreduce.offline)
    return out.groupBy("source_file").agg(F.sum("requests").alias("requests"), F.sum("input_chars").alias("input_chars"))


QUERIES = {
    "win04_section_carry": carry, "win05_units": units, "txt06_sections": sections, "txt09_passages": passages, "txt10_chunks": chunks, "txt10_long_page_split": long_parts, "txt11_facts": found, "txt11_raw_facts": raw_facts, "txt12_raw_quotes": raw_quotes, "jon07_fact_section": fact_sections,
    "jon08_range_page": quote_page, "evd02_locate": locate, "flt06_stat_search": statistical, "comp01_compare": compare, "rep02_selection": select_papers, "rep01_layout": layout, "mr06_request_plan": plan, "mr05_budget_groups": groups,
    "mr08_contract": contract, "agg03_dedup_by_sha": identity, "agg01_manifest_counts": manifest, "win03_alias_occurrence": alias, "bat01_resume_anti": resume, "snk07_upsert": upsert, "snk08_changed_sources": changed, "agg04_repeated_lines": repeated,
    "txt02_collapse": collapsed, "txt03_sentences": split, "qa03_bounded_text": bounded, "fmt05_safe_stem": stems, "src12_histogram": histogram, "flt01_value_filter": three_filters,
    "txt01_clean_pages": cleaned, "txt23_extractive_summary": extractive, "txt24_method_evidence": methods, "txt17_metadata": metadata, "mr01_map_chunks": mapped, "mr03_reduce": reduced, "agg16_usage": usage,
}
ORACLE = {
    "txt01_clean_pages": CLEANED, "txt24_method_evidence": METHODS,
    "txt17_metadata": "select distinct 'order-' || l_orderkey source_file, 'Introduction' title, null::int as \"year\", null::varchar year_source, null::varchar doi, null::varchar purpose, null::varchar research_object from lineitem",
    "win04_section_carry": "with " + LINES + " select source_file, section, count(*) n, sum(length(line))::bigint chars from cs group by 1, 2", "win05_units": UNITS, "txt06_sections": "with " + LINES + SECTIONS + " select * from ss",
    "txt09_passages": PASSAGES, "txt10_chunks": CHUNKS, "txt10_long_page_split": LONG, "txt11_facts": FACT_ROWS, "txt11_raw_facts": RAW_FACTS, "txt12_raw_quotes": RAW_QUOTES, "jon07_fact_section": IN_SECTIONS, "jon08_range_page": QUOTE, "evd02_locate": LOCATE, "flt06_stat_search": "with " + PAGES + r" select source_file, page_number from pages where regexp_matches(text, '(?i)\bp\s*=\s*0\.03')",
    "comp01_compare": COMPARE, "rep02_selection": SELECT, "rep01_layout": "select papers, case when papers <= 1 then 'single' when papers <= 3 then 'matrix' else 'vertical' end layout, count(*) batches from (select count(*) papers from lineitem group by l_orderkey) group by 1, 2",
    "mr06_request_plan": "with n as (select doc_id, greatest(length(text) - 8000, 0) // 7500 + 1 n_chunks from documents) select *, n_chunks + 1 base_requests, n_chunks * 2000 + 4000 max_output_tokens, (n_chunks + 1) * 6 worst_requests from n",
    "mr05_budget_groups": GROUPS, "mr08_contract": CONTRACT, "agg03_dedup_by_sha": IDENTITY, "agg01_manifest_counts": "select count(*) inputs, count(distinct text) documents, count(*) - count(distinct text) duplicates from documents", "win03_alias_occurrence": ALIAS,
    "bat01_resume_anti": RESUME, "snk07_upsert": UPSERT, "snk08_changed_sources": CHANGED, "agg04_repeated_lines": REPEATED, "txt02_collapse": r"select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) digest from documents", "txt03_sentences": SPLIT,
    "qa03_bounded_text": BOUNDED, "fmt05_safe_stem": STEMS, "src12_histogram": HISTOGRAM, "flt01_value_filter": "select lang, count(*) \"all\", 0::bigint nothing, count_if(source in ('src1', 'src2'))::bigint \"some\" from documents group by 1",
}
