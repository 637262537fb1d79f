"""Queries over text: keyword and vector search, narrative, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import extract_confidence
from ..operators import audit, narrative, search
from .registry import query, rounded

DOCS_SQL = """
, docs as (select 1 as source_no, well, date, md_m as depth_m, 'summary_24hr' as doc_type, report_no as doc_no, summary_24hr as text from ddr_status
 union all select 2, well, date, depth_m, activity_code || ' activity', event_id, comments from ddr_activities where comments is not null and comments <> '')
"""
SEARCHES = ["stuck pipe in well", "lost circulation losses", "waiting on weather", "of to"]
_HITS = [
    "(case when l like '%stuck%' then 1 else 0 end) + (case when l like '%pipe%' then 1 else 0 end) + (case when l like '%well%' then 1 else 0 end)",
    "(case when l like '%lost%' then 1 else 0 end) + (case when l like '%circulation%' then 1 else 0 end) + (case when l like '%losses%' then 1 else 0 end)",
    "(case when l like '%waiting%' then 1 else 0 end) + (case when l like '%weather%' then 1 else 0 end)",
]


def search_sql(n: int) -> str:
    """All matches per query, summaries first, cut to n per source and n overall."""
    found = " union all ".join(
        [f"select {q} as query_no, {h} as n_hits, * from lowered where {h} > 0" for q, h in enumerate(_HITS)]
        + ["select 3 as query_no, 0 as n_hits, * from lowered"]
    )
    return f""", lowered as (select *, lower(text) as l from docs), found as ({found}),
s as (select *, row_number() over (partition by query_no, source_no order by date nulls last, doc_no) as a from found),
r as (select *, row_number() over (partition by query_no order by source_no, a) as r from s where a <= {n})
select query_no, n_hits, source_no, well, date, round(depth_m, 6) as depth_m, doc_type, doc_no, text, cast(r as int) as rank_no from r where r <= {n}"""


@query("r1_keyword_search", ["ddr_status", "ddr_activities"], DOCS_SQL + search_sql(10))
def keyword_search(t):
    docs = search.search_docs(t["ddr_status"], t["ddr_activities"])
    return rounded(search.keyword_search(docs, SEARCHES, 10), 6)


def messages_as_docs(t):
    return t["witsml_messages"].select(
        F.lit(3).alias("source_no"), "well", F.lit(None).cast("string").alias("date"),
        F.col("message_no").alias("doc_no"), F.col("message_type").alias("doc_type"), F.col("message_text").alias("text"),
    )


@query(
    "r1_keyword_search_messages",
    ["witsml_messages"],
    """, l as (select *, lower(message_text) as l from witsml_messages),
f as (select 0 as query_no, (case when l like '%the%' then 1 else 0 end) + (case when l like '%license%' then 1 else 0 end) as n_hits, * from l
  union all select 1, (case when l like '%email%' then 1 else 0 end) + (case when l like '%password%' then 1 else 0 end), * from l)
select * from (select query_no, n_hits, well, message_no as doc_no, message_type as doc_type, md5(message_text) as text_md5,
 cast(row_number() over (partition by query_no order by message_no) as int) as rank_no from f where n_hits > 0) where rank_no <= 50""",
)
def keyword_search_messages(t):
    out = search.keyword_search(messages_as_docs(t), ["the license", "email password"], 50)
    return out.select("query_no", "n_hits", "well", "doc_no", "doc_type", F.md5("text").alias("text_md5"), "rank_no")


@query(
    "r1_keyword_table",
    ["witsml_messages"],
    r""", l as (select *, lower(message_text) as l from witsml_messages),
q as (select conv_id * 1000 + turn as query_id, array_to_string(list_slice(string_split_regex(text, '\s+'), 1, 5), ' ') as query from conversations),
w as (select query_id, word, count(*) as times from (select query_id, unnest(string_split_regex(lower(query), '\s+')) as word from q) where length(word) > 2 group by all),
p as (select word, message_no from (select distinct word from w) cross join l where contains(l.l, word)),
f as (select query_id, message_no, cast(sum(times) as int) as n_hits from w join p using (word) group by all
  union all select query_id, message_no, 0 from (select query_id from q anti join w using (query_id)) cross join l),
r as (select *, cast(row_number() over (partition by query_id order by message_no) as int) as rank_no from f)
select query_id, n_hits, well, message_no as doc_no, message_type as doc_type, md5(message_text) as text_md5, rank_no from r join l using (message_no) where rank_no <= 10""",
)
def keyword_search_table(t):
    """The first five words of every conversation turn are a query over all messages."""
    asked = t.source("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.array_join(F.slice(F.split("text", r"\s+"), 1, 5), " ").alias("query"),
    )
    out = search.keyword_search_table(messages_as_docs(t), asked, 10)
    return out.select("query_id", "n_hits", "well", "doc_no", "doc_type", F.md5("text").alias("text_md5"), "rank_no")


@query(
    "r2_semantic_search",
    sql="""with u as (select vec_id, label, embedding as e from embeddings),
c as (select label as query_id, list(m order by i) as q from (select label, i, avg(v) as m from (select label, generate_subscripts(e, 1) as i, unnest(e) as v from u) group by label, i) group by label),
s as (select query_id, vec_id, list_cosine_similarity(cast(e as double[]), cast(q as double[])) as cosine from u cross join c)
select query_id, vec_id, round(cosine, 6) as cosine, round(greatest(0, cosine), 6) as relevance,
 cast(row_number() over (partition by query_id order by cosine desc, vec_id) as int) as rank_no from s
qualify row_number() over (partition by query_id order by cosine desc, vec_id) <= 10""",
)
def semantic_search(t):
    """Query vectors are the label means, so both sides come from the whole table."""
    vectors = t.source("embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i")
        .agg(F.avg("v").alias("m"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    )
    return rounded(search.semantic_search(vectors, means, 10, doc_id="vec_id"), 6)


VECTOR_DOCS = "select *, '15_9_F_' || cast(vec_id % 26 as string) as well, case when label % 2 = 0 then '2013-01-0' else '2013-02-0' end || cast(1 + vec_id % 9 as string) as date from {embeddings}"
VECTOR_SQL = (
    "with docs as (" + VECTOR_DOCS.replace("{embeddings}", "embeddings") + """), d as (select vec_id, embedding as e from docs where starts_with(well, '15_9_F_1') and date >= '2013-01-03'),
c as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, list_cosine_similarity(cast(e as double[]), cast(q as double[])) as cosine from d cross join c)
select query_id, vec_id, round(cosine, 6) as cosine, round(greatest(0, cosine), 6) as relevance,
 cast(row_number() over (partition by query_id order by cosine desc, vec_id) as int) as rank_no from s
qualify row_number() over (partition by query_id order by cosine desc, vec_id) <= 5"""
)


@query("r2_filtered", sql=VECTOR_SQL)
def filtered_search(t):
    """Vector search over the documents of a well pattern from a date on; every twentieth vector is a query."""
    docs = t.spark.sql(VECTOR_DOCS, embeddings=t.source("embeddings"))
    asked = t.source("embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    out = search.semantic_search(docs, asked, 5, doc_id="vec_id", well="15_9_F_1*", date_from="2013-01-03")
    return rounded(out, 6)


@query(
    "r3_search_with_vectors",
    sql="with docs as (" + VECTOR_DOCS.replace("{embeddings}", "embeddings") + """), q as (select list(m order by i) as q from (select i, avg(v) as m from (select generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings) group by i)),
s as (select vec_id as doc_id, list_cosine_similarity(cast(embedding as double[]), cast(q as double[])) as cosine from docs, q where well = '15_9_F_3')
select 0 as query_id, doc_id, round(cosine, 6) as cosine, round(greatest(0, cosine), 6) as relevance, cast(row_number() over (order by cosine desc, doc_id) as int) as rank_no from s
qualify row_number() over (order by cosine desc, doc_id) <= 10""",
)
def search_with_vectors(t):
    """The branch with embeddings: the query's vector is the mean of all vectors."""
    docs = t.spark.sql(VECTOR_DOCS, embeddings=t.source("embeddings")).withColumnRenamed("vec_id", "doc_id")
    parts = t.source("embeddings").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m")).scalar()
    return rounded(search.search_with_fallback(docs, "any text", embed=lambda text: mean, k=10, well="15_9_F_3"), 6)


@query("r3_search_with_fallback", ["ddr_status", "ddr_activities"], DOCS_SQL + search_sql(10).replace("where r <= 10", "where r <= 10 and query_no = 1"))
def search_with_fallback(t):
    docs = search.search_docs(t["ddr_status"], t["ddr_activities"])
    out = search.search_with_fallback(docs, SEARCHES[1], k=10)
    return rounded(out.withColumn("query_no", F.lit(1)), 6)


@query(
    "r4_ddr_narrative",
    ["ddr_status", "ddr_activities"],
    """, s as (select *, row_number() over (partition by well order by date, report_no) as r from ddr_status where summary_24hr is not null),
a as (select *, row_number() over (partition by well order by date, start_ts, event_id) as r from ddr_activities where comments <> '' and length(comments) >= 20)
select well, 'summary' as kind, cast(r as int) as ordinal, date, round(md_m, 6) as depth_m, hole_diameter_in, summary_24hr as text, null as activity_code, null as state, null as state_detail from s where r <= 15
union all select well, 'activity', cast(r as int), date, round(depth_m, 6), null, substr(comments, 1, 200), activity_code, state, state_detail from a where r <= 15""",
)
def ddr_narrative(t):
    return rounded(narrative.ddr_narrative(t), 6)


@query(
    "r4_narrative_of_range",
    ["ddr_status", "ddr_activities_aligned"],
    """, s as (select *, row_number() over (partition by well order by date, report_no) as r from ddr_status where summary_24hr is not null and date between '1995-03-01' and '1997-06-30' and md_m between 500 and 2500),
a as (select *, row_number() over (partition by well order by date, start_ts, event_id) as r from ddr_activities_aligned where length(comments) >= 20 and date between '1995-03-01' and '1997-06-30' and depth_m between 500 and 2500),
m as (select '15_9_F_' || cast(doc_id % 26 as varchar) as well, doc_id, text, '1996-0' || cast(1 + doc_id % 9 as varchar) || '-15T08:00:00' as timestamp, cast(doc_id % 4000 as double) as md_m from documents),
k as (select *, row_number() over (partition by well order by timestamp, doc_id) as r from m where timestamp >= '1995-03-01' and timestamp <= '1997-06-30T99' and md_m between 500 and 2500
  and well in (select well from s union select well from a))
select well, 'summary' as kind, cast(r as int) as ordinal, date, round(md_m, 6) as depth_m, hole_diameter_in, summary_24hr as text, null as activity_code, null as state, null as state_detail from s where starts_with(well, '15_9_F_2')
union all select well, 'activity', cast(r as int), date, round(depth_m, 6), null, comments, activity_code, state, state_detail from a where r <= 20 and starts_with(well, '15_9_F_2')
union all select well, 'message', cast(r as int), substr(timestamp, 1, 10), md_m, null, md5(text), null, null, null from k where r <= 10 and starts_with(well, '15_9_F_2')""",
)
def narrative_of_range(t):
    """A range of dates and depths of a well pattern, all summaries, 20 whole comments, whole messages."""
    tables = {"ddr_status": t["ddr_status"], "ddr_activities": t["ddr_activities_aligned"]}
    messages = t.spark.sql(
        """select '15_9_F_' || cast(doc_id % 26 as string) as well, '1996-0' || cast(1 + doc_id % 9 as string) || '-15T08:00:00' as timestamp, cast(doc_id % 4000 as double) as md_m,
 doc_id as message_no, text as message_text from {documents}""",
        documents=t.source("documents"),
    )
    out = narrative.ddr_narrative(tables, "1995-03-01", "1997-06-30", 500, 2500, messages, n_summaries=None, n_activities=20, chars=None, well="15_9_F_2*")
    shown = F.when(F.col("kind") == "message", F.md5("text")).otherwise(F.col("text"))
    return rounded(out.withColumn("text", shown), 6)


# Headings and evidence are put around the conversation texts, so that every branch occurs.
ANSWERS = """select conv_id, turn, case when (conv_id + turn) % 4 = 0 then '# Answer' || chr(10) || '##Evidence from drilling data' || chr(10) || '## Evidence from Daily Reports' || chr(10)
  || '## Reasoning' || chr(10) || '## Assumptions' || chr(10) || '## Confidence: Medium' || chr(10) || text
 when (conv_id + turn) % 4 = 1 then '## Answer 12.5 m/hr ' || text || ' DDR 15/9-F-1, 2013' when (conv_id + turn) % 4 = 2 then 'daily report of 2013-04-22 ' || text else text end as text
from {conversations}"""
SECTION_SQL = [
    ("Answer", "answer"), ("Evidence from Drilling Data", "evidence from drilling data"), ("Evidence from Daily Reports", "evidence from daily reports"),
    ("Reasoning", "reasoning"), ("Assumptions", "assumptions"), ("Confidence", "confidence"),
]
_MISSING = ", ".join(f"case when not regexp_matches(text, '(?i)##?\\s*{low}') then '{name}' end" for name, low in SECTION_SQL)
AUDIT_SQL = (
    "with ans as (" + ANSWERS.replace("{conversations}", "conversations") + "), "
    + f"""m as (select *, array_to_string([x for x in [{_MISSING}] if x is not null], ', ') as missing,
 regexp_matches(text, '\\d+(?:\\.\\d+)?\\s*(?:m|m/hr|m/h|kN|kNm|sg|g/cm3|mPa|Pa|ppm|hrs?|days?|%)') as has_measurement,
 regexp_matches(text, '(?i)DDR.*?(?:15[/_]9|F-\\d).*?\\d{{4}}') or regexp_matches(text, '(?i)(?:DDR|report|daily)\\s.*?\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}')
  or regexp_matches(text, '"\\*?\\*?[A-Z].*?\\*?\\*?"') as has_ddr_quote,
 coalesce(nullif(upper(regexp_extract(text, '(?i)\\b(HIGH|MEDIUM|LOW)\\b', 1)), ''), 'N/A') as confidence from ans)
"""
)


def _answers(t):
    return t.spark.sql(ANSWERS, conversations=t.source("conversations"))


@query(
    "u1_audit_answers",
    sql=AUDIT_SQL
    + """select conv_id, turn, missing, has_measurement, has_ddr_quote, confidence, missing = '' as valid,
 (case when missing <> '' then 1 else 0 end) + (case when has_measurement then 0 else 1 end) + (case when has_ddr_quote then 0 else 1 end) as n_warnings from m""",
)
def audit_answers(t):
    return audit.audit_answers(_answers(t)).select(
        "conv_id", "turn", F.array_join("missing_sections", ", ").alias("missing"), "has_measurement", "has_ddr_quote",
        "confidence", "valid", F.size("warnings").alias("n_warnings"),
    )


@query(
    "u2_extract_confidence",
    sql="""select doc_id, coalesce(nullif(upper(regexp_extract(text, '(?i)\\b(HIGH|MEDIUM|LOW)\\b', 1)), ''), 'N/A') as confidence from documents""",
)
def confidence(t):
    return t.source("documents").select("doc_id", extract_confidence(F.col("text")).alias("confidence"))


@query(
    "a29_audit_summary",
    sql=AUDIT_SQL
    + """, items as (select case when missing = '' then 'valid' else 'invalid' end as item from m
 union all select 'with_measurement' from m where has_measurement union all select 'with_ddr_quote' from m where has_ddr_quote
 union all select 'warning: Missing sections: ' || missing from m where missing <> ''
 union all select 'warning: No specific measurement with units found' from m where not has_measurement
 union all select 'warning: No DDR report quote with date attribution found' from m where not has_ddr_quote union all select 'texts' from m)
select item, count(*) as cnt from items group by item""",
)
def audit_summary(t):
    return audit.audit_summary(audit.audit_answers(_answers(t)))
