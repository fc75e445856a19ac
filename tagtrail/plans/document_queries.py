"""Registered queries over documents, chunks, vectors and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions import routing, text, vectors
from tagtrail.functions.ids import document_id, event_id, example_id, knowledge_id
from tagtrail.operators import correlation, documents, retrieval, vector_index
from tagtrail.plans import bindings as b
from tagtrail.plans.registry import query
from tagtrail.plans.series_queries import rounded
from tagtrail.session import scratch_path, staged
from tagtrail.sources import files

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

# --- text ---------------------------------------------------------------------------------------------------------

LINES_SQL = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex({0}, '\r\n|\n|\r'),
  lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"""


@query("fn_normalize_lines", f"select doc_id, {LINES_SQL.format('text')} as text from documents")
def fn_normalize_lines(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.normalize_lines(F.col("text")).alias("text"))


@query("fn_collapse_ws", b.ctes("page_text") + "select doc_id, text, lower(text) as lowered from page_text")
def fn_collapse_ws(spark, d):
    flat = text.collapse_ws(F.col("text"))
    return b.pages(spark, d).select("doc_id", flat.alias("text"), F.lower(flat).alias("lowered"))


@query("src_document_pages", f"""select concat('doc_', substring(sha1(concat(url, '|', sha256(html))), 1, 16)) as document_id,
  page_id, pos as page, {LINES_SQL.format('part')} as text, length({LINES_SQL.format('part')}) as char_count,
  'text' as source_type from (select page_id, url, html, generate_subscripts(parts, 1) as pos, unnest(parts) as part
  from (select *, string_split(html, '<p>') as parts from pages))""")
def src_document_pages(spark, d):
    # Pages of a file are what its parser gives; here a paragraph mark ends a page.
    raw = b.table(spark, d, "pages").select(
        "page_id", F.col("url").alias("file_name"), F.col("html").cast("binary").alias("content")
    )
    found = files.document_pages(raw, files.split_parser("<p>"), source_type="text", keep=["page_id"])
    return found.select("document_id", "page_id", "page", "text", "char_count", "source_type")


@query("flt_empty_pages", """select count(*) as pages,
  count(*) filter (length(trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))) = 0) as empty_pages,
  count(*) filter (length(trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))) > 0) as text_pages
  from (select case when doc_id % 9 = 0 then '  ' when doc_id % 13 = 0 then null else text end as t from documents)""")
def flt_empty_pages(spark, d):
    doc = F.col("doc_id")
    pages = b.pages(spark, d).withColumn("text", F.when(doc % 9 == 0, "  ").when(doc % 13 != 0, F.col("text")))
    return documents.page_text_counts(pages)


@query("agg_document_catalog", b.ctes("doc_pages") + """select document_id, file_name, count(*) as page_count,
  sum(length(text))::bigint as total_characters, 'parsed' as status from doc_pages group by 1, 2""")
def agg_document_catalog(spark, d):
    return documents.document_catalog(b.pages(spark, d))


@query("fn_split_chunks", b.ctes("chunks") + "select chunk_id, doc_id, chunk_index, text from chunks")
def fn_split_chunks(spark, d):
    return b.chunks(spark, d).select("chunk_id", "doc_id", "chunk_index", "text")


@query("win_chunk_position", b.ctes("chunks") + """select chunk_id, document_id, page, chunk_index, chunk_count_on_page,
  length(text) as char_count from chunks""")
def win_chunk_position(spark, d):
    return b.chunks(spark, d).select(
        "chunk_id", "document_id", "page", "chunk_index", "chunk_count_on_page", "char_count"
    )


@query("fn_stable_ids", b.ctes("detected", "doc_pages") + """select cast(doc_id as varchar) as key,
  concat('doc_', substring(sha1(concat(file_name, '|', sha256(text))), 1, 16)) as a,
  concat('sensor_', substring(sha1(file_name), 1, 12)) as b,
  concat('doc_evidence_', substring(sha1(concat(document_id, '||', cast(page as varchar))), 1, 12)) as c from doc_pages
  union all select event_id, sensor_tag, event_type, concat('event_', substring(sha1(concat(event_type, '|', sensor_tag,
  '||', coalesce(timestamp, ''))), 1, 16)) from detected""")
def fn_stable_ids(spark, d):
    pages = b.pages(spark, d).select(
        F.col("doc_id").cast("string").alias("key"),
        document_id(F.col("file_name"), F.sha2("text", 256)).alias("a"),
        knowledge_id("sensor", F.col("file_name")).alias("b"),
        example_id("doc_evidence", F.col("document_id"), F.col("page")).alias("c"),
    )
    events = b.detected(spark, d).select(
        F.col("event_id").alias("key"), F.col("sensor_tag").alias("a"), F.col("event_type").alias("b"),
        event_id(F.col("event_type"), F.col("sensor_tag"), F.lit(None), F.col("timestamp")).alias("c"),
    )
    return pages.unionByName(events)


@query("fn_slug", r"""select item_id, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'sheet')
  as slug, coalesce(nullif(left(trim(regexp_replace(lower(text), '[^a-zA-Z0-9_-]+', '_', 'g'), '_'), 80), ''), 'query')
  as query_slug, coalesce(nullif(left(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_-]', '_', 'g'), '_'), 80), ''), 'query')
  as char_slug from (select item_id, text from benchmark union all select -1 - doc_id, text from documents)""")
def fn_slug(spark, d):
    items = b.table(spark, d, "benchmark").select("item_id", "text").union(
        b.table(spark, d, "documents").select(-1 - F.col("doc_id"), "text")
    )
    t = F.col("text")
    return items.select(
        "item_id", text.slug(t).alias("slug"), text.query_slug(t).alias("query_slug"),
        text.char_slug(t).alias("char_slug"),
    )


@query("fn_json_safe", """select event_id, case when event_id % 3 = 0 then null else value end as value,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as at from events""")
def fn_json_safe(spark, d):
    from tagtrail.session import finite

    third = F.col("event_id") % 3 == 0
    odd = F.when(third & (F.col("event_id") % 2 == 0), F.lit(float("nan"))).when(third, F.lit(float("inf")))
    return b.table(spark, d, "events").select(
        "event_id", finite(F.coalesce(odd, F.col("value"))).alias("value"), F.date_format("ts", b.ISO).alias("at")
    )


@query("fn_excerpt", r"""select doc_id, case when length(e) > 700 then concat(regexp_replace(left(e, 700), ' [^ ]*$', ''), '...')
  else e end as excerpt from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as e from documents)""")
def fn_excerpt(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


# --- tags in text -------------------------------------------------------------------------------------------------


@query("set_distinct_tags", b.ctes("dict") + "select tag, row_number() over (order by length(tag) desc, tag) as place from dict")
def set_distinct_tags(spark, d):
    from tagtrail.operators.ordering import with_position

    ranked = documents.dictionary_tags(b.tag_dictionary(spark, d)).withColumn("shorter", -F.length("tag"))
    return with_position(ranked, [], ["shorter", "tag"], "place").drop("shorter")


@query("join_mentions", b.ctes("mentions") + "select chunk_id, tag from mentions")
def join_mentions(spark, d):
    return b.mentions(spark, d).select("chunk_id", "tag")


@query("join_mentions_phrases", r"""with recursive """ + b.ctes("chunks").split("with recursive ", 1)[1].rstrip() + r""",
  pairs as (select distinct concat(lower(w[1]), ' ', lower(w[2])) as tag from (select
  string_split_regex(text, '[^A-Za-z0-9_.-]+') as w from benchmark where regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+ '))
  where len(w) > 2)
  select distinct c.chunk_id, p.tag from chunks c join pairs p on
  regexp_matches(lower(c.text), concat('(^|[^a-z0-9_.-])', p.tag, '($|[^a-z0-9_.-])'))""")
def join_mentions_phrases(spark, d):
    words = F.split("text", text.NOT_TAG_CHARS)
    pairs = (
        b.table(spark, d, "benchmark").where(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+ ") & (F.size(words) > 2))
        .select(F.lower(F.concat_ws(" ", words[0], words[1])).alias("tag")).distinct()
    )
    return documents.phrase_mentions(staged(b.chunks(spark, d), "chunks"), pairs).select("chunk_id", "tag")


@query("join_mention_edges", b.ctes("mention_edges") + "select chunk_id, entity_id from mention_edges")
def join_mention_edges(spark, d):
    return b.mention_edges(spark, d)


@query("join_chunk_links", b.ctes("chunks", "mentions") + """select c.chunk_id, c.document_id, c.file_name, c.page,
  coalesce((select string_agg(m.tag, ',' order by m.tag) from mentions m where m.chunk_id = c.chunk_id), '') as tags
  from chunks c""")
def join_chunk_links(spark, d):
    chunks = staged(b.chunks(spark, d), "chunks")
    links = documents.linked_chunks(chunks, b.tag_dictionary(spark, d))
    tags = F.array_join(F.array_sort(F.transform("matched_sensor_tags", F.lower)), ",")
    return links.select("chunk_id", "document_id", "file_name", "page", tags.alias("tags"))


# --- vectors ------------------------------------------------------------------------------------------------------


@query("fn_l2_normalize", """select vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) as length,
  round(v[1], 6) as first, round(v[64], 6) as last from (select vec_id, list_transform(w, lambda x: x /
  case when n = 0 then 1 else n end) as v from (select vec_id, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) as n
  from (select vec_id, list_transform(embedding::double[], lambda x: x * (vec_id % 7)) as w from embeddings)))""")
def fn_l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    v = vectors.l2_normalize(scaled)
    out = b.table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return out.select(
        "vec_id", F.round(F.pow(vectors.norm(F.col("v")), 2), 6).alias("length"),
        F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"),
    )


@query("topk_cosine", b.ctes("hits") + "select question_id, chunk_id, rank, round(score, 6) as score from hits")
def topk_cosine(spark, d):
    return rounded(b.hits(spark, d), "score").select("question_id", "chunk_id", "rank", "score")


@query("topk_cosine_blocks", b.ctes("hits") + "select question_id, chunk_id, rank, round(score, 6) as score from hits")
def topk_cosine_blocks(spark, d):
    found = retrieval.top_k_chunks(
        b.question_vectors(spark, d), b.chunk_vectors(spark, d), 8, block=16, corpus_slice=1000
    )
    return rounded(found, "score").select("question_id", "chunk_id", "rank", "score")


def chunk_index(spark, d):
    """The chunks in a vector index, with their files and pages."""
    chunks = staged(b.chunks(spark, d), "chunks")
    path = scratch_path(spark, "chunk-index")
    vector_index.write_index(b.chunk_vectors(spark, d, chunks), path, metadata=chunks.select("chunk_id", "file_name", "page"))
    return vector_index.open_index(spark, path)


@query("topk_cosine_index", b.ctes("hits") + "select question_id, chunk_id, rank, round(score, 6) as score from hits")
def topk_cosine_index(spark, d):
    """The same hits from a written index, whose cells are visited until no other can hold a better one."""
    found = vector_index.search(chunk_index(spark, d), b.question_vectors(spark, d), 8, exact=True)
    return rounded(found, "score").select("question_id", "chunk_id", "rank", "score")


@query("topk_index_recall", b.ctes("hits") + """select count(distinct question_id) as questions, count(*) as wanted,
  true as nine_in_ten from hits""")
def topk_index_recall(spark, d):
    """How much of the exact result a search of few cells finds."""
    index, questions = chunk_index(spark, d), staged(b.question_vectors(spark, d), "questions")
    truth = retrieval.top_k_chunks(questions, index.rows().select("chunk_id", "doc_id", "embedding"), 8)
    found = vector_index.search(index, questions, 8, sigmas=vector_index.fitted_sigmas(index, questions, 8))
    told = vector_index.recall(found, truth)
    return told.select("questions", "wanted", (F.col("hit") * 10 >= F.col("wanted") * 9).alias("nine_in_ten"))


@query("win_hit_rank", b.ctes("hits") + """select question_id, rank, h.chunk_id, round(score, 4) as score, c.file_name as file,
  c.page from hits h join chunks c on c.chunk_id = h.chunk_id where rank <= 5""")
def win_hit_rank(spark, d):
    found = b.hits(spark, d, 5).join(b.chunks(spark, d).select("chunk_id", F.col("file_name").alias("file"), "page"), "chunk_id")
    return rounded(found, "score", digits=4).select("question_id", "rank", "chunk_id", "score", "file", "page")


@query("fn_round_score", b.ctes("hits") + """select question_id, chunk_id, round(score, 4) as hybrid_score,
  round(score, 6) as grounded_score from hits""")
def fn_round_score(spark, d):
    return b.hits(spark, d).select(
        "question_id", "chunk_id", F.round("score", 4).alias("hybrid_score"), F.round("score", 6).alias("grounded_score")
    )


@query("join_index_metadata", b.ctes("chunk_dims") + """select c.chunk_id, c.document_id, c.page,
  round(coalesce(max(case when v.dim = 0 then v.v end), 0), 6) as first, (select count(*) from chunks where chunk_id not in
  (select chunk_id from chunk_dims)) as without_vector from chunks c join chunk_dims v on v.chunk_id = c.chunk_id group by 1, 2, 3""")
def join_index_metadata(spark, d):
    chunks = staged(b.chunks(spark, d), "chunks")
    index = b.chunk_vectors(spark, d, chunks).select("chunk_id", "embedding")
    gap = retrieval.index_mismatch(index, chunks).select("without_vector").scalar()
    joined = retrieval.join_index_metadata(index, chunks).withColumn("without_vector", gap)
    return joined.select(
        "chunk_id", "document_id", "page", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"),
        "without_vector",
    )


@query("ev_encode_chunks", b.ctes("chunk_dims") + f"""select chunk_id, {b.DIMS} as dims, 1.0::double as length,
  round(sum(dim * v), 6) as moment from chunk_dims group by chunk_id""")
def ev_encode_chunks(spark, d):
    v = F.col("embedding")
    weighed = F.transform(v, lambda x, i: x.cast("double") * i)
    return b.chunk_vectors(spark, d).select(
        "chunk_id", F.size(v).alias("dims"), F.round(vectors.norm(v), 4).alias("length"),
        F.round(F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x), 6).alias("moment"),
    )


# --- questions ----------------------------------------------------------------------------------------------------

TOKENS_SQL = r"""toks as (select question_id, lower(t) as token from (select question_id,
  unnest(string_split_regex(question, '[^A-Za-z0-9_.-]+')) as t from questions) where length(t) >= 3)"""
IDENTIFY_SQL = TOKENS_SQL + """,
tags as (select distinct tag from read150),
named as (select question_id, tag from questions, tags where contains(lower(question), lower(tag))),
fuzzy as (select question_id, tag, count(*) as score from toks, tags where contains(lower(tag), token) group by 1, 2),
merged as (select question_id, tag, min(tier) as tier, max(case when tier = 1 then score else 0 end) as score from
  (select question_id, tag, 0 as tier, 0 as score from named union all select question_id, tag, 1, score from fuzzy)
  group by 1, 2),
identified as (select question_id, tag, case when tier = 0 then 'named' else 'token' end as found_by,
  row_number() over (partition by question_id order by tier, case when tier = 0 then 0 else score end desc, tag) as rank
  from merged)"""


@query("prj_identify_sensors", b.ctes("read150", "questions").rstrip() + ", " + IDENTIFY_SQL
       + " select question_id, tag, rank, found_by from identified where rank <= 10")
def prj_identify_sensors(spark, d):
    return retrieval.identify_sensors(b.questions(spark, d), b.read150(spark, d))


@query("prj_explicit_sensors", b.ctes("read150", "questions").rstrip() + ", " + IDENTIFY_SQL
       + """ select question_id, tag, row_number() over (partition by question_id order by tag) as rank, 'named' as found_by
  from named union all select question_id, tag, rank, found_by from identified
  where rank <= 4 and question_id not in (select question_id from named)""")
def prj_explicit_sensors(spark, d):
    return retrieval.explicit_sensors(b.questions(spark, d), b.read150(spark, d))


@query("prj_resolve_sensor", b.ctes("read150") + """, asked as (select distinct lower(tag) as asked from read150
  union select distinct event_type from events)
  select asked, t.tag as canonical, t.tag is not null as known from asked a
  left join (select distinct tag from read150) t on lower(t.tag) = lower(a.asked)""")
def prj_resolve_sensor(spark, d):
    readings = b.read150(spark, d)
    asked = readings.select(F.lower("tag").alias("asked")).union(b.read5(spark, d).select("tag")).distinct()
    return retrieval.resolve_sensors(asked, readings)


def terms_sql(terms):
    return "(" + " or ".join(f"contains(q, '{t}')" for t in terms) + ")"


@query("prj_route_v1", b.ctes("questions") + f"""select question_id, concat('document_search',
  case when {terms_sql(routing.GRAPH_TERMS)} then ',graph_lookup' else '' end,
  case when {terms_sql(routing.EVENT_TERMS)} then ',event_lookup' else '' end) as tools
  from (select question_id, lower(question) as q from questions)""")
def prj_route_v1(spark, d):
    return b.questions(spark, d).select(
        "question_id", F.array_join(routing.route(F.col("question")), ",").alias("tools")
    )


ROUTE_SQL = f"""concat('document_search', case when {terms_sql(routing.GRAPH_TERMS)} then ',graph_lookup' else '' end,
  case when {terms_sql(routing.AGENT_EVENT_TERMS)} then ',event_lookup' else '' end,
  case when {terms_sql(routing.SERIES_TERMS + routing.AGENT_EVENT_TERMS)} then ',timeseries' else '' end)"""


@query("prj_route_v2", b.ctes("questions") + f"""select question_id, {ROUTE_SQL} as tools
  from (select question_id, lower(question) as q from questions)""")
def prj_route_v2(spark, d):
    return b.questions(spark, d).select(
        "question_id", F.array_join(routing.route_agent(F.col("question")), ",").alias("tools")
    )
