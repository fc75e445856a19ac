"""Registered queries that gather and render the evidence of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions import citations as c
from tagtrail.operators import evidence, package, retrieval
from tagtrail.plans import bindings as b, knowledge_queries as k
from tagtrail.plans.document_queries import IDENTIFY_SQL, ROUTE_SQL
from tagtrail.plans.registry import query
from tagtrail.session import staged

# --- graph evidence of chunks found -------------------------------------------------------------------------------

b.SQL["hit_docs"] = """select h.question_id, h.rank, h.chunk_id, h.score, c.file_name, c.page, c.text from hits h
  join chunks c on c.chunk_id = h.chunk_id"""
b.NEEDS["hit_docs"] = ["hits"]
b.SQL["found_entities"] = """select distinct h.question_id, h.chunk_id, e.* exclude (user_id) from hits h join mention_edges m
  on m.chunk_id = h.chunk_id join dict_entities e on e.entity_id = m.entity_id"""
b.NEEDS["found_entities"] = ["hits", "mention_edges"]
b.SQL["found_events"] = """select distinct f.question_id, v.* from found_entities f join dict_events v on
  v.entity_id = f.entity_id"""
b.NEEDS["found_events"] = ["found_entities", "dict_events"]


def grounded_parts(spark, d):
    """Documents, entities and events of every question."""
    chunks = staged(b.chunks(spark, d), "chunks")
    hits = staged(retrieval.top_k_chunks(b.question_vectors(spark, d), b.chunk_vectors(spark, d, chunks), 8), "hits")
    docs = hits.drop("doc_id").join(chunks.select("chunk_id", "file_name", "page", "text"), "chunk_id")
    words = b.dict_entities(spark, d)
    from tagtrail.operators.documents import mention_edges, mentions

    # Only the chunks found are read for mentions.
    read = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    edges = mention_edges(mentions(read, b.tag_dictionary(spark, d)), words)
    entities, events = retrieval.graph_evidence(hits, edges, words.drop("user_id"), b.dict_events(spark, d))
    return docs, staged(entities, "entities-found"), events


@query("join_graph_evidence", b.ctes("found_entities", "found_events") + """select question_id, 'entity' as kind, chunk_id as a,
  entity_id as b, cast(confidence as varchar) as detail from found_entities union all select question_id, 'event', entity_id,
  event_id, event_type from found_events""")
def join_graph_evidence(spark, d):
    _, entities, events = grounded_parts(spark, d)
    return entities.select(
        "question_id", F.lit("entity").alias("kind"), F.col("chunk_id").alias("a"), F.col("entity_id").alias("b"),
        F.col("confidence").cast("string").alias("detail"),
    ).unionByName(events.select(
        "question_id", F.lit("event").alias("kind"), F.col("entity_id").alias("a"), F.col("event_id").alias("b"),
        F.col("event_type").alias("detail"),
    ))


@query("join_hybrid_context", b.ctes("hits", "mention_edges", "dict_events") + """, asked as (select distinct h.question_id,
  lower(e.source_column) as tag from hits h join mention_edges m on m.chunk_id = h.chunk_id join dict_entities e on
  e.entity_id = m.entity_id) select distinct a.question_id, e.entity_id, e.source_column, v.event_id, v.event_type, v."start"
  from asked a join dict_entities e on lower(e.source_column) = a.tag left join dict_events v on v.entity_id = e.entity_id""")
def join_hybrid_context(spark, d):
    words = b.dict_entities(spark, d)
    out = retrieval.hybrid_context(b.hits(spark, d), b.mention_edges(spark, d), words.drop("user_id"), b.dict_events(spark, d))
    return out.select("question_id", "entity_id", "source_column", "event_id", "event_type", "start")


@query("ev_bundle_grounded", b.ctes("hit_docs", "found_events") + """select question_id, 'document' as kind, concat('DOC:',
  file_name, ' p.', cast(page as varchar), ' chunk:', chunk_id) as key, cast(null as varchar) as parent,
  round(score, 6) as score from hit_docs union all select question_id, 'entity', concat('ENTITY:', entity_id), chunk_id, null
  from found_entities union all select question_id, 'event', concat('EVENT:', event_id), entity_id, null from found_events
  union all select question_id, 'policy', rule, null, null from questions, (values """
       + ", ".join(f"('{p}')" for p in package.ANSWER_POLICY) + ") t(rule)")
def ev_bundle_grounded(spark, d):
    found = evidence.grounded_bundle(*grounded_parts(spark, d)).withColumn("score", F.round("score", 6))
    return found.unionByName(evidence.policy_rows(b.questions(spark, d), package.ANSWER_POLICY))


@query("fn_citation_key", b.ctes("chunks", "ents", "detected") + """select concat('DOC:', file_name, ' p.', cast(page as varchar),
  ' chunk:', chunk_id) as key from chunks union all select concat('ENTITY:', id) from ents union all select
  concat('EVENT:', event_id) from detected union all select distinct concat('TS:SUMMARY:', source_tag) from ents""")
def fn_citation_key(spark, d):
    ents = k.entities(spark, d)
    return (
        b.chunks(spark, d).select(c.document_key(F.col("file_name"), F.col("page"), F.col("chunk_id")).alias("key"))
        .unionByName(ents.select(c.entity_key(F.col("id")).alias("key")))
        .unionByName(b.detected(spark, d).select(c.event_key(F.col("event_id")).alias("key")))
        .unionByName(ents.select(c.series_key("SUMMARY", F.col("attributes.source_tag")).alias("key")).distinct())
    )


# --- prompts ------------------------------------------------------------------------------------------------------


def none(expr: str) -> str:
    return f"coalesce(cast({expr} as varchar), 'None')"


def grounded_sql(layout: str) -> str:
    heads = evidence.LAYOUTS[layout]
    if layout == "grounded":
        entity = (f"' tag_family=', {none('tag_family')}, ' confidence=', {none('confidence')}")
        event = (f"' start=', {none('\"start\"')}, ' end=', {none('\"end\"')}, ' peak=', {none('peak_value')}, ' robust_z=', "
                 f"{none('peak_robust_z')}, ' direction=', {none('direction')}, ' status=', {none('status')}")
    else:
        entity = "''"
        event = (f"' status=', {none('status')}, ' start=', {none('\"start\"')}, ' end=', {none('\"end\"')}, ' peak=', "
                 f"{none('peak_value')}, ' robust_z=', {none('peak_robust_z')}")
    return b.ctes("questions", "hit_docs", "found_events") + f"""
select question_id, 0 as section, '' as place, n, case n when 0 then '{heads["question"]}' when 1 then question else '' end as line
  from questions, (values (0), (1), (2)) v(n)
union all select question_id, 2, '', 0, '{heads["documents"]}' from questions
union all select question_id, 2, lpad(cast(rank as varchar), 6, '0'), n, case n when 0 then concat('[DOC:', file_name, ' p.',
  cast(page as varchar), ' chunk:', chunk_id, ']') when 1 then text else '' end from hit_docs, (values (0), (1), (2)) v(n)
union all select question_id, 3, '', 0, '{heads["entities"]}' from questions
union all select question_id, 3, concat(chunk_id, '|', entity_id), 0, concat('[ENTITY:', entity_id, '] column=',
  {none('source_column')}, ' class=', {none('candidate_class')}, {entity}) from found_entities
union all select question_id, 4, '', n, case n when 0 then '' else '{heads["events"]}' end from questions, (values (0), (1)) v(n)
union all select question_id, 4, concat(entity_id, '|', event_id), n, case n when 0 then concat('[EVENT:', event_id, '] sensor=',
  entity_id, ' type=', event_type, {event}) else concat('interpretation=', interpretation) end from found_events,
  (values (0), (1)) v(n) where n = 0 or interpretation <> ''
union all select question_id, 9, '', n, case n when 0 then '' else '{heads["closing"]}' end from questions, (values (0), (1)) v(n)"""


def register_grounded(name: str, layout: str) -> None:
    @query(name, grounded_sql(layout))
    def run(spark, d):
        docs, entities, events = grounded_parts(spark, d)
        return evidence.grounded_lines(b.questions(spark, d), docs, entities, events, layout)


register_grounded("ev_render", "grounded")
register_grounded("ev_render_evaluation", "evaluation")

GRAPH_LINE = (f"' status=', {none('status')}, ' start=', {none('\"start\"')}, ' end=', {none('\"end\"')}, ' peak=', "
              f"{none('peak_value')}, ' robust_z=', {none('peak_robust_z')}")
V1_ROUTE = "concat(tools1)"
SYSTEM_PROMPT = "Use the evidence only."

# Readings with one row per sensor and hour mark, so that sensors meet at equal times.
b.SQL["read150h"] = "select tag, user_id, date_trunc('hour', ts) as ts, rid, value from read150"
b.NEEDS["read150h"] = ["read150"]


def read150h(spark, d):
    return b.read150(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


def routed_sql(layout: str, route: str, extra_ctes: str = "", extra_lines: str = "", needs: tuple = ()) -> str:
    heads = evidence.LAYOUTS[layout]
    return b.ctes("questions", "hit_docs", "looked", "event_found", "graph_events", *needs).rstrip() + ", " + k.TEN_EVENTS + f""",
routed as (select question_id, question, {route} as tools from (select *, lower(question) as q from questions)),
linked as (select *, row_number() over (partition by question_id order by rank, event_id) as place from (
  select l.question_id, l.rank, t.*, row_number() over (partition by l.question_id, t.event_id order by l.rank) as seen
  from looked l join ten t on t.entity_id = l.entity_id) where seen = 1){extra_ctes},
lines as (
select question_id, 0 as section, '' as place, n, case n when 0 then '{SYSTEM_PROMPT}' when 1 then '' when 2 then
  '{heads["question"]}' when 3 then question else '' end as line from routed, (values (0), (1), (2), (3), (4)) v(n)
union all select question_id, 1, '', n, case n when 0 then '{heads["tools"]}' when 1 then replace(tools, ',', ', ') else '' end
  from routed, (values (0), (1), (2)) v(n)
union all select question_id, 2, '', 0, '{heads["documents"]}' from routed
union all select question_id, 2, lpad(cast(rank as varchar), 6, '0'), n, case n when 0 then concat('[DOC:', file_name, ' p.',
  cast(page as varchar), ' chunk:', chunk_id, '] score=', cast(round(score, 6) as varchar)) when 1 then text else '' end
  from hit_docs, (values (0), (1), (2)) v(n) where rank <= 6
union all select question_id, 3, '', 0, '{heads["entities"]}' from routed
union all select l.question_id, 3, lpad(cast(l.rank as varchar), 6, '0'), 0, concat('[ENTITY:', entity_id, '] column=',
  {none('source_column')}, ' class=', {none('candidate_class')}, ' family=', {none('tag_family')}) from looked l join routed r
  on r.question_id = l.question_id where contains(tools, 'graph_lookup')
union all select question_id, 4, '', n, case n when 0 then '' else '{heads["events"]}' end from routed, (values (0), (1)) v(n)
union all select l.question_id, 4, lpad(cast(place as varchar), 6, '0'), 0, concat('[EVENT:', event_id, '] sensor=', entity_id,
  ' type=', event_type, {GRAPH_LINE}) from linked l join routed r on r.question_id = l.question_id
  where contains(tools, 'graph_lookup')
union all select question_id, 5, '', n, case n when 0 then '' else '{heads["found"]}' end from routed, (values (0), (1)) v(n)
union all select f.question_id, 5, lpad(cast(rank as varchar), 6, '0'), 0, concat('[EVENT:', event_id, '] sensor=', entity_id,
  ' type=', event_type, {GRAPH_LINE}) from event_found f join routed r on r.question_id = f.question_id
  where contains(tools, 'event_lookup'){extra_lines}
union all select question_id, 9, '', n, case n when 0 then '' else '{heads["closing"]}' end from routed, (values (0), (1)) v(n))"""


TEXT_SELECT = " select question_id, string_agg(line, chr(10) order by section, place, n) as prompt from lines group by question_id"


def terms(ts):
    return "(" + " or ".join(f"contains(q, '{t}')" for t in ts) + ")"


from tagtrail.functions import routing  # noqa: E402

ROUTE1_SQL = f"""concat('document_search', case when {terms(routing.GRAPH_TERMS)} then ',graph_lookup' else '' end,
  case when {terms(routing.EVENT_TERMS)} then ',event_lookup' else '' end)"""


def routed_parts(spark, d, agent):
    questions = evidence.routed(b.questions(spark, d), agent)
    chunks = staged(b.chunks(spark, d), "chunks")
    hits = retrieval.top_k_chunks(b.question_vectors(spark, d), b.chunk_vectors(spark, d, chunks), 6)
    docs = hits.drop("doc_id").join(chunks.select("chunk_id", "file_name", "page", "text"), "chunk_id")
    entities = staged(k.entities(spark, d), "entities")
    events = staged(k.graph_events(spark, d, entities), "events")
    return questions, evidence.routed_evidence(questions, docs, k.graph_entities(spark, d, entities), events)


@query("ev_render_tools", routed_sql("tools", ROUTE1_SQL) + TEXT_SELECT)
def ev_render_tools(spark, d):
    questions, found = routed_parts(spark, d, agent=False)
    return evidence.render_text(evidence.routed_lines(questions, found, "tools", SYSTEM_PROMPT))


ISO_SQL = "'%Y-%m-%dT%H:%M:%S.%f'"
SERIES_CTES = ", " + IDENTIFY_SQL.split("),\ntags as", 1)[0].replace("toks as", "toks2 as") + """),
tags as (select distinct tag from read150),""" + IDENTIFY_SQL.split("tags as (select distinct tag from read150),", 1)[1].replace(
    "from toks, tags", "from toks2, tags") + """,
explicit as (select question_id, tag, row_number() over (partition by question_id order by tag) as rank from named union all
  select question_id, tag, rank from identified where rank <= 4 and question_id not in (select question_id from named)),
sens as (select e.* from explicit e join routed r on r.question_id = e.question_id where contains(tools, 'timeseries')),
stats as (select tag, count(value) as rows, min(value) as lo, max(value) as hi, avg(value) as mean,
  quantile_cont(value, 0.5) as median, stddev_pop(value) as std from read150h group by tag),
recent as (select *, row_number() over (partition by tag order by ts desc, rid desc) as recency from read150h),
evs as (select *, row_number() over (partition by lower(sensor_tag) order by coalesce("start", timestamp, '') desc, event_id)
  as recency from detected),
pair as (select question_id, arg_min(tag, rank) as a, arg_max(tag, rank) as b from sens where rank <= 2 and question_id in
  (select question_id from questions where contains(lower(question), 'compare') or contains(lower(question), 'correlation'))
  group by question_id having count(*) = 2),
tail as (select distinct ts from read150h order by ts desc limit 500),
cmp as (select p.question_id, p.a, p.b, count(case when x is not null and y is not null then 1 end) as n, case when
  count(case when x is not null and y is not null then 1 end) >= 2 then corr(x, y) end as r from pair p left join (select pp.question_id, t.ts,
  max(case when h.tag = pp.a then value end) as x, max(case when h.tag = pp.b then value end) as y from pair pp join tail t on true
  join read150h h on h.ts = t.ts and h.tag in (pp.a, pp.b) group by 1, 2) q on q.question_id = p.question_id group by 1, 2, 3)"""
SERIES_LINES = f"""
union all select question_id, 6, '', n, case n when 0 then '' else '{evidence.LAYOUTS["agent"]["series"]}' end
  from routed, (values (0), (1)) v(n)
union all select r.question_id, 6, '0', 0, concat('IDENTIFIED SENSORS: ', coalesce((select string_agg(tag, ', ' order by rank)
  from sens s where s.question_id = r.question_id), '')) from routed r
union all select question_id, 6, concat('1|', lpad(cast(rank as varchar), 6, '0')), 0, concat('[TS:SUMMARY:', s.tag, '] rows=',
  cast(rows as varchar), ' min=', {none('round(lo, 8)')}, ' max=', {none('round(hi, 8)')}, ' mean=', {none('round(mean, 8)')},
  ' median=', {none('round(median, 8)')}, ' std=', {none('round(std, 8)')}, ' range=',
  (select strftime(min(ts), {ISO_SQL}) from read150h), '..', (select strftime(max(ts), {ISO_SQL}) from read150h))
  from sens s join stats t on t.tag = s.tag where rank <= 3
union all select question_id, 6, concat('2|', lpad(cast(rank as varchar), 6, '0')), 0, concat('[TS:RECENT:', tag, ']') from sens
  where rank <= 3
union all select question_id, 6, concat('2|', lpad(cast(rank as varchar), 6, '0'), '|', lpad(cast(1000 - recency as varchar), 6, '0')),
  0, concat('timestamp=', strftime(ts, {ISO_SQL}), ' value=', {none('value')}) from sens s join recent t on t.tag = s.tag
  where rank <= 3 and recency <= 12
union all select question_id, 6, concat('3|', lpad(cast(rank as varchar), 6, '0'), '|', lpad(cast(recency as varchar), 6, '0')), 0,
  concat('[TS:EVENT:', event_id, '] sensor=', s.tag, ' type=', event_type, {GRAPH_LINE}) from sens s join evs t on
  t.sensor_tag = s.tag where rank <= 3 and recency <= 12
union all select question_id, 6, '4', 0, concat('[TS:COMPARE:', a, ':', b, '] rows=', cast(n as varchar), ' pearson=',
  {none('round(r, 8)')}, ' range=', (select strftime(min(ts), {ISO_SQL}) from tail), '..',
  (select strftime(max(ts), {ISO_SQL}) from tail)) from cmp"""
AGENT_SQL = routed_sql("agent", ROUTE_SQL, SERIES_CTES, SERIES_LINES, ("read150h",))


def agent_lines(spark, d):
    questions, found = routed_parts(spark, d, agent=True)
    readings = read150h(spark, d)
    sensors = evidence.question_sensors(questions, readings)
    series = evidence.sensor_evidence(questions, sensors, readings, b.detected(spark, d))
    return evidence.routed_lines(questions, found, "agent", SYSTEM_PROMPT).unionByName(
        evidence.series_lines(sensors, series, questions)
    )


@query("ev_render_agent", AGENT_SQL + TEXT_SELECT)
def ev_render_agent(spark, d):
    return evidence.render_text(agent_lines(spark, d))


@query("ev_bundle_routed", AGENT_SQL + """ select question_id, section, place, n, line from lines where line <> '' union all
  select question_id, 7, '', n, line from questions, (values """ + ", ".join(
    f"({i}, '{p}')" for i, p in enumerate(package.EVIDENCE_POLICY)) + ") t(n, line)")
def ev_bundle_routed(spark, d):
    rules = evidence.policy_lines(b.questions(spark, d), package.EVIDENCE_POLICY)
    return agent_lines(spark, d).where("line <> ''").unionByName(rules)


# --- summary rows that name a sensor anywhere ---------------------------------------------------------------------


@query("join_summary_anycol", b.ctes("sensors") + """, summary as (select tag as name, 'x' as alias, row_count, user_id as ord
  from sensors where user_id % 2 = 0 union all select concat('s', cast(user_id as varchar)), upper(tag), row_count, user_id
  from sensors where user_id % 2 = 1 union all select concat('late', cast(user_id as varchar)), tag, -1, user_id + 1000000
  from sensors where user_id % 3 = 0)
  select tag, name, n from (select s.tag, m.name, m.row_count as n, row_number() over (partition by s.tag order by ord) as r
  from sensors s left join summary m on lower(m.name) = lower(s.tag) or lower(m.alias) = lower(s.tag)) where r = 1""")
def join_summary_anycol(spark, d):
    s = b.sensors(spark, d)
    user, n = F.col("user_id"), F.col("row_count")

    def rows(where, name, alias, count, order):
        return s.where(where).select(name.alias("name"), alias.alias("alias"), count.alias("row_count"), order.alias("ord"))

    summary = (
        rows("user_id % 2 = 0", F.col("tag"), F.lit("x"), n, user)
        .unionByName(rows("user_id % 2 = 1", F.concat(F.lit("s"), user.cast("string")), F.upper("tag"), n, user))
        .unionByName(rows("user_id % 3 = 0", F.concat(F.lit("late"), user.cast("string")), F.col("tag"), F.lit(-1).cast("bigint"),
                          user + 1000000))
    )
    return retrieval.first_summary(s.select("tag"), summary, ["name", "alias"], ["ord"]).select(
        "tag", "name", F.col("row_count").alias("n")
    )
