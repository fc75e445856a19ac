"""Registered queries over grounded examples, their checks, split and evaluation, and over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions import citations as c
from tagtrail.functions.ids import hash_bucket, pair_key
from tagtrail.operators import evaluation as ev, knowledge as kg, package, training as tr, vector_index
from tagtrail.operators.documents import linked_chunks
from tagtrail.plans import bindings as b, knowledge_queries as k
from tagtrail.plans.registry import query
from tagtrail.plans.series_queries import rounded
from tagtrail.session import staged
from tagtrail.sources import files, sinks, tables

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
EXCERPT = r"""case when length(text) > 700 then concat(regexp_replace(left(text, 700), ' [^ ]*$', ''), '...') else text end"""


def ex_id(prefix: str, value: str, digits: int = 12) -> str:
    return f"concat('{prefix}_', substring(sha1({value}), 1, {digits}))"


b.SQL["tr_entity"] = f"""select {ex_id('entity_class', 'id')} as id, 'entity_classification' as task_type, 'standard' as difficulty,
  concat('What class was proposed for sensor entity ', id, '?') as instruction,
  concat('The candidate class recorded for ', id, ' is ', candidate_class, '.') as response from ents
  union all select {ex_id('entity_provenance', 'id')}, 'provenance', 'standard',
  concat('Where did the knowledge system obtain evidence for ', id, '?'), concat('The recorded provenance points to source ',
    source_id, ', sheet ', source_sheet, ', column ', source_column, ', rows ', cast(source_row_start as varchar), '–',
    cast(source_row_end as varchar), '.') from ents"""
b.NEEDS["tr_entity"] = ["ents"]
b.SQL["tr_document"] = f"""select {ex_id('doc_evidence', 'chunk_id')} as id, 'document_evidence' as task_type, 'standard' as
  difficulty, concat('What does the retrieved document evidence at ', file_name, ' page ', cast(page as varchar), ' say?')
  as instruction, concat('The retrieved evidence from ', file_name, ' p.', cast(page as varchar), ' chunk:', chunk_id,
  ' states: ', {EXCERPT}) as response, document_id, page, chunk_index from chunks"""
b.NEEDS["tr_document"] = ["chunks"]
b.SQL["tr_event"] = f"""select {ex_id('event', 'event_id')} as id, 'timeseries_event_interpretation' as task_type, 'standard' as
  difficulty, concat('What does candidate event ', event_id, ' tell us?') as instruction, concat(concat_ws(' ',
    concat('The recorded event type is ', event_type, '.'), concat('The associated sensor is ', sensor_tag, '.'),
    case when "start" is not null or "end" is not null then concat('The recorded time window is ',
      coalesce("start", 'unspecified'), ' to ', coalesce("end", 'unspecified'), '.') end,
    case when peak_value is not null then concat('The recorded peak value is ', cast(peak_value as varchar), '.') end,
    case when peak_robust_z is not null then concat('The recorded peak robust z-score is ', cast(peak_robust_z as varchar), '.') end,
    concat('Recorded interpretation: ', interpretation), concat('Status: ', status, '.')), '{tr.EVENT_CAVEAT}') as response,
  event_id from detected"""
b.NEEDS["tr_event"] = ["detected"]


def staged_chunks(spark, d):
    return staged(b.chunks(spark, d), "chunks")


def links(spark, d, chunks):
    return linked_chunks(chunks, b.tag_dictionary(spark, d))


def flat(df):
    return df.select("id", "task_type", "difficulty", "instruction", "response")


@query("tr_entity_examples", b.ctes("tr_entity") + "select * from tr_entity")
def tr_entity_examples(spark, d):
    return flat(tr.entity_examples(k.entities(spark, d)))


@query("tr_document_examples", b.ctes("tr_document", "mentions") + """select t.* exclude (document_id, page, chunk_index),
  (select count(*) from mentions m where concat('doc_evidence_', substring(sha1(m.chunk_id), 1, 12)) = t.id) as tags
  from tr_document t""")
def tr_document_examples(spark, d):
    chunks = staged_chunks(spark, d)
    made = tr.document_examples(chunks, links(spark, d, chunks), limit=None)
    tags = F.from_json(F.col("context")[0]["mentioned_sensor_tags"], "array<string>")
    return made.select("id", "task_type", "difficulty", "instruction", "response", F.size(tags).cast("bigint").alias("tags"))


@query("tr_event_examples", b.ctes("tr_event") + "select * exclude (event_id) from tr_event")
def tr_event_examples(spark, d):
    return flat(tr.event_examples(b.detected(spark, d), limit=None))


@query("tr_hard_negatives", b.ctes("ents", "detected") + f"""select id, instruction, response, case when id =
  'hard_negative_failure' then (select min(event_id) from detected) end as event_id, case when id = 'hard_negative_failure'
  then (select min(id) from ents) end as sensor from (values """
       + ", ".join(f"('{i}', '{q}', '{a}')" for i, _, q, a, _ in tr.HARD_NEGATIVES) + ") t(id, instruction, response)")
def tr_hard_negatives(spark, d):
    made = tr.hard_negatives(k.entities(spark, d), b.detected(spark, d))
    first = F.col("context")[0]
    return made.select(
        "id", "instruction", "response", F.try_element_at(first, F.lit("event_id")).alias("event_id"),
        F.try_element_at(first, F.lit("sensor")).alias("sensor"),
    )


@query("limit_examples", b.ctes("tr_document", "tr_event") + """select id from (select id from tr_document order by document_id, page,
  chunk_index limit 25) union all select id from (select id from tr_event order by event_id limit 50)""")
def limit_examples(spark, d):
    chunks = staged_chunks(spark, d)
    docs = tr.document_examples(chunks, links(spark, d, chunks), tr.DOCUMENT_LIMIT)
    return docs.select("id").unionByName(tr.event_examples(b.detected(spark, d), tr.EVENT_LIMIT).select("id"))


def every_example(spark, d):
    chunks = staged_chunks(spark, d)
    return tr.all_examples(k.entities(spark, d), chunks, links(spark, d, chunks), b.detected(spark, d), None, None)


b.SQL["every"] = "select id, task_type, difficulty from tr_entity union all select id, task_type, difficulty from tr_document union all select id, task_type, difficulty from tr_event union all select id, 'uncertainty_reasoning', 'hard' from (values " + ", ".join(f"('{i}')" for i, *_ in tr.HARD_NEGATIVES) + ") t(id)"
b.NEEDS["every"] = ["tr_entity", "tr_document", "tr_event"]


@query("set_union_examples", b.ctes("every") + "select id, task_type, difficulty from every")
def set_union_examples(spark, d):
    return every_example(spark, d).select("id", "task_type", "difficulty")


# --- checks and split ---------------------------------------------------------------------------------------------

PAIR_SQL = f"sha256(concat(lower({STRIP.format('instruction')}), chr(10), lower({STRIP.format('response')})))"
BUCKET_SQL = f"(('0x' || substring(sha256({PAIR_SQL}), 1, 16))::ubigint::double / 18446744073709551616.0)"
SPLIT_SQL = "case when bucket < 0.8 then 'train' when bucket < 0.8::double + 0.1::double then 'validation' else 'test' end"


@query("fn_hash_bucket", b.ctes("examples") + f"select id, {PAIR_SQL} as key, {BUCKET_SQL} as bucket from examples")
def fn_hash_bucket(spark, d):
    key = pair_key(F.col("instruction"), F.col("response"))
    return b.examples(spark, d).select("id", key.alias("key"), hash_bucket(key).alias("bucket"))


def copied(df):
    """Examples of which every fiftieth comes once more under the same id."""
    again = (F.substring_index("id", "_", -1).cast("bigint") % 50) == 0
    return df.unionByName(df.where(again))


b.SQL["copied"] = "select * from examples union all select * from examples where cast(substring(id, 4) as bigint) % 50 = 0"
b.NEEDS["copied"] = ["examples"]


@query("agg_duplicate_keys", b.ctes("copied") + f"""select id, count(*) over (partition by id) > 1 as duplicate_id,
  count(*) over (partition by {PAIR_SQL}) > 1 as duplicate_pair from copied""")
def agg_duplicate_keys(spark, d):
    return tr.with_duplicates(copied(b.examples(spark, d))).select("id", "duplicate_id", "duplicate_pair")


@query("agg_example_counts", b.ctes("examples") + f""", s as (select task_type, difficulty, {SPLIT_SQL} as split from
  (select *, {BUCKET_SQL} as bucket from examples)) select 'task_type' as field, task_type as value, count(*) as examples from s
  group by 2 union all select 'difficulty', difficulty, count(*) from s group by 2 union all select 'split', split, count(*)
  from s group by 2""")
def agg_example_counts(spark, d):
    return tr.example_counts(tr.split_examples(b.examples(spark, d)), ["task_type", "difficulty", "split"])


# Examples over documents with faults planted by document number.
b.SQL["planted"] = """select doc_id, case when doc_id % 17 = 1 then '' else concat('ex_', cast(doc_id as varchar)) end as id,
  case when doc_id % 17 = 2 then null else concat('Summarise the ', lang, ' passage') end as instruction,
  case when doc_id % 17 = 3 then '  ' else text end as response,
  case when doc_id % 17 in (4, 5) then 'timeseries_event_interpretation' when doc_id % 17 in (6, 7) then
    'uncertainty_reasoning' else 'document_evidence' end as task_type,
  case when doc_id % 17 = 8 then concat('ghost', cast(doc_id as varchar)) else concat('doc_', substring(sha1(source), 1, 16)) end as chunk_ref,
  case when doc_id % 17 = 9 then 'nobody' end as entity_ref, case when doc_id % 17 = 10 then 'nothing' end as event_ref,
  doc_id % 17 = 11 as no_source, doc_id % 17 = 12 as no_policy, doc_id % 17 = 13 as weak_policy, doc_id % 17 = 14 as no_context
  from documents"""
b.SQL["planted_errors"] = f"""select doc_id, task_type, concat_ws(',', case when instruction is null then 'missing_field:instruction' end,
  case when no_context then 'missing_field:context' end, case when no_policy then 'missing_field:grounding_policy' end,
  case when id = '' then 'empty_id' end, case when instruction is null then 'empty_instruction' end,
  case when {STRIP.format('response')} = '' then 'empty_response' end, case when no_context then 'context_not_list' end,
  case when no_policy then 'grounding_policy_not_object' end,
  case when weak_policy then 'missing_policy:correlation_is_not_causation' end, case when no_source then 'no_source_records' end,
  case when not no_context and chunk_ref like 'ghost%' then concat('unknown_chunk:', chunk_ref) end,
  case when not no_context and entity_ref is not null then concat('unknown_entity:', entity_ref) end,
  case when not no_context and event_ref is not null then concat('unknown_event:', event_ref) end,
  case when task_type = 'timeseries_event_interpretation' and not (contains(lower(response), 'does not') and
    contains(lower(response), 'confirmed')) then 'event_response_missing_uncertainty_guard' end,
  case when task_type = 'uncertainty_reasoning' and not (contains(lower(response), 'no.') or contains(lower(response), 'not')
    or contains(lower(response), 'insufficient') or contains(lower(response), 'cannot')) then
    'uncertainty_example_may_be_overconfident' end,
  case when count(*) over (partition by id) > 1 then 'duplicate_example_id' end,
  case when count(*) over (partition by {PAIR_SQL.replace(
      STRIP.format('instruction'), STRIP.format("coalesce(instruction, '')"))}) > 1 then
    'duplicate_instruction_response' end) as errors from planted"""
b.NEEDS["planted_errors"] = ["planted"]


def planted(spark, d):
    docs = b.table(spark, d, "documents")
    f = F.col("doc_id") % 17
    chunk = F.when(f == 8, F.concat(F.lit("ghost"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("doc_"), F.substring(F.sha1("source"), 1, 16))
    )
    context = F.array(
        tr.record(chunk_id=chunk, entity_id=F.when(f == 9, "nobody")), tr.record(event_id=F.when(f == 10, "nothing"))
    )
    policy = F.struct(*(
        (F.when(f != 13, True) if p == "correlation_is_not_causation" else F.lit(True)).alias(p) for p in tr.POLICY_KEYS
    ))
    return docs.select(
        "doc_id",
        F.when(f == 1, "").otherwise(F.concat(F.lit("ex_"), F.col("doc_id").cast("string"))).alias("id"),
        F.lit("1.0").alias("schema_version"),
        F.when(f.isin(4, 5), "timeseries_event_interpretation").when(f.isin(6, 7), "uncertainty_reasoning").otherwise(
            "document_evidence").alias("task_type"),
        F.lit("standard").alias("difficulty"),
        F.when(f != 2, F.concat(F.lit("Summarise the "), "lang", F.lit(" passage"))).alias("instruction"),
        F.when(f == 3, "  ").otherwise(F.col("text")).alias("response"),
        F.when(f != 14, context).alias("context"),
        F.when(f == 11, F.array().cast("array<map<string,string>>")).otherwise(
            F.array(tr.record(artifact=F.col("source")))).alias("source_records"),
        F.when(f != 12, policy).alias("grounding_policy"),
    )


def known_ids(spark, d):
    files_known = b.pages(spark, d).select(F.col("document_id").alias("id"))
    ents = k.entities(spark, d).select("id")
    return files_known, ents, b.detected(spark, d).select(F.col("event_id").alias("id"))


@query("tr_validate", b.ctes("planted_errors") + """select doc_id, task_type, errors, case when errors = '' then 'passed' else
  'failed' end as status from planted_errors""")
def tr_validate(spark, d):
    checked = tr.validate_examples(planted(spark, d), *known_ids(spark, d))
    return checked.select("doc_id", "task_type", F.array_join("errors", ",").alias("errors"), "status")


@query("join_reference_check", b.ctes("planted") + """select doc_id, concat('unknown_chunk:', chunk_ref) as unknown from planted
  where chunk_ref like 'ghost%' and not no_context union all select doc_id, concat('unknown_entity:', entity_ref) from planted
  where entity_ref is not null and not no_context union all select doc_id, concat('unknown_event:', event_ref) from planted
  where event_ref is not null and not no_context""")
def join_reference_check(spark, d):
    examples = planted(spark, d)
    bad = tr.unknown_references(examples, *known_ids(spark, d))
    return examples.select("doc_id", tr.context_key().alias("context_key")).join(bad, "context_key").select(
        "doc_id", F.explode("unknown").alias("unknown")
    )


@query("tr_split", b.ctes("examples") + f"select id, task_type, {SPLIT_SQL} as split from (select *, {BUCKET_SQL} as bucket from examples)")
def tr_split(spark, d):
    made = b.examples(spark, d)
    return tr.split_examples(made, checked=made.withColumn("status", F.lit("passed"))).select("id", "task_type", "split")


@query("sort_split_output", b.ctes("examples") + f"""select id, instruction, {SPLIT_SQL} as split from (select *, {BUCKET_SQL}
  as bucket from examples)""")
def sort_split_output(spark, d):
    at = sinks.scratch_path(spark, "splits")
    sinks.write_splits(tr.split_examples(b.examples(spark, d)).drop("bucket"), at)
    back = spark.read.schema("id string, instruction string, split string").json(at)
    return back.select("id", "instruction", "split")


SYSTEM_PROMPT = "Answer only from the evidence given."


@query("tr_sft", b.ctes("every") + """select example_id, task_type, roles, user_starts, user_ends from (select id as example_id,
  task_type, 'system,user,assistant' as roles, true as user_starts, true as user_ends from every)""")
def tr_sft(spark, d):
    rows = tr.chat_rows(tr.split_examples(every_example(spark, d)), SYSTEM_PROMPT)
    at = sinks.scratch_path(spark, "chat")
    sinks.write_jsonl(rows.withColumn("split", F.col("metadata.split")), at, ["split"])
    back = spark.read.schema(rows.schema).json(at)
    user = F.col("messages")[1]["content"]
    return back.select(
        "metadata.example_id", "metadata.task_type", F.array_join(F.col("messages")["role"], ",").alias("roles"),
        user.contains("\n\nEVIDENCE CONTEXT\n").alias("user_starts"),
        user.endswith("\n\nProvide the grounded answer using only this evidence.").alias("user_ends"),
    )


POLICY_JSON = "{" + ",".join(f'"{p}":true' for p in tr.POLICY_KEYS) + "}"


@query("fn_chat_messages", b.ctes("tr_event") + f"""select id, instruction, response, concat(chr(10), 'GROUNDING POLICY', chr(10),
  '{POLICY_JSON}', chr(10), chr(10), 'Provide the grounded answer using only this evidence.') as tail from tr_event""")
def fn_chat_messages(spark, d):
    rows = tr.chat_rows(tr.split_examples(tr.event_examples(b.detected(spark, d), None)), SYSTEM_PROMPT)
    user = F.col("messages")[1]["content"]
    return rows.select(
        F.col("metadata.example_id").alias("id"), F.substring_index(user, "\n\n", 1).alias("instruction"),
        F.col("messages")[2]["content"].alias("response"),
        F.concat(F.lit("\nGROUNDING POLICY"), F.substring_index(user, "GROUNDING POLICY", -1)).alias("tail"),
    )


@query("fn_compact_json", """select event_id, concat('{"id":', cast(event_id as varchar), ',"type":"', event_type,
  '","user":', case when user_id % 3 = 0 then 'null' else concat('"', cast(user_id as varchar), '"') end, '}') as json from events""")
def fn_compact_json(spark, d):
    user = F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string"))
    item = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), user.alias("user"))
    return b.table(spark, d, "events").select("event_id", c.compact_json(item).alias("json"))


@query("fn_split_prompt", """select conv_id, concat(coalesce(concat(string_agg(concat(upper(role), ': ', text), chr(10) || chr(10) order by
  turn) filter (role <> 'assistant'), chr(10), chr(10)), ''), 'ASSISTANT:') as prompt,
  coalesce(arg_min(text, turn) filter (role = 'assistant'), '') as reference from conversations group by conv_id""")
def fn_split_prompt(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    talks = b.table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    return talks.select(
        "conv_id", c.prompt_text(F.col("messages")).alias("prompt"), c.reference_text(F.col("messages")).alias("reference")
    )


# --- answers ------------------------------------------------------------------------------------------------------

CITED = r"regexp_extract_all(answer, '\[((?:{0}):[^\]]+)\]', 1)"


def checks_sql(kinds: str) -> str:
    return f"""cited as (select conv_id, turn, unnest({CITED.format(kinds)}) as key from answers),
counted as (select a.conv_id, a.turn, count(x.key) as citation_count, count(s.key) as valid_citation_count,
  coalesce(string_agg(case when s.key is null then x.key end, ',' order by x.key), '') as invalid_citations from answers a
  left join cited x on x.conv_id = a.conv_id and x.turn = a.turn left join shown s on s.conv_id = x.conv_id and s.key = x.key
  group by 1, 2)"""


def low(text="answer"):
    return rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))"


def any_sql(text, phrases):
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


@query("fn_citations", b.ctes("answers") + f"""select conv_id, turn, array_to_string({CITED.format('DOC|ENTITY|EVENT')}, ',') as cited,
  array_to_string({CITED.format('DOC|ENTITY|EVENT|TS')}, ',') as cited_with_series from answers""")
def fn_citations(spark, d):
    a = F.col("answer")
    return b.answers(spark, d).select(
        "conv_id", "turn", F.array_join(c.citations(a), ",").alias("cited"),
        F.array_join(c.citations(a, with_series=True), ",").alias("cited_with_series"),
    )


@query("set_invalid_citations", b.ctes("answers") + f"""select conv_id, turn, array_to_string(list_filter(x, lambda y: y not in
  ('EVENT:x1', 'ENTITY:e0')), ',') as invalid from (select *, {CITED.format('DOC|ENTITY|EVENT|TS')} as x from answers)""")
def set_invalid_citations(spark, d):
    valid = F.array(F.lit("EVENT:x1"), F.lit("ENTITY:e0"))
    bad = c.invalid_citations(c.citations(F.col("answer"), with_series=True), valid)
    return b.answers(spark, d).select("conv_id", "turn", F.array_join(bad, ",").alias("invalid"))


FLAG_SQL = f"""contains(answer, 'Answer:') as has_answer_section, contains(answer, 'Evidence:') as has_evidence_section,
  contains(answer, 'Uncertainty:') as has_uncertainty_section,
  {any_sql('lower(answer)', c.INSUFFICIENT_PHRASES)} as contains_insufficient_language"""
SYSTEM_SQL = f"""contains({low()}, 'answer:') and contains({low()}, 'evidence:') and contains({low()}, 'assessment:') and
  contains({low()}, 'uncertainty:') as has_required_sections, {any_sql(low(), c.UNCERTAINTY_PHRASES)} as has_uncertainty_language,
  {any_sql(low(), c.FAILURE_PHRASES)} as contains_failure_language, {STRIP.format('answer')} <> '' as has_non_empty_answer"""
MODEL_SQL = f"""{STRIP.format('answer')} <> '' as non_empty, contains({low()}, 'answer:') as has_answer_section,
  contains({low()}, 'evidence:') as has_evidence_section, contains({low()}, 'uncertainty:') as has_uncertainty_section,
  {any_sql(low(), c.COMPARISON_GUARD_PHRASES)} as has_grounding_guard"""


@query("fn_answer_flags", b.ctes("answers") + f"""select conv_id, turn, {FLAG_SQL}, {SYSTEM_SQL},
  {any_sql(low(), c.GUARD_PHRASES)} as grounding_guard_present,
  {any_sql(low(), c.COMPARISON_GUARD_PHRASES)} as has_grounding_guard from answers""")
def fn_answer_flags(spark, d):
    a = F.col("answer")
    flags = c.grounding_flags(a) | c.system_flags(a)
    flags["grounding_guard_present"] = c.prediction_flags(a)["grounding_guard_present"]
    flags["has_grounding_guard"] = c.comparison_flags(a)["has_grounding_guard"]
    return b.answers(spark, d).withColumns(flags).drop("answer")


SHOWN_SQL = """kinds as (select conv_id, count(*) filter (key like 'DOC:%') as document_count, count(*) filter (key like 'ENTITY:%')
  as entity_count, count(*) filter (key like 'EVENT:%') as event_count from shown group by conv_id)"""
COUNTS = """c.citation_count, c.valid_citation_count, c.citation_count - c.valid_citation_count as invalid_citation_count,
  c.invalid_citations, c.citation_count = c.valid_citation_count as citation_grounding_pass, document_count, entity_count, event_count"""
JOINED = "from answers a join counted c on c.conv_id = a.conv_id and c.turn = a.turn left join kinds k on k.conv_id = a.conv_id"
KEYS = ["conv_id", "turn"]


def listed(df):
    return df.withColumn("invalid_citations", F.array_join("invalid_citations", ",")).drop("answer")


@query("qa_grounding_eval", b.ctes("answers", "shown").rstrip() + ", " + checks_sql("DOC|ENTITY|EVENT") + ", " + SHOWN_SQL
       + f" select a.conv_id, a.turn, {COUNTS}, {FLAG_SQL} {JOINED}")
def qa_grounding_eval(spark, d):
    return listed(ev.grounding_evaluation(b.answers(spark, d), b.shown(spark, d), "conv_id", KEYS))


@query("qa_system_eval", b.ctes("answers", "shown").rstrip() + ", " + checks_sql("DOC|ENTITY|EVENT|TS") + ", " + SHOWN_SQL
       + f" select a.conv_id, a.turn, {COUNTS}, {SYSTEM_SQL} {JOINED}")
def qa_system_eval(spark, d):
    return listed(ev.system_evaluation(b.answers(spark, d), b.shown(spark, d), "conv_id", KEYS))


RATES = ["has_non_empty_answer", "has_required_sections", "citation_grounding_pass", "has_uncertainty_language"]


MEANS = ["average_top_document_score", "average_documents", "average_entities"]


@query("agg_pass_rates", b.ctes("answers", "shown", "hits").rstrip() + ", " + checks_sql("DOC|ENTITY|EVENT|TS") + ", " + SHOWN_SQL
       + f", rows as (select a.conv_id, {COUNTS}, {SYSTEM_SQL} {JOINED}), best as (select question_id, max(score) as score from hits "
       + "group by 1) select count(*) as cases, "
       + ", ".join(f"round(avg(cast({f} as int)), 6) as {f}_rate" for f in RATES)
       + ", round(avg(score), 6) as average_top_document_score, round(avg(document_count), 6) as average_documents, "
       + "round(avg(entity_count), 6) as average_entities from rows left join best on question_id = conv_id")
def agg_pass_rates(spark, d):
    # The documents of a case are those found for the question of its number.
    checked = ev.system_evaluation(b.answers(spark, d), b.shown(spark, d), "conv_id", KEYS)
    scores = b.hits(spark, d).select(F.col("question_id").alias("conv_id"), "score")
    one = ev.retrieval_summary(checked, scores, "conv_id").select(F.struct(*MEANS).alias("m")).scalar()
    out = ev.pass_rates(checked, RATES).withColumn("m", one).select("*", "m.*").drop("m")
    return rounded(out, *(f"{f}_rate" for f in RATES), *MEANS)


@query("agg_grounding_rates", b.ctes("answers", "shown").rstrip() + ", " + checks_sql("DOC|ENTITY|EVENT") + ", " + SHOWN_SQL
       + f", rows as (select {COUNTS}, {FLAG_SQL} {JOINED}) select count(*) as cases, round(avg(cast(citation_grounding_pass as int)), 6) "
       + "as citation_grounding_pass_rate, round(avg(cast(has_answer_section and has_evidence_section and has_uncertainty_section as int)), 6) "
       + "as required_structure_rate from rows")
def agg_grounding_rates(spark, d):
    checked = ev.with_structure(ev.grounding_evaluation(b.answers(spark, d), b.shown(spark, d), "conv_id", KEYS))
    flags = ["citation_grounding_pass", "required_structure"]
    return rounded(ev.pass_rates(checked, flags), *(f"{f}_rate" for f in flags))


PREDICTION_SQL = f"""{STRIP.format('answer')} <> '' as non_empty_prediction, {any_sql(low(), c.GUARD_PHRASES)} as grounding_guard_present,
  contains(answer, 'Answer:') as has_answer_section, contains(answer, 'Evidence:') as has_evidence_section,
  contains(answer, 'Uncertainty:') as has_uncertainty_section, contains(answer, 'Answer:') and contains(answer, 'Evidence:') and
  contains(answer, 'Uncertainty:') as required_structure"""


@query("qa_sft_eval", b.ctes("answers") + f"select conv_id, turn, {PREDICTION_SQL} from answers")
def qa_sft_eval(spark, d):
    return ev.prediction_evaluation(b.answers(spark, d)).drop("answer")


PREDICTION_RATES = ["non_empty_prediction", "grounding_guard_present", "required_structure"]


@query("agg_sft_rates", b.ctes("answers") + f", rows as (select {PREDICTION_SQL} from answers) select count(*) as cases, "
       + ", ".join(f"round(avg(cast({f} as int)), 6) as {f}_rate" for f in PREDICTION_RATES) + " from rows")
def agg_sft_rates(spark, d):
    rates = ev.pass_rates(ev.prediction_evaluation(b.answers(spark, d)), PREDICTION_RATES)
    return rounded(rates, *(f"{f}_rate" for f in PREDICTION_RATES))


b.SQL["two_models"] = """select conv_id, turn, answer as tuned, case when turn % 3 = 0 then '' else replace(answer, 'Evidence:', '') end as base
  from answers"""
b.NEEDS["two_models"] = ["answers"]
LONG_SQL = f"""long as (select conv_id, turn, model, answer from two_models unpivot (answer for model in (base, tuned))),
checked as (select conv_id, turn, model, {MODEL_SQL} from long)"""


def two_models(spark, d):
    base = F.when(F.col("turn") % 3 == 0, "").otherwise(F.replace(F.col("answer"), F.lit("Evidence:"), F.lit("")))
    return b.answers(spark, d).select("conv_id", "turn", F.col("answer").alias("tuned"), base.alias("base"))


@query("qa_model_compare", b.ctes("two_models").rstrip() + ", " + LONG_SQL + " select * from checked")
def qa_model_compare(spark, d):
    return ev.model_checks(two_models(spark, d), ["base", "tuned"], KEYS).drop("answer")


CHECKS = ["non_empty", "has_answer_section", "has_evidence_section", "has_uncertainty_section", "has_grounding_guard"]


@query("agg_model_comparison", b.ctes("two_models").rstrip() + ", " + LONG_SQL + " " + " union all ".join(
    f"select model, '{x}_rate' as \"check\", round(avg(cast({x} as int)), 6) as rate from checked group by model" for x in CHECKS))
def agg_model_comparison(spark, d):
    return rounded(ev.model_comparison(ev.model_checks(two_models(spark, d), ["base", "tuned"], KEYS)), "rate")


@query("qa_consistency", b.ctes("chunk_dims", "checked", "planted_errors") + """select 'vectors_match_metadata' as "check",
    count(*) = 0 as passed, count(*) as detail from chunks where chunk_id not in (select chunk_id from chunk_dims)
  union all select 'knowledge_validation_passed', (select count(*) from checked where issues like '%error%') = 0,
    case when (select count(*) from checked where issues like '%error%') = 0 then 0 else 1 end
  union all select 'no_invalid_examples', count(*) = 0, count(*) from planted_errors where errors <> ''
  union all select 'has_chunks', (select count(*) from chunks) > 0, case when (select count(*) from chunks) > 0 then 0 else 1 end
  union all select 'has_labels', (select count(*) from labels) > 0, case when (select count(*) from labels) > 0 then 0 else 1 end
  union all select 'has_drafts', false, 1""")
def qa_consistency(spark, d):
    chunks = staged_chunks(spark, d)
    ents = kg.validate_entities(k.faulty_entities(spark, d), k.source_catalog(spark, d))
    report = kg.validation_report(ents, kg.validate_relations(k.relations(spark, d), k.entities(spark, d)))
    examples = tr.validate_examples(planted(spark, d), *known_ids(spark, d))
    parts = {"chunks": chunks, "labels": b.table(spark, d, "labels"), "drafts": spark.createDataFrame([], "id string")}
    return ev.consistency_checks(b.chunk_vectors(spark, d, chunks), chunks, report, examples, parts)


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("sink_jsonl", b.ctes("chunks") + "select chunk_id, document_id, page, chunk_index, text from chunks")
def sink_jsonl(spark, d):
    at = sinks.scratch_path(spark, "chunks")
    sinks.write_jsonl(b.chunks(spark, d), at)
    return files.read_jsonl(spark, at, "chunk_id string, document_id string, page bigint, chunk_index bigint, text string")


@query("sink_csv", b.ctes("sensors") + "select tag, 'Sheet1' as sheet, row_count, unique_count, family as tag_family_hint from sensors")
def sink_csv(spark, d):
    at = sinks.scratch_path(spark, "summary")
    where = F.struct(F.lit("Sheet1").alias("sheet"))
    sinks.write_csv(b.sensors(spark, d).select("tag", where.alias("at"), "row_count", "unique_count", "tag_family_hint"), at)
    schema = "tag string, sheet string, row_count bigint, unique_count bigint, tag_family_hint string"
    return files.read_csv(spark, at, schema)


@query("src_csv_summary", b.ctes("read5") + """select tag, count(*) as "count", round(avg(value), 6) as mean from read5 group by tag""")
def src_csv_summary(spark, d):
    at = sinks.scratch_path(spark, "stats")
    sinks.write_csv(
        b.read5(spark, d).groupBy("tag").agg(F.count("*").alias("count"), F.round(F.avg("value"), 6).alias("mean")), at
    )
    return files.read_csv(spark, at, "tag string, count bigint, mean double")


@query("src_jsonl", """select event_id, event_type, null as bad from events where event_id % 500 <> 7
  union all select null, null, concat('{broken ', cast(event_id as varchar)) from events where event_id % 500 = 7""")
def src_jsonl(spark, d):
    line = F.when(F.col("event_id") % 500 == 7, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(
        F.to_json(F.struct("event_id", "event_type"))
    )
    blank = F.when(F.col("event_id") % 10 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))
    at = sinks.scratch_path(spark, "lines")
    b.table(spark, d, "events").select(F.explode(blank).alias("value")).write.text(at)
    back = files.read_jsonl(spark, at, "event_id bigint, event_type string", strict=False)
    return back.select("event_id", "event_type", F.col("_corrupt_record").alias("bad"))


@query("src_event_envelope", b.ctes("read5") + "select rid as event_id, tag as sensor_tag, value as peak_value from read5")
def src_event_envelope(spark, d):
    # Files of at most 2000 events each, in the five shapes an event file may have.
    event = F.struct(F.col("rid").alias("event_id"), F.col("tag").alias("sensor_tag"), F.col("value").alias("peak_value"))
    part = F.floor(F.col("rid") / 2000)
    found = b.read5(spark, d).groupBy(part.alias("part")).agg(F.to_json(F.collect_list(event)).alias("list"))
    wrapped = F.coalesce(
        *(F.when(F.col("part") % 5 == i, F.concat(F.lit(f'{{"{key}":'), "list", F.lit("}")))
          for i, key in enumerate(files.EVENT_KEYS)),
        F.col("list"),
    )
    at = sinks.scratch_path(spark, "events")
    found.select("part", wrapped.alias("value")).write.partitionBy("part").text(at)
    return files.read_events(spark, f"{at}/*", "event_id: bigint, sensor_tag: string, peak_value: double")


@query("src_file_digest")
def src_file_digest(spark, d):
    return files.file_digests(files.binary_files(spark, d, "*.parquet"))


SHEETS = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@query("src_multi_table", " union all ".join(
    f"""select '{t}' as sheet, '{t}' as slug, (select count(*) from (describe {t}))::int as columns,
  (select count(*) from {t}) = 0 as is_empty""" for t in SHEETS))
def src_multi_table(spark, d):
    paths = {t: f"{d}/{t}.parquet" for t in SHEETS}
    return tables.persist_sheets(spark, paths, sinks.scratch_path(spark, "sheets"))


@query("sink_vector_index", """select count(*) as vectors, max(len(embedding))::int as dims, 'cosine' as metric from embeddings""")
def sink_vector_index(spark, d):
    found = b.table(spark, d, "embeddings")
    index = vector_index.write_index(found.drop("label"), sinks.scratch_path(spark, "index"), "vec_id", found.select("vec_id", "label"))
    return index.select("vectors", "dims", "metric")


@query("kg_manifest")
def kg_manifest(spark, d):
    """A package of three parts: its files with digests, and the required parts it lacks."""
    at = sinks.scratch_path(spark, "package")
    chunks = staged_chunks(spark, d)
    sinks.write_jsonl(chunks, f"{at}/document_chunks")
    sinks.write_jsonl(links(spark, d, chunks), f"{at}/document_entity_links")
    sinks.write_table(b.chunk_vectors(spark, d, chunks), f"{at}/embeddings")
    manifest = package.package_manifest(spark, at)
    missing = package.missing_artifacts(manifest)
    return manifest.select("artifact", "size_bytes", "sha256", F.lit(True).alias("present")).unionByName(
        missing.select("artifact", F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"),
                       F.lit(False).alias("present"))
    )
