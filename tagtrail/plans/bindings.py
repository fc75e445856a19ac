"""The test tables seen as sensor readings, documents, questions, answers and training examples.

Each binding exists as a DataFrame and as SQL of the same name, used as a common table expression.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagtrail.functions.ids import prefixed_sha1
from tagtrail.operators import documents, knowledge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str) -> str:
    """``with`` clause holding the named bindings and what they need, in order."""
    seen: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    return "with recursive " + ",\n".join(f"{n} as ({SQL[n]})" for n in seen) + "\n"


SQL: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}

# --- readings -------------------------------------------------------------------------------------------------

SQL["read5"] = "select event_type as tag, ts, event_id as rid, value from events"
SQL["read5n"] = (
    "select event_type as tag, ts, event_id as rid, case when event_id % 337 = 0 then null else value end as value "
    "from events"
)
SQL["read150"] = """select concat('75', case user_id % 6 when 0 then 'PDI' when 1 then 'PI' when 2 then 'TI'
  when 3 then 'SI' when 4 then 'XI' else 'ZI' end, cast(800 + user_id as varchar), '.pv') as tag,
  user_id, ts, event_id as rid, value from events"""
SQL["wide"] = """select l_shipdate as ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as quantity,
  l_extendedprice as gross, l_extendedprice * (1 - l_discount) as net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge, l_discount as discount, l_tax as tax,
  l_returnflag as flag from lineitem"""

WIDE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "gross"]
WIDE_SENSORS = ["quantity", "gross", "net", "charge", "discount", "tax"]


def read5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_type as tag", "ts", "event_id as rid", "value")


def read5n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read5(spark, sf_dir).withColumn("value", F.when(F.col("rid") % 337 != 0, F.col("value")))


def read150(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('75', case user_id % 6 when 0 then 'PDI' when 1 then 'PI' when 2 then 'TI' when 3 then 'SI' "
        "when 4 then 'XI' else 'ZI' end, cast(800 + user_id as string), '.pv') as tag",
        "user_id", "ts", "event_id as rid", "value",
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_shipdate as ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity as quantity",
        "l_extendedprice as gross", "l_extendedprice * (1 - l_discount) as net",
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge", "l_discount as discount", "l_tax as tax",
        "l_returnflag as flag",
    )


# --- documents, chunks, tag dictionary --------------------------------------------------------------------------

SQL["doc_pages"] = """select concat('doc_', substring(sha1(source), 1, 16)) as document_id, source as file_name,
  doc_id + 1 as page, doc_id, text from documents"""
SQL["page_text"] = r"""select document_id, file_name, page, doc_id,
  trim(regexp_replace(text, '\s+', ' ', 'g')) as text from doc_pages"""
NEEDS["page_text"] = ["doc_pages"]
SQL["cuts"] = """select doc_id, text, 0 as start_at, 1600 as hard, 0 as idx,
    case when length(text) > 1600 then
      case when position(' ' in reverse(substring(text, 801, 800))) > 0
        then 1600 - position(' ' in reverse(substring(text, 801, 800))) else 1600 end
    else length(text) end as end_at
  from page_text where length(text) > 0
  union all
  select doc_id, text, s, s + 1600, idx + 1,
    case when length(text) > s + 1600 then
      case when position(' ' in reverse(substring(text, s + 801, 800))) > 0
        then s + 1600 - position(' ' in reverse(substring(text, s + 801, 800))) else s + 1600 end
    else length(text) end
  from (select *, greatest(end_at - 250, start_at + 1) as s from cuts where end_at < length(text))"""
NEEDS["cuts"] = ["page_text"]
SQL["chunks"] = """select concat('chunk_', substring(sha1(concat(p.document_id, '|', cast(p.page as varchar), '|',
    cast(c.idx as varchar))), 1, 16)) as chunk_id, p.document_id, p.file_name, p.page, p.doc_id,
    c.idx as chunk_index, count(*) over (partition by p.doc_id) as chunk_count_on_page,
    trim(substring(c.text, c.start_at + 1, c.end_at - c.start_at)) as text
  from cuts c join page_text p on p.doc_id = c.doc_id"""
NEEDS["chunks"] = ["cuts"]
SQL["dict"] = r"""select tag, cast(('0x' || substring(sha1(tag), 1, 6)) as bigint) % 100 as user_id from (
  select distinct lower(t) as tag from
    (select unnest(string_split_regex(text, '[^A-Za-z0-9_.-]+')) as t from benchmark) where t <> '')"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document row is one page of the file named by its source."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.substring(F.sha1("source"), 1, 16)).alias("document_id"),
        F.col("source").alias("file_name"),
        (F.col("doc_id") + 1).alias("page"),
        "doc_id",
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_pages(pages(spark, sf_dir), keep=["doc_id"])


def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark texts play the tags; ``user_id`` ties a tag to readings."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split("text", r"[^A-Za-z0-9_.-]+")).alias("word")
    )
    return (
        words.where(F.col("word") != "")
        .select(F.lower("word").alias("tag"))
        .distinct()
        .withColumn("user_id", F.conv(F.substring(F.sha1("tag"), 1, 6), 16, 10).cast("bigint") % 100)
    )


# --- sensors, entities, events ----------------------------------------------------------------------------------

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SQL["sensors"] = r"""select tag, min(user_id) as user_id,
    nullif(regexp_extract(upper(tag), '\d+(PDI|PI|TI|XI|ZI|SI)', 1), '') as family, count(*) as row_count,
    count(distinct value) as unique_count from read150 group by tag"""
NEEDS["sensors"] = ["read150"]
SQL["detected"] = """select tag as sensor_tag, user_id, event_type, "start", "end", timestamp, peak_timestamp, peak_value,
    peak_robust_z, direction, status, interpretation,
    concat('event_', substring(sha1(concat(event_type, '|', tag, '|', coalesce("start", ''), '|', coalesce("end", ''), '|',
      coalesce(timestamp, ''), '|', coalesce(peak_timestamp, ''))), 1, 16)) as event_id
  from (select tag, user_id,
    case when spike then 'statistical_spike' else 'change_point_candidate' end as event_type,
    case when spike then iso end as "start", case when spike then iso end as "end",
    case when not spike then iso end as timestamp, case when spike then iso end as peak_timestamp,
    case when spike then value end as peak_value, case when spike then round(value / 25, 4) end as peak_robust_z,
    case when spike then 'high_spike' end as direction, 'candidate' as status,
    case when spike then 'outlier needs validation' else 'shift is not proof of a fault' end as interpretation
    from (select *, rid % 4 <> 3 as spike, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso
          from read150 where value >= 100))"""
NEEDS["detected"] = ["read150"]


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of evidence per sensor of ``read150``."""
    from tagtrail.functions.tags import family_by_pattern

    return (
        read150(spark, sf_dir)
        .groupBy("tag")
        .agg(
            F.min("user_id").alias("user_id"), F.count("*").alias("row_count"),
            F.countDistinct("value").alias("unique_count"),
        )
        .withColumn("tag_family_hint", family_by_pattern(F.col("tag")))
        .withColumn("data_type", F.lit("double"))
        .withColumn("missing_fraction", F.lit(0.0))
    )


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High readings of ``read150`` in the shape of detected events, with ids."""
    spike = F.col("rid") % 4 != 3
    iso = F.date_format("ts", ISO)
    events = (
        read150(spark, sf_dir)
        .where(F.col("value") >= 100)
        .select(
            F.col("tag").alias("sensor_tag"), "user_id",
            F.when(spike, "statistical_spike").otherwise("change_point_candidate").alias("event_type"),
            F.when(spike, iso).alias("start"), F.when(spike, iso).alias("end"),
            F.when(~spike, iso).alias("timestamp"), F.when(spike, iso).alias("peak_timestamp"),
            F.when(spike, F.col("value")).alias("peak_value"),
            F.when(spike, F.round(F.col("value") / 25, 4)).alias("peak_robust_z"),
            F.when(spike, "high_spike").alias("direction"), F.lit("candidate").alias("status"),
            F.when(spike, "outlier needs validation").otherwise("shift is not proof of a fault").alias(
                "interpretation"
            ),
        )
    )
    return knowledge.with_event_ids(events)


# Entities named by the tag dictionary: what a chunk can mention.
SQL["dict_entities"] = """select concat('sensor_', substring(sha1(tag), 1, 12)) as entity_id, tag as source_column,
  'Sensor' as candidate_class, cast(null as varchar) as tag_family, 0.4 as confidence, user_id from dict"""
NEEDS["dict_entities"] = ["dict"]
SQL["dict_events"] = """select e.entity_id, d.event_id, d.event_type, d."start", d."end", d.peak_value, d.peak_robust_z,
  d.direction, d.status, d.interpretation from dict_entities e join detected d on d.user_id = e.user_id"""
NEEDS["dict_events"] = ["dict_entities", "detected"]
SQL["mentions"] = r"""select distinct c.chunk_id, d.tag from
  (select chunk_id, unnest(string_split_regex(text, '[^A-Za-z0-9_.-]+')) as t from chunks) c
  join dict d on d.tag = lower(c.t)"""
NEEDS["mentions"] = ["chunks", "dict"]
SQL["mention_edges"] = """select m.chunk_id, e.entity_id from mentions m
  join dict_entities e on lower(e.source_column) = m.tag"""
NEEDS["mention_edges"] = ["mentions", "dict_entities"]


def dict_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_dictionary(spark, sf_dir).select(
        prefixed_sha1("sensor_", F.col("tag"), 12).alias("entity_id"), F.col("tag").alias("source_column"),
        F.lit("Sensor").alias("candidate_class"), F.lit(None).cast("string").alias("tag_family"),
        F.lit(0.4).alias("confidence"), "user_id",
    )


def dict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected events tied to dictionary entities."""
    return detected(spark, sf_dir).drop("sensor_tag").join(
        dict_entities(spark, sf_dir).select("entity_id", "user_id"), "user_id"
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.mentions(chunks(spark, sf_dir), tag_dictionary(spark, sf_dir))


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.mention_edges(mentions(spark, sf_dir), dict_entities(spark, sf_dir))


# --- questions, hits, answers, examples -------------------------------------------------------------------------

SQL["questions"] = """select item_id as question_id, concat(text, case item_id % 8
  when 0 then ' recent pressure values' when 1 then ' which sensor spike happened'
  when 2 then ' compare 75PI801.pv and 75TI802.pv' when 3 then ' manual section'
  when 4 then ' trend before the fault' when 5 then ' bearing temperature' when 6 then ' statistical_spike'
  else ' latest measurement of 75ZI805.pv' end) as question from benchmark"""
# The stand-in encoder: counts of hashed words, at unit length, in single precision.
DIMS = 64


def _dims_sql(keys: str, text: str, table: str) -> str:
    return f"""select *, (n / sqrt(sum(n * n) over (partition by {keys})))::float::double as v from (
  select {keys}, cast(concat('0x', substring(sha1(w), 1, 4)) as bigint) % {DIMS} as dim, count(*)::double as n
  from (select {keys}, unnest(string_split({text}, ' ')) as w from {table}) where w <> '' group by all)"""


SQL["question_dims"] = _dims_sql("question_id", "question", "questions")
NEEDS["question_dims"] = ["questions"]
SQL["chunk_dims"] = _dims_sql("chunk_id, doc_id", "text", "chunks")
NEEDS["chunk_dims"] = ["chunks"]
SQL["hits"] = """select question_id, chunk_id, doc_id, rank, score from (
  select question_id, chunk_id, doc_id, score,
    row_number() over (partition by question_id order by score desc, chunk_id) as rank
  from (select q.question_id, c.chunk_id, c.doc_id,
      round(sum(q.v * c.v), 9) as score
    from question_dims q join chunk_dims c on c.dim = q.dim group by 1, 2, 3)) where rank <= 8"""
NEEDS["hits"] = ["question_dims", "chunk_dims"]
SQL["examples"] = """select concat('ex_', cast(doc_id as varchar)) as id, concat('Summarise the ', lang, ' passage') as
  instruction, text as response, source as task_type, case when n_chars > 2000 then 'hard' else 'standard' end as
  difficulty from documents"""
SQL["answers"] = """select conv_id, turn, concat('Answer: ', text, case turn % 4 when 1 then
  concat(' Evidence: [ENTITY:e', cast(conv_id % 5 as varchar), '] [DOC:src1 p.2 chunk:c', cast(conv_id % 3 as varchar),
  ']') else ' Evidence: [EVENT:x1] [TS:SUMMARY:a] [EVENT:x1]' end, case when conv_id % 2 = 0
  then ' Uncertainty: evidence is insufficient.' else ' ASSESSMENT: bearing failure' end) as answer
  from conversations where role = 'assistant'"""
# What each answer was shown: some of the cited ids are among them.
SQL["shown"] = """select conv_id, unnest([concat('ENTITY:e', cast(conv_id % 4 as varchar)),
  concat('DOC:src1 p.2 chunk:c', cast(conv_id % 2 as varchar)), concat('EVENT:x', cast(conv_id % 2 as varchar))]) as key
  from (select distinct conv_id from conversations where role = 'assistant')"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [
        " recent pressure values", " which sensor spike happened", " compare 75PI801.pv and 75TI802.pv",
        " manual section", " trend before the fault", " bearing temperature", " statistical_spike",
        " latest measurement of 75ZI805.pv",
    ]
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.concat("text", F.array(*map(F.lit, ends))[(F.col("item_id") % 8).cast("int")]).alias("question"),
    )


@functools.lru_cache(maxsize=1 << 16)
def _dim(word: str) -> int:
    return int(hashlib.sha1(word.encode()).hexdigest()[:4], 16) % DIMS


def hashed_words(texts: pd.Series) -> np.ndarray:
    """Counts of hashed words: a stand-in for a sentence encoder that SQL can follow."""
    found = np.zeros((len(texts), DIMS))
    for row, text in enumerate(texts):
        dims = np.fromiter(map(_dim, filter(None, text.split(" "))), dtype=np.int64)
        found[row] = np.bincount(dims, minlength=DIMS)
    return found


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded questions."""
    from tagtrail.operators.retrieval import encode_chunks

    named = questions(spark, sf_dir).select(F.col("question_id").alias("chunk_id"), F.col("question").alias("text"))
    return encode_chunks(named, hashed_words).withColumnRenamed("chunk_id", "question_id")


def chunk_vectors(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Every chunk, encoded."""
    from tagtrail.operators.retrieval import encode_chunks

    return encode_chunks(chunks(spark, sf_dir) if found is None else found, hashed_words, keep=["doc_id"])


def hits(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    from tagtrail.operators.retrieval import top_k_chunks

    return top_k_chunks(question_vectors(spark, sf_dir), chunk_vectors(spark, sf_dir), k)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("ex_"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("Summarise the "), F.col("lang"), F.lit(" passage")).alias("instruction"),
        F.col("text").alias("response"),
        F.col("source").alias("task_type"),
        F.when(F.col("n_chars") > 2000, "hard").otherwise("standard").alias("difficulty"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn",
        F.concat(
            F.lit("Answer: "), F.col("text"),
            F.when(
                F.col("turn") % 4 == 1,
                F.concat(
                    F.lit(" Evidence: [ENTITY:e"), (conv % 5).cast("string"), F.lit("] [DOC:src1 p.2 chunk:c"),
                    (conv % 3).cast("string"), F.lit("]"),
                ),
            ).otherwise(" Evidence: [EVENT:x1] [TS:SUMMARY:a] [EVENT:x1]"),
            F.when(conv % 2 == 0, " Uncertainty: evidence is insufficient.").otherwise(
                " ASSESSMENT: bearing failure"
            ),
        ).alias("answer"),
    )


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    keys = F.array(
        F.concat(F.lit("ENTITY:e"), (conv % 4).cast("string")),
        F.concat(F.lit("DOC:src1 p.2 chunk:c"), (conv % 2).cast("string")),
        F.concat(F.lit("EVENT:x"), (conv % 2).cast("string")),
    )
    return (
        table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id").distinct()
        .select("conv_id", F.explode(keys).alias("key"))
    )
