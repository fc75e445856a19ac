"""Registered queries over sensor readings: scans, profiles, events, trends, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions.tags import FAMILIES, family_by_pattern, family_by_pattern_or_prefix, family_by_substring
from tagtrail.operators import correlation, profile, timeseries as ts
from tagtrail.plans import bindings as b
from tagtrail.plans.registry import query
from tagtrail.sources import tables

US = "cast(date_diff('microsecond', {0}, {1}) as bigint)"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def robust_sql(source: str) -> str:
    return f"""med as (select tag, quantile_cont(value, 0.5) as median from {source} where value is not null group by tag),
mad as (select r.tag, quantile_cont(abs(r.value - m.median), 0.5) as mad from {source} r join med m on m.tag = r.tag
  where r.value is not null group by r.tag),
z as (select r.tag, r.ts, r.rid, r.value, row_number() over (partition by r.tag order by r.ts, r.rid) as pos,
  case when a.mad is null or a.mad = 0 then 0.0 else 0.6745 * (r.value - m.median) / a.mad end as robust_z
  from {source} r left join med m on m.tag = r.tag left join mad a on a.tag = r.tag)"""


def spikes_sql(threshold: float) -> str:
    return f"""hit as (select *, pos - row_number() over (partition by tag order by pos) as island from z
  where abs(robust_z) >= {threshold}),
spikes as (select 'statistical_spike' as event_type, tag as sensor_tag, min(ts) as "start", max(ts) as "end",
  arg_max(ts, (abs(robust_z), -pos)) as peak_timestamp, arg_max(value, (abs(robust_z), -pos)) as peak_value,
  arg_max(robust_z, (abs(robust_z), -pos)) as peak_robust_z, count(*) as sample_count from hit group by tag, island)"""


def changes_sql(source: str, threshold: float) -> str:
    return f"""roll as (select tag, ts, rid, value,
  case when count(value) over w = 96 then avg(value) over w end as rolling_mean,
  case when count(value) over w = 96 then stddev_samp(value) over w end as rolling_std
  from {source} window w as (partition by tag order by ts, rid rows between 95 preceding and current row)),
score as (select *, abs(rolling_mean - lag(rolling_mean, 96) over (partition by tag order by ts, rid))
  / nullif(rolling_std, 0) as change_score from roll),
changes as (select tag as sensor_tag, ts as timestamp, change_score from (
  select *, row_number() over (partition by tag order by change_score desc, ts, rid) as strength from score
  where change_score >= {threshold}) where strength <= 20)"""


def trends_sql(source: str) -> str:
    return f"""v as (select tag, value, row_number() over (partition by tag order by ts, rid) as a,
  row_number() over (partition by tag order by ts desc, rid desc) as d from {source} where value is not null),
ends as (select tag, count(*) as valid, stddev_samp(value) as std, avg(case when a <= 96 then value end) as s,
  avg(case when d <= 96 then value end) as e from v group by tag),
trends as (select tag, case when valid < 192 then 'insufficient_data'
    when (case when std > 1e-12 then abs(e - s) / std else 0 end) < 1 then 'stable'
    when e > s then 'rising' else 'falling' end as label,
  case when valid >= 192 then s end as start_mean, case when valid >= 192 then e end as end_mean,
  case when valid >= 192 then e - s end as difference,
  case when valid >= 192 then case when std > 1e-12 then abs(e - s) / std else 0 end end as normalized_change
  from ends)"""


# --- scans and projections ----------------------------------------------------------------------------------------


@query("src_sensor_wide", """select cast(l_shipdate as timestamp) as ts, l_quantity as quantity, l_tax as tax
  from lineitem where l_shipdate is not null""")
def src_sensor_wide(spark, d):
    raw = b.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("string").alias("Timestamp"), F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"),
    )
    return tables.sensor_table(raw, on_bad_ts="drop").withColumnRenamed("Timestamp", "ts")


@query("prj_numeric_columns", """select count(*) as rows, sum(l_orderkey)::bigint as l_orderkey, round(sum(l_quantity), 2)
  as l_quantity, round(sum(l_extendedprice), 2) as l_extendedprice, round(sum(l_discount), 2) as l_discount,
  round(sum(l_tax), 2) as l_tax, sum(l_partkey)::bigint as l_partkey, sum(l_suppkey)::bigint as l_suppkey,
  sum(l_linenumber)::bigint as l_linenumber from lineitem""")
def prj_numeric_columns(spark, d):
    df = b.table(spark, d, "lineitem")
    sums = [
        (F.round(F.sum(c), 2) if dict(df.dtypes)[c] == "double" else F.sum(c)).alias(c)
        for c in profile.numeric_columns(df)
    ]
    return df.agg(F.count("*").alias("rows"), *sums)


@query("prj_unpivot", b.ctes("wide") + " select ts, l_orderkey, l_linenumber, l_partkey, tag, round(value, 6) as value "
       "from (select * from wide) unpivot include nulls (value for tag in (quantity, gross, net, charge, discount, tax))")
def prj_unpivot(spark, d):
    ids = ["ts", "l_orderkey", "l_linenumber", "l_partkey"]
    return rounded(profile.unpivot_sensors(b.wide(spark, d), ids, b.WIDE_SENSORS), "value")


@query("prj_to_numeric", r"""select event_id, try_cast(regexp_extract(props, '(\d+|a)\}', 1) as double) as number,
  try_cast(event_type as double) as bad, case when event_id % 3 = 0 then null else value end as finite from events""")
def prj_to_numeric(spark, d):
    return b.table(spark, d, "events").select(
        "event_id",
        profile.to_number(F.regexp_extract("props", r"(\d+|a)\}", 1)).alias("number"),
        profile.to_number(F.col("event_type")).alias("bad"),
        profile.to_number(F.when(F.col("event_id") % 3 == 0, "NaN").otherwise(F.col("value").cast("string"))).alias(
            "finite"
        ),
    )


FAMILY_NAMES = b.ctes("read150") + """, names as (select distinct tag from read150 union select 'Timestamp'
  union select distinct concat(upper(event_type), '_zi') from events)"""


@query("prj_tag_family", FAMILY_NAMES + r"""select tag,
  coalesce(nullif(regexp_extract(upper(tag), '\d+(PDI|PI|TI|XI|ZI|SI)', 1), ''), case
    when starts_with(upper(tag), 'PDI') then 'PDI' when starts_with(upper(tag), 'PI') then 'PI'
    when starts_with(upper(tag), 'TI') then 'TI' when starts_with(upper(tag), 'XI') then 'XI'
    when starts_with(upper(tag), 'ZI') then 'ZI' when starts_with(upper(tag), 'SI') then 'SI' end) as by_prefix,
  nullif(regexp_extract(upper(tag), '\d+(PDI|PI|TI|XI|ZI|SI)', 1), '') as by_pattern,
  case when contains(upper(tag), 'PDI') then 'PDI' when contains(upper(tag), 'PI') then 'PI'
    when contains(upper(tag), 'TI') then 'TI' when contains(upper(tag), 'XI') then 'XI'
    when contains(upper(tag), 'ZI') then 'ZI' when contains(upper(tag), 'SI') then 'SI' end as by_substring
  from names""")
def prj_tag_family(spark, d):
    names = (
        b.read150(spark, d).select("tag")
        .union(b.table(spark, d, "events").select(F.concat(F.upper("event_type"), F.lit("_zi"))))
        .union(spark.range(1).select(F.lit("Timestamp")))
        .distinct()
    )
    tag = F.col("tag")
    return names.select(
        "tag", family_by_pattern_or_prefix(tag).alias("by_prefix"), family_by_pattern(tag).alias("by_pattern"),
        family_by_substring(tag).alias("by_substring"),
    )


# --- profiles -----------------------------------------------------------------------------------------------------

SHEET_COLUMNS = ["ts", "quantity", "gross", "discount", "tax", "flag", "note"]
SHEET_SQL = """sheet as (select ts, quantity, gross, discount, tax, flag,
    case when l_orderkey % 7 = 0 then null else concat('k', cast(l_orderkey % 11 as varchar)) end as note,
    l_orderkey, l_linenumber, l_partkey, l_suppkey from wide),
cells as (select "column", cell, o from (select concat_ws('|', strftime(ts, '%Y%m%d'), lpad(cast(l_orderkey as varchar), 12, '0'),
    lpad(cast(l_linenumber as varchar), 6, '0'), lpad(cast(l_partkey as varchar), 12, '0'),
    lpad(cast(l_suppkey as varchar), 12, '0'), lpad(cast(cast(round(gross * 100) as bigint) as varchar), 14, '0')) as o,
    strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, cast(quantity as varchar) as quantity, cast(gross as varchar) as gross,
    cast(discount as varchar) as discount, cast(tax as varchar) as tax, flag, note from sheet)
  unpivot include nulls (cell for "column" in (ts, quantity, gross, discount, tax, flag, note))),
prof as (select "column", count(*) as rows, count(*) - count(cell) as missing_count,
    (count(*) - count(cell)) / count(*) as missing_fraction, count(distinct cell) as unique_count from cells group by 1),
samp as (select "column", string_agg(cell, ';' order by n) as samples from (select *, row_number() over
    (partition by "column" order by o) as n from cells where cell is not null) where n <= 5 group by 1),
colprof as (select p."column", case p."column" when 'ts' then 'timestamp_ntz' when 'flag' then 'string'
    when 'note' then 'string' else 'double' end as dtype,
    p."column" in ('quantity', 'gross', 'discount', 'tax') as is_numeric, missing_count, missing_fraction, unique_count,
    samples, cast(null as varchar) as tag_family_hint, rows from prof p join samp s on s."column" = p."column")"""
WIDE_SHEET = b.ctes("wide").rstrip() + ",\n" + SHEET_SQL


def sheet(spark, d):
    note = F.when(F.col("l_orderkey") % 7 != 0, F.concat(F.lit("k"), (F.col("l_orderkey") % 11).cast("string")))
    return b.wide(spark, d).withColumn("note", note)


def sheet_columns(spark, d):
    return profile.column_profile(sheet(spark, d), b.WIDE_ORDER, SHEET_COLUMNS)


@query("agg_column_profile", WIDE_SHEET + """ select "column", dtype, is_numeric, missing_count,
  round(missing_fraction, 6) as missing_fraction, unique_count, samples, tag_family_hint from colprof""")
def agg_column_profile(spark, d):
    out = sheet_columns(spark, d).withColumn("samples", F.array_join("sample_values", ";"))
    return rounded(out, "missing_fraction").drop("sample_values", "rows")


@query("prj_timestamp_candidates", """select distinct k as "column" from (
  select unnest(json_keys(replace(props, '"k"', '" Time "'))) as k from events) where lower(trim(k)) in
  ('timestamp', 'time', 'datetime', 'date')""")
def prj_timestamp_candidates(spark, d):
    keys = b.table(spark, d, "events").select(
        F.explode(F.json_object_keys(F.replace("props", F.lit('"k"'), F.lit('" Time "')))).alias("column")
    )
    return profile.timestamp_candidates(keys.distinct())


@query("agg_sheet_profile", WIDE_SHEET + """ select max(rows) as rows, count(*) as columns,
  count(*) filter (is_numeric) as numeric_column_count, count(*) filter (not is_numeric) as non_numeric_column_count,
  sum(missing_count)::bigint as total_missing_cells from colprof""")
def agg_sheet_profile(spark, d):
    return profile.sheet_profile(sheet_columns(spark, d))


STATS = "min max mean std median q01 q99".split()
STATS_SQL = ", ".join(
    f"round({e}, 7) as {n}"
    for n, e in {
        "min": "min(value)", "max": "max(value)", "mean": "avg(value)", "std": "stddev_samp(value)",
        "median": "quantile_cont(value, 0.5)", "q01": "quantile_cont(value, 0.01)", "q99": "quantile_cont(value, 0.99)",
    }.items()
)


@query("agg_numeric_profile", b.ctes("read5n") + f"select tag, {STATS_SQL} from read5n group by tag")
def agg_numeric_profile(spark, d):
    return rounded(profile.numeric_profile(b.read5n(spark, d)), *STATS, digits=7)


@query("agg_sensor_profile", WIDE_SHEET + f""", long as (select tag, value from (select quantity, gross, discount, tax
    from sheet) unpivot include nulls (value for tag in (quantity, gross, discount, tax))),
  st as (select tag, {STATS_SQL} from long group by tag)
  select p."column" as tag, tag_family_hint, dtype, missing_count, round(missing_fraction, 7) as missing_fraction,
    unique_count, min, max, mean, std, median, q01, q99 from colprof p join st on st.tag = p."column" """)
def agg_sensor_profile(spark, d):
    df = sheet(spark, d)
    long = profile.unpivot_sensors(df, [], ["quantity", "gross", "discount", "tax"])
    flat = profile.sensor_profile(sheet_columns(spark, d), profile.numeric_profile(long))
    return rounded(flat, "missing_fraction", *STATS, digits=7)


@query("agg_sensor_evidence", b.ctes("read150") + f"""select r.tag,
  nullif(regexp_extract(upper(r.tag), '\\d+(PDI|PI|TI|XI|ZI|SI)', 1), '') as tag_family_hint, count(*) as row_count,
  count(*) - count(value) as missing_count, round((count(*) - count(value)) / count(*), 8) as missing_fraction,
  count(distinct value) as unique_count, any_value(s.samples) as samples, {STATS_SQL.replace(", 7)", ", 8)")},
  round(case when abs(avg(value)) > 1e-12 then stddev_samp(value) / abs(avg(value)) end, 8) as relative_std
  from (select tag, ts, rid, case when rid % 101 = 0 then null else value end as value from read150) r left join (select tag,
    string_agg(cast(cast(value * 100 as bigint) as varchar), ';' order by n) as samples from (select *,
    row_number() over (partition by tag order by ts, rid) as n from read150 where rid % 101 <> 0) where n <= 5 group by tag) s
  on s.tag = r.tag group by r.tag""")
def agg_sensor_evidence(spark, d):
    r = b.read150(spark, d).withColumn("value", F.when(F.col("rid") % 101 != 0, F.col("value")))
    out = profile.sensor_evidence(r)
    cents = F.transform("sample_values", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    out = out.withColumn("samples", F.array_join(cents, ";")).drop("sample_values", "data_type", "numeric")
    return rounded(out, "missing_fraction", "relative_std", *STATS, digits=8)


@query("agg_family_counts", b.ctes("read150") + r"""select coalesce(nullif(regexp_extract(upper(tag),
  '\d+(PDI|PI|TI|XI|ZI|SI)', 1), ''), 'UNKNOWN') as family, count(*) as sensors from
  (select distinct tag from read150 union select distinct event_type from events) group by 1""")
def agg_family_counts(spark, d):
    names = b.read150(spark, d).select("tag").union(b.read5(spark, d).select("tag")).distinct()
    return profile.family_counts(names.select("tag", family_by_pattern(F.col("tag")).alias("tag_family_hint")))


STAMPS_SQL = """stamps as (select case when l_orderkey % 97 = 0 then 'not a time' else strftime(l_shipdate,
  '%Y-%m-%d %H:%M:%S') end as stamp from lineitem),
parsed as (select try_cast(stamp as timestamp) as ts from stamps),
gaps as (select date_diff('microsecond', lag(ts) over (order by ts), ts) as us from parsed where ts is not null),
cnt as (select us, count(*) as n from gaps where us is not null group by us)"""


def stamps(spark, d):
    text = F.when(F.col("l_orderkey") % 97 == 0, "not a time").otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    )
    return b.table(spark, d, "lineitem").select(text.alias("stamp"))


@query("agg_timestamp_profile", "with " + STAMPS_SQL + """ select (select count(*) - count(ts) from parsed) as parse_failures,
  (select count(*) - count(distinct ts) - max(case when ts is null then 1 else 0 end) from parsed) as duplicate_timestamps,
  (select min(ts) from parsed) as min_ts, (select max(ts) from parsed) as max_ts,
  (select us from cnt order by n desc, us limit 1) as most_common_us, (select max(n) from cnt) as most_common_count,
  (select count(*) from cnt) as unique_intervals, (select max(us) from cnt) as largest_us,
  (select min(us) from cnt) as smallest_us""")
def agg_timestamp_profile(spark, d):
    return profile.timestamp_profile(stamps(spark, d), "stamp")


GAPS_SQL = """gaps as (select tag, date_diff('microsecond', lag(ts) over (partition by tag order by ts), ts) as us
  from (select tag, date_trunc('minute', ts) as ts from read5)),
cnt as (select tag, us, count(*) as n from gaps where us is not null group by tag, us)"""


def minute_gaps(spark, d):
    r = b.read5(spark, d).select("tag", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))
    return profile.intervals(r, ["tag"])


@query("win_sampling_intervals", b.ctes("read5").rstrip() + ", " + GAPS_SQL + """ select tag,
  arg_max(us, (n, -us)) as most_common_us, max(n) as most_common_count, count(*) as unique_intervals,
  max(us) as largest_us, min(us) as smallest_us from cnt group by tag""")
def win_sampling_intervals(spark, d):
    return profile.sampling(minute_gaps(spark, d), ["tag"])


@query("topk_intervals", b.ctes("read5").rstrip() + ", " + GAPS_SQL + """ select tag, us as interval_us, n, place from (
  select *, row_number() over (partition by tag order by n desc, us) as place from cnt) where place <= 5""")
def topk_intervals(spark, d):
    return profile.top_intervals(minute_gaps(spark, d), ["tag"])


@query("agg_dataset_extent", b.ctes("read150") + """select count(*) as rows, count(distinct tag) as sensors,
  min(ts) as "start", max(ts) as "end" from read150""")
def agg_dataset_extent(spark, d):
    return ts.dataset_extent(b.read150(spark, d))


# --- events and trends --------------------------------------------------------------------------------------------


@query("win_robust_zscore", b.ctes("read5n").rstrip() + ", " + robust_sql("read5n") + """ select tag, rid,
  round(robust_z, 6) as robust_z from z""")
def win_robust_zscore(spark, d):
    return rounded(ts.robust_zscore(b.read5n(spark, d)), "robust_z").select("tag", "rid", "robust_z")


SPIKE_COLUMNS = ["event_type", "sensor_tag", "start", "end", "peak_timestamp", "peak_value", "peak_robust_z",
                 "direction", "sample_count"]
SPIKE_SELECT = """ select event_type, sensor_tag, "start", "end", peak_timestamp, round(peak_value, 6) as peak_value,
  round(peak_robust_z, 6) as peak_robust_z, case when peak_robust_z > 0 then 'high_spike' else 'low_spike' end
  as direction, sample_count from spikes"""


def flagship(spark, d):
    found = ts.spike_events(ts.positioned(b.read5(spark, d)), threshold=2.0)
    return rounded(found, "peak_value", "peak_robust_z").select(*SPIKE_COLUMNS)


query("win_spike_events", b.ctes("read5").rstrip() + ", " + robust_sql("read5") + ", " + spikes_sql(2.0) + SPIKE_SELECT)(
    flagship
)


@query("win_spike_events_strict", b.ctes("read5n").rstrip() + ", " + robust_sql("read5n") + ", " + spikes_sql(6.0)
       + SPIKE_SELECT)
def win_spike_events_strict(spark, d):
    found = ts.spike_events(ts.positioned(b.read5n(spark, d)))
    return rounded(found, "peak_value", "peak_robust_z").select(*SPIKE_COLUMNS)


@query("win_rolling_stats", b.ctes("read5n").rstrip() + ", " + changes_sql("read5n", 0.4) + """ select tag, rid,
  round(rolling_mean, 8) as rolling_mean, round(rolling_std, 8) as rolling_std from roll""")
def win_rolling_stats(spark, d):
    out = ts.rolling_stats(ts.positioned(b.read5n(spark, d)))
    return rounded(out, "rolling_mean", "rolling_std", digits=8).select("tag", "rid", "rolling_mean", "rolling_std")


@query("win_change_points", b.ctes("read5n").rstrip() + ", " + changes_sql("read5n", 0.4) + """ select sensor_tag,
  timestamp, round(change_score, 6) as change_score from changes""")
def win_change_points(spark, d):
    out = ts.change_points(ts.positioned(b.read5n(spark, d)), threshold=0.4)
    return rounded(out, "change_score").select("sensor_tag", "timestamp", "change_score")


TREND_NUMBERS = ["start_mean", "end_mean", "difference", "normalized_change"]


@query("win_trend", b.ctes("read5n").rstrip() + ", " + trends_sql("read5n") + " select tag, label, "
       + ", ".join(f"round({c}, 8) as {c}" for c in TREND_NUMBERS) + " from trends")
def win_trend(spark, d):
    return rounded(ts.trends(b.read5n(spark, d)), *TREND_NUMBERS, digits=8)


@query("agg_sensor_summary", b.ctes("read5n").rstrip() + ", " + robust_sql("read5n") + ", " + spikes_sql(2.0) + ", "
       + changes_sql("read5n", 0.4) + ", " + trends_sql("read5n") + """ select r.tag,
  case when contains(upper(r.tag), 'PDI') then 'PDI' when contains(upper(r.tag), 'PI') then 'PI'
    when contains(upper(r.tag), 'TI') then 'TI' when contains(upper(r.tag), 'XI') then 'XI'
    when contains(upper(r.tag), 'ZI') then 'ZI' when contains(upper(r.tag), 'SI') then 'SI' end as tag_family,
  count(*) as "count", count(value) as valid_count, count(*) - count(value) as missing_count,
  round((count(*) - count(value)) / count(*), 8) as missing_fraction, round(min(value), 8) as min,
  round(max(value), 8) as max, round(avg(value), 8) as mean, round(stddev_samp(value), 8) as std,
  round(quantile_cont(value, 0.5), 8) as median, any_value(t.label) as trend_label,
  """ + ", ".join(f"round(any_value(t.{c}), 8) as {c}" for c in TREND_NUMBERS) + """,
  (select count(*) from spikes s where s.sensor_tag = r.tag) as spike_event_count,
  (select count(*) from changes c where c.sensor_tag = r.tag) as change_point_candidate_count
  from read5n r left join trends t on t.tag = r.tag group by r.tag""")
def agg_sensor_summary(spark, d):
    out = ts.sensor_summary(b.read5n(spark, d), spike_z=2.0, change_score=0.4)
    return rounded(out, "missing_fraction", "min", "max", "mean", "std", "median", *TREND_NUMBERS, digits=8)


@query("set_union_events", b.ctes("read5n").rstrip() + ", " + robust_sql("read5n") + ", " + spikes_sql(6.0) + ", "
       + changes_sql("read5n", 0.4) + """ select event_type, sensor_tag, "start", "end", peak_timestamp,
  round(peak_value, 6) as peak_value, sample_count, cast(null as timestamp) as timestamp,
  cast(null as double) as change_score from spikes union all
  select 'change_point_candidate', sensor_tag, null, null, null, null, null, timestamp, round(change_score, 6)
  from changes""")
def set_union_events(spark, d):
    out = ts.all_events(ts.positioned(b.read5n(spark, d)), change_score=0.4)
    return rounded(out, "peak_value", "change_score").select(
        "event_type", "sensor_tag", "start", "end", "peak_timestamp", "peak_value", "sample_count", "timestamp",
        "change_score",
    )


@query("win_recent_values", b.ctes("read5n") + """select tag, ts, rid, value, recency from (select *, row_number() over
  (partition by tag order by ts desc, rid desc) as recency from read5n) where recency <= 200""")
def win_recent_values(spark, d):
    return ts.recent_values(b.read5n(spark, d), 200)


@query("win_trend_points", b.ctes("read5n") + """select tag, ts, rid, value, recency from (select *, row_number() over
  (partition by tag order by ts desc, rid desc) as recency from read5n) where recency <= 500 and value is not null""")
def win_trend_points(spark, d):
    return ts.trend_points(b.read5n(spark, d), 500)


@query("agg_sensor_stats_pop", b.ctes("read5n") + """select tag, count(value) as rows, round(min(value), 6) as min,
  round(max(value), 6) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
  round(quantile_cont(value, 0.5), 6) as median, (select min(ts) from read5n) as first_timestamp,
  (select max(ts) from read5n) as last_timestamp from read5n where value is not null group by tag""")
def agg_sensor_stats_pop(spark, d):
    return rounded(ts.tool_summary(b.read5n(spark, d)), "min", "max", "mean", "std", "median")


@query("flt_sensor_events", b.ctes("detected") + """select lower(sensor_tag) as sensor_key, event_id, event_type, "start",
  timestamp, recency from (select *, row_number() over (partition by lower(sensor_tag)
  order by coalesce("start", timestamp, '') desc, event_id) as recency from detected) where recency <= 3""")
def flt_sensor_events(spark, d):
    # Every third event names its sensor under another alias.
    other = F.col("user_id") % 3 == 0
    events = b.detected(spark, d).withColumns(
        {"source_column": F.when(other, F.upper("sensor_tag")), "sensor_tag": F.when(~other, F.col("sensor_tag"))}
    )
    return ts.sensor_events(events, 3).select("sensor_key", "event_id", "event_type", "start", "timestamp", "recency")


# --- correlation --------------------------------------------------------------------------------------------------

PAIRS = [(x, y) for i, x in enumerate(b.WIDE_SENSORS) for y in b.WIDE_SENSORS[i + 1 :]]
PAIR_SQL = " union all ".join(
    f"select '{x}' as sensor_a, '{y}' as sensor_b, corr({x}, {y}) as correlation from wide" for x, y in PAIRS
)


@query("agg_correlated_pairs", b.ctes("wide") + f"""select sensor_a, sensor_b, round(correlation, 6) as correlation,
  round(abs(correlation), 6) as absolute_correlation from ({PAIR_SQL}) where abs(correlation) >= 0.8""")
def agg_correlated_pairs(spark, d):
    found = correlation.correlated_pairs(b.wide(spark, d), b.WIDE_SENSORS)
    return rounded(found, "correlation", "absolute_correlation")


@query("topk_pairs", b.ctes("wide") + f"""select sensor_a, sensor_b, round(correlation, 6) as correlation,
  row_number() over (order by round(abs(correlation), 9) desc, sensor_a, sensor_b) as place from ({PAIR_SQL})
  qualify place <= 5""")
def topk_pairs(spark, d):
    return correlation.strongest_pairs(b.wide(spark, d), b.WIDE_SENSORS, 5)



HOUR_SQL = "hourly as (select date_trunc('hour', ts) as ts, tag, avg(value) as value from read5 group by 1, 2)"


@query("join_sensor_pairs", b.ctes("read5").rstrip() + ", " + HOUR_SQL + """ select a.tag as sensor_a, b.tag as sensor_b,
  count(*) as n, round(corr(a.value, b.value), 6) as correlation from hourly a join hourly b on a.ts = b.ts and
  a.tag < b.tag group by 1, 2""")
def join_sensor_pairs(spark, d):
    return rounded(correlation.sensor_pair_correlations(b.read5(spark, d), "hour"), "correlation")


@query("join_sensor_pairs_many", b.ctes("read150").rstrip() + """, daily as (select date_trunc('day', ts) as ts, tag,
  avg(value) as value from read150 group by 1, 2) select a.tag as sensor_a, b.tag as sensor_b, count(*) as n,
  round(case when isnan(corr(a.value, b.value)) then null else corr(a.value, b.value) end, 6) as correlation
  from daily a join daily b on a.ts = b.ts and a.tag < b.tag group by 1, 2""")
def join_sensor_pairs_many(spark, d):
    return rounded(correlation.sensor_pair_correlations(b.read150(spark, d), "day"), "correlation")


@query("join_correlated_sensors", b.ctes("read150").rstrip() + """, daily as (select date_trunc('day', ts) as ts, tag,
  avg(value) as value from read150 group by 1, 2) select * from (select a.tag as sensor_a, b.tag as sensor_b, count(*) as n,
  round(corr(a.value, b.value), 6) as correlation from daily a join daily b on a.ts = b.ts and a.tag < b.tag group by 1, 2)
  where not isnan(correlation) and abs(correlation) >= 0.5""")
def join_correlated_sensors(spark, d):
    return rounded(correlation.correlated_sensor_pairs(b.read150(spark, d), "day", 0.5), "correlation")


@query("agg_compare_sensors", b.ctes("wide") + """, last as (select ts, gross as x, case when l_orderkey % 5 = 0 then null
  else net end as y from wide order by ts desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, gross desc limit 500)
  select 'gross' as sensor_a, 'net' as sensor_b, count(*) filter (x is not null and y is not null) as rows_analyzed,
  round(corr(x, y), 6) as pearson_correlation, min(ts) as "start", max(ts) as "end",
  'Correlation does not establish causation.' as warning from last""")
def agg_compare_sensors(spark, d):
    wide = b.wide(spark, d).withColumn("net", F.when(F.col("l_orderkey") % 5 != 0, F.col("net")))
    return rounded(correlation.compare_sensors(wide, "gross", "net", 500, b.WIDE_ORDER), "pearson_correlation")
