"""SQL of the fill-in-the-middle transformation and of the URL filter."""

MIDDLE_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents
), cut as (
  select doc_id, t, n, cast('0x' || substr(d, 17, 8) as ubigint) % 100 as h3, cast('0x' || substr(d, 25, 8) as ubigint) % 100 as h4,
    cast(least(cast('0x' || substr(d, 1, 8) as ubigint) % (n + 1), cast('0x' || substr(d, 9, 8) as ubigint) % (n + 1)) as bigint) as a,
    cast(greatest(cast('0x' || substr(d, 1, 8) as ubigint) % (n + 1), cast('0x' || substr(d, 9, 8) as ubigint) % (n + 1)) as bigint) as b
  from drawn
), formed as (
  select *, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form,
    substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s
  from cut
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from formed
"""

URL_SQL = r"""
with rules(rule_host, rule_path, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parsed as (
  select page_id, url, html, row_number() over () as nth,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) as params
  from pages
), named as (
  select *, case when contains(url, '://') then regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as canonical
  from parsed
), firsts as (
  select html, min(page_id) as first_id from pages where html <> '' group by html having count(*) > 1
), listed as (
  select distinct canonical from named join firsts using (html) where canonical is not null and (page_id > first_id or page_id is null)
), fitting as (
  select nth, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path) * 1000 + length(rule_host)) as best
  from named join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by nth
)
select page_id, host, path, best.rule as rule,
  coalesce(best.verdict, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict
from named left join fitting using (nth)
"""
