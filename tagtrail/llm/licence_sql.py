"""The licence scan as one DuckDB statement over ``documents``, without anchors: every piece of every text is compared."""

from __future__ import annotations

from tagtrail.llm.licences import LIKE, TEMPLATES, THRESHOLD, plain_bigrams


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_OWN = {name: plain_bigrams(text) for name, text in TEMPLATES.items()}
_ROWS = ", ".join(f"('{name}', {len(own)}, {_list(own)})" for name, own in _OWN.items())
_BIGRAMS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"

LICENCE_SQL = f"""
with templates(license, size, own) as (values {_ROWS}),
docs as (select row_number() over () as rid, doc_id, string_split(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) as pieces from documents where text is not null),
piece as (select rid, doc_id, unnest(range(len(pieces))) as pos, unnest(pieces) as piece from docs),
worded as (select rid, doc_id, pos, list_filter(string_split(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as w from piece),
numbered as (select *, row_number() over (partition by rid order by pos) as nth, {_BIGRAMS.format(w="w")} as b from worded where len(w) > 1),
liked as (select * from numbered where len(b) > 0 and len(list_intersect(b, {_list(sorted({b for own in _OWN.values() for b in own}))})) >= {LIKE} * len(b)),
run as (select *, nth - row_number() over (partition by rid order by pos) as grp from liked),
units as (
  select rid, doc_id, pos as first_piece, pos as last_piece, b from run
  union all
  select rid, doc_id, first_piece, last_piece, {_BIGRAMS.format(w="w")} as b
  from (select s.rid, s.grp, any_value(s.doc_id) as doc_id, any_value(s.first_piece) as first_piece, any_value(s.last_piece) as last_piece, flatten(list(p.w order by p.pos)) as w
    from (select rid, grp, any_value(doc_id) as doc_id, min(pos) as first_piece, max(pos) as last_piece from run group by rid, grp having count(*) > 1) s
    join worded p on p.rid = s.rid and p.pos between s.first_piece and s.last_piece group by s.rid, s.grp)
)
select doc_id, license, 2.0::double * len(list_intersect(b, own)) / (len(b) + size) as dice, first_piece::int as first_piece, last_piece::int as last_piece, len(b)::int as n_bigrams
from units join templates on 2.0 * len(list_intersect(b, own)) / (len(b) + size) >= {THRESHOLD}
"""
