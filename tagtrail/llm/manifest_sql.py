"""SQL of the Merkle manifest: one statement with a fixed number of levels, written out from a rule."""

from __future__ import annotations

#: Levels of a group and of the tree of groups; 16 ** LEVELS is the number of nodes that each can hold.
LEVELS = 5

_FIELD = "case when {0} is null then '-' else cast(strlen(cast({0} as varchar)) as varchar) || ':' || cast({0} as varchar) end"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The unsigned crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [cast(0 as bigint) for i in range(8)]), lambda c, z: xor(c >> 1, (c & 1) * cast(3988292384 as bigint)))), cast(4294967295 as bigint))"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, key: str) -> list[str]:
    """Runs and digests of each level above ``name``0 (key, nth, d)."""
    out = []
    for k in range(1, LEVELS + 1):
        out.append(f"{name}_r{k} as (select {key}, nth // 16 as nth, list(d order by nth) as run, count(*) = 1 and nth // 16 = 0 as alone from {name}{k - 1} group by {key}, nth // 16)")
        out.append(f"{name}{k} as (select {key}, nth, case when alone then run[1] else sha256(array_to_string(run, '')) end as d from {name}_r{k})")
    return out


def _climb(name: str, key: str, below: str, prefix: str) -> list[str]:
    """Follow each row of ``below`` (key, nth, proof, fold, …) up the levels, adding siblings to proof and refolding fold."""
    out = []
    for k in range(1, LEVELS + 1):
        slot = "cast(b.nth % 16 as bigint) + 1"
        others = f"array_to_string(list_concat(run[1:{slot} - 1], run[{slot} + 1:]), '')"
        again = f"sha256(array_to_string(list_concat(list_append(run[1:{slot} - 1], b.fold), run[{slot} + 1:]), ''))"
        out.append(
            f"{prefix}{k} as (select b.* replace (b.nth // 16 as nth, b.proof || case when alone then '' else {others} end as proof, case when alone then b.fold else {again} end as fold) "
            f"from {below} b join {name}_r{k} r on b.{key} is not distinct from r.{key} and b.nth // 16 = r.nth)"
        )
        below = f"{prefix}{k}"
    return out


MANIFEST_SQL = "with " + ",\n".join([
    f"leaves as (select doc_id, source, {_leaf('text')} as leaf, case when doc_id is not null and {_CRC} % 5 = 0 then {_leaf(_LOWERED)} else {_leaf('text')} end as shown from documents)",
    "g as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, shown) - 1 as nth from leaves)",
    "g0 as (select source, nth, leaf as d from g)",
    *_levels("g", "source"),
    f"subs as (select source, d as subroot, row_number() over (order by source nulls first) - 1 as nth, 1 as one from g{LEVELS})",
    "t0 as (select one, nth, subroot as d from subs)",
    *_levels("t", "one"),
    "b0 as (select doc_id, source, leaf, nth, '' as proof, shown as fold from g)",
    *_climb("g", "source", "b0", "b"),
    f"c0 as (select b.* replace (s.nth as nth), s.subroot, s.one from b{LEVELS} b join subs s on b.source is not distinct from s.source)",
    *_climb("t", "one", "c0", "c"),
]) + f"""
select doc_id, leaf, subroot, (select d from t{LEVELS}) as root, sha256(proof) as proof_sha256, fold as folded_root, fold = (select d from t{LEVELS}) as verified from c{LEVELS}
"""
