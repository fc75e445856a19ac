"""Merkle manifest of a dataset, with proofs that are folded from kept hash states.

A row is a leaf: the SHA-256 of its fields, each with its length. Per group (source), leaves in order are taken sixteen
at a time, and the SHA-256 of their digests in a row, as hexadecimal text, is their parent; so on until one node is left,
the subroot. Subroots in order of their group give the root in the same way. A lone node is no parent's child: it
stands for itself. A last run of one becomes a node of its own.

A parent does not rehash itself when a child is replaced. It retains a copy of its hash state before each of its child
slots; folding takes the copy at the child's slot and feeds it the replacement and the siblings to the right of it.

No task holds a group: leaves get their place by range partitions, each level is one aggregate of sixteen rows a key,
and the siblings above a run of leaves are found level by level from the root down, each table a sixteenth of the one
below. States exist where they are used: a task builds those of the sixteen leaves at hand and, for each level above,
the one before the slot of the path.

Nulls are fields of their own (``-``); null groups form one group, first in order. Null ids come first in a group, equal
ids are ordered by their leaves, and repeated rows are leaves of their own. An empty table has no root and no rows. Very
long texts are hashed whole, in Spark. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.operators.joins import same_keys_join
from tagtrail.operators.ordering import with_position
from tagtrail.session import staged

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UP = "array<struct<slot int, run array<binary>>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _parents(nodes: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """(keys, at, run): sixteen nodes (keys, at, digest) each, in their order."""
    placed = nodes.select(*keys, F.floor(F.col("at") / fan).alias("up"), F.struct((F.col("at") % fan).cast("int").alias("slot"), "digest").alias("node"))
    grouped = placed.groupBy(*keys, "up").agg(F.sort_array(F.collect_list("node"))["digest"].alias("run"))
    return grouped.withColumnRenamed("up", "at")


def _alone() -> Column:
    """The only run of a group with one node in it: that node has no parent."""
    return (F.col("at") == 0) & (F.size("run") == 1)


def _digest() -> Column:
    joined = F.array_join(F.transform("run", lambda d: F.lower(F.hex(d))), "")
    return F.when(_alone(), F.col("run")[0]).otherwise(F.unhex(F.sha2(joined, 256)))


def levels_of(nodes: DataFrame, keys: Sequence[str], fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level from below, and (keys, digest) of what remains of each group. Each level is a written table."""
    levels = []
    while True:
        runs = staged(_parents(nodes, keys, fan), "merkle-level")
        levels.append(runs)
        nodes = runs.select(*keys, "at", _digest().alias("digest"))
        if not (runs.agg(F.max("at")).first()[0] or 0):
            return levels, nodes.select(*keys, "digest")


def _paths(levels: list[DataFrame], keys: Sequence[str], above: DataFrame, fan: int) -> DataFrame:
    """(keys, at, up) of the lowest runs of ``levels``; ``above`` has ``up``, the path of each group's last node."""
    paths = above.withColumn("at", F.lit(0).cast("bigint"))
    for depth in range(len(levels) - 1, 0, -1):
        runs = levels[depth]
        known = same_keys_join(runs, paths, [*keys, "at"])
        step = F.array(F.struct(F.col("slot").alias("slot"), F.col("run").alias("run")))
        child = known.select(*keys, "at", "run", "up", F.posexplode("run").alias("slot", "own"))
        paths = child.select(
            *keys, (F.col("at") * fan + F.col("slot")).alias("at"),
            F.when(_alone(), F.col("up")).otherwise(F.concat(step, F.col("up"))).cast(_UP).alias("up"),
        )
        # Runs hold each 16 digests and a level up is a sixteenth of this one: written, it is not worked out twice.
        paths = staged(paths, "merkle-paths")
    return paths


def tree(leaves: DataFrame, group: str, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Lowest runs (group, at, run, subroot, up, root) of leaves (group, at, digest, …), and (group, subroot, root)."""
    levels, subroots = levels_of(leaves.select(group, "at", "digest"), [group], fan)
    ordered = with_position(subroots.withColumn("_last", F.col(group).isNotNull()), [], ["_last", group], "pos").drop("_last")
    ordered = staged(ordered.select(group, "digest", (F.col("pos") - 1).alias("at")), "merkle-subroots")
    top, root = levels_of(ordered.select("at", "digest"), [], fan)
    crown = root.select("digest", F.array().cast(_UP).alias("up"))
    runs = _paths(top, [], crown.select("up"), fan)
    # The lowest runs of the upper tree lead to its leaves, the subroots.
    step = lambda at: F.array(F.struct((F.col(at) % fan).cast("int").alias("slot"), F.col("run").alias("run")))
    over = same_keys_join(top[0].withColumn("_alone", _alone()), runs, ["at"]).withColumnRenamed("at", "_run")
    named = ordered.join(over, F.floor(ordered["at"] / fan) == F.col("_run"))
    named = named.select(
        group, F.col("digest").alias("subroot"), F.when(F.col("_alone"), F.col("up")).otherwise(F.concat(step("at"), F.col("up"))).cast(_UP).alias("up")
    )
    whole = root.select(F.col("digest").alias("root"))
    named = staged(named.withColumn("root", whole.scalar()), "merkle-groups")
    lowest = same_keys_join(levels[0], _paths(levels, [group], named.select(group, "up"), fan), [group, "at"])
    return lowest, named.select(group, "subroot", "root")


def retained(run: Sequence[bytes]) -> list:
    """Copies of a parent's hash state before each child slot."""
    state, kept = hashlib.sha256(), []
    for digest in run:
        kept.append(state.copy())
        state.update(digest.hex().encode())
    return kept


def folded(kept, run: Sequence[bytes], slot: int, replacement: bytes) -> bytes:
    """The parent's digest with ``replacement`` at ``slot``: its state there goes on with what stands to the right."""
    state = kept.copy()
    state.update(replacement.hex().encode() + b"".join(d.hex().encode() for d in run[slot + 1 :]))
    return state.digest()


def _siblings(run: Sequence[bytes], slot: int) -> bytes:
    return b"".join(d.hex().encode() for k, d in enumerate(run) if k != slot)


def judged(run: list[bytes], shown: list[bytes], alone: bool, up: list[tuple[int, list[bytes]]]) -> Iterator[tuple[bytes, bytes]]:
    """(proof digest, folded root) of each leaf of a run, folded from the leaf that is shown in its place."""
    own = retained(run)
    above = [(retained(r[: s + 1])[s], r, s) for s, r in up]
    tail = b"".join(_siblings(r, s) for s, r in up)
    known: dict[bytes, bytes] = {}  # parents that come out alike fold alike
    for slot, leaf_shown in enumerate(shown):
        proof = hashlib.sha256((b"" if alone else _siblings(run, slot)) + tail).digest()
        first = leaf_shown if alone else folded(own[slot], run, slot, leaf_shown)
        if first not in known:
            node = first
            for kept, r, s in above:
                node = folded(kept, r, s, node)
            known[first] = node
        yield proof, known[first]


def verified(rows: DataFrame, group: str, doc_id: str, fan: int = FAN) -> DataFrame:
    """Judge the leaves (group, doc_id, digest, shown): ``digest`` is in the tree, ``shown`` is what the proof is folded from.

    Returns doc_id, group, leaf, subroot, root, proof_sha256, folded_root as lower-case hexadecimal text, and ``verified``.
    """
    narrow = rows.select(F.col(group).alias("grp"), F.col(doc_id).alias("id"), "digest", "shown")
    placed = with_position(narrow, ["grp"], ["id", "digest", "shown"], "pos").withColumn("at", F.col("pos") - 1).drop("pos")
    lowest, groups = tree(placed, "grp", fan)
    member = F.struct((F.col("at") % fan).cast("int").alias("slot"), "id", "shown")
    shown = placed.groupBy("grp", F.floor(F.col("at") / fan).alias("up_at")).agg(F.sort_array(F.collect_list(member)).alias("rows")).withColumnRenamed("up_at", "at")
    runs = same_keys_join(lowest.withColumn("alone", _alone()), shown, ["grp", "at"])
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("grp", "id", "leaf", "proof", "folded")}
            grps = batch.column("grp").to_pylist()
            for r, grp in zip(batch.select(["run", "alone", "up", "rows"]).to_pylist(), grps):
                found = judged(r["run"], [m["shown"] for m in r["rows"]], r["alone"], [(u["slot"], u["run"]) for u in r["up"]])
                for m, digest, (proof, root) in zip(r["rows"], r["run"], found):
                    for name, value in zip(out, (grp, m["id"], digest, proof, root)):
                        out[name].append(value)
            types = [batch.schema.field("grp").type, batch.schema.field("rows").type.value_type.field("id").type, pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), types)], names=list(out))

    told = runs.select("grp", "run", "alone", "up", "rows").mapInArrow(run, f"grp {rows.schema[group].dataType.simpleString()}, id {kind}, leaf binary, proof binary, folded binary")
    text = lambda c: F.lower(F.hex(c))
    return same_keys_join(told, groups, ["grp"]).select(
        F.col("id").alias(doc_id), F.col("grp").alias(group), *[text(c).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))],
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def manifest(documents: DataFrame, shown: Column | None = None, text: str = "text", group: str = "source", doc_id: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The manifest of ``documents``, one row each. ``shown`` is the text that is held against it, by default the same."""
    now = {text: shown} if shown is not None else {}
    rows = documents.select(
        F.col(group), F.col(doc_id), leaf([F.col(c) for c in fields]).alias("digest"), leaf([now.get(c, F.col(c)) for c in fields]).alias("shown")
    )
    return verified(rows, group, doc_id)
