"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words. No target is
above ``COPIES`` times the words of its source; what is over is shared anew by weight among the others.

A document of a source with target T gets copies = min(COPIES, c * measure) in expectation, with c set so that the
source's expected words are T. The whole part of it is certain. For the rest, of probability p, documents are ordered by
(U / (1 - U)) / (p / (1 - p)), U being a hash of the document, and taken in this order as long as their words fit into
what the source still needs: a sample of fixed size in words, with unequal probabilities. What is then missing, less than
the next document, is filled from the FILL documents that follow in the order, each taken if it still fits; so also a
source of a few documents comes near its target. ``measure`` is the
square root of the words by default, so that long documents are likelier and short ones not shut out.

The order of a source is never sorted in one task: its words are summed in 4096 bins of the order, then in 4096 bins of
the bin in which the need is met, and only the last bin, one part in 16 million, is ordered row by row. Rounds exchange
one row per source. Null or empty text: size 0, taken 0. Rows that agree in id, source and text are taken or left
together. An empty table gives an empty mix. Very long texts count by all their words. Columns of any name are kept, but for
those of the names of the four new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtrail.llm.texts import WORD
from tagtrail.operators.ordering import with_position
from tagtrail.session import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
SEED = 23
_BINS = 4096
#: Documents behind the cut that may fill what is missing.
FILL = 256
#: Of each row: its source's number, words, place in the order of ids, hash, expected copies.
_OWN = ["_words", "_key"]


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, nth, target) from (source, source_size), one row per source."""
    ranked = with_position(sizes.withColumn("_none", F.col("source").isNull()), [], ["_none", "source"], "nth").drop("_none")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.withColumns({"_w": weight, "_cap": copies * F.col("source_size")}), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, held = 0.0, F.lit(False)
    while True:  # each round caps at least one more source
        free = ranked.agg(F.sum(F.when(held, F.col("_cap"))), F.sum(F.when(~held, F.col("_w")))).first()
        if not free[1]:
            break
        new = (share * total - (free[0] or 0)) / free[1]
        if new == level:
            break
        level = new
        held = F.lit(level) * F.col("_w") > F.col("_cap")
    target = F.when(held, F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_w"))
    return ranked.select("source", "source_size", "nth", target.alias("target"))


def _rows(documents: DataFrame, text: str, source: str, doc_id: str, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    words = n_words(text)
    return documents.select(*([F.struct(*keep).alias("_row")] if keep else []), F.col(source).alias("_source"), words.alias("_words"), F.xxhash64(F.lit(seed), doc_id, source, text).alias("_key"))


def _rates(rows: DataFrame, per: DataFrame, measure: Callable[[Column], Column], copies: int) -> DataFrame:
    """``per`` with c, the factor from measure to expected copies. A round takes documents at the cap out of the sum."""
    sized = rows.select("_source", "_words", measure(F.col("_words")).alias("_m"))
    joined = lambda table: sized.join(table, sized["_source"].eqNullSafe(table["source"]))
    # A source that is wanted whole, as often as it may be, needs no search.
    per = per.withColumn("c", F.when(F.col("target") >= copies * F.col("source_size"), F.lit(1e15)).otherwise(F.lit(0.0)))
    before = None
    while True:
        full = F.col("c") * F.col("_m") >= copies
        sums = joined(per).groupBy("source").agg(
            F.coalesce(F.sum(F.when(full, copies * F.col("_words"))), F.lit(0)).alias("_full"),
            F.coalesce(F.sum(F.when(~full, F.col("_words") * F.col("_m"))), F.lit(0.0)).alias("_open"),
            F.count(F.when(full, 1)).alias("_n"),
        )
        old = per.withColumnRenamed("source", "_s")
        grown = F.when(F.col("_open") > 0, (F.col("target") - F.col("_full")) / F.col("_open")).otherwise(F.col("c"))
        per = staged(
            old.join(sums, F.col("_s").eqNullSafe(F.col("source")), "left")
            .select(F.col("_s").alias("source"), "source_size", "nth", "target", F.greatest(F.coalesce(grown, F.lit(0.0)), "c").alias("c"), "_n"),
            "rates",
        )
        now = per.agg(F.sum("_n")).first()[0]
        per = per.drop("_n")
        if now == before:
            return per
        before = now


def _expected(measure: Callable[[Column], Column], copies: int) -> dict[str, Column]:
    """Certain copies of a row, and the place of the row in the Pareto order of its source, from 0 to 1."""
    # A hair below a whole number is that number: c is a quotient of sums.
    expected = F.least(F.lit(float(copies)), F.col("c") * measure(F.col("_words")))
    expected = F.when(F.abs(expected - F.round(expected)) < 1e-9, F.round(expected)).otherwise(expected)
    whole = F.floor(expected)
    p = expected - whole
    u = (F.shiftrightunsigned("_key", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    odds = (u / (1 - u)) / (p / (1 - p))
    return {"_whole": whole, "_order": F.when(p > 0, odds / (1 + odds))}


def _cuts(rows: DataFrame, per: DataFrame) -> DataFrame:
    """(nth, cut, cut_key, extra): a row is taken once more if its (_order, _key) is at most this, or its key is an extra one."""
    need = rows.groupBy("nth").agg(F.sum(F.col("_whole") * F.col("_words")).alias("_certain"))
    need = per.select("nth", "target").join(need, "nth").select("nth", (F.col("target") - F.col("_certain")).alias("_need"))
    open_rows = rows.where("_order is not null").select("nth", "_order", "_key", "_words")
    binned = open_rows.withColumn("_cell", F.floor(F.col("_order") * (_BINS * _BINS)))
    binned = binned.withColumn("_bin", F.floor(F.col("_cell") / _BINS))
    upto = lambda order: Window.partitionBy("nth").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def met(sums: DataFrame, by: str) -> DataFrame:
        """The bin of a source in which the sum passes the need; without one, the source takes all its rows."""
        before = F.coalesce(F.sum("_sum").over(upto([by])), F.lit(0))
        run = sums.withColumn("_before", before).where((F.col("_before") <= F.col("_need")) & (F.col("_before") + F.col("_sum") > F.col("_need")))
        return run.groupBy("nth").agg(F.min(F.struct(by, "_before", "_need")).alias("_at")).select("nth", f"_at.{by}", (F.col("_at._need") - F.col("_at._before")).alias("_need"))

    coarse = binned.groupBy("nth", "_bin").agg(F.sum("_words").alias("_sum")).join(need, "nth")
    first = staged(met(coarse, "_bin"), "cuts")
    fine = binned.join(first, ["nth", "_bin"]).groupBy("nth", "_need", "_cell").agg(F.sum("_words").alias("_sum"))
    second = staged(met(fine, "_cell"), "cuts")
    last = binned.join(second, ["nth", "_cell"])
    after = F.sum("_words").over(Window.partitionBy("nth").orderBy("_order", "_key"))
    fits = F.col("_after") <= F.col("_need")
    own = last.withColumn("_after", after).groupBy("nth").agg(
        F.max(F.when(fits, F.struct("_order", "_key"))).alias("_best"), F.max(F.when(fits, F.col("_after"))).alias("_got"),
        F.first("_need").alias("_need"), F.first("_cell").alias("_cell"),
    )
    # None of the last bin may fit; the cut is then the lower edge of the bin.
    found = own.select(
        "nth", F.coalesce("_best._order", F.col("_cell") / (_BINS * _BINS)).alias("cut"), F.coalesce("_best._key", F.lit(-(1 << 63))).alias("cut_key"),
        (F.col("_need") - F.coalesce("_got", F.lit(0))).alias("missing"),
    )
    found = staged(found, "cuts")
    everything = per.select("nth").join(found, "nth", "left_anti").select("nth", F.lit(2.0).alias("cut"), F.lit(0).cast("bigint").alias("cut_key"), F.array().cast("array<bigint>").alias("extra"))
    return found.join(_filling(open_rows, found), "nth", "left").select("nth", "cut", "cut_key", F.coalesce("extra", F.array().cast("array<bigint>")).alias("extra")).unionByName(everything)


def _filling(open_rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(nth, extra): keys of the documents that fill what a cut leaves, of the FILL that follow it."""
    behind = (F.col("_order") > F.col("cut")) | ((F.col("_order") == F.col("cut")) & (F.col("_key") > F.col("cut_key")))
    # Rows that agree in all are taken together.
    rest = open_rows.join(cuts, "nth").where(behind & (F.col("_words") > 0)).groupBy("nth", "_order", "_key", "missing").agg(F.sum("_words").alias("words"))
    first = rest.withColumn("_n", F.row_number().over(Window.partitionBy("nth").orderBy("_order", "_key"))).where(F.col("_n") <= FILL)
    listed = first.groupBy("nth", "missing").agg(F.sort_array(F.collect_list(F.struct("_n", "_key", "words"))).alias("next"))
    empty = F.struct(F.col("missing").alias("left"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, row: Column) -> Column:
        fits = row["words"] <= acc["left"]
        more = F.struct((acc["left"] - row["words"]).alias("left"), F.concat(acc["taken"], F.array(row["_key"])).alias("taken"))
        return F.when(fits, more).otherwise(acc)

    return listed.select("nth", F.aggregate("next", empty, step)["taken"].alias("extra"))


def mix(
    documents: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: Sequence[str] | None = None,
    measure: Callable[[Column], Column] = F.sqrt, weights: Sequence[int] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED,
) -> DataFrame:
    """Each row with ``size``, ``source_size``, ``target`` and ``copies``, the number of times the mix takes it.

    ``keep`` names the columns to return, all by default; the four new columns replace any of the same name.
    """
    new = ("size", "source_size", "target", "copies")
    keep = [c for c in (documents.columns if keep is None else keep) if c not in new]
    narrow = staged(_rows(documents, text, source, doc_id, seed), "sizes")
    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    per = staged(source_targets(sizes, weights, share, copies), "targets")
    per = staged(_rates(narrow, per, measure, copies), "targets")
    place = lambda rows, table: rows.join(table.withColumnRenamed("source", "_per"), F.col("_source").eqNullSafe(F.col("_per"))).withColumns(_expected(measure, copies))
    cuts = _cuts(place(narrow, per.select("source", "nth", "c")), per)
    final = staged(per.join(cuts, "nth").select(*[F.col(c).alias(f"_{c}_of") for c in ("source", "source_size", "target", "cut", "cut_key", "extra")], "c"), "cuts")
    # The columns to return travel in one, so that their names meet no name used here.
    rows = _rows(documents, text, source, doc_id, seed, keep)
    joined = rows.join(final, F.col("_source").eqNullSafe(F.col("_source_of"))).withColumns(_expected(measure, copies))
    ahead = (F.col("_order") < F.col("_cut_of")) | ((F.col("_order") == F.col("_cut_of")) & (F.col("_key") <= F.col("_cut_key_of")))
    once = F.coalesce(ahead | (F.col("_order").isNotNull() & F.array_contains("_extra_of", F.col("_key"))), F.lit(False))
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in keep], F.col("_words").alias("size"), F.col("_source_size_of").alias("source_size"), F.col("_target_of").alias("target"),
        (F.col("_whole") + once.cast("int")).cast("int").alias("copies"),
    )
