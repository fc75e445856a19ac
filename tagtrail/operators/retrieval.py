"""Nearest chunks, sensors named by a question, and look-ups in the graph tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tagtrail.functions.text import tokens
from tagtrail.operators import matcher
from tagtrail.operators.ordering import with_position
from tagtrail.session import small_or_none, staged
from tagtrail.sources.files import by_bytes

# Fixed values of the look-ups.
LOOKUP_LIMIT = 20
EVENTS_PER_ENTITY = 10
GRAM = 3

QUESTION_BLOCK = 4096
CORPUS_SLICE = 50_000
SCORE_DIGITS = 9
#: Chunks that are scored at once.
SCORED_ROWS = 1024
#: Bytes of texts that an encoder's worker holds as Python strings at once.
ENCODE_BYTES = 1 << 20

#: Rows of the first block of a look-up with a limit, and how much larger each next block is.
FIRST_ROWS, GROWTH = 200_000, 8


# --- vectors ------------------------------------------------------------------------------------------------------


def join_index_metadata(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Embedding rows with their metadata, by key."""
    return vectors.join(metadata, key)


def index_mismatch(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """How many keys have only a vector or only metadata; both must be 0 for a sound index."""
    both = vectors.select(key, F.lit(True).alias("v")).join(
        metadata.select(key, F.lit(True).alias("m")), key, "full_outer"
    )
    return both.agg(
        F.count_if("v").alias("vectors"), F.count_if("m").alias("metadata"),
        F.count_if(F.col("m").isNull()).alias("without_metadata"),
        F.count_if(F.col("v").isNull()).alias("without_vector"),
    )


class TopK:
    """The ``k`` best chunks of each question among all batches that were added; equal scores go by chunk id.

    Only scores that reach the ``k``-th best so far of their question are looked at, all questions at once.
    """

    def __init__(self, questions: int, k: int):
        self.k = k
        self.floor = np.full(questions, -np.inf)
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, scores: np.ndarray, batch: pa.RecordBatch | pa.Table, questions: np.ndarray | None = None) -> None:
        """``scores`` has a row per question, or per question of ``questions``, and a column per row of ``batch``."""
        scores = np.round(scores, SCORE_DIGITS)
        asked = np.arange(len(self.floor)) if questions is None else questions
        floor = self.floor[asked]
        if scores.shape[1] > self.k:
            own = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            floor = np.maximum(floor, own)
            # ``k`` rows of this batch reach ``own``, so it bounds the k-th best from below from now on.
            self.floor[asked] = floor
        who, where = np.nonzero(scores >= floor[:, None])
        if len(who):
            at = pa.array(where)
            self.held.append((asked[who], scores[who, where], batch.column("chunk_id").take(at), batch.column("doc_id").take(at)))
            self.rows += len(who)
        if self.rows > 8 * self.k * len(self.floor) + 4096:
            self._shrink()

    def _shrink(self) -> None:
        who, score = (np.concatenate([h[n] for h in self.held]) for n in (0, 1))
        chunk, doc = (pa.concat_arrays([c for h in self.held for c in (h[n].chunks if isinstance(h[n], pa.ChunkedArray) else [h[n]])]) for n in (2, 3))
        order = np.lexsort((np.asarray(chunk.to_pylist(), dtype=object), -score, who))
        first = np.searchsorted(who[order], who[order], side="left")
        order = order[np.arange(len(order)) - first < self.k]
        self.held = [(who[order], score[order], chunk.take(pa.array(order)), doc.take(pa.array(order)))]
        self.rows = len(order)
        counts = np.bincount(who[order], minlength=len(self.floor))
        ends = np.cumsum(counts) - 1
        full = counts == self.k
        self.floor[full] = np.maximum(self.floor[full], score[order][ends[full]])

    def best(self, names: list, kind: pa.DataType) -> pa.Table | None:
        """question_id, chunk_id, doc_id, score; ``names`` are the ids of the questions."""
        if not self.held:
            return None
        self._shrink()
        who, score, chunk, doc = self.held[0]
        asked = pa.array([names[q] for q in who.tolist()], type=kind)
        return pa.table({"question_id": asked, "chunk_id": chunk, "doc_id": doc, "score": score})


def matrix_of(batch: pa.RecordBatch | pa.Table, name: str = "embedding") -> np.ndarray:
    """The vectors of a column as rows of doubles."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def top_k_chunks(
    questions: DataFrame, corpus: DataFrame, k: int, block: int = QUESTION_BLOCK, corpus_slice: int = CORPUS_SLICE
) -> DataFrame:
    """The ``k`` chunks of largest dot product with each question: ``question_id, chunk_id, doc_id, rank, score``.

    Both sides hold unit vectors in ``embedding``. Scores count to nine digits; equal ones go by chunk id. At most
    ``block`` questions travel to every task and the corpus is scanned in place; more questions than that meet the
    corpus block by block. Either way a task keeps only ``k`` chunks per question.
    """
    corpus = corpus.where(F.col("embedding").isNotNull()).select("chunk_id", "doc_id", "embedding")
    questions = questions.select("question_id", F.col("embedding").cast("array<double>").alias("embedding"))
    few = small_or_none(questions, block)
    if few is not None:
        return ranked(_scan(questions, corpus, few, k), k)
    # Both are read twice, and vectors may be made by an encoder.
    return ranked(_grid(staged(questions, "questions"), staged(corpus, "corpus"), k, block, corpus_slice), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "question_id", "chunk_id", "doc_id", "rank", "score"
    )


def _scored_schema(questions: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
            T.StructField("doc_id", corpus.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan(questions: DataFrame, corpus: DataFrame, few: list, k: int) -> DataFrame:
    schema = _scored_schema(questions, corpus)
    if not few:
        return questions.sparkSession.createDataFrame([], schema)
    sent = questions.sparkSession.sparkContext.broadcast(
        ([r.question_id for r in few], np.array([r.embedding for r in few], dtype=float))
    )

    kind = to_arrow_type(schema["question_id"].dataType)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        found = TopK(len(names), k)
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                found.add(matrix @ matrix_of(part).T, part)
        out = found.best(names, kind)
        if out is not None:
            yield from out.combine_chunks().to_batches()

    return corpus.mapInArrow(nearest, schema)


def _grid(questions: DataFrame, corpus: DataFrame, k: int, block: int, corpus_slice: int) -> DataFrame:
    """Question blocks against corpus slices; every (block, slice) is one bounded task."""
    blocks = max(1, -(-questions.count() // block))
    slices = max(1, -(-corpus.count() // corpus_slice))

    def spread(df: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(own_n)).alias(own)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other))

    left = spread(questions, "question_id", "block", blocks, "slice", slices)
    right = spread(corpus, "chunk_id", "slice", slices, "block", blocks)
    keys = [F.col("block").cast("bigint"), F.col("slice").cast("bigint")]

    schema = _scored_schema(questions, corpus)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest_of_group(k, schema), schema)


def nearest_of_group(k: int, schema: T.StructType):
    """A function of a table of questions and one of chunks: the best chunks of each question among these."""
    kind = to_arrow_type(schema["question_id"].dataType)
    empty = to_arrow_schema(schema).empty_table()

    def nearest(asked: pa.Table, chunks: pa.Table) -> pa.Table:
        if not asked.num_rows or not chunks.num_rows:
            return empty
        names, matrix = asked.column("question_id").to_pylist(), matrix_of(asked)
        found = TopK(len(names), k)
        for batch in chunks.to_batches(max_chunksize=SCORED_ROWS):
            found.add(matrix @ matrix_of(batch).T, batch)
        out = found.best(names, kind)
        return empty if out is None else out.cast(empty.schema)

    return nearest


_encoders: dict[str, Callable] = {}


def _set_up(name: str, factory: Callable[[], Callable]) -> Callable:
    """What ``factory`` makes, once in this process."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = factory()
    return _encoders[name]


def encode_chunks(
    chunks: DataFrame, encoder: Callable | None = None, batch: int = 32, keep: Sequence[str] = (), factory: Callable[[], Callable] | None = None
) -> DataFrame:
    """``chunk_id, embedding``, and the columns ``keep``, by a plugged-in encoder, unit length.

    The encoder takes a pandas series of texts and gives their vectors, as a series of lists or as an array with a row for
    each. One that is costly to set up comes from ``factory``, which is called once in each Python worker. The encoder gets
    at most ``batch`` texts at a time, of like length where the order of rows allows. An empty text is an error.
    """
    if (encoder is None) == (factory is None):
        raise ValueError("give an encoder or a factory of one")
    name = uuid.uuid4().hex
    source = chunks.select("chunk_id", *keep, "text")
    schema = T.StructType([*(f for f in source.schema if f.name != "text"), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder or _set_up(name, factory)
        for rows in (part for whole in batches for part in by_bytes(whole, "text", ENCODE_BYTES)):
            texts = pd.Series(rows.column("text").to_pylist(), dtype=object)
            if not len(texts):
                continue
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("a chunk without text cannot be encoded")
            order = np.argsort(texts.str.len().to_numpy(dtype=np.int64), kind="stable")
            parts = []
            for i in range(0, len(order), batch):
                found = encode(texts.iloc[order[i : i + batch]].reset_index(drop=True))
                parts.append(np.asarray(found if isinstance(found, np.ndarray) else found.tolist(), dtype=float))
            vectors = np.concatenate(parts)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            own = np.empty_like(vectors, dtype=np.float32)
            own[order] = vectors / np.where(length == 0, 1.0, length)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel()))
            # What Arrow keeps for later use adds up over the workers of an executor, which stand side by side.
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(rows.columns, rows.schema.names) if n != "text"), lists], names=schema.names)

    return source.mapInArrow(run, schema)


# --- substrings by equality joins ---------------------------------------------------------------------------------


def question_tokens(questions: DataFrame) -> DataFrame:
    """``question_id, token, times``; a token repeated in the question counts each time."""
    return (
        questions.select("question_id", F.explode(tokens(F.col("question"))).alias("token"))
        .groupBy("question_id", "token")
        .agg(F.count("*").alias("times"))
    )


def token_hits(words: DataFrame, values: DataFrame) -> DataFrame:
    """Distinct ``token, value`` pairs where the token occurs inside the lowercased value.

    Tokens have at least three characters. Each meets the values on that of its three-letter pieces which the fewest
    values hold, then is checked in full: a piece that all ids share is met only by tokens that have no other.
    """

    def grams(name: str) -> Column:
        places = F.sequence(F.lit(1), F.length(name) - (GRAM - 1))
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(GRAM))))).alias("gram")

    pieces = (
        values.select(F.lower("value").alias("value")).distinct().where(F.length("value") >= GRAM)
        .select("value", grams("value"))
    )
    wanted = words.select("token").distinct().select("token", grams("token"))
    held = pieces.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(held, "gram", "left").groupBy("token").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    )
    return pieces.join(rarest, "gram").where(F.col("value").contains(F.col("token"))).select("token", "value")


def first_per_token(words: DataFrame, values: DataFrame, rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Per token the first ``limit`` of the ``rows`` whose ``value`` holds it, in ``order``.

    The first ``limit`` rows of a question are among these of its tokens, so questions only ever meet ``limit`` rows per
    token. ``order`` tells any two different rows apart: equal ones share a rank and are folded after it.

    More than FIRST_ROWS rows are searched in blocks of that order, each GROWTH times as large as the one before, and a
    token that has its rows goes no further: one that stands in very many values is done after the first blocks, one that
    stands in few has few to bring.
    """
    if rows.limit(FIRST_ROWS + 1).count() <= FIRST_ROWS:
        return _first_rows(token_hits(words, values).join(rows, "value"), order, limit)
    placed = with_position(rows, [], order, "place")
    total, at, size = placed.count(), 0, FIRST_ROWS
    open_words, found = words.select("token").distinct(), None
    while at < total:
        block = placed.where(F.col("place").between(at + 1, at + size)).drop("place")
        own = _first_rows(token_hits(open_words, block.select("value")).join(block, "value"), order, limit)
        found = staged(own if found is None else _first_rows(found.unionByName(own), order, limit), "found")
        done = found.groupBy("token").count().where(F.col("count") >= limit)
        open_words = staged(words.select("token").distinct().join(done, "token", "left_anti"), "tokens")
        if open_words.isEmpty():
            break
        at, size = at + size, size * GROWTH
    return found


def _first_rows(hits: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    own = hits.drop("value") if "value" in hits.columns else hits
    ranked = Window.partitionBy("token").orderBy(*order)
    return own.withColumn("n", F.dense_rank().over(ranked)).where(F.col("n") <= limit).drop("n").distinct()


def _named_in(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """``question_id, tag`` where the whole tag occurs in the question, any case."""
    named = tags.select("tag").distinct().withColumn("key", F.lower("tag"))
    low = questions.select("question_id", F.lower("question").alias("text"))
    found = matcher.phrases_in(low, "question_id", "text", named, "key").withColumnRenamed("phrase", "key")
    return found.join(named, "key").select("question_id", "tag")


def identify_sensors(questions: DataFrame, tags: DataFrame, limit: int = 10) -> DataFrame:
    """Sensors of each question, best first: those named in full, then by number of token hits, then by tag.

    Tags that hold the same tokens score alike in every question, so only the first ``limit`` of them can be among the
    best: questions meet sets of tokens with at most ``limit`` tags each, not all tags.
    """
    named = _named_in(questions, tags).select("question_id", "tag", F.lit(0).alias("tier"), F.lit(0).alias("score"))
    words = question_tokens(questions)
    keyed = tags.select("tag").distinct().withColumn("value", F.lower("tag"))
    sets = token_hits(words, keyed).groupBy("value").agg(F.array_sort(F.collect_list("token")).alias("held"))
    by_tag = Window.partitionBy("held").orderBy("tag")
    alike = (
        keyed.join(sets, "value").withColumn("n", F.row_number().over(by_tag)).where(F.col("n") <= limit)
        .groupBy("held").agg(F.collect_list("tag").alias("tags"))
    )
    scored = (
        alike.select("held", F.explode("held").alias("token")).join(words, "token")
        .groupBy("question_id", "held")
        .agg(F.sum("times").alias("score"))
        .join(alike, "held")
        .select("question_id", F.explode("tags").alias("tag"), F.lit(1).alias("tier"), "score")
    )
    best = Window.partitionBy("question_id").orderBy("tier", F.desc("score"), "tag")
    return (
        named.unionByName(scored)
        .groupBy("question_id", "tag")
        .agg(F.min(F.struct("tier", "score")).alias("s"))
        .select("question_id", "tag", "s.tier", "s.score")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= limit)
        .select("question_id", "tag", "rank", F.when(F.col("tier") == 0, "named").otherwise("token").alias("found_by"))
    )


def explicit_sensors(questions: DataFrame, tags: DataFrame, fallback_limit: int = 4) -> DataFrame:
    """Sensors named in full; a question that names none gets its best ``fallback_limit`` by token hits."""
    named = _named_in(questions, tags)
    by_tag = Window.partitionBy("question_id").orderBy("tag")
    ranked = named.select("question_id", "tag", F.row_number().over(by_tag).alias("rank"), F.lit("named").alias("found_by"))
    others = questions.join(named.select("question_id").distinct(), "question_id", "left_anti")
    return ranked.unionByName(identify_sensors(others, tags, fallback_limit))


def resolve_sensors(asked: DataFrame, tags: DataFrame) -> DataFrame:
    """Asked tags in any case to canonical tags; ``known`` is false where there is none."""
    canonical = tags.groupBy(F.lower("tag").alias("key")).agg(F.min("tag").alias("canonical"))
    return (
        asked.withColumn("key", F.lower("asked"))
        .join(canonical, "key", "left")
        .select("asked", "canonical", F.col("canonical").isNotNull().alias("known"))
    )


# --- graph look-ups -----------------------------------------------------------------------------------------------

EVENT_FIELDS = ["event_id", "event_type", "status", "start", "end", "peak_value", "peak_robust_z", "interpretation"]


def _values_of(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    values = F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in columns))
    return rows.select(*key, F.explode(F.array_distinct(values)).alias("value"))


def graph_lookup(questions: DataFrame, entities: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Entities with a question token inside their id, column, family or class; the first ``limit`` ids per question.

    Only the first ``limit`` ids of each distinct field value, and of each token, can be among them: a class shared by
    very many entities, or a token inside very many ids, gives no more than ``limit`` rows to the joins.
    """
    values = _values_of(entities, ["entity_id"], ["entity_id", "source_column", "tag_family", "candidate_class"])
    first = Window.partitionBy("value").orderBy("entity_id")
    kept = values.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).drop("n")
    words = question_tokens(questions)
    by_id = Window.partitionBy("question_id").orderBy("entity_id")
    answers = first_per_token(words, values, kept, [F.col("entity_id")], limit)
    return (
        words.join(answers, "token")
        .select("question_id", "entity_id").distinct()
        .withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= limit)
        .join(entities, "entity_id")
        .select("question_id", "rank", "entity_id", "source_column", "candidate_class", "tag_family")
    )


def entity_events(events: DataFrame, per_entity: int = EVENTS_PER_ENTITY) -> DataFrame:
    """The first ``per_entity`` distinct events of each entity, by event id."""
    by_id = Window.partitionBy("entity_id").orderBy("event_id")
    return (
        events.where(F.col("event_id").isNotNull())
        .select("entity_id", *EVENT_FIELDS)
        .dropDuplicates(["entity_id", "event_id"])
        .withColumn("n", F.row_number().over(by_id))
        .where(F.col("n") <= per_entity)
    )


def graph_lookup_events(found: DataFrame, events: DataFrame, per_entity: int = EVENTS_PER_ENTITY) -> DataFrame:
    """Events of the entities found, each event once per question under its first entity."""
    wanted = events.join(found.select("entity_id").distinct(), "entity_id", "left_semi")
    once = Window.partitionBy("question_id", "event_id").orderBy("rank")
    return (
        found.select("question_id", "rank", "entity_id")
        .join(entity_events(wanted, per_entity), "entity_id")
        .withColumn("seen", F.row_number().over(once))
        .where(F.col("seen") == 1)
        .drop("seen")
    )


def newest_first(extra: list[str] = ()) -> list[Column]:
    """Events without a start come first, then the latest start; ties by id."""
    return [F.desc_nulls_first("start"), F.asc("event_id"), *(F.asc(c) for c in extra)]


def event_lookup(questions: DataFrame, events: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """The newest ``limit`` events with a question token in their type, sensor id, column or interpretation.

    ``events`` holds one row per event and sensor (``event_id, entity_id, source_column, ...``). A question without
    tokens gets the newest events of all. As in ``graph_lookup``, each distinct value and each token gives ``limit`` rows.
    """
    order = ["event_id", "entity_id", "start"]
    values = _values_of(events, order, ["event_type", "entity_id", "source_column", "interpretation"])
    newest = Window.partitionBy("value").orderBy(*newest_first(["entity_id"]))
    kept = values.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).drop("n")
    words = question_tokens(questions)
    answers = first_per_token(words, values, kept, newest_first(["entity_id"]), limit)
    matched = words.join(answers, "token").select("question_id", *order)
    silent = questions.where(F.size(tokens(F.col("question"))) == 0).select("question_id", F.lit(0).alias("all"))
    latest = events.select(*order).orderBy(*newest_first(["entity_id"])).limit(limit).withColumn("all", F.lit(0))
    ranked = Window.partitionBy("question_id").orderBy(*newest_first(["entity_id"]))
    return (
        matched.unionByName(silent.join(latest, "all").drop("all"))
        .distinct()
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= limit)
        .drop("start")
        .join(events, ["event_id", "entity_id"])
    )


def event_timeline(events: DataFrame, limit: int) -> DataFrame:
    """The latest ``limit`` events of the graph (1 to 500)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return events.orderBy(*newest_first(["entity_id"])).limit(limit)


def graph_evidence(
    hits: DataFrame, edges: DataFrame, entities: DataFrame, events: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Entities mentioned by the chunks found (once per chunk) and their events (once per entity)."""
    found = (
        hits.select("question_id", "chunk_id").join(edges.distinct(), "chunk_id").join(entities, "entity_id")
        .dropDuplicates(["question_id", "chunk_id", "entity_id"])
    )
    detected = (
        found.select("question_id", "entity_id").distinct()
        .join(events.where(F.col("event_id").isNotNull()), "entity_id")
        .dropDuplicates(["question_id", "entity_id", "event_id"])
    )
    return found, detected


def hybrid_context(hits: DataFrame, edges: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Chunks to the tags they mention, to every entity of those tags, to their events.

    One row per entity and event; an entity without events keeps one row with a null event.
    """
    keyed = entities.withColumn("tag", F.lower(F.coalesce("source_column", "entity_id")))
    tags = (
        hits.select("question_id", "chunk_id").join(edges, "chunk_id").join(keyed.select("entity_id", "tag"), "entity_id")
        .select("question_id", "tag").distinct()
    )
    fields = ["event_id", "event_type", "start", "end", "status", "interpretation"]
    return (
        tags.join(keyed, "tag")
        .join(events.select("entity_id", *fields), "entity_id", "left")
        .dropDuplicates(["question_id", "entity_id", "event_id"])
        .select("question_id", "entity_id", "source_column", "candidate_class", *fields)
    )


def first_summary(tags: DataFrame, summary: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Each tag with the first summary row, in ``order``, that holds it in any of ``columns``; nulls if none does."""
    rows = F.struct(*(F.col(c) for c in summary.columns))
    named = summary.select(
        F.explode(F.array_distinct(F.array(*(F.lower(F.col(c).cast("string")) for c in columns)))).alias("key"),
        rows.alias("row"), F.struct(*order).alias("place"),
    )
    first = named.groupBy("key").agg(F.min_by("row", "place").alias("row"))
    return tags.withColumn("key", F.lower("tag")).join(first, "key", "left").select("tag", "row.*")
