"""New reports into a keyed history, by Structured Streaming, and late ones into a dated history with kept state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions.session import checkpointed
from vigil.operators.history import carry_forward, upsert
from vigil.sources import parts

ROWS, STATE = "rows", "state"


def current(spark: SparkSession, history: str, schema: str) -> DataFrame:
    """The history's rows; none if there is none yet."""
    return parts.rows(spark, history, parts.manifest(spark, history), ROWS, schema)


def merge_batch(spark: SparkSession, batch: DataFrame, history: str, schema: str, keys: Sequence[str], by: Column, order: Sequence[str] = (), writer: str = "", number: int | None = None) -> bool:
    """Merges a batch into the parts of the history that its rows fall in, all or nothing; False if the writer's batch of this number is in it already.

    Rows without a key are dropped. The parts' names come to the driver, as they do with the manifest.
    """
    held = parts.manifest(spark, history)
    if number is not None and held.marks.get(writer, -1) >= number:
        return False
    rows = checkpointed(batch.dropna(subset=list(keys)))
    touched = [r[0] for r in rows.select(parts.part_of(by)).distinct().collect()]
    old = parts.rows(spark, history, held, ROWS, schema, touched).select(rows.columns)
    made = parts.staged(upsert(old, rows, list(keys), order), history, by)
    parts.commit(spark, history, held, {ROWS: made}, {} if number is None else {writer: number})
    return True


def ingest_stream(
    spark: SparkSession, source: str, schema: str, history: str, checkpoint: str, keys: Sequence[str], by: Column, order: Sequence[str] = ()
) -> StreamingQuery:
    """Processes files not seen yet into one history, last wins.

    by: which part of the history a row belongs to, by its keys alone (a month, a bucket of keys). A batch
    reads and rewrites only the parts that its rows fall in, beside the old files, and one rename of the manifest makes
    them the history's (see `parts`). A crash before it changes nothing, and Spark runs the batch again; after it the
    batch's number, kept with the stream's id in the same manifest, tells that it is done. A stream with a
    new checkpoint merges by key, so rows of other streams stay. One stream writes a history at a time. The checkpoint keeps the seen files.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        merge_batch(session, batch, history, schema, keys, by, order, stream, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_reports(spark: SparkSession, history: str, updates: DataFrame, entity: Sequence[str], values: Sequence[str], date: str = "d", part: str = "yyyy-MM") -> DataFrame:
    """Merges dated rows, late ones too, and returns every entity's latest values at each report date from the earliest changed one on (see `carry_forward`).

    The history is in parts by date (`part`: a pattern whose texts sort by date), and beside each part's rows
    stands what was known at its end: a row an entity. An update reads the rows of its first part and of
    later ones, and of what came before only the one kept state; earlier parts are not listed. It rewrites the parts that it
    changes and the states from its first part on, and all are switched together. No updates give no rows.
    """
    fields = [*entity, date, *values]
    schema = updates.select(*fields).schema
    by = F.date_format(date, part)
    rows = checkpointed(updates.select(*fields).where(F.col(date).isNotNull()))
    begin, first = rows.agg(F.min(date), F.min(by)).first()  # one date and its part
    if begin is None:
        return rows.withColumn("carried", F.lit(False)).limit(0)
    held = parts.manifest(spark, history)
    touched = {r[0] for r in rows.select(by).distinct().collect()}
    later = [p for p in held.parts(ROWS) if p >= first]
    merged = checkpointed(upsert(parts.rows(spark, history, held, ROWS, schema, later), rows, [*entity, date]))
    known = [p for p in held.parts(STATE) if p < first][-1:]
    before = parts.rows(spark, history, held, STATE, schema, known)
    reports = merged.select(date).distinct()
    whole = checkpointed(carry_forward(before.unionByName(merged), reports, entity, values, (), date))
    ends = reports.groupBy(by.alias("_p")).agg(F.max(date).alias(date)).select(date)
    state = parts.staged(whole.join(ends, date, "left_semi").select(fields), history, by)
    changed = parts.staged(merged.where(by.isin(*touched)), history, by)
    parts.commit(spark, history, held, {ROWS: changed, STATE: state})
    return whole.where(F.col(date) >= F.lit(begin))


def changed_dates(updates: DataFrame, date: str = "d") -> DataFrame:
    """Dates that a batch rewrites."""
    return updates.select(F.col(date)).distinct()
