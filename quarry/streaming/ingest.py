"""Streams: pages into an index whose documents are replaced by their newer versions, events into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import stable_id
from quarry.operators.chunking import chunk_pages
from quarry.operators.extraction import numeric_values
from quarry.operators.models import Encoder, encoded, hashed_vectors
from quarry.sources.segments import Index, load_index, write_segment
from quarry.sources.shared import saved


def page_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def index_stream(pages: DataFrame, folder: str, checkpoint: str, encoder: Encoder | None = hashed_vectors, document: str = "document_id", number: str = "page", text: str = "text", version: str | None = None) -> StreamingQuery:
    """Keeps an index of segments for a stream of pages: chunks with postings, measured values and vectors of each
    document's newest version.  It processes what is there and ends.

    Every micro-batch is one segment, named by its number: a batch that is run again after a failure is written once.  A
    document that comes again replaces all that the index has of it, unless the index has the same or a later version
    (a column that orders deliveries, such as a time; without one, what comes later is newer).  A version comes whole
    in one batch.  Without an encoder there are no vectors.
    """

    def index(batch: DataFrame, number_of_batch: int) -> None:
        update_index(batch, folder, f"batch-{number_of_batch:09d}", encoder, document, number, text, version)

    return pages.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_index(pages: DataFrame, folder: str, name: str, encoder: Encoder | None = hashed_vectors, document: str = "document_id", number: str = "page", text: str = "text", version: str | None = None) -> Index | None:
    """One step of `index_stream`, for a table of pages: the index's new state, None where nothing has come yet."""
    spark = pages.sparkSession
    at = F.lit(None).cast("string") if version is None else F.col(version)
    given = pages.select(F.col(document).alias("document_id"), F.col(number).alias("number"), F.col(text).alias("text"), at.alias("version")).where("document_id IS NOT NULL").distinct()
    if version is not None:
        newest = given.groupBy("document_id").agg(F.max("version").alias("newest"))
        given = given.join(newest, "document_id").where(F.col("version").eqNullSafe(F.col("newest"))).drop("newest")
    try:
        before = load_index(spark, folder)
    except FileNotFoundError:
        before = None
    if before is not None and version is not None:
        known = before.live("chunks").groupBy("document_id").agg(F.max("version").alias("known"))
        given = given.join(known, "document_id", "left").where("known IS NULL OR version > known").drop("known")
    given = saved(given)
    if given.isEmpty():
        return before
    made = chunk_pages(given, "document_id", "number", "text").withColumnRenamed("document", "document_id")
    chunk_id = stable_id("chunk_", "document_id", "chunk", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12))
    versions = given.select("document_id", "version").distinct()
    chunks = saved(made.select(chunk_id.alias("chunk_id"), "document_id", F.col("first").alias("page_start"), F.col("last").alias("page_end"), "text").join(versions, "document_id"))
    owner = chunks.select("chunk_id", "document_id")
    values = numeric_values(chunks).join(owner, "chunk_id")
    vectors = None if encoder is None else encoded(chunks, encoder).join(owner, "chunk_id")
    # a document without a chunk any more is removed
    return write_segment(spark, folder, chunks, values, vectors, removed=versions.select("document_id"), name=name)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, for streams and tables alike: start, event_type, cnt.

    In a stream an event that comes more than `late` after the latest one seen doesn't count any more.
    """
    return _counts(events.withWatermark("ts", late), size)


def _counts(events: DataFrame, size: str) -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "event_type", "cnt")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events of a stream once each, however often they are delivered within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def window_stream(events: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes", size: str = "1 hour") -> StreamingQuery:
    """Appends the counts of each window to a folder once the watermark has passed its end; repeats count once.

    It processes what is there and ends; the state, in the checkpoint, holds the open windows, and the next start takes
    up there.  A window that is written is final.
    """
    counts = _counts(once(events.withColumn("ts", F.col("ts").cast("timestamp")), late=late), size)
    return counts.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
