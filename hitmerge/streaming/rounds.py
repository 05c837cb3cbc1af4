"""Rounds as streams of landed rows: incremental merge, deadline, status and late rows of closed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hitmerge import fixed_values as fv
from hitmerge import schemas
from hitmerge.operators.hits import drop_blank_urls, pool_order, with_rank
from hitmerge.operators.kept_dedup import KeptDedup
from hitmerge.operators.reach import with_target
from hitmerge.session import cut_lineage
from hitmerge.streaming.keyed import ANSWER, MERGED_HIT, MergedHit, RoundLedger, as_hits, start_keyed

STREAM_ROW = schemas.RAW_HITS + ", round_start timestamp, arrived_at timestamp"
RAW_COLUMNS = ["query_id", "query", "engine", "ord", "rank", "title", "url", "snippet", "date", "signals"]


def read_rows(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(STREAM_ROW)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def within_deadline(rows: DataFrame, seconds: int = fv.ROUND_DEADLINE_SECONDS) -> DataFrame:
    """Rows that arrived before their round ended; what was received is kept."""
    return rows.filter(F.col("arrived_at") <= F.col("round_start") + F.expr(f"INTERVAL {seconds} SECONDS"))


def after_deadline(rows: DataFrame, seconds: int = fv.ROUND_DEADLINE_SECONDS) -> DataFrame:
    return rows.filter(F.col("arrived_at") > F.col("round_start") + F.expr(f"INTERVAL {seconds} SECONDS"))


def merged_hits(rows: DataFrame) -> DataFrame:
    """Stream of hits as they are made and changed by the rows of each batch, one row per changed (query, URL).

    State is kept by (query, URL), a few fields per engine that names the URL: a busy query is spread over all tasks, and a
    batch reads and writes the state of its own URLs only."""
    flat = with_rank(drop_blank_urls(rows)).select("query_id", "url", "engine", "ord", "rank", "title", "snippet", "date", "signals.*")
    return flat.groupBy("query_id", "url").transformWithState(MergedHit(), MERGED_HIT, "Update", "None")


def merge_stream(rows: DataFrame, table_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the pools of all queries up to date: each micro-batch writes the hits that it made or changed, nothing else.

    A repeated batch replaces itself. ``trigger`` as in ``DataStreamWriter.trigger``."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/changes/batch={batch_id}")

    return start_keyed(merged_hits(rows).writeStream.outputMode("update").foreachBatch(store), rows.sparkSession, checkpoint, **trigger)


def dedup_stream(rows: DataFrame, kept: KeptDedup, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge and deduplicate as rows come: of each micro-batch the changed hits, and the components of near copies they touch."""
    def store(batch: DataFrame, batch_id: int) -> None:
        changed = cut_lineage(as_hits(batch))
        if not changed.isEmpty():
            kept.add(changed, batch_id)

    return start_keyed(merged_hits(rows).writeStream.outputMode("update").foreachBatch(store), rows.sparkSession, checkpoint, **trigger)


def current_hits(spark: SparkSession, table_path: str) -> DataFrame:
    """Last state of every hit merged so far."""
    changes = spark.read.schema(MERGED_HIT + ", batch bigint").parquet(f"{table_path}/changes")
    rest = [c for c in changes.columns if c not in ("query_id", "url", "batch")]
    return changes.groupBy("query_id", "url").agg(F.max_by(F.struct(*rest), "batch").alias("hit")).select("query_id", "url", "hit.*")


def current_pool(spark: SparkSession, table_path: str) -> DataFrame:
    """Exact-URL pool over everything merged so far."""
    return pool_order(as_hits(current_hits(spark, table_path)))


def new_hosts(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of hosts to test, each once while the watermark remembers it; available as soon as
    the first engine that names the host has answered."""
    return with_target(rows).filter("host is not null").withWatermark("arrived_at", delay) \
        .dropDuplicatesWithinWatermark(["host", "port"]).select("host", "port", "arrived_at")


def with_verdicts(rows: DataFrame, verdicts: DataFrame, seconds: int = fv.ROUND_DEADLINE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Stream of rows joined with the verdicts of their hosts as these come in: ``reachable`` is true if a good verdict of the host
    was made up to the deadline of the row's round. Each row comes once: at once with its verdict, or without one (dropped)
    as soon as the watermarks say that none can come in time. A row whose URL names no host has no verdict to wait for; it is
    dropped with the others. Verdicts made before a round count for it while they are ``2 * delay`` old at most.

    Rows and verdicts are kept in state only as long as they can still meet, by (host, port).

    :param rows: landed rows with ``round_start`` and ``arrived_at``
    :param verdicts: ``host``, ``port``, ``ok``, ``tested_at``; a row that several good ones meet still comes once, so rows are
        told apart by query, engine, place, URL and round
    """
    good = verdicts.where("ok").withWatermark("tested_at", delay).select(F.col("host").alias("v_host"), F.col("port").alias("v_port"), "tested_at")
    named = with_target(rows).withColumns({"host": F.coalesce("host", F.lit("")), "port": F.coalesce("port", F.lit(""))}) \
        .withWatermark("round_start", delay)
    meet = F.expr(f"host = v_host AND port = v_port AND tested_at >= round_start - 2 * INTERVAL {delay} "
                  f"AND tested_at <= round_start + INTERVAL {seconds} SECONDS")
    return named.join(good, meet, "left_outer").withColumn("reachable", F.col("v_host").isNotNull()).drop("v_host", "v_port", "tested_at") \
        .dropDuplicates(["query_id", "engine", "ord", "url", "round_start"])


def closed_status(rows: DataFrame, asked: DataFrame, seconds: int = fv.ROUND_DEADLINE_SECONDS,
                  delay: str = "1 minute") -> DataFrame:
    """Status of every engine of a round once the watermark has passed the round's deadline: rows in time (up to
    the cap), rows too late, latency of the last row in time, and an error for an engine that answered late or never.

    ``asked`` is the stream of (query_id, engine, round_start) of the requests; it gives silent engines their row.
    Coherence is not judged here: a round cut by its deadline has none."""
    late = F.col("arrived_at") > F.col("round_start") + F.expr(f"INTERVAL {seconds} SECONDS")
    in_time = F.col("arrived_at").isNotNull() & ~late
    seen = ["query_id", "engine", "round_start", "arrived_at"]
    events = rows.select(*seen).unionByName(asked.select(*seen[:3], F.lit(None).cast("timestamp").alias("arrived_at")))
    # The round itself is the event time: it closes when later rounds have moved the watermark on.
    return events.withWatermark("round_start", delay) \
        .groupBy(F.window("round_start", f"{seconds} seconds"), "query_id", "engine").agg(
            F.count_if(in_time).alias("in_time"), F.count_if(late).alias("too_late"),
            F.max(F.when(in_time, F.unix_millis("arrived_at") - F.unix_millis("round_start"))).alias("latency_ms")) \
        .select("query_id", "engine", F.col("window.start").alias("round_window"),
                (F.col("in_time") > 0).alias("ok"),
                F.least("in_time", F.lit(fv.PER_ENGINE_CAP)).alias("count"), "too_late", "latency_ms",
                F.when(F.col("in_time") == 0, fv.ABANDONED).otherwise("").alias("error"),
                F.lit(None).cast("double").alias("coherence"))


def ledger(rows: DataFrame, asked: DataFrame, seconds: int = fv.ROUND_DEADLINE_SECONDS, delay: str = "1 minute",
           forget: int = 3600) -> DataFrame:
    """One stream of the outcome of rounds: a status row for each asked engine, when the watermark passes the round's deadline,
    and every row that arrived after the deadline, as it comes.

    A timer in event time closes an engine's part of a round, so silent and late engines get their row like the others, once;
    what comes later is only a late row. Rows may come out of order by ``delay``; Spark drops older ones and counts them in its
    progress.

    :param rows: landed rows with ``round_start`` and ``arrived_at``
    :param asked: stream of ``query_id``, ``engine``, ``round_start`` of the requests
    :param forget: seconds after the deadline for which a closed part is remembered
    :return: ``ANSWER`` columns; ``kind`` is status or late
    """
    key = ["query_id", "engine", "round_start"]
    seen = rows.select(*key, "arrived_at", F.to_json(F.struct(*[c for c in RAW_COLUMNS if c not in key])).alias("row"))
    gone = asked.select(*key, F.lit(None).cast("timestamp").alias("arrived_at"), F.lit(None).cast("string").alias("row"))
    events = seen.unionByName(gone).withColumn("at", F.coalesce("arrived_at", "round_start")).withWatermark("at", delay) \
        .withColumn("after_ms", F.unix_millis("arrived_at") - F.unix_millis("round_start")) \
        .withColumn("deadline_ms", F.unix_millis("round_start") + seconds * 1000)
    return events.groupBy(*key).transformWithState(RoundLedger(seconds * 1000, forget * 1000), ANSWER, "Append", "EventTime")


def ledger_stream(outcome: DataFrame, table_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the status rows and the late rows of ``ledger`` as two tables; a repeated batch replaces its own."""
    def store(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.where("kind = 'status'").write.mode("overwrite").parquet(f"{table_path}/status/batch={batch_id}")
        kept.where("kind = 'late'").write.mode("overwrite").parquet(f"{table_path}/late/batch={batch_id}")
        kept.unpersist()

    return start_keyed(outcome.writeStream.outputMode("append").foreachBatch(store), outcome.sparkSession, checkpoint, **trigger)


def round_status(spark: SparkSession, table_path: str) -> DataFrame:
    """Status of every asked engine of the rounds closed so far; coherence is not judged for rounds cut by their deadline."""
    s = spark.read.schema(ANSWER).parquet(f"{table_path}/status")
    silent = F.col("outcome") != "ok"
    return s.select("query_id", "engine", "round_start", "outcome", (~silent).alias("ok"), F.least("in_time", F.lit(fv.PER_ENGINE_CAP)).alias("count"),
                    "too_late", "latency_ms", F.when(silent, fv.ABANDONED).otherwise("").alias("error"), F.lit(None).cast("double").alias("coherence"))


def late_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """Rows that came after the deadline of their round, as they were landed."""
    s = spark.read.schema(ANSWER).parquet(f"{table_path}/late")
    return s.withColumn("r", F.from_json("row", schemas.RAW_HITS)).select(
        *[F.col(c) if c in ("query_id", "engine") else F.col(f"r.{c}") for c in RAW_COLUMNS], "round_start", "arrived_at")
