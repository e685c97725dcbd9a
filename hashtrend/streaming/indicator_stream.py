"""Structured Streaming form of the engine.

One streaming query keeps Spark's event-time state small: posts are folded
into *panes*, one tumbling slide each, per ``(kind, tag, item)`` where
``kind = 'u'`` carries the author of a tag occurrence (with its counts and
reach), ``kind = 'n'`` a distinct co-occurring neighbour and ``kind = 't'`` is
the tick of a slide that had any post, tagged or not.  Append mode
emits a pane once the watermark passes its end, so the state holds about one
slide of keys, spread by tag and item.

``IndicatorSink`` (``foreachBatch``) appends the closed panes to a table and
computes every window end that just became complete, ``(previous frontier,
new frontier]``, with the *batch* operators over a bounded slice: panes of
the last ``analytic`` slides, shares of the last ``reference`` slides and
vectors of the last ``rec_window`` slides, read back from the tables it
wrote.  Batch and stream therefore agree on every closed window.

Every output is partitioned by ``(bucket, batch_id)`` and written with dynamic
partition overwrite, and history reads take ``batch_id < current`` only: a
replayed micro-batch (``foreachBatch`` is at-least-once) rewrites exactly its
own partitions and sees the same inputs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hashtrend.config import Windows
from hashtrend.functions.time import end_timestamp, slot_index
from hashtrend.operators import (
    PANE_COLUMNS,
    author_rows,
    base_from_panes,
    co_tags_from_pairs,
    delta_share,
    feature_vectors,
    fold_panes,
    neighbour_rows,
    pane_rows,
    percent_share,
    post_panes,
    recurrent_vectors,
    reference_share,
    slot_totals,
    top_n,
    with_first_degree,
    with_velocity,
)
from hashtrend.plans.tables import INDICATOR_COLUMNS
from hashtrend.session import use_rocksdb
from hashtrend.sources.messages import decode, drop_delete_notices

# Output files are grouped by slide bucket so that history reads prune whole
# directories; 1024 slides is 34 minutes at 2 s batches.
BUCKET_SLIDES = 1024

# Per-slide top-N tables written by default: volume (the reference's commented
# report) and delta share (the one report it prints).
DEFAULT_REPORTS = {"volume": 10, "delta_share": 10}


def _interval(us: int) -> str:
    return f"{us // 1_000_000} seconds" if us % 1_000_000 == 0 else f"{us} microseconds"


def pane_stream(posts: DataFrame, win: Windows, watermark: str = "0 seconds") -> DataFrame:
    """Streaming pane aggregate: ``(pane, kind, tag, item) -> n, fol, fri, rt``."""
    pane = F.window("ts", _interval(win.batch_us)).alias("pane")
    return fold_panes(pane_rows(posts.withWatermark("ts", watermark)), pane)


class IndicatorSink:
    """``foreachBatch`` handler writing panes, indicators and vectors under ``root``."""

    def __init__(self, root: str, win: Windows, reports: dict[str, int] | None = None, vector_report: int = 10):
        """``reports`` maps an indicator column, or ``first_degree_smoothed``, to the
        N of its per-slide top-N table (``top_<column>``, S5/O1/O2); ``vector_report`` is the N of the
        recurrent-vector report (``top_vectors``, O3; 0 turns it off)."""
        self.root = root.rstrip("/")
        self.win = win
        self.reports = dict(DEFAULT_REPORTS if reports is None else reports)
        self.vector_report = vector_report
        # (batch_id, frontier) of the last batch this process completed; the
        # progress table is read only after a restart.
        self._done: tuple[int, int | None] | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # -- storage helpers -------------------------------------------------
    def _write(self, df: DataFrame, name: str, batch_id: int, idx: str = "w_idx") -> None:
        (
            df.withColumn("bucket", F.call_function("div", F.col(idx), F.lit(BUCKET_SLIDES).cast("long")))
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch_id")
            .parquet(self.path(name))
        )

    def _existing(self, spark: SparkSession, paths: list[str]) -> list[str]:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for p in paths:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            if hp.getFileSystem(conf).exists(hp):
                out.append(p)
        return out

    def _read(self, spark: SparkSession, name: str, batch_id: int, idx: str, lo: int, hi: int) -> DataFrame | None:
        """Rows of ``name`` with ``lo <= idx <= hi`` written by batches up to
        ``batch_id`` (``hi`` inclusive; the bound makes replays deterministic).

        Only the bucket folders overlapping ``[lo, hi]`` are listed, so the
        cost of a read does not grow with the age of the stream.
        """
        base = self.path(name)
        b_lo, b_hi = lo // BUCKET_SLIDES, hi // BUCKET_SLIDES
        paths = self._existing(spark, [f"{base}/bucket={b}" for b in range(b_lo, b_hi + 1)])
        if not paths:
            return None
        try:
            df = spark.read.option("basePath", base).parquet(*paths)
        except AnalysisException:  # folders exist but hold no data files yet
            return None
        return df.where(
            F.col("bucket").between(b_lo, b_hi) & (F.col("batch_id") <= F.lit(batch_id)) & F.col(idx).between(lo, hi)
        ).drop("bucket", "batch_id")

    def _written(self, spark: SparkSession, name: str, batch_id: int, lo: int, hi: int, schema: T.StructType) -> DataFrame:
        """What this batch just wrote for the window ends ``lo..hi``: only its own
        folders are read, and a batch that wrote no row gives an empty frame."""
        buckets = range(lo // BUCKET_SLIDES, hi // BUCKET_SLIDES + 1)
        paths = self._existing(spark, [f"{self.path(name)}/bucket={b}/batch_id={batch_id}" for b in buckets])
        if not paths:
            return spark.createDataFrame([], schema)
        # a replay may have left rows of a wider range in the same folders
        return spark.read.schema(schema).parquet(*paths).where(F.col("w_idx").between(lo, hi))

    def _frontier_before(self, spark: SparkSession, batch_id: int) -> int | None:
        if self._done is not None and self._done[0] == batch_id - 1:
            return self._done[1]
        if not self._existing(spark, [self.path("progress")]):
            return None
        try:
            prog = spark.read.parquet(self.path("progress"))
        except AnalysisException:
            return None
        row = prog.where(F.col("batch_id") < batch_id).agg(F.max("frontier")).first()
        return row[0] if row else None

    # -- per micro-batch --------------------------------------------------
    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        win = self.win
        self.advance(batch.select(slot_index(F.col("pane.start"), win.batch_us).alias("slot"), *PANE_COLUMNS[1:]), batch_id)

    def advance(self, panes: DataFrame, batch_id: int, beyond: int = 0) -> None:
        """Store ``panes`` and compute the window ends they complete, and ``beyond`` more."""
        spark = panes.sparkSession
        panes = panes.persist()
        try:
            self._write(panes, "panes", batch_id, idx="slot")
            # Panes leave the state in watermark order, so this batch holds the
            # newest closed pane: every window ending at or before its end is
            # complete.
            bounds = panes.agg(F.min("slot"), F.max("slot")).first()
        finally:
            panes.unpersist()
        prev = self._frontier_before(spark, batch_id)
        newest = bounds[1]
        if newest is None and beyond and prev is not None:
            newest = prev - 1
        if newest is None:
            self._progress(spark, batch_id, prev)
            return
        hi = newest + 1 + beyond
        lo = prev + 1 if prev is not None else bounds[0] + 1
        if hi < lo:
            self._progress(spark, batch_id, prev)
            return
        self._compute(spark, batch_id, lo, hi)
        self._progress(spark, batch_id, hi)

    def _progress(self, spark: SparkSession, batch_id: int, frontier: int | None) -> None:
        self._done = (batch_id, frontier)
        schema = T.StructType([T.StructField("frontier", T.LongType())])
        df = spark.createDataFrame([(frontier,)], schema).withColumn("batch_id", F.lit(batch_id).cast("long"))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
            self.path("progress")
        )

    def _compute(self, spark: SparkSession, batch_id: int, lo: int, hi: int) -> None:
        """Window ends ``lo..hi`` (inclusive), all complete."""
        win = self.win
        in_range = F.col("w_idx").between(lo, hi)
        panes = self._read(spark, "panes", batch_id, "slot", lo - win.analytic, hi - 1)
        authors = author_rows(panes)
        base = with_velocity(base_from_panes(authors, win)).where(in_range)
        pairs = co_tags_from_pairs(neighbour_rows(panes), win).where(in_range)
        totals = slot_totals(authors, win, weight="n").where(in_range)
        # One micro-batch of rows, used three times: the history's tags, the frame and the output.
        wide = percent_share(with_first_degree(pairs, base), totals).persist()
        try:
            framed = wide
            hist = self._read(spark, "indicators", batch_id - 1, "w_idx", lo - win.reference + 1, lo - 1)
            if hist is not None:
                # Only tags with a row to write need their past shares.
                past = hist.select("w_idx", "tag", "percent_share").join(wide.select("tag").distinct(), "tag", "left_semi")
                framed = wide.unionByName(past, allowMissingColumns=True)
            ind = delta_share(reference_share(framed, win).where(in_range)).select("w_idx", "tag", *INDICATOR_COLUMNS)
            ind = ind.withColumn("w_end", end_timestamp("w_idx", win.batch_us))
            self._write(ind, "indicators", batch_id)
        finally:
            wide.unpersist()

        vec_cols = ["w_idx", "tag", "volume", "unique_users", "activeness", "first_degree"]
        ind_now = self._written(spark, "indicators", batch_id, lo, hi, ind.schema)
        ind_all = ind_now.select(*vec_cols)
        ind_hist = self._read(spark, "indicators", batch_id - 1, "w_idx", lo - win.analytic + 1, lo - 1)
        if ind_hist is not None:
            ind_all = ind_all.unionByName(ind_hist.select(*vec_cols))
        fv = feature_vectors(ind_all, win).where(in_range)
        fv = fv.withColumn("w_end", end_timestamp("w_idx", win.batch_us))
        self._write(fv, "feature_vectors", batch_id)

        fv_now = self._written(spark, "feature_vectors", batch_id, lo, hi, fv.schema)
        fv_all = fv_now.select("w_idx", "tag", "features")
        fv_hist = self._read(spark, "feature_vectors", batch_id - 1, "w_idx", lo - win.rec_window + 1, lo - 1)
        if fv_hist is not None:
            fv_all = fv_all.unionByName(fv_hist.select("w_idx", "tag", "features"))
        # Slides with vectors come straight from the stored feature vectors.
        live = fv_all.select("w_idx").distinct()
        rv = recurrent_vectors(fv_all, win, live=live).where(in_range)
        rv = rv.withColumn("w_end", end_timestamp("w_idx", win.batch_us))
        self._write(rv, "recurrent_vectors", batch_id)

        # Reports read the rows just written (small, bounded per slide).
        for metric, n in self.reports.items():
            rep = top_n(fv_now if metric == "first_degree_smoothed" else ind_now, metric, n)
            self._write(rep.withColumn("w_end", end_timestamp("w_idx", win.batch_us)), f"top_{metric}", batch_id)
        if self.vector_report:
            rv_written = self._written(spark, "recurrent_vectors", batch_id, lo, hi, rv.schema)
            newest = (win.rec_window - 1) * win.n_features
            rep = top_n(
                rv_written.withColumn("newest_volume", F.col("features")[newest]),
                "newest_volume",
                self.vector_report,
                carry=["features"],
            )
            self._write(rep.withColumn("w_end", end_timestamp("w_idx", win.batch_us)), "top_vectors", batch_id)


def posts_stream_from_json_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Landed tweet JSON lines as a stream of ``(posts, bad_records)``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path).select(F.lit(None).cast("string").alias("key"), "value")
    return decode(drop_delete_notices(raw))


def start_indicator_stream(
    posts: DataFrame,
    out_dir: str,
    win: Windows,
    *,
    watermark: str = "0 seconds",
    checkpoint: str | None = None,
    trigger: dict | None = None,
    query_name: str | None = None,
    rocksdb: bool = True,
    reports: dict[str, int] | None = None,
) -> StreamingQuery:
    """Start the pane aggregate with :class:`IndicatorSink` as its sink.

    ``checkpoint`` defaults to ``<out_dir>/_checkpoint``, which a restarted
    application finds again.  An ``out_dir`` that already holds tables but not
    that checkpoint belongs to another query and is refused, as its rows would
    be written a second time under other batch ids.  With ``rocksdb``
    the pane state lives in RocksDB (off-heap, spills to local disk,
    checkpointed to ``checkpoint``) unless the session already names a state
    store provider.
    """
    spark = posts.sparkSession
    if rocksdb:
        use_rocksdb(spark)
    checkpoint = checkpoint or f"{out_dir.rstrip('/')}/_checkpoint"
    sink = IndicatorSink(out_dir, win, reports=reports)
    if sink._existing(spark, [sink.path("progress")]) and not sink._existing(spark, [checkpoint]):
        raise ValueError(f"{out_dir} holds the tables of a stream whose checkpoint is not {checkpoint}")
    if sink._existing(spark, [sink.path("flushed")]):
        raise ValueError(f"{out_dir} was closed by flush_stream")
    writer = (
        pane_stream(posts, win, watermark)
        .writeStream.outputMode("append")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
    )
    if query_name:
        writer = writer.queryName(query_name)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def flush_stream(posts: DataFrame, out_dir: str, win: Windows, *, reports: dict[str, int] | None = None) -> None:
    """Write the windows a stopped stream over bounded input still owes.

    ``posts`` is the whole input as a batch frame.  Its slides at or after the
    frontier, whose panes the watermark never closed, are folded and every
    window end up to the last one holding data is computed, smoothed and
    recurrent windows included, so the tables then equal the batch engine's.
    (A post that the stream dropped as late is counted only if its slide is at
    or after the frontier.)  The output is closed by it: a stream cannot go on
    from there.  A second call writes the same rows again.
    """
    spark = posts.sparkSession
    sink = IndicatorSink(out_dir, win, reports=reports)
    closing = T.StructType([T.StructField("batch_id", T.LongType())])
    mark = sink.path("flushed")
    if not sink._existing(spark, [mark]):
        last = None
        if sink._existing(spark, [sink.path("progress")]):
            stored = spark.read.schema("frontier long, batch_id long").parquet(sink.path("progress"))
            last = stored.agg(F.max("batch_id")).first()[0]
        # Written first: from here on the batch id belongs to the flush.
        spark.createDataFrame([(0 if last is None else last + 1,)], closing).write.parquet(mark)
    batch_id = spark.read.schema(closing).parquet(mark).first().batch_id
    frontier = sink._frontier_before(spark, batch_id)
    panes = post_panes(posts, win)
    if frontier is not None:
        panes = panes.where(F.col("slot") >= frontier)
    sink.advance(panes, batch_id, beyond=2 * (win.analytic - 1) + win.rec_window - 1)


def start_bad_record_sink(
    bad: DataFrame, out_dir: str, *, checkpoint: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Malformed messages to parquet (stateless append)."""
    checkpoint = checkpoint or f"{out_dir.rstrip('/')}/_checkpoint"
    writer = bad.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def main(argv: list[str] | None = None) -> None:
    """Run the indicator stream (the reference's long-running application).

    python -m hashtrend.streaming.indicator_stream --json-lines /landing/tweets --out /shared/trends
    python -m hashtrend.streaming.indicator_stream --kafka host:9092 --topic Tweet --out /shared/trends
    """
    import argparse

    from hashtrend.session import ensure_engine_conf
    from hashtrend.sources.messages import read_kafka

    ap = argparse.ArgumentParser(description="hashtag indicator stream")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--json-lines", help="folder receiving tweet JSON-lines files")
    src.add_argument("--kafka", help="bootstrap servers")
    ap.add_argument("--topic", default="Tweet")
    ap.add_argument("--out", required=True)
    ap.add_argument("--batch", default="2 seconds")
    ap.add_argument("--watermark", default="10 seconds")
    ap.add_argument("--trigger", default="10 seconds", help="processing-time trigger interval")
    ap.add_argument("--checkpoint", help="checkpoint of the indicator query (default: <out>/_checkpoint)")
    ap.add_argument("--reports", default="volume=10,delta_share=10", help="indicator=N top-N tables, comma separated")
    ap.add_argument("--master", help="only when not launched by spark-submit")
    args = ap.parse_args(argv)

    builder = SparkSession.builder.appName("hashtrend-stream")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    ensure_engine_conf(spark)
    if args.json_lines:
        posts, bad = posts_stream_from_json_lines(spark, args.json_lines)
    else:
        posts, bad = decode(drop_delete_notices(read_kafka(spark, args.kafka, args.topic)))
    trigger = {"processingTime": args.trigger}
    out = args.out.rstrip("/")
    start_bad_record_sink(bad, f"{out}/bad_records", trigger=trigger)
    reports = {k: int(n) for k, n in (r.split("=") for r in args.reports.split(",") if r)}
    start_indicator_stream(
        posts, out, Windows(batch=args.batch), watermark=args.watermark, trigger=trigger, checkpoint=args.checkpoint, reports=reports
    )
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
