"""Batch job: posts -> pane, indicator, feature-vector, recurrent-vector and report tables.

The posts are read once, into the pane table.  Each table is written once and
the next one reads it back, so lineage is cut at every stage (a lost executor
recomputes from the last written table, not from the raw posts) and the wide
indicator aggregate is never computed twice.  Tables are partitioned by a bucket
of slides so time-range readers prune directories, and rows are dealt by bucket
before they are written, so a bucket is a few files whatever the task count.

    python -m hashtrend.plans.job --events /data/events.parquet --out /shared/hashtrend [--batch "1 hour"]
    python -m hashtrend.plans.job --messages /landing/tweets/ --out /shared/hashtrend --reports volume=10,delta_share=10
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.functions.time import end_timestamp
from hashtrend.operators import feature_vectors, post_panes, recurrent_vectors, top_n
from hashtrend.plans.tables import IndicatorTables
from hashtrend.session import ensure_engine_conf
from hashtrend.sources import decode, drop_delete_notices, posts_from_events, read_json_lines

BUCKET_SLIDES = 1024

# Parts of a bucket while it is written: a busy bucket is several tasks and files.
BUCKET_PARTS = 16

DEFAULT_REPORTS = {"volume": 10, "delta_share": 10}


def _write(df: DataFrame, path: str, win: Windows, idx: str = "w_idx") -> None:
    if idx == "w_idx":
        df = df.withColumn("w_end", end_timestamp("w_idx", win.batch_us))
    (
        df.withColumn("bucket", F.call_function("div", F.col(idx), F.lit(BUCKET_SLIDES).cast("long")))
        .repartition("bucket", F.pmod(F.hash("tag"), F.lit(BUCKET_PARTS)))
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def run(
    spark: SparkSession,
    posts: DataFrame,
    out_dir: str,
    win: Windows,
    reports: dict[str, int] | None = None,
    vector_report: int = 10,
) -> dict[str, str]:
    """Write every table and return their paths.

    ``reports`` maps an indicator column, or ``first_degree_smoothed``, to the N
    of its per-slide top-N table ``top_<column>`` (default: volume and delta
    share); ``vector_report`` is the N of ``top_vectors`` (0: none).
    """
    ensure_engine_conf(spark)
    out = out_dir.rstrip("/")
    paths = {n: f"{out}/{n}" for n in ("panes", "indicators", "feature_vectors", "recurrent_vectors")}
    _write(post_panes(posts, win), paths["panes"], win, idx="slot")

    panes = spark.read.parquet(paths["panes"]).drop("bucket")
    _write(IndicatorTables.from_panes(panes, win).indicators, paths["indicators"], win)

    ind = spark.read.parquet(paths["indicators"]).drop("bucket", "w_end")
    _write(feature_vectors(ind, win), paths["feature_vectors"], win)

    fv = spark.read.parquet(paths["feature_vectors"]).drop("bucket", "w_end")
    _write(recurrent_vectors(fv.select("w_idx", "tag", "features"), win), paths["recurrent_vectors"], win)

    for metric, n in (DEFAULT_REPORTS if reports is None else reports).items():
        paths[f"top_{metric}"] = f"{out}/top_{metric}"
        _write(top_n(fv if metric == "first_degree_smoothed" else ind, metric, n), paths[f"top_{metric}"], win)
    if vector_report:
        rv = spark.read.parquet(paths["recurrent_vectors"]).drop("bucket", "w_end")
        newest = F.col("features")[(win.rec_window - 1) * win.n_features]
        paths["top_vectors"] = f"{out}/top_vectors"
        ranked = top_n(rv.withColumn("newest_volume", newest), "newest_volume", vector_report, carry=["features"])
        _write(ranked, paths["top_vectors"], win)
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--events", help="events parquet (posts derived as in FIXTURES.md)")
    src.add_argument("--messages", help="folder of tweet JSON lines")
    ap.add_argument("--out", required=True)
    ap.add_argument("--batch", default="2 seconds")
    ap.add_argument("--reports", default="volume=10,delta_share=10", help="indicator=N top-N tables, comma separated")
    ap.add_argument("--master", help="only when not launched by spark-submit, e.g. local[8]")
    args = ap.parse_args(argv)

    builder = SparkSession.builder.appName("hashtrend-batch")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    win = Windows(batch=args.batch)
    if args.events:
        posts = posts_from_events(spark.read.parquet(args.events))
    else:
        posts, bad = decode(drop_delete_notices(read_json_lines(spark, args.messages)))
        bad.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/bad_records")
    reports = {k: int(n) for k, n in (r.split("=") for r in args.reports.split(",") if r)}
    run(spark, posts, args.out, win, reports)


if __name__ == "__main__":
    main()
