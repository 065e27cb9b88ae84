"""Command line: preprocess, index, query, evaluate, run-all."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reelspan import engine as en
from reelspan.settings import Settings, load_settings
from reelspan.sources import index, media, segments


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reelspan", description="Find the span of a video in which a sentence happens.")
    p.add_argument("--config", help="YAML file of settings")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("preprocess", help="scenes of all videos").add_argument("--scores", help="table of frame scores; else videos are decoded")
    verbs.add_parser("index", help="vectors of all scenes").add_argument("--force", action="store_true")
    q = verbs.add_parser("query", help="answer one query")
    q.add_argument("text")
    e = verbs.add_parser("evaluate", help="score annotated queries")
    a = verbs.add_parser("run-all", help="all of these")
    a.add_argument("--scores")
    a.add_argument("--force", action="store_true")
    a.add_argument("--text", action="append", default=[])
    for x in (e, a):
        x.add_argument("--gold", required=x is e, help="table of query_id, query_text, video, gt_start, gt_end, query_type")
    for x in (q, e, a):
        x.add_argument("--top-k", type=int)
        x.add_argument("--merge-gap", type=float)
    return p


def _encoder(settings: Settings) -> index.Encoder:
    if settings.models.text_model == "hashing":
        return index.HashingEncoder()
    try:
        return index.sentence_encoder(settings.models.text_model, settings.models.device)
    except ImportError:
        raise SystemExit("reelspan: sentence-transformers is missing; models.text_model: hashing matches texts by hashed words") from None


def _pair(make: Callable[..., index.Encoder], model: str, kind: str, **options) -> tuple[index.Encoder, index.Encoder] | None:  # noqa: ANN003
    """Encoders of files and of queries, or None where the library is missing."""
    try:
        return make(model, kind, **options), make(model, "text", **options)
    except ImportError:
        print(f"reelspan: transformers is missing, {kind} counts for nothing", file=sys.stderr)
        return None


def _engine(spark: SparkSession, s: Settings, force: bool = False) -> en.Engine:
    root = s.paths.output_root
    videos = media.list_videos(spark, s.paths.video_root, s.preprocessing.suffixes, s.preprocessing.name_filter)
    image = _pair(index.clip_encoder, s.models.clip_model, "image", device=s.models.device)
    audio = _pair(index.clap_encoder, s.audio.model, "audio", rate=s.audio.sample_rate, device=s.models.device) if s.audio.enabled else None
    frames, sounds = en.samplers(videos, s, image and image[0], audio and audio[0])
    return en.text_engine(spark, segments.read_parquet(spark, f"{root}/segments"), en.subtitle_lines(spark, s, videos), _encoder(s), f"{root}/index", s, force, image, audio, frames, sounds, media.durations(videos))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    s = load_settings(args.config) if args.config else Settings()
    spark = spark or SparkSession.builder.appName("reelspan").getOrCreate()
    root = s.paths.output_root
    if args.verb in ("preprocess", "run-all"):
        made = en.preprocess(spark, s, spark.read.parquet(args.scores) if args.scores else None)
        segments.write_parquet(made, f"{root}/segments")
        print(json.dumps(segments.stats(segments.read_parquet(spark, f"{root}/segments")).first().asDict()))
    if args.verb in ("index", "run-all"):
        _engine(spark, s, args.force)
    if args.verb == "query":
        print(json.dumps(_engine(spark, s).answer(args.text, args.top_k, args.merge_gap), ensure_ascii=False))
    if args.verb == "run-all":
        for text in args.text:
            _engine(spark, s).show(text, args.top_k, args.merge_gap)
    if args.verb == "evaluate" or args.verb == "run-all" and args.gold:
        gold = spark.read.parquet(args.gold).withColumn("query_id", F.col("query_id").cast("int"))
        rows, summary = _engine(spark, s).evaluate(gold, args.top_k, args.merge_gap)
        segments.write_csv(rows, f"{root}/evaluation_final")
        summary.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
