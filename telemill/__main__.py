"""Runs the pipelines of a configuration file: python -m telemill --config FILE [--stream].

Under spark-submit the session's master and settings come from the command line;
spark.checkpoint.dir must name a folder that all nodes share.
"""

from __future__ import annotations

import argparse
import os

from telemill.plans import config, pipeline
from telemill.session import build_session, ensure_checkpoint_dir
from telemill.streaming.progress import ProgressCounters, serve


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="telemill", description=__doc__)
    p.add_argument("--config", default=os.environ.get("TELEMILL_CONFIG", "config.yaml"), help="pipelines, as YAML")
    p.add_argument("--pipeline", action="append", help="run only these; all by default")
    p.add_argument("--landing", help="folder in which a gateway lands what network receivers and topics get, by component")
    p.add_argument("--checkpoint", help="folder of the streams' checkpoints; a folder of spark.checkpoint.dir by default")
    p.add_argument("--stream", action="store_true", help="run as streams until they end or are stopped; else one batch")
    p.add_argument("--interval", help="processing time between micro-batches, as 10 seconds; without it a stream ends with what is there")
    p.add_argument("--lateness", type=float, default=600.0, help="seconds that records may be late")
    p.add_argument("--metrics-addr", default=os.environ.get("TELEMILL_METRICS_ADDR", ""), help="host:port of /metrics, /livez and /readyz")
    p.add_argument("--master", help="Spark master, for runs without spark-submit")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    made = pipeline.build(config.load(args.config), args.landing)
    unknown = set(args.pipeline or ()) - set(made)
    if unknown:
        raise config.ConfigError(f"unknown pipelines {', '.join(sorted(unknown))}")
    chosen = {n: p for n, p in made.items() if not args.pipeline or n in args.pipeline}
    spark = build_session("telemill", args.master)
    counters = ProgressCounters()
    spark.streams.addListener(counters)
    server = serve(counters, args.metrics_addr) if args.metrics_addr else None
    try:
        if not args.stream:
            for name, p in chosen.items():
                with counters.batch(name):
                    p.run_batch(p.source(spark))
            return 0
        root = (args.checkpoint or f"{ensure_checkpoint_dir(spark)}/streams").rstrip("/")
        trigger = {"processingTime": args.interval} if args.interval else None
        runs = [p.run_stream(spark, f"{root}/{name}", trigger, args.lateness, name) for name, p in chosen.items()]
        for run in runs:
            run.awaitTermination()
        return 0
    finally:
        spark.streams.removeListener(counters)
        if server is not None:
            server.shutdown()


if __name__ == "__main__":
    raise SystemExit(main())
