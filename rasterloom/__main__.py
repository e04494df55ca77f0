"""python -m rasterloom run PIPELINE.json --in A --out B [--quality N] [--quiet] | ops"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import RasterError
from .plans.spec import OPS, REQUIRED, Pipeline
from .session import Session
from .sources.images import format_of


def ops() -> str:
    """A line per operation with its parameters and defaults."""
    lines = []
    for name, params in OPS.items():
        parts = [key if p.default is REQUIRED else f"{key}={p.default}" if p.default is not None else f"[{key}]" for key, p in params.items()]
        lines.append(f"{name:20} {', '.join(parts)}".rstrip())
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("ops", help="list operations")
    one = sub.add_parser("run", help="run a pipeline over one image")
    one.add_argument("pipeline")
    one.add_argument("--in", dest="source", required=True)
    one.add_argument("--out", dest="target", required=True)
    one.add_argument("--quality", type=int, default=90)
    one.add_argument("--quiet", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "ops":
        print(ops())
        return 0
    try:
        format_of(args.target)  # before any work
        with open(args.pipeline) as f:
            pipeline = Pipeline.parse(f.read())
        session = Session(SparkSession.builder.appName("rasterloom").getOrCreate())
        result = session.run_pipeline(session.open_image(args.source).id, pipeline, measure=not args.quiet)
        session.export(result.id, args.target, args.quality)
    except (RasterError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not args.quiet:
        print(session.report(), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
