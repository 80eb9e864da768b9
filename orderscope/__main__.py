"""Command line: ``python -m orderscope audit|build ...`` (or the same via spark-submit)."""

from __future__ import annotations

import argparse

from orderscope.plans.jobs import run_build, run_file_audit
from orderscope.session import get_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orderscope")
    sub = parser.add_subparsers(dest="command", required=True)
    audit = sub.add_parser("audit", help="audit every raw CSV file of a folder")
    audit.add_argument("raw_dir")
    audit.add_argument("out_dir")
    build = sub.add_parser("build", help="land raw CSV files, build the model, write reports")
    build.add_argument("--raw", default=None, help="folder of raw CSV files to land first")
    build.add_argument("--strict", action="store_true", help="stop on failed integrity checks")
    build.add_argument(
        "--file",
        action="append",
        default=[],
        metavar="TABLE=NAME",
        help="raw file name of a table when it is not <table>.csv (repeatable)",
    )
    build.add_argument("landed_dir")
    build.add_argument("out_dir")
    parser.add_argument("--profile", default="default", choices=["default", "cluster"])
    args = parser.parse_args(argv)
    spark = get_session(profile=args.profile)
    if args.command == "audit":
        print(run_file_audit(spark, args.raw_dir, args.out_dir))
    else:
        file_names = dict(item.split("=", 1) for item in args.file)
        written = run_build(
            spark, args.raw, args.landed_dir, args.out_dir, strict=args.strict, file_names=file_names
        )
        for name, path in written.items():
            print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
