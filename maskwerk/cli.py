"""Command line: spark-submit maskwerk/cli.py COMMAND ... (or python -m maskwerk.cli)."""

from __future__ import annotations

import argparse
import getpass
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwerk.operators import audit
from maskwerk.profiles import Profile, listed
from maskwerk.sources import files
from maskwerk.streaming import folder

MISSING = 3


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskwerk")
    out.add_argument("--root", default="profiles")
    out.add_argument("--profile", default="default")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("anonymize", "deanonymize"):
        c = commands.add_parser(name)
        c.add_argument("input", nargs="?", help="a path; without, --text or standard input")
        c.add_argument("--text")
        c.add_argument("--output", help="a folder for Parquet; without, lines of JSON")
    commands.add_parser("profiles")
    c = commands.add_parser("set")
    c.add_argument("key")
    c.add_argument("value", nargs="?")
    c = commands.add_parser("audit")
    c.add_argument("what", choices=["verify", "export"])
    c.add_argument("path", nargs="?")
    c = commands.add_parser("watch")
    for a in ("inbox", "output", "quarantine", "checkpoint"):
        c.add_argument(a)
    c.add_argument("--forever", action="store_true")
    commands.add_parser("doctor")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("maskwerk").getOrCreate()
    if args.command == "profiles":
        print("\n".join(listed(spark, args.root)))
        return 0
    profile = Profile(spark, args.root, args.profile, os.environ.get("MASKWERK_PASSWORD") or getpass.getpass())
    if args.command in ("anonymize", "deanonymize"):
        if args.input:
            segments = files.reader_for(args.input)(spark, args.input)
        else:
            text = args.text if args.text is not None else sys.stdin.read()
            segments = spark.createDataFrame([("-", 0, text)], "doc_id string, seg_no long, text string")
        forward = args.command == "anonymize"
        out = profile.anonymize(segments) if forward else profile.deanonymize(segments)
        rows = out.select("doc_id", "seg_no", F.col("anonymized" if forward else "restored").alias("output"), "entity_counts", *([] if forward else ["missing"]))
        if args.output:
            rows.write.parquet(args.output)
        else:
            for line in rows.orderBy("doc_id", "seg_no").toJSON().toLocalIterator():
                print(line)
        return MISSING if not forward and not out.filter(F.size("missing") > 0).isEmpty() else 0
    if args.command == "set":
        profile.set(args.key, args.value)
    elif args.command == "audit":
        log = profile.log()
        if args.what == "export" and log is not None:
            audit.export_csv(log, args.path)
        else:
            ok = log is None or audit.verify(log)
            print("chain is whole" if ok else "CHAIN IS BROKEN")
            return 0 if ok else 1
    elif args.command == "watch":
        folder.watch(spark, args.inbox, args.output, args.quarantine, profile.store, args.checkpoint, once=not args.forever).awaitTermination()
    elif args.command == "doctor":
        text = "Frau Eva Muster, AT61 1904 3002 3457 3201, eva@muster.at"
        found = profile.preview(spark.createDataFrame([(1, 0, text)], "doc_id long, seg_no long, text string")).first()["spans"]
        result = {"profile": profile.name, **profile.summary(), "detects": sorted({s["category"] for s in found})}
        print(json.dumps(result))
        return 0 if {"IBAN", "EMAIL", "PERSON"} <= set(result["detects"]) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
