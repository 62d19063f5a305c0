"""Command line: ingest, detect, triage, policy, eval, stats."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .operators import metrics
from .plans import jobs, render
from .plans.store import Store
from .sources import codeowners, corpus, diff, junit


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="runsieve", description=__doc__)
    top.add_argument("--store", default="history", help="folder of the tables")
    top.add_argument("--config", help="TOML file of settings")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="add a run's result files")
    p.add_argument("results", nargs="+", help="files, globs or folders")
    p.add_argument("--sha", required=True)
    p.add_argument("--run-id", required=True)
    p.add_argument("--attempt", type=int, default=1)
    p.add_argument("--started-at", help="ISO 8601; UTC without a zone; now by default")
    p.add_argument("--diff", help="patch file")
    for name in ("branch", "shard", "worker"):
        p.add_argument(f"--{name}", default="")
    for name, text in (("detect", "verdicts"), ("triage", "verdicts and causes")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--since", help="30d, 12h, ...")
        p.add_argument("--sha", help="only tests that failed at this commit")
        p.add_argument("--format", choices=("table", "json", "markdown"), default="table")
        p.add_argument("--all", action="store_true", help="healthy tests too")
        p.add_argument("--out", help="write JSON lines there instead, for any number of tests")
    p = sub.add_parser("policy", help="quarantine decisions")
    p.add_argument("--root", default=".", help="where to look for the code-owners file")
    p.add_argument("--apply", action="store_true", help="expire, record and release")
    p.add_argument("--list", action="store_true", help="only list the open quarantines, by expiry")
    p.add_argument("--committers", action="store_true", help="ask git for owners where no rule names one")
    p.add_argument("--rows", type=int, default=500, help="decisions to print")
    p = sub.add_parser("eval", help="score the keyword rules on labelled examples")
    p.add_argument("corpus")
    p = sub.add_parser("stats", help="totals of calls and classifications")
    p.add_argument("--prometheus", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    conf = settings.load(args.config)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None, microsecond=0)
    if args.command == "eval":
        examples = corpus.load(spark, args.corpus)
        totals, classes = jobs.evaluate(examples)
        print(render.as_scores(classes, totals, jobs.guesses(examples)))
        return 0
    store = Store(spark, args.store)
    if args.command == "ingest":
        run = {"run_id": args.run_id, "commit_sha": args.sha, "attempt": args.attempt, "branch": args.branch, "shard_id": args.shard}
        run |= {"worker_id": args.worker, "started_at": jobs.instant(args.started_at) if args.started_at else now}
        patches = diff.read_patches(spark, args.diff) if args.diff else None
        print(jobs.ingest(store, junit.result_files(spark, *args.results), run, patches, conf))
    elif args.command == "stats":
        calls, classified = jobs.stats(store)
        if args.prometheus:
            print(render.as_prometheus(calls.join(classified, F.lit(True)), metrics.tally(store.table("classifications"), "cause")))  # one row each
        else:
            print(calls.first().asDict() | classified.first().asDict())
            for name, rows in jobs.tallies(store).items():
                print(name + ": " + ", ".join(f"{r[0]} {r[1]}" for r in rows.collect()))
    else:
        since = now - jobs.duration(args.since) if getattr(args, "since", None) else None
        found = jobs.detect(store, since, getattr(args, "sha", None), conf)
        if args.command == "policy":
            if args.list:
                print(render.as_quarantines(jobs.quarantines(store, now, conf), args.rows))
                return 0
            committers = None
            if args.committers:
                flaky = found.filter("verdict = 'flaky' AND file_path IS NOT NULL").orderBy("file_path").select("file_path").distinct().limit(args.rows)
                committers = codeowners.last_committers(spark, args.root, [r[0] for r in flaky.collect()])
            decided = jobs.decisions(store, found, codeowners.load(spark, args.root), now, conf, committers)
            for r in decided.select("display_name", "recommended", "refusal", "owner", "expires_at").orderBy("display_name").limit(args.rows).collect():
                print(f"{r['display_name']}: " + (f"quarantine until {r['expires_at']}, owner {r['owner'] or 'unresolved'}" if r["recommended"] else r["refusal"]))
            if args.apply:
                print(jobs.apply_policy(store, decided, now, conf))
            return 0
        causes = jobs.triage(store, found, config=conf) if args.command == "triage" else None
        if args.out:
            render.write_json(found, args.out, causes, "display_name")
        elif args.format == "json":
            print(render.as_json(found, causes, "display_name"))
        elif args.format == "markdown":
            print(render.as_markdown(found, conf.report.comment_rows, "display_name", causes))
        else:
            print(render.as_table(found, args.all, "display_name"))
            if causes is not None:
                names = causes.join(found.select("test_id", "display_name"), "test_id").orderBy("display_name")
                print("\n".join(f"{r['display_name']}: {r['cause']} ({r['downgrade_reason']})" for r in names.collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
