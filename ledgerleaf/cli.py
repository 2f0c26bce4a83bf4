"""Command line: python -m ledgerleaf.cli --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store


def export_ndjson(frame: DataFrame, path: str) -> None:
    """One JSON object a line, one file for each partition."""
    frame.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("value")).write.text(path)


def format_duration(seconds: float) -> str:
    """Such as 1d2h, 3m5s or 40s."""
    left, out = int(seconds), []
    for name, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, left = divmod(left, size)
        if n:
            out.append(f"{n}{name}")
    return "".join(out[:2]) or "0s"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerleaf", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the store")
    p.add_argument("--mode", default="single", choices=["single", "schema_per_tenant", "conjoined"])
    p.add_argument("--tenant")
    sub = p.add_subparsers(dest="command", required=True)
    docs = sub.add_parser("docs").add_subparsers(dest="action", required=True)
    for name in ("get", "soft-delete", "restore"):
        docs.add_parser(name).add_argument("id")
    docs.add_parser("verify")
    explain = docs.add_parser("explain-sql")
    explain.add_argument("sql")
    explain.add_argument("--analyze", action="store_true", help="run it, and show the plan that was run with rows and time")
    streams = sub.add_parser("streams").add_subparsers(dest="action", required=True)
    streams.add_parser("resolve").add_argument("alias")
    read = streams.add_parser("read")
    read.add_argument("id")
    read.add_argument("--limit", type=int)
    archive = sub.add_parser("archive").add_subparsers(dest="action", required=True)
    archive.add_parser("status")
    for name in ("mark", "reactivate"):
        archive.add_parser(name).add_argument("stream")
    move = archive.add_parser("move")
    move.add_argument("--before", required=True, type=dt.datetime.fromisoformat)
    move.add_argument("--stream")
    move.add_argument("--dry-run", action="store_true")
    move.add_argument("--batches", type=int, help="streams at a time; those left without hot events are marked")
    move.add_argument("--max-batches", type=int)
    archive.add_parser("redirect").add_argument("state", choices=["on", "off", "show"])
    tenants = sub.add_parser("tenants").add_subparsers(dest="action", required=True)
    tenants.add_parser("list")
    for name in ("ensure", "drop"):
        tenants.add_parser(name).add_argument("name")
    out = tenants.add_parser("archive")
    out.add_argument("name", nargs="?")
    out.add_argument("--to", required=True)
    proj = sub.add_parser("projections").add_subparsers(dest="action", required=True)
    proj.add_parser("list")
    for name in ("status", "pause", "resume", "reset", "dlq-list"):
        proj.add_parser(name).add_argument("name")
    for name in ("dlq-requeue", "dlq-delete"):
        proj.add_parser(name).add_argument("id", type=int)
    proj.add_parser("rebuild").add_argument("name")
    subs = sub.add_parser("subscriptions").add_subparsers(dest="action", required=True)
    subs.add_parser("list")
    for name in ("status", "pause", "resume", "reset", "groups"):
        own = subs.add_parser(name)
        own.add_argument("name")
        if name in ("status", "reset"):
            own.add_argument("--group")
        if name == "reset":
            own.add_argument("--to", type=int, default=0)
    flight = subs.add_parser("max-in-flight")
    flight.add_argument("name")
    flight.add_argument("group")
    flight.add_argument("most", type=int)
    snaps = sub.add_parser("snapshots").add_subparsers(dest="action", required=True)
    for name in ("metrics", "candidates", "run"):
        own = snaps.add_parser(name)
        own.add_argument("--threshold", type=int, default=100)
        own.add_argument("--batch", type=int, default=100)
        if name == "run":
            own.add_argument("aggregate", help="module:Class")
    schema = sub.add_parser("schema").add_subparsers(dest="action", required=True)
    for name in ("show", "merge", "backfill", "suggest"):
        schema.add_parser(name)
    schema.add_parser("vacuum").add_argument("--hours", type=float, default=168.0)
    cluster = sub.add_parser("cluster").add_subparsers(dest="action", required=True)
    for name in ("health", "promote", "relinquish"):
        own = cluster.add_parser(name)
        own.add_argument("name")
        if name != "health":
            own.add_argument("node")
    p.add_argument("--promote", action="append", default=[], metavar="PATH:COLUMN[:KIND]", help="a column kept for documents")
    p.add_argument("--search", help="text search configuration whose lexemes are kept")
    sub.add_parser("health")
    sub.add_parser("metrics")
    serve = sub.add_parser("serve")
    serve.add_argument("--port", type=int, default=9464)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> object:
    """What the command prints as JSON."""
    from .operators.documents import Documents
    from .operators.events import Events
    from .operators.aggregates import Snapshotter
    from .operators.schema import suggest_promoted
    from .promoted import Promoted
    from .serving import serve
    from .streaming.cluster import ClusterNode
    from .streaming.projections import Daemon
    from .streaming.subscriptions import Subscriptions

    promoted = tuple(Promoted(*text.split(":", 2)) for text in args.promote)
    store = Store(spark, args.root, args.mode, promoted=promoted, search=args.search)
    docs, events = Documents(store, args.tenant), Events(store, args.tenant)
    what = (args.command, getattr(args, "action", None))
    if what == ("docs", "get"):
        return docs.get(args.id)
    if what == ("docs", "soft-delete"):
        return docs.soft_delete(args.id)
    if what == ("docs", "restore"):
        return docs.restore(args.id)
    if what == ("docs", "verify"):
        rows = docs.versions()
        gaps = rows.groupBy("tenant_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("v")).where("n <> v").count()
        return {"versions": rows.count(), "documents_with_gaps": gaps}
    if what == ("docs", "explain-sql"):
        frame = spark.sql(args.sql)
        if not args.analyze:
            return frame._jdf.queryExecution().toString().splitlines()
        began = time.monotonic()
        rows = frame._jdf.collectAsList().size() if frame.isLocal() else frame.count()
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        return {"rows": rows, "seconds": round(time.monotonic() - began, 3), "plan": plan}
    if what == ("streams", "resolve"):
        return store.resolve_stream_alias(args.alias, args.tenant)
    if what == ("streams", "read"):
        return [{"stream_seq": s, "type": e.typ, "body": e.body} for s, e in events.with_archived().read_stream(args.id)[: args.limit]]
    if what == ("archive", "status"):
        return [r.asDict() for r in events.archive_status().collect()]
    if what == ("archive", "mark"):
        return events.archive_stream(args.stream)
    if what == ("archive", "reactivate"):
        return events.reactivate_stream(args.stream)
    if what == ("archive", "redirect"):
        if args.state != "show":
            store.set_archive_redirect(args.state == "on", args.tenant)
        return bool(store.log(args.tenant).state().values.get("archive_redirect", store.archive_redirect))
    if what == ("archive", "move") and args.batches and not args.dry_run:
        return events.archive_in_batches(args.before, args.batches, args.max_batches)
    if what == ("archive", "move"):
        return events.archive_before(args.before, args.stream, args.dry_run)
    if what == ("tenants", "list"):
        return store.list_tenants()
    if what == ("tenants", "ensure"):
        return store.ensure_tenant(args.name)
    if what == ("tenants", "drop"):
        return store.drop_tenant(args.name)
    if what == ("tenants", "archive"):
        for table in ("docs", "events", "snapshots"):
            export_ndjson(store.scan(table, args.name), f"{args.to}/{table}")
        daemon = Daemon(Events(store, args.name))
        rows = [(n, daemon.checkpoint(n)) for n in daemon.names()]
        export_ndjson(spark.createDataFrame(rows, "name string, last_seq long"), f"{args.to}/projections")
        return {"exported": args.to}
    if args.command == "subscriptions":
        subs = Subscriptions(events)
        if args.action == "list":
            return subs.names()
        if args.action == "status":
            return subs.status(args.name, args.group)
        if args.action == "reset":
            return subs.reset(args.name, args.to, args.group)
        if args.action == "max-in-flight":
            return subs.set_group_max_in_flight(args.name, args.group, args.most)
        return getattr(subs, args.action)(args.name)
    if args.command == "snapshots":
        kind = None
        if args.action == "run":
            module, name = args.aggregate.split(":")
            kind = getattr(importlib.import_module(module), name)
        shots = Snapshotter(events, kind, args.threshold, args.batch)
        if args.action == "candidates":
            return [r.asDict() for r in shots.candidates().collect()]
        return shots.metrics() if args.action == "metrics" else shots.run_until_idle()
    if args.command == "schema":
        if args.action == "show":
            state = store.log(args.tenant).state()
            return {t: {"columns": {f.name: f.dataType.simpleString() for f in s}, "folders": len(state.tables.get(t, []))} for t, s in store.tables.items()}
        if args.action == "vacuum":
            return store.log(args.tenant).vacuum(args.hours * 3600)
        if args.action == "suggest":
            return [vars(p) for p in suggest_promoted(docs.current())]
        return getattr(store, args.action)(args.tenant)
    if args.command == "cluster":
        node = ClusterNode(store, args.name, node=getattr(args, "node", ""))
        return getattr(node, args.action)()
    if args.command == "metrics":
        return store.observe(args.tenant).render().splitlines()
    if args.command == "serve":
        server = serve(store, args.port)
        print(json.dumps({"port": server.server_address[1]}), flush=True)
        threading.Event().wait()
    daemon = Daemon(events)
    if what == ("projections", "list"):
        return daemon.names()
    if what == ("projections", "status"):
        return daemon.status(args.name)
    if what == ("projections", "dlq-list"):
        return [r.asDict() for r in daemon.dlq(args.name, 100).collect()]
    if what[0] == "projections":
        given = args.id if args.action.startswith("dlq") else args.name
        return getattr(daemon, args.action.replace("-", "_"))(given)
    return {"healthy": store.healthy()}


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(run(args, spark), default=str))


if __name__ == "__main__":
    main()
