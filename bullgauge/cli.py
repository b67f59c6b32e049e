"""Command line: python -m bullgauge.cli --warehouse DIR COMMAND."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bullgauge.render import day as view
from bullgauge.sources.store import TABLES, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bullgauge")
    p.add_argument("--warehouse", default="warehouse")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "demo": ("inbox", "out"), "ingest": ("inbox", "channel", "now"), "pipeline": (), "show": ("date", "version"), "matrix": ("date", "version"), "push": ("date", "version"), "html": ("date", "out", "version"), "status": (), "reset": (),
    }.items():
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", default={"inbox": "inbox", "channel": "inbox"}.get(o))
        if name in ("demo", "show", "matrix"):
            c.add_argument("--no-color", action="store_true")
    return p


def _day(store: Store, date: str | None, version: str | None = None) -> view.Day | None:
    """The day as one model version sees it, all of it."""
    version = version or store.s.score_version
    index = store.index(version)
    d = view.last_day(index, date)
    if not d:
        return None
    readable, ballot = store.votes()
    return view.load_day(index, readable.filter(readable["model_version"] == version), ballot.filter(ballot["model_version"] == version), d)


def _first(store: Store) -> str | None:
    d = store.index().agg(F.min("trade_date").alias("d")).first()["d"]
    return d.isoformat() if d else None


def _page(d: view.Day, out: str | None) -> Path:
    path = Path(out or f"dashboard-{d.day}.html")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(view.html_page(d), encoding="utf-8")
    return path


def _color(a: argparse.Namespace) -> bool:
    return not a.no_color and sys.stdout.isatty()


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    store = Store(spark, a.warehouse)
    if a.command == "reset":
        store.reset()
    elif a.command == "ingest":
        print(store.ingest(a.inbox, a.channel, a.now))
    elif a.command == "pipeline":
        print(store.pipeline())
    elif a.command == "status":
        print({t: store.count(t) for t in TABLES} | {"first": _first(store), "last": view.last_day(store.index())})
    elif a.command == "demo":
        store.reset()
        print(store.ingest(a.inbox), store.pipeline())
        if not (d := _day(store, None)):
            return 1
        print(view.terminal(d, color=_color(a)))
        print(view.push_message(d))
        print(_page(d, a.out))
    else:
        if not (d := _day(store, a.date, a.version)):
            print("还没有已聚合的交易日")
            return 1
        if a.command == "html":
            print(_page(d, a.out))
        else:
            print({"show": lambda x: view.terminal(x, color=_color(a)), "matrix": view.matrix_text, "push": view.push_message}[a.command](d))
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("bullgauge").getOrCreate(), sys.argv[1:]))
