"""Command line: crawl, watch, run (a task from standard input), config validate, config list."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lathe import control, crawl
from lathe.functions.durations import parse_text
from lathe.session import local_session
from lathe.sources import config, keyed, web


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lathe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("crawl", "watch"):
        c = sub.add_parser(name)
        c.add_argument("--config", default="config.yaml")
        c.add_argument("--site", default="")
        c.add_argument("--sites", default="")
        c.add_argument("--all-sites", action="store_true")
        c.add_argument("--pages", default="", help="Parquet of (url, html) to serve pages from instead of the network")
        if name == "crawl":
            c.add_argument("--resume", action="store_true")
            how = c.add_mutually_exclusive_group()
            how.add_argument("--incremental", action="store_true")
            how.add_argument("--full", action="store_true")
        else:
            c.add_argument("--interval", default="24h")
            c.add_argument("--rounds", type=int, default=None)
    r = sub.add_parser("run")
    r.add_argument("--pages", default="")
    v = sub.add_parser("config")
    v.add_argument("action", choices=["validate", "list"])
    v.add_argument("--config", default="config.yaml")
    v.add_argument("--site", default=None)
    v.add_argument("--json", action="store_true")
    return p


def one_site(spark: SparkSession, app: config.App, key: str, pages: str, resume: bool, incremental: bool) -> int:
    """Crawl a site with its stored state and history; gives the number of saved pages."""
    site, settings = app.sites[key], config.resolve(app.sites[key], app)
    fetch = crawl.offline_fetch(spark.read.parquet(pages)) if pages else web.fetcher(settings["user_agent"], settings["delay_per_host"], settings["max_page_size_bytes"], retries=app.max_retries, first=app.initial_retry_delay, most=app.max_retry_delay)
    if not (resume or incremental):
        keyed.clean_below(app.output_base_dir, config.output_dir(app.output_base_dir, key))
    table = keyed.KeyedTable(spark, config.state_path(app.state_dir, key))
    store = keyed.History(spark, f"{app.state_dir.rstrip('/')}/history/{config.output_dir('', key).strip('/')}", app.history_retention)
    return crawl.crawl(spark, key, site, app, fetch, table, store, resume=resume, incremental=incremental).saved


def crawl_sites(spark: SparkSession, app: config.App, keys: list[str], pages: str = "", resume: bool = False, incremental: bool = False) -> dict[str, tuple[bool, int, str]]:
    return control.run_sites(keys, lambda key: one_site(spark, app, key, pages, resume, incremental))


def execute(command: str, path: str, keys: list[str] | None, pages: str, resume: bool = False, incremental: bool = False, full: bool = False, interval: str = "24h", rounds: int | None = None) -> int:
    """Exit code: 0 if all sites succeeded."""
    app = config.load(path)
    for note in config.validate_app(app):
        print(note, file=sys.stderr)
    chosen = sorted(app.sites) if keys is None else keys
    config.require_sites(app, chosen)
    for key in chosen:
        config.validate_site(app.sites[key])
    spark = SparkSession.getActiveSession() or local_session()
    incremental = not full and (incremental or app.enable_incremental)
    if command == "watch":
        schedule = control.Schedule(f"{app.state_dir.rstrip('/')}/watch_state.json")
        control.watch(chosen, parse_text(interval), lambda due: crawl_sites(spark, app, due, pages, True, True), schedule, rounds)
        return 0
    results = crawl_sites(spark, app, chosen, pages, resume, incremental)
    for key, (ok, n, error) in sorted(results.items()):
        print(f"{key}: {'ok' if ok else 'failed'}, {n} pages {error}".rstrip())
    print(json.dumps(control.summary(results)))
    return int(not all(ok for ok, _, _ in results.values()))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "run":
        spec = control.parse_task(sys.stdin.read())
        return execute(spec["command"], spec["config"], control.task_sites(spec), a.pages, spec.get("resume", False), spec.get("incremental", False), spec.get("full", False), spec.get("interval", "24h"))
    if a.command == "config":
        app = config.load(a.config)
        if a.action == "list":
            print(json.dumps(sorted(app.sites)) if a.json else "\n".join(f"{k}\t{app.sites[k].allowed_domain}" for k in sorted(app.sites)))
            return 0
        out = control.validate(app, a.site)
        print(json.dumps(out, indent=2) if a.json else "\n".join([*out["warnings"], *out["errors"], *(f"{s['site']}: {'ok' if s['valid'] else s['error']}" for s in out["sites"])]))
        return int(not out["valid"])
    keys, every, ignored = control.pick_sites(a.site, a.sites, a.all_sites)
    if not keys and not every:
        print("name a site, several sites, or all of them", file=sys.stderr)
        return 2
    for name in ignored:
        print(f"--{name} is ignored", file=sys.stderr)
    if a.command == "watch":
        return execute("watch", a.config, None if every else keys, a.pages, interval=a.interval, rounds=a.rounds)
    return execute("crawl", a.config, None if every else keys, a.pages, a.resume, a.incremental, a.full)


if __name__ == "__main__":
    sys.exit(main())
