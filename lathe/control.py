"""Jobs, schedules, task files and the functions that tools call; all on the driver."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.durations import DAY, format_text, parse_text
from lathe.operators import history, records
from lathe.sources import config, jsonl

TERMINAL = ("completed", "failed", "cancelled")
KEEP_TERMINAL = 100


def now_text() -> str:
    return datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")


@dataclass
class Job:
    id: str
    site_key: str
    status: str = "pending"
    started_at: str = field(default_factory=now_text)
    completed_at: str | None = None
    pages_processed: int = 0
    pages_queued: int = 0
    error_message: str = ""
    incremental: bool = False


class Jobs:
    """One active job per site; finished ones are kept up to a number; written with a rename."""

    def __init__(self, path: str | None = None, keep: int = KEEP_TERMINAL):
        self.path, self.keep, self.lock = path, keep, threading.RLock()
        self.jobs: dict[str, Job] = {}
        if path and os.path.exists(path):
            for row in json.loads(Path(path).read_text()):
                job = Job(**row)
                if job.status not in TERMINAL:
                    job.status, job.completed_at, job.error_message = "failed", now_text(), "interrupted by a restart"
                self.jobs[job.id] = job
            self._prune()

    def create(self, site_key: str, incremental: bool = False) -> tuple[Job, bool]:
        """(job, whether it is new): a site's active job is returned as it is."""
        with self.lock:
            active = next((j for j in self.jobs.values() if j.site_key == site_key and j.status not in TERMINAL), None)
            if active:
                return active, False
            job = Job(uuid.uuid4().hex, site_key, incremental=incremental)
            self.jobs[job.id] = job
            self.flush()
            return job, True

    def update(self, job_id: str, status: str | None = None, error: str = "", processed: int | None = None, queued: int | None = None) -> None:
        with self.lock:
            job = self.jobs[job_id]
            job.pages_processed = job.pages_processed if processed is None else processed
            job.pages_queued = job.pages_queued if queued is None else queued
            if status:
                job.status, job.error_message = status, error
                if status in TERMINAL:
                    job.completed_at = now_text()
                    self._prune()
                self.flush()

    def cancel(self, job_id: str) -> bool:
        """Whether the job was active; raises KeyError for an unknown one."""
        with self.lock:
            if self.jobs[job_id].status in TERMINAL:
                return False
            self.update(job_id, "cancelled")
            return True

    def recent(self, n: int = 20) -> list[Job]:
        return sorted(self.jobs.values(), key=lambda j: (j.started_at, j.id), reverse=True)[:n]

    def _prune(self) -> None:
        done = sorted((j for j in self.jobs.values() if j.status in TERMINAL), key=lambda j: (j.completed_at or "", j.id), reverse=True)
        for j in done[self.keep :]:
            del self.jobs[j.id]

    def flush(self) -> None:
        if self.path:
            Path(self.path + ".tmp").write_text(json.dumps([asdict(j) for j in self.jobs.values()]))
            os.replace(self.path + ".tmp", self.path)


class Schedule:
    """When each site ran last; failed runs wait for a whole interval as well."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.sites: dict[str, dict[str, Any]] = json.loads(Path(path).read_text()) if path and os.path.exists(path) else {}

    def due(self, keys: list[str], interval: float, now: float) -> list[str]:
        return [k for k in sorted(keys) if k not in self.sites or now - self.sites[k]["last_run_time"] >= interval]

    def done(self, key: str, ok: bool, pages: int, now: float, error: str = "") -> None:
        self.sites[key] = {"last_run_time": now, "last_run_success": ok, "pages_processed": pages, "error_message": error}
        if self.path:
            Path(self.path + ".tmp").write_text(json.dumps(self.sites))
            os.replace(self.path + ".tmp", self.path)

    def next_run(self, keys: list[str], interval: float, now: float) -> tuple[str, float] | None:
        """(site, time) of the run that comes first."""
        times = [(self.sites[k]["last_run_time"] + interval if k in self.sites else now, k) for k in keys]
        return (min(times)[1], min(times)[0]) if times else None


def tick(interval: float) -> float:
    """Pause between looks at the schedule: a tenth of the interval, one to ten minutes."""
    return min(max(interval / 10, 60.0), 600.0)


def watch(keys: list[str], interval: float, run: Callable[[list[str]], dict[str, tuple[bool, int, str]]], schedule: Schedule, rounds: int | None = None, clock=time.time, sleep=time.sleep) -> None:
    """Run due sites now, then at every tick; ``run`` gives (ok, pages, error) per site."""
    n = 0
    while rounds is None or n < rounds:
        ready = schedule.due(keys, interval, clock())
        for key, (ok, pages, error) in (run(ready) if ready else {}).items():
            schedule.done(key, ok, pages, clock(), error)
        n += 1
        if rounds is None or n < rounds:
            sleep(tick(interval))


def run_sites(keys: list[str], one: Callable[[str], int]) -> dict[str, tuple[bool, int, str]]:
    """Crawl sites side by side, one driver thread each; a failure stays with its site."""
    out: dict[str, tuple[bool, int, str]] = {}

    def work(key: str) -> None:
        try:
            out[key] = (True, one(key), "")
        except Exception as problem:  # noqa: BLE001 - reported per site
            out[key] = (False, 0, str(problem))

    threads = [threading.Thread(target=work, args=(k,)) for k in keys]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def summary(results: dict[str, tuple[bool, int, str]]) -> dict[str, int]:
    return {"success": sum(ok for ok, _, _ in results.values()), "failed": sum(not ok for ok, _, _ in results.values()), "pages": sum(n for _, n, _ in results.values())}


def pick_sites(site: str = "", sites: str = "", every: bool = False) -> tuple[list[str], bool, list[str]]:
    """(keys, all sites?, what was ignored): all over several over one."""
    if every:
        return [], True, [n for n, v in (("sites", sites), ("site", site)) if v]
    if sites:
        return [s.strip() for s in sites.split(",") if s.strip()], False, ["site"] if site else []
    return ([site] if site else []), False, []


TASK = {"command": str, "config": str, "site": str, "sites": list, "all_sites": bool, "resume": bool, "incremental": bool, "full": bool, "interval": str, "loglevel": str, "json_logs": bool, "pprof": str}


def parse_task(text: str) -> dict[str, Any]:
    """A checked task with defaults; ValueError for anything that is not one."""
    spec = json.loads(text)
    if not isinstance(spec, dict):
        raise ValueError("a task is an object")
    for k, v in spec.items():
        if k not in TASK or not isinstance(v, TASK[k]):
            raise ValueError(f"unknown or malformed field {k!r}")
    command = spec.get("command", "")
    if command not in ("crawl", "watch"):
        raise ValueError(f"command must be crawl or watch, not {command!r}")
    if sum(bool(spec.get(k)) for k in ("site", "sites", "all_sites")) != 1:
        raise ValueError("give exactly one of site, sites and all_sites")
    if any(not isinstance(s, str) or not s.strip() for s in spec.get("sites", [])):
        raise ValueError("empty key in sites")
    spec = {"config": "config.yaml", "loglevel": "info", **{k: v for k, v in spec.items() if v != ""}}
    if command == "crawl" and spec.get("incremental") and spec.get("full"):
        raise ValueError("incremental contradicts full")
    if command == "watch":
        spec.setdefault("interval", "24h")
        parse_text(spec["interval"])
        if any(spec.get(k) for k in ("resume", "incremental", "full", "pprof")):
            raise ValueError("watch is always incremental and takes no crawl options")
    return spec


def task_sites(spec: dict[str, Any]) -> list[str] | None:
    """Keys of a task; None stands for all sites."""
    return None if spec.get("all_sites") else [s.strip() for s in spec.get("sites", [])] or [spec["site"]]


def validate(app: config.App, site: str | None = None) -> dict[str, Any]:
    """Outcome of checking a configuration, ready for printing."""
    notes = config.validate_app(app)
    results, errors = [], []
    if site is not None and site not in app.sites:
        errors.append(f"unknown site {site!r}")
    for key in sorted(app.sites):
        if site is None or key == site:
            try:
                results.append({"site": key, "valid": True, "warnings": config.validate_site(app.sites[key]), "error": ""})
            except config.ConfigError as problem:
                results.append({"site": key, "valid": False, "warnings": [], "error": str(problem)})
    return {"valid": not errors and all(r["valid"] for r in results), "site_count": len(app.sites), "warnings": notes, "errors": errors, "sites": results}


class Tools:
    """Functions for listing sites and pages, starting and watching crawls, freshness and differences."""

    def __init__(self, spark: SparkSession, app: config.App, store, jobs: Jobs | None = None, crawl: Callable[[Job], int] | None = None, fetch: Callable[[str], str] | None = None):
        self.spark, self.app, self.store, self.jobs, self.crawl, self.fetch = spark, app, store, jobs or Jobs(), crawl, fetch

    def registry(self) -> dict[str, Callable]:
        names = ("list_sites", "describe_server", "list_pages", "get_page", "crawl_site", "get_job_status", "cancel_crawl", "get_freshness", "diff_crawl")
        return {n: getattr(self, n) for n in names}

    def _records_path(self, key: str) -> str:
        site = self._site(key)
        return f"{config.output_dir(self.app.output_base_dir, key)}/{config.resolve(site, self.app)['jsonl_output_filename']}"

    def _site(self, key: str) -> config.Site:
        config.require_sites(self.app, [key])
        return self.app.sites[key]

    def list_sites(self) -> list[dict]:
        active = {j.site_key for j in self.jobs.jobs.values() if j.status not in TERMINAL}
        last = {r["site_key"]: r["crawl_ended_at"] for r in history.latest(self.store.crawls()).collect()}
        return [{"site_key": k, "allowed_domain": s.allowed_domain, "start_urls": s.start_urls, "last_crawled": last.get(k), "crawling": k in active} for k, s in sorted(self.app.sites.items())]

    def describe_server(self) -> dict:
        return {"sites": self.list_sites(), "jobs": [asdict(j) for j in self.jobs.recent()]}

    def _rows(self, key: str) -> DataFrame:
        return records.last_wins(jsonl.sequenced(jsonl.read_pages(self.spark, self._records_path(key))), "url", "seq").drop("seq")

    def list_pages(self, site_key: str, limit: int = 0, offset: int = 0) -> dict:
        rows = self._rows(site_key)
        n, o = records.clamp(limit, offset)
        return {"total": rows.count(), "limit": n, "offset": o, "pages": [r.asDict() for r in records.listing(rows, limit, offset).collect()]}

    def get_page(self, url: str, selector: str = "body") -> dict:
        """One page fetched now: the first match of the selector in document order, as Markdown."""
        from lathe.operators import dom, markdown, pagetree

        if self.fetch is None:
            raise ValueError("no fetcher was given")
        tree = dom.parse(self.fetch(url))
        found = dom.find(tree, selector or "body")
        if not found:
            raise ValueError(f"nothing matches {selector!r}")
        body = markdown.convert(found[0]).strip()
        return {"url": url, "title": pagetree.title_of(tree, "Untitled"), "content": body, "content_length": len(body.encode())}

    def crawl_site(self, site_key: str, incremental: bool = False) -> dict:
        self._site(site_key)
        job, new = self.jobs.create(site_key, incremental)
        if new and self.crawl is not None:
            threading.Thread(target=self._work, args=(job,), daemon=True).start()
        return {"job_id": job.id, "status": job.status, "already_running": not new}

    def _work(self, job: Job) -> None:
        self.jobs.update(job.id, "running")
        self.spark.addTag(job.id)
        try:
            done = self.crawl(job)  # type: ignore[misc]
            if job.status != "cancelled":
                self.jobs.update(job.id, "completed", processed=done)
        except Exception as problem:  # noqa: BLE001 - kept with the job
            if job.status != "cancelled":
                self.jobs.update(job.id, "failed", str(problem))

    def get_job_status(self, job_id: str) -> dict:
        job = self.jobs.jobs[job_id]
        out = asdict(job)
        if job.completed_at:
            out["duration_seconds"] = (datetime.fromisoformat(job.completed_at) - datetime.fromisoformat(job.started_at)).total_seconds()
        return out

    def cancel_crawl(self, job_id: str) -> dict:
        done = self.jobs.cancel(job_id)
        if done:
            self.spark.interruptTag(job_id)
        return {"job_id": job_id, "cancelled": done}

    def get_freshness(self, site_key: str, now: str | None = None) -> dict:
        self._site(site_key)
        row = history.freshness(self.store.crawls().filter(F.col("site_key") == site_key), now or now_text()).first()
        out = {"site_key": site_key, "ever_crawled": row is not None, "output_exists": os.path.isdir(config.output_dir(self.app.output_base_dir, site_key))}
        if row is not None:
            # whole seconds, to be passed on as ``since``
            out |= {"last_crawled": row["crawl_ended_at"][:19] + "Z", "age_seconds": row["age_seconds"], "age": format_text(row["age_seconds"])}
        return out

    def diff_crawl(self, site_key: str, since: str, limit: int = 0, offset: int = 0) -> dict:
        self._site(site_key)
        datetime.fromisoformat(since)
        found = history.crawl_difference(self.store.crawls(), self.store.pages(), site_key, since).cache()
        try:
            counts = history.tally(found).first()
            rows = [r.asDict() for r in history.entries(found, limit, offset).collect()]
        finally:
            found.unpersist()
        return {"site_key": site_key, "since": since, "max_results": limit, "offset": offset, "total": counts["total"], "unchanged": counts["unchanged"], **{k: [r for r in rows if r["kind"] == k] for k in ("added", "removed", "changed")}}


__all__ = ["DAY", "Job", "Jobs", "Schedule", "Tools", "parse_task", "pick_sites", "run_sites", "summary", "task_sites", "tick", "validate", "watch"]
