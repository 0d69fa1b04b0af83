"""Configuration: reading, defaults and limits, per-site resolution."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lathe.functions.durations import parse_text

PAGE_CAP = 50 << 20


class ConfigError(ValueError):
    """A site or application setting that cannot be used."""


@dataclass
class Site:
    start_urls: list[str] = field(default_factory=list)
    allowed_domain: str = ""
    allowed_path_prefix: str = ""
    content_selector: str = ""
    link_extraction_selectors: list[str] = field(default_factory=list)
    disallowed_path_patterns: list[str] = field(default_factory=list)
    respect_nofollow: bool = False
    user_agent: str = ""
    delay_per_host: float = 0
    max_depth: int = 0
    skip_images: bool | None = None
    max_image_size_bytes: int | None = None
    allowed_image_domains: list[str] = field(default_factory=list)
    disallowed_image_domains: list[str] = field(default_factory=list)
    enable_jsonl_output: bool | None = None
    jsonl_output_filename: str = ""


@dataclass
class App:
    default_user_agent: str = ""
    default_delay_per_host: float = 0
    num_workers: int = 0
    num_image_workers: int = 0
    max_requests: int = 0
    max_requests_per_host: int = 0
    output_base_dir: str = ""
    state_dir: str = ""
    max_retries: int = 0
    initial_retry_delay: float = 0
    max_retry_delay: float = 0
    semaphore_acquire_timeout: float = 30
    global_crawl_timeout: float = 0
    per_page_timeout: float = 0
    skip_images: bool | None = None
    max_image_size_bytes: int = 0
    max_page_size_bytes: int = 0
    http_client_settings: dict = field(default_factory=dict)
    enable_jsonl_output: bool = False
    jsonl_output_filename: str = ""
    enable_incremental: bool = False
    history_retention: int = 10
    sites: dict[str, Site] = field(default_factory=dict)


DURATIONS = frozenset("default_delay_per_host initial_retry_delay max_retry_delay semaphore_acquire_timeout global_crawl_timeout per_page_timeout delay_per_host".split())


def _fill(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from a mapping; unknown keys are ignored, durations may be text."""
    known = {f.name for f in fields(kind)}
    out = {}
    for k, v in (values or {}).items():
        if k in known and v is not None:
            out[k] = parse_text(v) if k in DURATIONS and isinstance(v, str) else v
    return kind(**out)


def parse(text: str) -> App:
    """An application configuration from YAML (or JSON, where no YAML reader is installed)."""
    try:
        import yaml
    except ImportError:
        import json

        values = json.loads(text)
    else:
        values = yaml.safe_load(text)
    values = dict(values or {})
    sites = values.pop("sites", None) or {}
    app = _fill(App, values)
    app.sites = {str(k): _fill(Site, v) for k, v in sites.items()}
    return app


def load(path: str) -> App:
    with open(path, encoding="utf-8") as file:
        return parse(file.read())


def validate_app(app: App) -> list[str]:
    """Put defaults and limits in place; returns what was changed and worth a word."""
    notes: list[str] = []

    def default(name: str, bad: bool, value: Any, quiet: bool = False) -> None:
        if bad:
            setattr(app, name, value)
            if not quiet:
                notes.append(f"{name}: set to {value!r}")

    default("num_workers", app.num_workers <= 0, 4)
    default("num_image_workers", app.num_image_workers <= 0, app.num_workers)
    default("max_requests", app.max_requests <= 0, 10)
    default("max_requests_per_host", app.max_requests_per_host <= 0, 2)
    default("output_base_dir", not app.output_base_dir, "./crawled_docs")
    default("state_dir", not app.state_dir, "./crawler_state")
    default("max_retries", app.max_retries < 0, 0)
    default("max_retries", app.max_retries == 0 and app.initial_retry_delay == 0, 3, quiet=True)
    if app.max_retries > 0:
        default("initial_retry_delay", app.initial_retry_delay <= 0, 1.0, quiet=True)
        default("max_retry_delay", app.max_retry_delay <= 0, 30.0, quiet=True)
    default("initial_retry_delay", app.initial_retry_delay > app.max_retry_delay > 0, app.max_retry_delay)
    for name in ("global_crawl_timeout", "per_page_timeout", "max_image_size_bytes"):
        default(name, getattr(app, name) < 0, 0)
    client = app.http_client_settings
    app.http_client_settings = client | {"timeout": client.get("timeout") or 45, "max_idle_conns_per_host": client.get("max_idle_conns_per_host") or 2}
    return notes


def validate_site(site: Site) -> list[str]:
    """Check required settings and bring the others in form; raises ``ConfigError``."""
    for name in ("start_urls", "allowed_domain", "content_selector"):
        if not getattr(site, name):
            raise ConfigError(f"{name} is missing")
    site.allowed_path_prefix = "/" + site.allowed_path_prefix.removeprefix("/")
    notes = []
    if site.max_depth < 0:
        site.max_depth = 0
        notes.append("max_depth: set to 0 (no limit)")
    if (site.max_image_size_bytes or 0) < 0:
        site.max_image_size_bytes = 0
        notes.append("max_image_size_bytes: set to 0 (no limit)")
    return notes


def resolve(site: Site, app: App) -> dict[str, Any]:
    """Settings in force: the site's own, else the application's, else the default."""
    first = lambda *values: next((v for v in values if v is not None), None)
    return {
        "user_agent": site.user_agent or app.default_user_agent,
        "jsonl_output_filename": site.jsonl_output_filename or app.jsonl_output_filename or "pages.jsonl",
        "delay_per_host": site.delay_per_host if site.delay_per_host > 0 else app.default_delay_per_host,
        "max_page_size_bytes": app.max_page_size_bytes if app.max_page_size_bytes > 0 else PAGE_CAP,
        "max_image_size_bytes": first(site.max_image_size_bytes, app.max_image_size_bytes),
        "skip_images": first(site.skip_images, app.skip_images, True),
        "enable_jsonl_output": first(site.enable_jsonl_output, app.enable_jsonl_output),
    }


def require_sites(app: App, keys: list[str]) -> None:
    missing = sorted(set(keys) - set(app.sites))
    if missing:
        raise ConfigError(f"unknown sites {missing}; known: {sorted(app.sites)}")


def sites_frame(spark: SparkSession, app: App) -> DataFrame:
    """One row per site with its settings in force, ordered by key."""
    rows = []
    for key in sorted(app.sites):
        r = resolve(app.sites[key], app)
        rows.append((key, app.sites[key].allowed_domain, app.sites[key].allowed_path_prefix, int(app.sites[key].max_depth), r["user_agent"], float(r["delay_per_host"]), int(r["max_page_size_bytes"]), int(r["max_image_size_bytes"]), bool(r["skip_images"]), bool(r["enable_jsonl_output"]), r["jsonl_output_filename"]))
    return spark.createDataFrame(rows, "site_key string, allowed_domain string, allowed_path_prefix string, max_depth int, user_agent string, delay_per_host double, max_page_size_bytes long, max_image_size_bytes long, skip_images boolean, enable_jsonl_output boolean, jsonl_output_filename string")


def output_dir(base: str, key: str) -> str:
    from lathe.functions.text import sanitize_text

    return f"{base.rstrip('/')}/{sanitize_text(key)}"


def state_path(base: str, key: str) -> str:
    from lathe.functions.text import sanitize_text

    return f"{base.rstrip('/')}/{sanitize_text(key)}_visited_db"


def mode(resume: bool, incremental: bool) -> str:
    return "incremental" if incremental else "resume" if resume else "full"
