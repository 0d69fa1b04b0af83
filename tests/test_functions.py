import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathe.functions import addresses, durations, pictures, text, urls

TEXTS = ["", "..", "a<b>:c", "__ x __", "é" * 60, "n" * 99 + "éé", "ok", "a\x01b", "a" * 99 + "_b", "🙂" * 30, " . "]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_sanitize_native_equals_python(spark):
    assert column(spark, TEXTS, text.sanitize) == [text.sanitize_text(t) for t in TEXTS]
    assert all(len(text.sanitize_text(t).encode()) <= 100 for t in TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_sanitized_names_are_safe(name):
    clean = text.sanitize_text(name)
    assert clean and clean.strip(".") and "/" not in clean and len(clean.encode()) <= 100


def test_normalize_is_idempotent(spark):
    given_urls = ["HTTP://A.com:80/x/?q#f", "https://a.com", "https://a.com:443/", "http://a.com//", "x", "http://a:8080/b/"]
    once = column(spark, given_urls, urls.normalize)
    assert once == ["http://a.com/x", "https://a.com/", "https://a.com/", "http://a.com/", None, "http://a:8080/b"]
    known = [u for u in once if u]
    assert column(spark, known, urls.normalize) == known


@pytest.mark.parametrize(
    "url,prefix,want",
    [
        ("https://h/docs/", "/docs/", "out/docs/index.md"), ("https://h/docs/a", "/docs/", "out/a/index.md"), ("https://h/docs/a/b.html", "/docs", "out/a/b.md"), ("https://h/", "/", "out/index.md"), ("https://h", "/", "out/index.md"),
        ("https://h/a/../../etc/passwd", "/", "out/a/untitled/untitled/etc/passwd/index.md"), ("https://h/x.", "/", "out/x./index.md"), ("https://other/x", "/", None), ("ftp://h/x", "/", None), ("https://h/x?y=z.html#q", "/", "out/x/index.md"), ("https://h/.html", "/", "out/untitled.md"), ("https://h/docsX", "/docs", "out/X/index.md"),
    ],
)
def test_output_paths(spark, url, prefix, want):
    assert urls.output_path_text(url, "h", prefix, "out") == want
    assert column(spark, [url], lambda c: urls.output_path(c, "h", prefix, "out")) == [want]


def test_resolution():
    r = urls.resolve_text
    assert r("http://h/a/b", "../c") == "http://h/c" and r("http://h/a", "//x/y") == "http://x/y" and r("http://h/a", "?q=1") == "http://h/a?q=1"
    assert r("http://h/a", "/é b") == "http://h/%C3%A9%20b" and r("http://h/a", "http://[bad") is None
    assert urls.relative_path("out/a/index.md", "out/b/c.md", "s") == "../b/c.md#s"


def test_markdown_items(spark):
    md = "# A\n\n#\nC\n####### no\n## B ##\n[x](u)[y](v) ![p](q) [ ](w)\n[![i](img)](outer)\n"
    assert column(spark, [md, "", "plain"], text.headings) == [["A", "C", "B ##"], None, None]
    assert column(spark, [md], text.links) == [["u", "w", "img"]]
    assert column(spark, [md], text.pictures) == [["q", "img"]]


def test_yaml_scalars():
    y = text.yaml_text
    assert [y(x) for x in ("plain title", "a: b", "", "true", "12", "it's", "- x", "tab\there", "end:", "a #b")] == ["plain title", "'a: b'", "''", "'true'", "'12'", "it's", "'- x'", '"tab\\there"', "'end:'", "'a #b'"]
    yaml = pytest.importorskip("yaml")
    for x in ("plain", "a: b", "null", "x\ny", "'q'", '"', "#", "[a]", "é", "1e3", "@x", "%", "&a", "*b", "!c", "|", ">", "~", "no", "0x1F", " lead", "2024-01-01"):
        assert yaml.safe_load(f"k: {y(x)}") == {"k": x}, x


@pytest.mark.parametrize("value,seconds", [("1h30m", 5400), ("7d", 604800), ("1d12h", 129600), ("90s", 90), ("1.5h", 5400), ("250ms", 0.25), ("0", 0)])
def test_intervals(value, seconds):
    assert durations.parse_text(value) == pytest.approx(seconds)


@pytest.mark.parametrize("value", ["", "abc", "5", "d", "1dx", "h"])
def test_bad_intervals(value):
    with pytest.raises(ValueError):
        durations.parse_text(value)


@given(st.integers(0, 10_000_000))
@settings(max_examples=100, deadline=None)
def test_formatted_intervals_read_back(seconds):
    back = durations.parse_text(durations.format_text(seconds))
    assert back <= seconds and seconds - back < (60 if seconds < 86_400 else 3600)


def test_addresses(spark):
    bad = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.169.254", "100.64.0.1", "100.127.255.255", "224.0.0.1", "0.0.0.0", "::1", "fe80::1", "fc00::1", "ff02::1", "::", "::ffff:10.0.0.1", "x", "", None]
    good = ["8.8.8.8", "172.32.0.1", "100.63.255.255", "100.128.0.0", "2606:4700::1", "::ffff:8.8.8.8"]
    assert column(spark, bad + good, addresses.blocked) == [True] * len(bad) + [False] * len(good)
    v4 = [a for a in bad + good if a and "." in a and ":" not in a]
    assert column(spark, v4, addresses.blocked_v4) == [addresses.is_blocked(a) for a in v4]


def test_local_names(spark):
    rows = spark.createDataFrame([("http://h/a/pic.JPEG", "image/png; x"), ("http://h/a/pic.jpeg", None), ("http://h/a/pic", None), ("http://h/a/pic", "image/bmp"), ("http://h/x.y.gif?z", "text/html")], "u string, t string")
    got = [r[0] for r in rows.select(pictures.local_name(F.col("u"), F.col("t"))).collect()]
    assert [g and (g.split("_")[0], g.rsplit(".", 1)[1], len(g.split("_")[-1].split(".")[0])) for g in got] == [("pic", "png", 8), ("pic", "jpeg", 8), None, ("pic", "bmp", 8), ("x.y", "gif", 8)]


def test_jitter_bounds(spark):
    lo, hi = spark.range(2000).select(durations.jitter(F.lit(100.0), 1).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert 90 <= lo < 92 and 108 < hi <= 110
