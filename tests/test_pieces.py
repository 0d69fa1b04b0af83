"""Page functions hold pieces of results, not whole batches, and leave no trees behind."""

import gc

import pyarrow as pa

from lathe.operators import dom, pagetree

PAGE = "<html><head><title>t {}</title></head><body><article><h1>h</h1><p>{}</p><a href='/x'>l</a></article></body></html>"


def test_pieces_of_rows_and_of_characters():
    small, large = [PAGE.format(k, "a") for k in range(3 * pagetree.PIECE_ROWS // 2)], [PAGE.format(k, "b" * (pagetree.PIECE // 3)) for k in range(8)]
    texts = [*small, *large, None]
    batch = (pa.array(texts), pa.nulls(len(texts), pa.string()))
    pieces = list(pagetree.facts_udf("article").func(iter([batch, batch])))
    assert max(map(len, pieces)) <= pagetree.PIECE_ROWS and len(pieces) == 2 * 4
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [r["title"] for r in rows] == [*[f"t {k}" for k in range(len(small))], *[f"t {k}" for k in range(8)], None] * 2
    assert rows[0]["content_html"] == '<article><h1>h</h1><p>a</p><a href="/x">l</a></article>' and rows[0]["anchors"] == [{"href": "/x", "rel": ""}]
    contents = pa.array([r["content_html"] for r in rows])
    shown = [p.to_pylist() for p in pagetree.markdown_udf("h", "/", "out").func(iter([(contents, pa.array(["http://h/"] * len(rows)))]))]
    assert max(map(len, shown)) <= pagetree.PIECE_ROWS and sum(shown, [])[0] == "# h\n\na\n\n[l](x/index.md)" and sum(shown, [])[-1] is None


def test_no_tree_waits_for_the_collector():
    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(x, dom.Node) for x in gc.get_objects())
        for _ in range(20):
            pagetree.facts_of(PAGE.format(1, "a"), None, "article", [])
        assert sum(isinstance(x, dom.Node) for x in gc.get_objects()) == before
    finally:
        gc.enable()


def test_functions_of_a_crawl_take_batches_apart():
    from pyspark.util import PythonEvalType

    for f in (pagetree.facts_udf("body"), pagetree.markdown_udf("h", "/", "out"), pagetree.framework):
        assert f.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
