"""Registered queries over whole columns and tables, against plain Python on fixtures."""

import html

from sparkwarden import catalog


def test_html_escape_whole(spark, tmp_path):
    pages = [(1, "<p class=\"a\">" + "x" * 200 + "</p> 'a' & \"b\" &lt;"), (2, ""), (3, None), (4, "<" * 5000)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["safe"] for r in catalog.QUERIES["d_html_escape"](spark, str(tmp_path)).collect()}
    assert got == {i: html.escape(t or "").replace("&#x27;", "&#39;") for i, t in pages}


def test_sanitize_whole(spark, tmp_path):
    hidden = {*range(0x80, 0xA0), 0x061C, *range(0x200B, 0x2010), 0x2028, 0x2029, *range(0x202A, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFEFF}

    def plain(text):
        code = lambda c: "\\t" if c == "\t" else f"\\x{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else f"\\u{{{ord(c):04X}}}" if ord(c) in hidden else c
        return None if text is None else "".join(map(code, text))

    every = "".join(map(chr, (*range(1, 0x300), *range(0x2000, 0x2070), 0xFEFF, 0x1F600)))
    texts = ["x" * 100 + "\tq\n\x1b\u202e\u200b\x85\u2028", "y" * 61 + every, "", None, "z\\t" * 5000 + "\x00\ufeff"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["safe"] for r in catalog.QUERIES["d_sanitize"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_all_orders_and_lines(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("orders", [(k, 10 + k % 3) for k in range(1, 8)], "o_orderkey long, o_custkey long")
    write("customer", [(10, 0), (11, 1), (12, 1)], "c_custkey long, c_nationkey long")
    write("nation", [(0, 5), (1, 6)], "n_nationkey long, n_regionkey long")
    write("lineitem", [(1, 1, "R"), (1, 2, "R"), (1, 3, "N"), (2, 3, "R"), (3, 1, "N"), (3, 7, "A")], "l_orderkey long, l_linenumber int, l_returnflag string")
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    want = [f"o{k}" for k in range(1, 8)] + "c10 c11 c12 n0 n1 r5 r6".split()
    assert run("g_fixpoint_bounded") == sorted((n, False) for n in want)
    assert run("g_taint_quote_labels") == [(1, "712", "certain"), (2, "709q", "high"), (3, "709", "certain")]
    assert [r[:2] for r in run("o_trace")] == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 1), (3, 7)]
