"""Near-duplicates, packing, mixing, pages and URLs against brute force."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwarden.llm import components, html_extract, minhash_forest, mixing, packing, url_filter

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- near-duplicates


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        inter = len(sets[i] & sets[j])
        if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
            a, b = comp[i], comp[j]
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    return sets, comp


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(20, 120)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = word()
            texts.append(" ".join(copy).title() if rng.random() < 0.2 else "  ".join(copy))
    base = [word() for _ in range(100)]
    for i in range(60):  # one large group of near copies
        copy = list(base)
        copy[i] = word()
        texts.append(" ".join(copy))
    texts += ["", "   ", None, "One", "one", "two words", "TWO\twords", "word " * 3000]
    sets, comp = brute_components(texts, n, percent)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, node int")
    got = {r["doc_id"]: r for r in minhash_forest.near_duplicates(docs.select("doc_id", "text", F.col("node").alias("n")), n, percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in got)


def test_links_hidden_in_a_dense_region(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(200)]

    def changed(words, places):
        out = list(words)
        for p in places:
            out[p] = word()
        return out

    family = [changed(base, [3 + 5 * (i % 30)]) for i in range(60)]
    # each outlier is near one member, and just too far from the rest
    outliers = [changed(family[7 * k], range(160, 160 + 2 * (k + 4), 2)) for k in range(8)]
    texts = [" ".join(w) for w in family + outliers]
    _, comp = brute_components(texts, 3, 85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(docs, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(5, "same text here now"), (5, "same text here now"), (None, "same text here now"), (6, "same text here now"), (9, "other")], "doc_id long, text string")
    got = minhash_forest.near_duplicates(docs, 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, 5, False), (5, 5, True), (5, 5, True), (6, 5, False), (9, 9, True)]
    assert minhash_forest.near_duplicates(docs.where("false")).count() == 0


# ---------------------------------------------------------------- packing


def unpacked(rows, capacity=2048):
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert all(v <= capacity for v in at.values())
    return len(at)


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(5)
    texts = [None, "", "Hello, World! it's ÉTÉ straße 12345", "x" * 500, "<|endoftext|> ΑΣ İ ﬁ 日本", "so<|endoftext|>it ends <|ENDOFTEXT|>", "a b c " * 3000] + [" ".join("word%d" % w for w in rng.integers(0, 99, int(rng.integers(1, 700)))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(2, texts[2], 3)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    for i, t in enumerate(texts):
        ids = np.asarray((tok.encode(t, add_special_tokens=False).ids if t else []) + [0], "<u4")
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i})
        assert own == [(p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    n = unpacked(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack_documents(docs.where("false"), TOKENIZER).count() == 0


def best_bins(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                put(i + 1, bins)
                bins[b] -= sizes[i]
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


def test_reduction_fixes_one_two_and_three_pieces():
    fixed, left = packing.fix_dominating(Counter({20: 3, 13: 2, 7: 2, 8: 1, 6: 1}), 20)
    assert not left and sorted((b, sorted(Counter(dict(p)).elements())) for b, p in fixed) == [(1, [6, 8]), (2, [7, 13]), (3, [20])]
    fixed, left = packing.fix_dominating(Counter({8: 5, 7: 5, 5: 5}), 20)
    assert not left and fixed == [(5, [(8, 1), (7, 1), (5, 1)])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(3, 20), min_size=1, max_size=9))
def test_reduction_never_costs_a_bin(sizes):
    fixed, left = packing.fix_dominating(Counter(sizes), 20)
    used = Counter()
    for bins, pattern in fixed:
        assert sum(s * k for s, k in pattern) <= 20
        for s, k in pattern:
            used[s] += bins * k
    assert used + left == Counter(sizes)
    rest = list(left.elements())
    assert sum(b for b, _ in fixed) + (best_bins(rest, 20) if rest else 0) == best_bins(sizes, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_grouped_best_fit_equals_one_by_one(sizes):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(50 - s)
    groups = packing.best_fit(Counter(sizes), 50)
    assert sorted(50 - sum(s * k for s, k in p) for b, p in groups for _ in range(b)) == sorted(rooms)


# ---------------------------------------------------------------- mixing


def test_targets_equal_plain_water_filling(spark):
    sizes = {"a": 100, "b": 4000, "c": 50, "d": 900, "é": 10, None: 300}
    rows = [(s, n) for s, n in sizes.items()]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert {s: r["weight"] for s, r in got.items()} == weight
    assert all(abs(got[s]["target"] - target[s]) < 1e-6 for s in sizes)


def test_mix_is_seeded_and_whole(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 11 else None, 1) for i in range(4000)] + [(9000, None, "s1", 1), (9001, "  ", "s9", 1), (1, "w w", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    a = sorted(mixing.mix(docs).select("doc_id", "_size", "_source_size", "_target", "_copies").collect())
    assert a == sorted(mixing.mix(docs.repartition(7)).select("doc_id", "_size", "_source_size", "_target", "_copies").collect())
    assert len(a) == len(rows) and max(r["_copies"] for r in a) <= 2
    by = mixing.mix(docs).groupBy("source").agg(F.max("_target").alias("t"), F.sum(F.col("_size") * F.col("_copies")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) <= 0.1 * r["t"] + 5 for r in by), by
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r["_copies"] for r in a)
    assert mixing.mix(docs.where("false")).count() == 0
    assert all(r["_copies"] == 0 for r in mixing.mix(docs.where("doc_id = 9001")).collect())


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain words only", "plain words only"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One &amp; two<br>three<p>Four  <b>five</b></article><footer>f</footer>", "T\nOne & two three\nFour five"),
        ("<html><head><title>x</title><script>var a='</p>';</script></head><body><div class='ad'>Buy</div><main><p>Kept.</p><form>no</form><p>Too.</p></main></body>", "Kept.\nToo."),
        ("<article><p>Text</p><section id='comments'><p>Me too</p></section><aside>side</aside><p>End</p></article>", "Text\nEnd"),
        ("<div class='cookie-notice'>We use cookies</div><div><p>" + "long text " * 20 + "</p><p>Short.</p></div>", ("long text " * 20).strip() + "\nShort."),
        ("<article>a < b &lt;c&gt; <!-- no --> d</article>", "a < b <c> d"),
        ("<nav><ul><li>x</ul><article><p>unclosed menu</p></article>", "unclosed menu"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_articles_are_a_hint_only():
    para = [("word%d " % k * 60).strip() for k in range(3)]
    cards = "".join(f"<article><h2>Card {k}</h2><p>A teaser of some words, no more.</p></article>" for k in range(4))
    body = "".join(f"<p>{t}</p>" for t in para)
    got = html_extract.main_text(f"<div>{body}</div>{cards}").split("\n")
    assert got[:3] == para  # the body stands outside the teasers' article elements
    links = "".join(f"<li><a href=x>Other story {k}</a></li>" for k in range(8))
    page = f"<div><p>Some unmarked words of the site, not of the article.</p></div><article><h1>T</h1>{body}<p>End.</p><ul>{links}</ul></article>"
    got = html_extract.main_text(page).split("\n")
    assert got[:5] == ["T", *para, "End."]  # edges bound the run, short first and last lines stay
    assert "Other story 7" not in got  # a block of links inside the article is judged


def test_gaps_do_not_split_the_body():
    para = ["w%d " % k * 170 for k in range(3)]
    body = "".join(f"<p>{t}</p>" for t in para)
    want = [t.strip() for t in para]
    close = "The closing paragraph of two hundred characters. " * 4
    got = html_extract.main_text(f"<div>{body}<div class=ad>Buy</div><p>{close}</p></div>").split("\n")
    assert got == [*want, close.strip()]  # under 20% of the densest window
    got = html_extract.main_text(f"<div>{body}<div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div>{body}</div>").split("\n")
    assert got == [*want, "Short.", *want]  # a short line between two gaps
    links = [f"Source {k}" for k in range(9)]
    got = html_extract.main_text(f"<div>{body}<ul>{''.join(f'<li><a href=x>{t}</a>' for t in links)}</ul>{body}</div>").split("\n")
    assert got == [*want, *links, *want]  # a linked stretch inside the body
    menu = "".join(f"<li><a href=x>Menu entry {k}</a>" for k in range(9))
    got = html_extract.main_text(f"<div><p>A slogan of the site with over forty characters.</p><ul>{menu}</ul>{body}</div>").split("\n")
    assert got[-3:] == want and "Menu entry 4" not in got


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<article>" + "<p>x</p>" * 20_000, "t"), (None, "u", "<p>" * 5000, "t")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 4 and {r["n_chars"] for r in got if r["page_id"] == 2} == {39_999}
    assert html_extract.extract(pages.where("false")).count() == 0


# ---------------------------------------------------------------- URLs


def test_bloom_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(0)
    keys, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 50_000)
    bloom = url_filter.BlockedBloom(5000 // url_filter.KEYS_PER_BLOCK + 1)
    bloom.add(keys)
    assert bloom.might(keys).all() and bloom.might(others).mean() < 0.02


def test_url_match_equals_plain_rules(spark):
    rules = [("org", "/", "rule", "allow"), ("example.org", "/es/", "rule", "block"), ("example.org", "/en/1", "rule", "block"), ("com", "/fr/", "rule", "allow"), ("com", "/de/", "rule", "block"), ("bad.net", "/", "list", "block")]
    urls = [f"http://{h}{p}" for h in ("a.org", "EXAMPLE.org", "x.example.org", "notexample.org", "example.com", "bad.net", "very.bad.net", "org") for p in ("", "/", "/es/x", "/en/12?q", "/en/2#f", "/fr/a", "/de/")] + [None, "", "no scheme", "x://", "http://a.org://b/", "http://\u00e9.org/es/"]

    def plain(url):
        if not url or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(k == "rule", len(h) + len(p), h + p) for h, p, k, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None

    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    got = url_filter.match(pages, spark.createDataFrame(rules, "host string, path string, kind string, verdict string")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["host"], r["path"], r["entry"]) == plain(urls[r["page_id"]]), urls[r["page_id"]]
    # any number of listed path lengths
    many = [("h.org", "/" + "x" * n, "list", "block") for n in range(0, 5000)]
    one = spark.createDataFrame([(1, "http://a.h.org/" + "x" * 4321 + "y", "x"), (2, "http://a.h.org/", "x"), (3, "http://g.org/xx", "x")], "page_id long, url string, host string")
    got = {r["page_id"]: r["entry"] for r in url_filter.match(one, spark.createDataFrame(many, "host string, path string, kind string, verdict string")).collect()}
    assert got == {1: "h.org/" + "x" * 4321, 2: "h.org/", 3: None}
    empty = spark.createDataFrame([], "host string, path string, kind string, verdict string")
    assert url_filter.match(pages, empty).where("entry is not null").count() == 0


def test_dropping_copies_does_not_shuffle_texts(spark, monkeypatch):
    """A list of up to BROADCAST_IDS ids goes to the texts, whatever Spark thinks of its size; a longer one gives the same rows."""
    rows = [(i, " ".join(f"w{i % 40}x{k}" for k in range(30))) for i in range(60)] + [(7, "twice the same id and text"), (7, "twice the same id and text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash_forest.one_of_each(docs)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(minhash_forest, "BROADCAST_IDS", 0)
        by_shuffle = minhash_forest.one_of_each(docs)
        assert "SortMergeJoin" in by_shuffle._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_shuffle.collect())) == sorted({*rows[:40], rows[-1]})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
