"""The contract queries' schemas, and the pipeline against a plain version of its stages."""

import itertools
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from sparkwarden.llm import mixing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == CONTRACT[name]
    rows = df.collect()
    if name in ("op1_toxicity", "op6_language_id"):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op9_source_mixing":
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0 and i < 120
        body = [str(w) for w in rng.choice(words, int(rng.integers(12, 80)))]
        if toxic:
            body[3] = "vilest"
        rows.append((i, " ".join(body) + (" mail a@b.org" if i % 7 == 0 else "") + ".", "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[1][1], "en", "s0", 0) for i in range(30)]
    rows += [(2000 + i, rows[2][1] + f" tail{i}", "en", "s1", 0) for i in range(5)]
    rows += [(3000, None, "en", "s1", 0), (3001, "", None, None, 0), (3002, "  ", "en", "s2", 0)]
    return rows, labels


def brute(rows, labels):
    """The documents before packing, stage by stage in plain Python."""
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    text = {r[0]: r[1] for r in rows}
    known = sorted((i, text[i], t) for i, _, t in labels if i not in held)
    scorer = toxicity.fit([t for _, t, _ in known], [y for _, _, y in known], 1.0).scorer()
    rows = [r for r in rows if scorer.score(r[1]) < 0.5]
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    rows = [r for r in rows if comp[r[0]] == r[0]]
    tagger, masked = pii.default_tagger(), []
    for r in rows:
        t = r[1]
        if t:
            (base, added), = pii.find([t], tagger)
            for k, a, b in sorted(base + added, key=lambda s: -s[1]):
                t = t[:a] + f"<{k.upper()}>" + t[b:]
        masked.append((r[0], t, r[3]))
    return masked


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns, name
        got.write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
    want = brute(rows, labels)
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert not any(r[0] in range(1000, 1030) or r[0] in range(2000, 2005) for r in want) and {3000, 3001, 3002} <= {r[0] for r in want}
    mixed = corpus_pipeline.mix_sources(spark, got, str(tmp_path))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == {r["doc_id"]: r["_copies"] for r in mixing.mix(got).collect() if r["_copies"]}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    places = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert places[r["sequence_id"]] == r["offset"]
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 2048
