"""Extra columns with every name the operators use inside, repeated ids, empty tables."""

import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwarden.llm import ann, embed_dedup, html_extract, langid, minhash_forest, mixing, packing, pii, toxicity, url_filter

LLM = Path(minhash_forest.__file__).parent
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
#: Every short quoted name in the subpackage's sources and in the pipeline: whatever columns they make or use.
NAMES = sorted({n.lower() for f in [*LLM.glob("*.py"), Path(corpus_pipeline.__file__)] for n in re.findall(r'"(_{0,2}[a-z][a-z0-9_]{0,14})"', f.read_text())} | {"fp", "_size", "_copies", "_target", "_source_size", "_bucket", "_toxicity", "_th"})


def widened(df, *own):
    """``df`` with a column of every name but its own; all hold 777."""
    have = {c.lower() for c in df.columns} | set(own)
    return df.select("*", *[F.lit(777).alias(n) for n in NAMES if n not in have])


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty {} mail jo@example.org."
    rows = [(i, base.format("x" if i % 2 else "y") + " z" * (i % 3), "en" if i % 2 else "de", f"s{i % 3}") for i in range(24)]
    rows += [(100 + i, f"text number {i} is apart from all the others as w{i} q{i} r{i} t{i}", "en", None) for i in range(12)]
    return spark.createDataFrame(rows + [(200, None, None, None), (201, "", "en", "s1")], "doc_id long, text string, lang string, source string")


def test_names_were_found():
    assert {"node", "sig", "_rank", "component", "label", "tree"} <= set(NAMES) and len(NAMES) > 100


def test_document_operators_with_clashing_columns(spark, docs):
    wide, labels = widened(docs).cache(), spark.createDataFrame([(i, 1, int(i % 2)) for i in range(24)], "doc_id long, quality int, toxic int")
    tagger = pii.default_tagger()
    model = toxicity.train(docs, labels)
    lang = langid.train(docs)
    pairs = [
        lambda d: toxicity.score(d, model), lambda d: toxicity.locate(d, model), lambda d: pii.detect(d, tagger), lambda d: minhash_forest.near_duplicates(d, 3, 85),
        lambda d: langid.predict(d, lang), lambda d: packing.tokenize(d, TOKENIZER),
    ]
    for f in pairs:
        a, b = f(docs), f(wide)
        assert a.columns == b.columns and rows_of(a, *a.columns) == rows_of(b, *a.columns)
    want = rows_of(mixing.mix(docs), "doc_id", *mixing.COLUMNS)
    assert rows_of(mixing.mix(wide), "doc_id", *mixing.COLUMNS) == want
    for f in (lambda d: mixing.mixed(d), lambda d: pii.mask(d, tagger), lambda d: minhash_forest.one_of_each(d), lambda d: toxicity.with_score(d, model, "_no")):
        a, b = f(docs), f(wide)
        assert rows_of(a, "doc_id", "text") == rows_of(b, "doc_id", "text")
        assert all(r[n] == 777 for r in b.collect() for n in NAMES if n in b.columns and n not in docs.columns and n not in ("_no", "n_chars"))
    assert toxicity.train(wide, widened(labels)).bias == model.bias
    pieces = packing.tokenize(docs, TOKENIZER)
    got = packing.pack(widened(pieces))
    assert {"sequence_id", "offset"} <= set(got.columns) and got.count() == pieces.count() and got.where("_bucket <> 777 or _rank <> 777").count() == 0


def test_pipeline_stages_with_clashing_columns(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(24)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    wide, plain = widened(docs), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain.write.parquet(f"{tmp_path}/p_{name}")
        wide.write.parquet(f"{tmp_path}/w_{name}")
        plain = stage(spark, spark.read.parquet(f"{tmp_path}/p_{name}"), str(tmp_path))
        wide = stage(spark, spark.read.parquet(f"{tmp_path}/w_{name}"), str(tmp_path))
        assert rows_of(plain, "doc_id", "text") == rows_of(wide, "doc_id", "text"), name
        assert wide.where(" or ".join(f"`{n}` <> 777" for n in NAMES if n in wide.columns and n not in (*docs.columns, "n_chars"))).count() == 0, name


def test_vector_and_page_operators_with_clashing_columns(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 4), 0.5], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.org/{i}", f"<p>{'words ' * 20}{i}</p>") for i in range(9)], "page_id long, url string, html string")
    listed = spark.createDataFrame([("example.org", "/", "list", "block")], "host string, path string, kind string, verdict string")
    for f, d in (
        (lambda d: embed_dedup.near_duplicates(d, 0.93), vectors), (lambda d: ann.search(d, F.col("node") % 20 == 0, 5), vectors),
        (html_extract.extract, pages), (lambda d: url_filter.match(d, listed), pages), (lambda d: url_filter.match(d, widened(listed)), pages),
    ):
        a, b = f(d), f(widened(d))
        assert a.columns == b.columns and rows_of(a, *a.columns) == rows_of(b, *a.columns)


LONG = [f"w{i}" for i in range(60)]


def near(words, at, by):
    return " ".join([*words[:at], by, *words[at + 1 :]])


@pytest.mark.parametrize("swap", [False, True])
def test_repeated_ids_lose_no_link(spark, swap):
    other = [f"v{i}" for i in range(60)]
    a, b = (other, LONG) if swap else (LONG, other)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 59, "x")), (3, near(b, 59, "y")), (4, near(b, 0, "z")), (9, "quite another text")]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 9)]


def test_null_ids_are_linked_by_their_texts(spark):
    rows = [(None, " ".join(LONG)), (None, near(LONG, 59, "x")), (7, near(LONG, 0, "y")), (None, "alone and apart"), (None, None)]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, False), (0, 0, False), (0, 7, False), (0, 7, False), (7, 7, True)]


def test_one_row_of_each_group_stays(spark):
    text, second = " ".join(LONG), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (1, second, "a"), (2, near(LONG, 59, "x"), "a"), (None, text, "a"), (None, "null id apart from all", "a"), (None, "null id apart from all", "a"), (3, None, "a"), (3, None, "a"), (4, " ", "a")]
    got = minhash_forest.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, text), (1, second), (None, "null id apart from all"), (3, None), (3, None), (4, " ")], key=str)


def test_empty_documents_through_the_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_labels_reject_nothing(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_an_entry_with_two_verdicts_and_language_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/x")], "page_id long, url string")
    listed = spark.createDataFrame([("example.org", "/", "list", "block"), ("example.org", "/", "list", "allow")], "host string, path string, kind string, verdict string")
    assert [r["verdict"] for r in url_filter.match(pages, listed).collect()] == ["allow"]
    twins = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["bb", "aa"] * 20)], "doc_id long, text string, lang string")
    model = langid.train(twins)
    assert model.labels == ["aa", "bb"] and len({r["lang_pred"] for r in langid.predict(twins, model).collect()}) == 1
