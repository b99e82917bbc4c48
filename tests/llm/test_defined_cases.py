"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from pricewell.llm import language_id, line_dedup, mixing, sharding, simhash_gray, surrogates, url_cascade
from pricewell.llm.queries import URL_RULES

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and runs to the river"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft"
ROWS = [
    (1, EN, "en", "web", 60), (2, DE, "de", "web", 60), (3, None, None, None, None), (4, "", "en", "", 0),
    (None, EN, "en", "books", 60), (5, "x " * 30_000 + EN, "en", "web", 60_000), (6, DE, None, None, 60),
    (6, DE, None, None, 60),
]


@pytest.fixture
def sf_dir(spark, tmp_path):
    items = [(1, "a passage that no document of this table holds at all"), (None, EN), (2, None), (3, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENT)


@pytest.mark.parametrize("name, stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_take_empty_tables(spark, docs, sf_dir, name, stage):
    out = stage(spark, docs.filter("doc_id < 0"), sf_dir)
    assert out.count() == 0
    assert set(docs.columns) <= set(out.columns)


@pytest.mark.parametrize("name, stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_take_nulls_and_clashing_columns(spark, docs, sf_dir, name, stage):
    more = ["lang_pred", "score", "_k", "key", "fp", "component_id", "item_id", "begin", "block", "column_0"]
    wide = docs.withColumns({c: F.lit(c) for c in more})
    out = stage(spark, wide, sf_dir)
    plain = stage(spark, docs, sf_dir)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    assert ids(out) == ids(plain)
    assert all(r[c] == c for r in out.select(*more).collect() for c in more)
    if name != "sharding":
        assert out.columns == wide.columns


def test_stages_keep_clean_documents(spark, docs, sf_dir):
    known = P.keep_known_languages(spark, docs, sf_dir)
    assert {r["doc_id"] for r in known.collect()} == {None, 1, 2, 5, 6}  # no letters: 3 and 4
    clean = P.drop_benchmark_leaks(spark, docs, sf_dir)  # an item without an id is a leak like any other
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 6, 6]
    alone = P.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in alone.filter("doc_id is not null").collect()) == [1, 2, 3, 5]


def test_mix_and_shards_do_not_depend_on_the_layout_of_files(spark, tmp_path):
    rows = [(i if i % 5 else None, "w " * (1 + i % 30), "en", "abc"[i % 3], i % 7) for i in range(600)]
    rows += [(7, "same text here", "en", "a", 1)] * 300
    sets = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, DOCUMENT).repartition(parts, "n_chars")
        path = f"{tmp_path}/{parts}"
        docs.write.parquet(path)
        for table in (docs, spark.read.parquet(path)):
            kept = P.mix_sources(spark, table, "")
            assert kept.columns == docs.columns
            placed = P.place_in_shards(spark, kept, "")
            sets.append((sorted(map(str, kept.collect())), sorted(map(str, placed.collect()))))
    assert all(s == sets[0] for s in sets)
    shards = [int(r.split("shard=")[1].split(",")[0]) for r in sets[0][1]]
    assert len(shards) == len(sets[0][0]) > 900 and set(shards) <= set(range(24))
    words = sum(len(r[1].split()) for r in rows)
    taken = sum(len(r["text"].split()) for r in P.mix_sources(spark, spark.read.parquet(path), "").collect())
    assert abs(taken - 1.5 * words) < 0.02 * words


def test_result_columns_replace_input_columns_of_their_name(spark):
    pages = spark.createDataFrame(
        [(1, "http://Example.com/en/a?b", "old", "old", "old", "old"), (2, None, None, None, None, None)],
        "page_id long, url string, host string, path string, rule string, verdict string",
    )
    got = {r["page_id"]: r for r in url_cascade.judge_urls(pages, URL_RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == (
        "example.com", "/en/a", "example.com/en/", "block")
    assert (got[2]["host"], got[2]["rule"], got[2]["verdict"]) == ("", None, "allow")
    rows = spark.createDataFrame([(k, -1, -1, -1) for k in (1, 2, 2, None)], "k long, shard int, slot int, grown_shard int")
    out = sharding.assign_shards(rows, "k", 3).collect()
    assert all(r["shard"] >= 0 and r["slot"] >= 0 and r["grown_shard"] >= 0 for r in out)
    assert len({(r["shard"], r["slot"]) for r in out}) == 4
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, "shard", 3)


def test_operators_agree_on_repeated_rows_and_ties(docs):
    prints = simhash_gray.near_duplicates(docs).filter("doc_id = 6").collect()
    assert len(prints) == 2 and len({tuple(r) for r in prints}) == 1
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(ROWS)
    assert all(r["taken"] <= 2 * r["size"] for r in taken)
    model = language_id.fit(docs)
    guessed = language_id.predict(docs, model, keep=[F.col("doc_id"), F.col("text")]).collect()
    assert {r["lang_pred"] for r in guessed if not r["text"]} == {language_id.UNKNOWN}
    assert {r["lang_pred"] for r in guessed if r["text"] == DE} == {"de"}
    kept = line_dedup.kept_lines(docs, line_dedup.dropped_lines(docs))
    assert kept.count() == len(ROWS)
    assert surrogates.with_surrogates(docs, "k").count() == 0
