from pricewell.llm import line_dedup, sharding, url_cascade
from pricewell.llm.queries import URL_RULES

from .conftest import DOCUMENTS

LONG = "this line is long enough to count"


def test_repeated_lines_stay_in_the_largest_id_only(frame):
    rows = [
        (1, f"a\n{LONG}\nb", None, None), (2, f"  {LONG.upper()}\t", None, None), (3, f"{LONG}\n{LONG}", None, None),
        (4, None, None, None), (5, "", None, None), (None, LONG, None, None), (1, f"a\n{LONG}\nb", None, None),
        (6, "\n".join(["x"] * 70 + [LONG]), None, None), (7, "short\nshort", None, None),
    ]
    docs = frame(rows, DOCUMENTS)
    kept = line_dedup.kept_lines(docs, line_dedup.dropped_lines(docs)).collect()
    out = sorted(((r["doc_id"], r["lines"], r["kept"]) for r in kept), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(i, k) for i, _, k in out] == [
        (1, ["a", "b"]), (1, ["a", "b"]), (2, []), (3, []), (4, [""]), (5, [""]), (6, ["x"] * 70 + [LONG]),
        (7, ["short", "short"]), (None, []),
    ]
    assert not line_dedup.dropped_lines(docs.limit(0)).collect()


def test_cascade_is_exact_for_every_key_of_the_corpus(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    levels = url_cascade.build_cascade(keys, listed)
    assert len(levels) > 1
    said = {r[0]: r[1] for r in keys.select("key", url_cascade.is_listed(levels, keys["key"])).collect()}
    assert said == {f"k{i}": i % 7 == 0 for i in range(3000)}


def test_urls_take_the_longest_rule(frame):
    urls = ["http://www.Example.com/en/1?x#y", "https://m.example.com/en/", "http://a.net/fr/2", "http://a.net/xx",
            "http://com", "no scheme", None, "http://example.com/en", "http://xexample.com/en/"]
    pages = frame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_cascade.judge_urls(pages, URL_RULES).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        1: ("m.example.com", "/en/", "example.com/en/", "block"), 2: ("a.net", "/fr/2", "net/fr/", "block"),
        3: ("a.net", "/xx", None, "allow"), 4: ("com", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("example.com", "/en", "com/", "allow"),
        8: ("xexample.com", "/en/", "com/", "allow"),
    }
    assert not url_cascade.judge_urls(pages.limit(0), URL_RULES).collect()


def test_shards_grow_into_the_new_one_only_and_follow_weights(frame):
    rows = [(i // 2, "t", None, None) for i in range(4000)] + [(None, None, None, None)]
    got = sharding.assign_shards(frame(rows, DOCUMENTS), "doc_id", 8).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    assert 0 < sum(r["grown_shard"] == 8 for r in got) < 800
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    heavy = sharding.assign_shards(frame(rows, DOCUMENTS), "doc_id", weights=[3.0, 1.0, 0.0]).collect()
    first = sum(r["shard"] == 0 for r in heavy) / len(heavy)
    assert 0.7 < first < 0.8 and all(r["shard"] != 2 for r in heavy)
    assert not sharding.assign_shards(frame(rows, DOCUMENTS).limit(0), "doc_id").collect()
