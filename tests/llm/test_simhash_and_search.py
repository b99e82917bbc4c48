import numpy as np
import xxhash

from pricewell.llm import ann_tree, simhash_gray

from .conftest import DOCUMENTS


def by_hand(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_follow_their_definition():
    for text in (None, "", "One", "one TWO", "a b c d É", "x " * 70_000 + "y z"):
        assert simhash_gray.fingerprint(text) == by_hand(text)


def test_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    prints = np.unique(np.concatenate([base, near, near ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))]))
    own, visitors = prints[::2], prints[1::2]
    got = {frozenset(p) for a, b in simhash_gray.close_pairs(own, visitors, 2) for p in zip(a.tolist(), b.tolist())}
    want = {
        frozenset((int(a), int(b))) for a in own for b in prints
        if a != b and int(a ^ b).bit_count() <= 2 and (b in visitors or a < b)
    }
    assert got == want


def test_components_reach_along_chains(frame):
    texts = ["a b c d e f g h", "A b c d e f g h", None, "", "other words that are quite different here", "a"]
    docs = frame([(i, t, None, None) for i, t in enumerate(texts)] + [(None, "a", None, None), (0, texts[0], None, None)], DOCUMENTS)
    got = simhash_gray.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [
        (0, 0), (0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [5]
    assert not simhash_gray.near_duplicates(docs.limit(0)).collect()


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash_gray.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_neighbours_reach_the_recall_and_defined_cases(frame):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1500, 8)) + 3 * rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    bad = [(None, [1.0] * 8), (5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0]), (5004, [1.0, None] * 4)]
    copies = [(2000 + i, rows[0][1]) for i in range(20)] + [rows[0]]
    table = frame(rows + bad + copies, "vec_id long, embedding array<double>")
    index = ann_tree.build_index(table, k=5, leaf_rows=64)
    assert index.tree.leaves > 4 and index.visits < index.tree.leaves
    got = {}
    for r in ann_tree.nearest(index, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [v for _, v, _ in sorted(got[0])] == [2000, 2001, 2002, 2003, 2004]
    ids = np.array([i for i, _ in rows] + [i for i, _ in copies[:-1]])
    unit = np.array([p for _, p in rows] + [p for _, p in copies[:-1]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 1500, 50):
        score = unit @ unit[q]
        best = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:5]
        hits += len({int(ids[i]) for i in best} & {v for _, v, _ in got[q]})
        total += 5
    assert hits / total >= 0.9
    assert set(got) == {*range(0, 1500, 50), 2000}
    assert ann_tree.build_index(table.limit(0)) is None


def test_vectors_of_extreme_size_keep_their_angles(spark):
    sizes = (1.0, 1e-200, 1e200, 5e-324, 1.7e308)
    rows = [(50 * i, [s, s, s, s]) for i, s in enumerate(sizes)] + [(7, [1e-200, 0.0, 0.0, 0.0]), (8, [-1e200, 1e200, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann_tree.build_index(table, k=6)
    got = {}
    for r in ann_tree.nearest(index, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 50, 100, 150, 200):
        found = sorted(got[q])
        assert [i for _, i, _ in found] == [i for i in (0, 50, 100, 150, 200) if i != q] + [7, 8]
        assert [s for _, _, s in found] == [1.0] * 4 + [0.5, 0.0]


def test_one_row_of_each_group_stays(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ape", "bee", "cow", "dog"))
    rows = [
        (1, one), (1, one), (1, one),  # a table loaded more than once
        (2, one), (2, two),  # an id with a copy of an earlier text and one of its own
        (None, three), (None, three), (None, four), (7, four),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [("1", one), ("2", two), ("7", four), ("None", three)]
    for table in (docs, docs.unionAll(docs).repartition(3)):
        kept = simhash_gray.without_duplicates(table)
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == want
        assert kept.columns == docs.columns
