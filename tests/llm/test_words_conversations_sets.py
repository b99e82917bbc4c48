"""Spelling variants, conversation repair and the set similarity join against brute force."""

import random
import re
from collections import Counter
from functools import cache

import pytest

from pricewell.llm import chosen_path, conversation_repair, spelling
from pricewell.llm.queries import damaged, misspelt

from .conftest import DOCUMENTS

TURNS = "conv_id long, turn long, role string, text string"


# --- spelling ----------------------------------------------------------------------------

def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts: dict, ratio: int) -> set:
    form, near = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and one_apart(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        near[w] = len(others)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, near[w], counts.get(form[w])) for w, n in counts.items()}


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE_WORDS", 7)  # many ranges, so that nodes are shared across cuts
    rng = random.Random(5)
    counts = {"a" * 300: 50, "a" * 299: 10, "a" * 301: 2, "ÿéß"[:2] * 4: 9, "": 3}
    for _ in range(60):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(4, 7)))
        counts[word] = rng.choice([1, 1, 5, 25, 125, 625])
        at = rng.randrange(len(word))
        counts.setdefault(word[:at] + rng.choice(["", "z", word[at] * 2]) + word[at + 1 :], rng.choice([1, 5, 25]))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(frame, 5).collect()]
    expected = {r for r in plain_variants({w: n for w, n in counts.items() if w}, 5)}
    assert len(got) == len(counts)
    assert {r for r in got if r[0]} == expected
    assert any(r[2] not in (r[0], r[1]) for r in got)  # chains of forms occur


def test_words_of_documents(spark, frame):
    rows = [(1, "Straße STRASSE x1y éàü", None, None), (1, "Straße STRASSE x1y éàü", None, None), (None, "straße " * 3000, None, None),
            (2, None, None, None), (3, "", None, None), (4, "!?", None, None)]
    docs = frame(rows, DOCUMENTS)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, least_length=3, least_count=2).collect()}
    assert got == {"straße": 3002, "strasse": 2, "éàü": 2}
    altered = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            altered[misspelt(doc_id)(run.lower())] += 1
    some = spelling.word_counts(docs, least_length=1, least_count=1, alter=misspelt)
    assert {r["word"]: r["n"] for r in some.collect()} == {w: n for w, n in altered.items() if w}
    none = spelling.variants(spelling.word_counts(docs.limit(0)))
    assert none.collect() == []


# --- conversations -----------------------------------------------------------------------

def plain_repair(rows):
    """The least audit by trying every edit, inserting at most two rows at a place."""
    C = conversation_repair

    @cache
    def best(at, state, inserts=0):
        ways = [(0, "")] if at == len(rows) and state in C.ENDS else []
        if inserts < 2:
            ways.append(_plus(best(at, C.AFTER_FIT[state], inserts + 1), 3, "I"))
        if at < len(rows):
            initial, fault = rows[at]
            ways.append(_plus(best(at + 1, state), 4, "D"))
            if fault in (C.SOUND, C.TRUNCATED):
                extra = 3 * (fault == C.TRUNCATED)
                ways.append(_plus(best(at + 1, C.AFTER_FIT[state]), 3 + extra, "R"))
                if (state, initial) in C.STEP:
                    ways.append(_plus(best(at + 1, C.STEP[state, initial]), extra, "K"))
        return min((w for w in ways if w), default=None)

    def _plus(way, cost, letter):
        return way and (way[0] + cost, letter + way[1])

    return best(0, C.NOTHING)


def test_cheapest_equals_trying_every_edit():
    rng = random.Random(3)
    assert conversation_repair.cheapest([]) == (0, "")
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 9))]
        assert conversation_repair.cheapest(rows) == plain_repair(tuple(rows)), rows


def _conversations(spark):
    rng = random.Random(11)
    rows = [(None, None, None, None), (None, None, None, None), (7, 3, "system", "Hi."), (7, 9, "user", "\t"), (8, None, "usher", "ok?")]
    for conv in range(40):
        for turn in range(rng.randint(1, 30)):
            rows.append((conv + 10, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "assistant", "tool"]),
                         rng.choice(["", " ", "Yes.", "No", f"text {turn}!", "long " * 2000 + "."])))
    return spark.createDataFrame(rows, TURNS)


def test_long_conversations_are_repaired_piece_by_piece(spark, frame, monkeypatch):
    from pyspark.sql import functions as F

    # One partition of columns that clash with the operator's own.
    conversations = _conversations(spark).withColumns({c: F.lit(1) for c in ("ord", "piece", "same", "fault")})
    rows = conversation_repair.diagnosed(conversations)
    plan = conversation_repair.repairs(rows)
    whole = {r["conv"]: r for r in conversation_repair.summary(rows, plan).collect()}
    hashes = {r["conv"]: r["sha256"] for r in conversation_repair.digests(conversation_repair.repaired(rows, plan, True)).collect()}
    by_conv = {}
    for r in sorted(rows.collect(), key=lambda r: r["ord"]):
        by_conv.setdefault(r["conv"], []).append((r["initial"], r["fault"]))
    for conv, pairs in by_conv.items():
        assert (whole[conv]["cost"], whole[conv]["audit"]) == plain_repair(tuple(pairs))
        initials = [a for a, _ in pairs]
        assert whole[conv]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert whole[None]["blank"] == 2 and whole[None]["gaps"] == 0 and whole[7]["gaps"] == 5

    monkeypatch.setattr(conversation_repair, "PIECE", 4)
    monkeypatch.setattr(conversation_repair, "PIECE_BITS", 2)
    cut = conversation_repair.diagnosed(conversations)
    assert cut.filter("piece >= 0").count() > 100
    pieces = conversation_repair.repairs(cut)
    again = {r["conv"]: r for r in conversation_repair.summary(cut, pieces).collect()}
    assert again == whole
    assert {r["conv"]: r["sha256"] for r in conversation_repair.digests(
        conversation_repair.repaired(cut, pieces, True)).collect()} == hashes
    out = {}
    for r in conversation_repair.repaired(cut, pieces).orderBy("piece", "nth").collect():
        out.setdefault(r["conv"], []).append(r["role"][0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in out.values())


def test_damage_and_empty_tables(spark):
    none = _conversations(spark).filter("conv_id < 0")
    rows = conversation_repair.diagnosed(damaged(none))
    plan = conversation_repair.repairs(rows)
    assert conversation_repair.summary(rows, plan).count() == 0
    assert conversation_repair.repaired(rows, plan).count() == 0
    import zlib

    kept = Counter()
    for r in _conversations(spark).collect():
        conv, turn = (" " if v is None else v for v in (r["conv_id"], r["turn"]))
        k = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        kept[r["conv_id"], r["turn"]] += {0: 0, 3: 2}.get(k, 1)
    got = Counter((r["conv_id"], r["turn"]) for r in damaged(_conversations(spark)).collect())
    assert got == +kept


# --- set similarity ----------------------------------------------------------------------

def plain_components(rows, shingle, threshold):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        width = min(shingle, len(words))
        sets.append({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((r[0], len(s), r[0] if not s else least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("small", [25, 2000])
def test_components_equal_brute_force(spark, frame, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    rng = random.Random(small)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = rng.choices(vocabulary, k=60)
    rows = [(1, None, None, None), (2, "", None, None), (2, "", None, None), (3, "One two", None, None), (4, "one\ttwo ", None, None),
            (None, "one two", None, None), (None, "only here", None, None), (5, "x " * 30_000 + "y", None, None),
            (6, "x " * 40_000 + "Y", None, None)]
    for family in range(12):
        text = rng.choices(vocabulary, k=rng.choice([40, 120, 300])) + shared
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(copy), None, None))
    got = chosen_path.near_duplicates(frame(rows, DOCUMENTS)).collect()
    assert Counter(tuple(r) for r in got) == plain_components(rows, 5, 85)


def test_set_join_defined_cases(spark, frame):
    assert chosen_path.near_duplicates(frame([], DOCUMENTS)).collect() == []
    assert chosen_path.trees_for(0.999, 85) < chosen_path.trees_for(0.99999, 85)
    nothing = chosen_path.near_duplicates(frame([(None, None, None, None), (9, " \n", None, None)], DOCUMENTS)).collect()
    assert sorted(map(tuple, nothing), key=str) == [(9, 0, 9), (None, 0, None)]
