import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.llm import decontaminate, language_id, mixing, surrogates, token_blocks

from .conftest import DOCUMENTS

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of seventeen herbs"


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_matches_equal_brute_force():
    rng = np.random.default_rng(3)
    matcher = decontaminate.Matcher([(1, ITEM)], 0.08)
    errors = matcher.patterns[1].errors
    for edits in range(0, 13):
        text = list("zz yy " + ITEM + " and so on")
        for at in rng.choice(np.arange(6, 6 + len(ITEM)), edits, replace=False):
            text[at] = rng.choice(list("abcdxyz"))
        text = "".join(text)
        best = edit_distance_within(ITEM, text)
        assert [m[:2] for m in matcher.matches(text)] == ([(1, best)] if best <= errors else [])


def test_leaks_are_found_and_clean_documents_stay(frame, spark):
    docs = frame([
        (1, f"Intro. {ITEM.upper()}!!", None, None), (2, None, None, None), (3, "", None, None),
        (4, "clean words only " * 5000, None, None), (5, "x " * 90_000 + ITEM.replace("wizards", "wizard"), None, None),
        (None, "no id", None, None), (1, f"Intro. {ITEM.upper()}!!", None, None),
    ], DOCUMENTS)
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "?!"), (7, ITEM)], "item_id long, text string")
    found = decontaminate.contaminations(docs, items, block_chars=50).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found) == [(1, 7, 0), (1, 7, 0), (5, 7, 1)]
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "None"]
    assert not decontaminate.contaminations(docs.limit(0), items).collect()


def test_every_text_of_an_item_id_is_sought(frame, spark):
    other = "a second passage under the very same number that is not at all like the first one of them"
    docs = frame([(1, ITEM, None, None), (2, f"so {other} it is", None, None), (3, "clean", None, None)], DOCUMENTS)
    items = spark.createDataFrame(
        [(0, ITEM), (0, other), (0, other.upper()), (None, other), (None, ITEM)], "item_id long, text string")
    for chars in (50, 2_000_000):
        found = decontaminate.contaminations(docs, items, block_chars=chars).collect()
        assert sorted((r["doc_id"], str(r["item_id"])) for r in found) == [(1, "0"), (1, "None"), (2, "0"), (2, "None")]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] == [3]


def test_short_items_match_whole_words_and_single_words_whole_documents():
    matcher = decontaminate.Matcher([(1, "cat"), (2, "two cats"), (3, "a b c")], 0.08)
    hits = lambda text: sorted(m[0] for m in matcher.matches(text))
    assert hits("education of cats") == [] and hits("the cat sat") == [] and hits("cat") == [1]
    assert hits("it has two catsup bottles") == [] and hits("it has two cats now") == [2]
    assert hits("xa b c and a b c") == [3] and matcher.matches("xa b c and a b c")[0][1:] == (0, 16)


def test_rows_without_an_id_are_judged_each(frame, spark):
    docs = frame([(None, ITEM, None, None), (None, "clean", None, None), (4, ITEM, None, None), (4, "also clean", None, None)],
                 DOCUMENTS)
    items = spark.createDataFrame([(None, ITEM)], "item_id long, text string")
    assert sorted(r["text"] for r in decontaminate.decontaminated(docs, items).collect()) == ["also clean", "clean"]


def test_languages_are_learned_and_unknown_words_back_off(frame):
    words = {"a": "kata mika tolo sata", "b": "strum grolf brint zwerk"}
    rows = [(i, words[g], g, None) for g in words for i in range(20)]
    model = language_id.fit(frame(rows, DOCUMENTS))
    asked = frame([(1, "KATA tolo", None, None), (2, "grolfen zwerkst", None, None), (3, None, None, None),
                   (4, "12 34 _ ²", None, None), (5, "", None, None), (6, "kata " * 100_000, None, None),
                   (7, "日本", None, None)], DOCUMENTS)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, model, keep=[F.col("doc_id")]).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == ["a", "b", "und", "und", "und", "a"]
    assert got[7][0] in "ab" and all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.fit(frame(rows, DOCUMENTS).limit(0))
    assert {r["lang_pred"] for r in language_id.predict(asked, empty).collect()} == {"und"}


def test_fit_rows_are_distinct_texts_of_every_language(spark):
    rows = [(f"copy {i % 2} of {g}", g) for g in "abcdefgh" for i in range(60)]
    rows += [("most of all rows", "z")] * 300 + [(f"other text {i}", "z") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    drawn = language_id._sampled(docs, "text", "lang", 5).collect()
    assert len(drawn) == len({tuple(r) for r in drawn})
    assert {g: sum(r["lang"] == g for r in drawn) for g in "abcdefghz"} == dict.fromkeys("abcdefgh", 2) | {"z": 5}
    for n in (1, 40):
        drawn = language_id._sampled(docs, "text", "lang", n).collect()
        assert sum(r["lang"] == "z" for r in drawn) == n and {r["lang"] for r in drawn} == {*"abcdefghz"}


@pytest.mark.parametrize("high", [1, 2, 50_000, 2**32])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(4)
    ids = rng.integers(0, high, 512 * 9, dtype=np.uint64).astype("<u4")
    ids[::97] = 2**32 - 1
    blocks = token_blocks.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks[:-1])])
    assert np.array_equal(token_blocks.decode_blocks(b"".join(blocks), starts), ids)


@pytest.fixture
def word_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as source:
        return Tokenizer.from_file(path), source.read()


def test_word_encoder_remembers_a_fixed_number_of_bytes(word_tokenizer):
    """Distinct words of 600 letters: 3,000 of them are within the limit as a number, but not by their bytes."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = (" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (100, 600))) for _ in range(30))
    encoder = token_blocks.WordEncoder(word_tokenizer[1], 2, 1 << 20)
    allocated = pa.total_allocated_bytes()
    tracemalloc.start()
    for text in texts:
        for ids, ends in encoder.encode([text]):
            assert ends == [len(ids)]
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - allocated
    tracemalloc.stop()
    assert 1 << 18 < held < 2 << 20


def test_word_encoder_equals_tokenizer(word_tokenizer, monkeypatch):
    """Also where texts are cut into pieces and all words are forgotten at once."""
    tokenizer, vocabulary = word_tokenizer
    latin = [chr(c) for c in range(33, 0x250) if not 0x7F <= c < 0xA1]
    odd = ["", " ", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|>.", "a<|endoftext|>b", "end<|endoftext|>",
           "don't! We'll.", "und&&& (pfau)*** x--y 12,5% 3rd", "e\u0301 a=\u0338 =\u0338 b\u0338.",
           "\u0130x \u212a\u01c5. \u03a3\u03a3", "\u65e5\u672c\u8a9e",
           " ".join(latin), " ".join(f"A{c}z" for c in latin), " ".join(f"{c}'{c}" for c in latin),
           "word " * 200, "\u00e9" * 300]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for t in odd]
    for piece, remember in [(1 << 20, 1 << 20), (7, 1 << 20), (100, 0), (1 << 20, 500)]:
        monkeypatch.setattr(token_blocks, "PIECE", piece)
        encoder, got, held = token_blocks.WordEncoder(vocabulary, 2, remember), [], []
        for ids, ends in (run for _ in range(2) for run in encoder.encode([*odd, None])):
            for start, end in zip([0, *ends], ends):
                got.append(np.concatenate([*held, ids[start:end]]))
                held = []
            held.append(ids[ends[-1] if ends else 0 :])
        assert not sum(map(len, held))
        assert len(got) == 2 * len(want) + 2
        assert all(np.array_equal(g, w) for g, w in zip(got, 2 * [*want, np.array([2])]))


def test_token_files_give_back_every_document(frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["One two.", None, "", "Été <|endoftext|> don't 12,5 日本 İx", "word " * 30_000, "é b\tc"]
    docs = frame([(10 - i, t, None, None) for i, t in enumerate(texts)] + [(None, "n", None, None)], DOCUMENTS)
    got = [tuple(r) for r in token_blocks.token_digests(docs, path).collect()]
    got.sort(key=lambda r: r[1])
    encode, start, want = Tokenizer.from_file(path).encode, 0, []
    for doc_id, text in [(None, "n"), *((10 - i, texts[i]) for i in reversed(range(6)))]:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert not token_blocks.token_digests(docs.limit(0), path).collect()


def test_mix_meets_targets(frame):
    rows = [(i, "w " * (1 + i % 40), None, ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(900)]
    rows += [(2000, None, None, "a"), (2001, "", None, "z"), (2000, None, None, "a")]
    docs = frame(rows, DOCUMENTS)
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        taken[key] = taken.get(key, 0) + r["taken"]
    assert all(abs(t - target) <= 1 for (_, target), t in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(r["size"] for r in got)) <= 5
    assert not mixing.mix(docs.limit(0)).collect()
    slots = mixing.schedule(docs.sparkSession, [1000, 10, 0, 300]).orderBy("slot").collect()
    assert [sum(r["k"] == k for r in slots) for k in range(4)] == [1000, 10, 0, 300]
    assert 330 < sum(r["k"] == 0 for r in slots[:500]) < 420


def test_mix_keeps_the_order_of_the_schedule(spark):
    rows = [(i, "w " * 16, s) for s, low in (("a", 0), ("b", 1000), ("c", 2000)) for i in range(low, low + 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["key"]: r["taken"] for r in mixing.mix(docs, block=16).collect()}
    dealt = mixing.pieces(docs, block=16).collect()
    assert [r["slot"] for r in dealt] == sorted(r["slot"] for r in dealt)
    summed = dict.fromkeys(taken, 0)
    for r in dealt:
        assert 0 <= r["from"] < r["to"] <= 16
        summed[r["key"]] += r["to"] - r["from"]
    assert summed == taken
    out = mixing.mixed(docs, block=16, slot="at").collect()
    assert [r["at"] for r in out] == sorted(r["at"] for r in out)
    plain = mixing.mixed(docs, block=16)
    assert plain.columns == docs.columns
    for order in ([r["source"] for r in out], [r["source"] for r in plain.collect()], ["abc"[r["key"] // 1000] for r in dealt]):
        whole = {s: order.count(s) / len(order) for s in "abc"}
        for low in range(0, len(order) - 100, 50):
            part = order[low : low + 100]
            assert all(abs(part.count(s) / 100 - whole[s]) < 0.05 for s in "abc")


def test_surrogates_are_consistent_distinct_and_complete(frame):
    mails = [f"user{i}@host.example.com" for i in range(300)]
    docs = frame([(i, f"Write {m} or call +1 (017) 555-77{i % 90 + 10}.", None, None) for i, m in enumerate(mails)] + [
        (900, f"Mr. Jan Vos and Mrs. Anna Vos; {mails[0].upper()} 10.2.3.4", None, None), (901, None, None, None),
        (902, "", None, None), (903, "clean text 1234", None, None), (904, "Г-н Иван Петров", None, None),
    ], DOCUMENTS)
    got = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(docs, "key").collect()}
    assert set(got) == {*range(300), 900, 904}
    new = [got[i].split()[1] for i in range(300)]
    assert len(set(new)) == 300 and not set(new) & set(mails)
    assert new[0].upper() in got[900] and "Vos" not in got[900] and "10.2.3.4" not in got[900]
    words = got[900].replace(";", "").split()
    assert words[0] == "Mr." and words[2] == words[6] and words[1].endswith("n") and words[5].endswith("na")
    assert all("а" <= c.lower() <= "я" for c in got[904].split()[1])
    assert not surrogates.with_surrogates(docs.limit(0), "key").collect()


def test_no_word_of_a_name_stays(spark):
    names = ["Mr. Juan Carlos Garcia", "Mr. Jean-Luc Picard", "Mrs. Anna van Dijk", "Mr. O'Brien", "Prof. Dr. Eva Horn",
             "Mr. JAN VOS", "Sr. de la Cruz", "Mr. John F. Kennedy", "Herr Dr. Max d'Artagnan", "Dr. Anna Vos", "Mrs. Anna Vos",
             "Mr. Jan", "Mr. Jan Vos", "Mr. Vos's", "Г-жа Анна фон Мейер"]
    rows = [(i, f"so {n}, who left") for i, n in enumerate(names)]
    rows += [(50, "Mr. Jan Vos Mrs. Anna Vos"), (51, "Mr. Jan Vos Anna.Vos@host.example.com"),
             (52, "Mr. Jan Vos DE89370400440532013000 end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(docs, "key").collect()}
    assert set(got) == {i for i, _ in rows}
    titles = {"Mr.", "Mrs.", "Dr.", "Prof.", "Sr.", "Herr", "Г-жа"}
    for i, n in enumerate(names):
        left = got[i].removeprefix("so ").removesuffix(", who left").removesuffix("'s").split(" ")
        assert len(left) == len(n.split(" "))
        for old, new in zip(n.split(" "), left):
            assert (old == new) == (old in titles), (n, got[i])
    word = lambda i, at: got[i].replace(",", "").removesuffix(" who left").split(" ")[at]
    assert word(9, 2) == word(10, 2) and word(9, 2).endswith("na") and word(9, 3) == word(10, 3) == word(12, 3)
    assert word(11, 2) == word(12, 2) and word(12, 2).endswith("n")
    assert got[50].split()[0::3] == ["Mr.", "Mrs."] and got[50].split()[2] == got[50].split()[5] == word(9, 3)
    assert "Vos" not in got[51] and got[51].count("@") == 1 and "Anna" not in got[51]
    assert "370400440532013000" not in got[52] and got[52].endswith(" end")
