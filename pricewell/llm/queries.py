"""One query per operator over the test tables, and its SQL where SQL can say the same."""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import (
    ann_tree, chosen_path, conversation_repair, decontaminate, language_id, line_dedup, mixing, sharding, simhash_gray,
    spelling, surrogates, token_blocks, url_cascade,
)
from pricewell.plans.session import use_local_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_local_folder(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    kept = line_dedup.kept_lines(documents, line_dedup.dropped_lines(documents))
    return kept.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def _rendezvous_sql(shards: int) -> str:
    best = f"""arg_min(i, -ln((('0x' || substr(md5(doc_id || ':' || i), 1, 13))::BIGINT + 0.5) / pow(2, 52)))
      FILTER (WHERE i < {shards})"""
    return f"({best})::INT"


SHARDS_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h, t
  FROM documents, crc_table),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(size - 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM sized),
placed AS (
  SELECT doc_id, any_value(size)::BIGINT AS size, any_value(text_crc32) AS text_crc32,
         {_rendezvous_sql(24)} AS shard, {_rendezvous_sql(25)} AS grown_shard
  FROM summed, range(25) AS r(i) GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM placed"""


@query("op4_sharding", SHARDS_SQL)
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
    )
    out = sharding.assign_shards(rows, "doc_id", 24, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The rules of the contract.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

URLS_SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS r FROM pages),
split AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(CASE WHEN instr(r, '/') > 0 THEN left(r, instr(r, '/') - 1) ELSE r END,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(r, '/') > 0 THEN substr(r, instr(r, '/')) ELSE '' END AS path FROM rest)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1"""


@query("op8_url_filter", URLS_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_simhash_gray")
def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, limit=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id):
    """The fold that language models never learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents.filter(~held_out(F.col("doc_id"))))
    return language_id.predict(documents, model, keep=[F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


@query("op6_token_blocks")
def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_blocks.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
sources AS (
  SELECT source, size::BIGINT AS size, n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, sum(size) AS size, count(*) AS n FROM sized GROUP BY source)),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) OVER before, 0)) / (sum(w) OVER onwards) AS rate
  FROM sources
  WINDOW before AS (ORDER BY 2 * size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onwards AS (ORDER BY 2 * size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT arg_min(rate, 2 * size / w::DOUBLE) AS rate FROM filled WHERE rate * w <= 2 * size),
goals AS (
  SELECT source, size, CASE WHEN f.rate * w <= 2 * size THEN l.rate * w ELSE (2 * size)::DOUBLE END AS target
  FROM filled f, level l),
placed AS (
  SELECT s.doc_id, s.size, g.size AS source_size, g.target, floor(g.target + 0.5)::BIGINT AS take,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS b
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
  (take // source_size) * size + greatest(0, least(b + size, take % source_size) - b) END::BIGINT AS taken
FROM placed"""


@query("op10_source_mix", MIX_SQL)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("slots").withColumnRenamed("key", "doc_id")


@query("op10_mix_order")
def op10_mix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix that ``op10_source_mix`` sums up, in the order of its schedule."""
    return mixing.pieces(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op1_ann_tree")
def op1_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann_tree.build_index(vectors, k=5)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann_tree.nearest(index, vectors.filter("vec_id % 50 = 0"))


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"), key="surrogates of the test tables")


CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))"""


def _crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, with ``crc_table`` joined."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})),
      lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id || ':' || run AS name, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {_crc_sql("name")} AS h FROM counted, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
  FROM hashed),
vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n FROM words GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
holes AS (
  SELECT word, left(word, i - 1) || '_' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM places),
near AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, v.word FROM holes h JOIN vocabulary v ON h.rest = v.word
  UNION SELECT v.word, h.word FROM holes h JOIN vocabulary v ON h.rest = v.word),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS other, max(o.n) AS other_n
  FROM near JOIN vocabulary o ON o.word = near.other GROUP BY near.word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form,
         CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
steps AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON f.word = s.word AND s.next IS NULL"""


def misspelt(doc_id):
    """The misspellings that the query's contract plants: of about one run in 199, a letter goes."""
    begin = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), begin)
        if h % 199:
            return run
        return run[: h % len(run)] + run[h % len(run) + 1 :]

    return change


@query("op11_spelling_variants", SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), least_length=6, least_count=5, alter=misspelt)
    return spelling.variants(counts, ratio=5)


def _least_sql(*labels: str) -> str:
    return f"least({', '.join(labels)})"


def _edit_sql(label: str, cost: str, letter: str) -> str:
    """A label is the cost in nine digits and the audit; X is none."""
    return (f"CASE WHEN {label} = 'X' THEN 'X' "
            f"ELSE lpad((left({label}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({label}, 10) || '{letter}' END")


def _let_sql(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _repair_sql() -> str:
    def inserted(v: str) -> str:
        """Labels of the states nothing, system, user, assistant after any inserts."""
        user = f"[{v}[1], {v}[2], {_least_sql(f'{v}[3]', *(_edit_sql(f'{v}[{i}]', '3', 'I') for i in (1, 2, 4)))}, {v}[4]]"
        return _let_sql(user, "w", f"[w[1], w[2], w[3], {_least_sql('w[4]', _edit_sql('w[3]', '3', 'I'))}]")

    extra = "CASE WHEN x[2] = '3' THEN 3 ELSE 0 END"

    def kept(state: int, initial: str) -> str:
        return f"CASE WHEN x[1] = '{initial}' AND x[2] IN ('0', '3') THEN {_edit_sql(f's[{state}]', extra, 'K')} ELSE 'X' END"

    def reroled(state: int) -> str:
        return f"CASE WHEN x[2] IN ('0', '3') THEN {_edit_sql(f's[{state}]', f'3 + {extra}', 'R')} ELSE 'X' END"

    def deleted(state: int) -> str:
        return _edit_sql(f"s[{state}]", "4", "D")

    read = ", ".join([
        deleted(1), _least_sql(deleted(2), kept(1, "s")),
        _least_sql(deleted(3), *(f(i, *a) for i in (1, 2, 4) for f, a in ((kept, "u"), (reroled, ())))),
        _least_sql(deleted(4), kept(3, "a"), reroled(3)),
    ])
    return _let_sql(f"[{read}]", "v", inserted("v"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
REPAIR_SQL = f"""
WITH {CRC_TABLE_SQL},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {_crc_sql("name")} % 20 AS k FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN ''
    WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(2) AS copies(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ordered),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN trim(text, {_SPACE_SQL}) = '' THEN 1 WHEN nth > 1 THEN 2
    WHEN right(rtrim(text, {_SPACE_SQL}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM placed),
grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list([initial, fault::VARCHAR] ORDER BY i) AS pairs
  FROM judged GROUP BY conv_id),
solved AS (
  SELECT * EXCLUDE (pairs), list_reduce(list_prepend(['000000000', 'X', '000000003I', '000000006II'], pairs),
    lambda s, x: {_repair_sql()}) AS s FROM grouped),
chosen AS (SELECT * EXCLUDE (s), left(least(s[1], s[4]), 9)::BIGINT AS cost, substr(least(s[1], s[4]), 10) AS audit FROM solved),
edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p
  FROM chosen WHERE audit <> ''),
counted AS (
  SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
         count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS m FROM edits),
joined AS (
  SELECT c.*, j.role, j.text, j.initial,
         bool_or(m = 1 AND e = 'K' AND j.initial = 's') OVER (PARTITION BY c.conv_id) AS opened
  FROM counted c LEFT JOIN judged j ON c.e <> 'I' AND c.conv_id IS NOT DISTINCT FROM j.conv_id AND c.i = j.i
  WHERE e <> 'D'),
hashed AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN e = 'K' THEN role WHEN (m - CASE WHEN opened THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS repaired_sha256 FROM joined GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN hashed h ON o.conv_id IS NOT DISTINCT FROM h.conv_id"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the query's contract plants; nulls read as one space."""
    blank = F.lit(" ")
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), blank) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("k"),
    ).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = conversation_repair.diagnosed(damaged(conversations))
    plan = conversation_repair.repairs(rows)
    hashes = conversation_repair.digests(conversation_repair.repaired(rows, plan, whole=True))
    hashes = hashes.withColumnsRenamed({"conv": "hashed", "sha256": "repaired_sha256"})
    found = conversation_repair.summary(rows, plan)
    found = found.join(hashes, F.col("conv").eqNullSafe(F.col("hashed")), "left").drop("hashed")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return every.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


SHINGLES_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
    lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.r = links.a),
least AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN least ON sets.doc_id = least.doc_id"""


@query("op13_chosen_path", SHINGLES_SQL)
def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, threshold=85)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.withColumn("kept", kept)
