"""Replace personal data by surrogates: keyed, of the same type and format, distinct and consistent.

Patterns find mail addresses, IPv4 addresses, phone, card, social-security and account numbers, secrets, and
people named after a title, or several, with all their capitalised words, initials and particles.  A mention's *canonical form* drops what varies between mentions of one entity
(case, and separators in numbers); each word of a name is an entity, so "Mr. Jan Vos" and "Mr. Vos"
still name one person.  Whether a word is a given name, and its gender, are settled over the whole corpus: it is one if it
ever stands before another, with the gender of most titles that it follows (none if they are even), so "Dr. Anna Vos",
"Mrs. Anna Vos" and "Mrs. Anna" agree.  SHA-256 of key, type, canonical form and draw number gives a candidate that keeps the
format: digits stay digits, letters letters in their case, hex stays hex, numbers keep their first
digit, mail keeps its top domain, names keep their gender and script, one plain word for each word.

Candidates are checked over the whole corpus: of entities with the same candidate only the first keeps it,
and no candidate may equal a real value of its type; the others draw again until none collides.  The mapping
joins the mentions by entity, and each text is rebuilt from its parts.  Only mentions and the texts that
have some are shuffled.

Defined cases: null or empty text and texts without a match give no row; null ids and rows that repeat an
id are told apart by a hash of the text; a repeated row gives a repeated row; an empty table gives an empty
result; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.text import shuffle_width, stored

# Titles by gender.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа", "Госпожа", "Κυρία"]
OTHER = ["Dr", "Prof"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "(?:" + "|".join(MALE + FEMALE + OTHER) + r")\.?"
_TITLES = _TITLE + r"(?: (?:Dr|Prof)\.?(?= ))*"
_WORD = r"\w\u00C0-\u024F\u0370-\u04FF"  # letters and digits as ranges, which are fast to test
_LEFT, _RIGHT = rf"(?<![{_WORD}])", rf"(?![{_WORD}])"
# Lower-case words inside names.
PARTICLES = ("van von vom de der den het 't ter ten te zu zum zur af av du des da das do dos del della dello degli di la le "
             "lo los las el al bin bint ibn ben abu san фон де ван дер").split()
_INSIDE = rf"(?:(?:{'|'.join(PARTICLES)})|(?:\p{{Lu}}\.-?)+) "
#: A capitalised word with hyphens and apostrophes (not the possessive), and with a prefix as in d'Artagnan; neither
#: the next title nor the beginning of an address.
_NAME_WORD = (
    rf"(?!(?:{'|'.join(t for t in MALE + FEMALE + OTHER if t not in ('Don', 'Doña'))})(?:\.|(?= \p{{Lu}})))"
    rf"(?:\p{{Ll}}{{1,4}}['’-])?\p{{Lu}}(?:[\p{{L}}\p{{M}}]|-(?=\p{{L}})|['’](?=\p{{L}})(?!s(?!\p{{L}})))+"
    rf"(?![{_WORD}]|[{_WORD}.%+-]*@)"
)
_NAME = rf"(?:{_INSIDE})*{_NAME_WORD}(?: (?:{_INSIDE})*{_NAME_WORD})*"
#: In the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![{_WORD}.%+-])[{_WORD}.%+-]++@[{_WORD}-]+(?:\.[{_WORD}-]+)*\.\p{{L}}{{2,}}",
    "secret": rf"{_LEFT}(?:[0-9a-fA-F]{{32,}}|(?:sk|pk|ghp|gho|xox[bp]|AKIA)[-_]?[A-Za-z0-9_-]{{16,}}){_RIGHT}",
    "iban": rf"{_LEFT}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_RIGHT}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d|-\d)",
    "phone": r"(?<![\d+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<!-)\d{3}[-.]\d{3}[-.]\d{4}(?!\d|-\d))",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "name": rf"{_LEFT}{_TITLES} (?:{_NAME}|\p{{Lu}}\p{{L}}+)",
}
#: All of them, behind one look at what a match can begin with, so that most places are left at once.
PATTERN = (
    f"{PATTERNS['email']}|(?=[0-9a-fA-Fsgpx]){PATTERNS['secret']}"
    f"|(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in ('ip', 'card', 'phone', 'ssn'))})"
    f"|(?=\\p{{Lu}})(?:{PATTERNS['iban']}|{PATTERNS['name']})"
)
NUMBERS = ["card", "phone", "ssn", "iban"]

# Syllables that names are put together from, and endings by gender, for each script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga ge ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te".split(),
    "cyrillic": "ба бе бо да де до ва ви га ге ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се та те".split(),
    "greek": "βα βε βο δα δε δο φα φι γα γε κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρο σα σε τα τε".split(),
}
ENDINGS = {
    ("latin", "m"): "n", ("latin", "f"): "na", ("latin", "x"): "r",
    ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("cyrillic", "x"): "р",
    ("greek", "m"): "ς", ("greek", "f"): "να", ("greek", "x"): "ρ",
}
MAX_DRAWS = 64


def _type(mention: Column) -> Column:
    """The type of a mention: the first whose pattern it fits as a whole."""
    out = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def _titles(mention: Column) -> Column:
    """The titles that a name begins with, and the space behind them."""
    return F.regexp_extract(mention, rf"^{_TITLES} ", 0)


def _name_words(mention: Column) -> Column:
    """The words behind the titles of a name."""
    return F.split(F.regexp_replace(mention, rf"^{_TITLES} ", ""), " ")


def _parts(mention: Column, kind: Column) -> Column:
    """The entities of a mention: (type, canonical form, role) structs; a name has one per word behind its titles."""
    words = _name_words(mention)
    titles = F.transform(F.split(F.rtrim(_titles(mention)), " "), lambda t: F.rtrim(t, F.lit(".")))
    gender = (F.when(F.arrays_overlap(titles, F.array(*map(F.lit, MALE))), "m")
              .when(F.arrays_overlap(titles, F.array(*map(F.lit, FEMALE))), "f").otherwise("x"))
    whole = F.when(kind.isin(NUMBERS), F.regexp_replace(F.lower(mention), r"[^\p{L}\p{N}]", "")).otherwise(F.lower(mention))

    def role(w: Column, i: Column) -> Column:
        # The last word and particles are a surname, which has no gender; an only word may be either.
        return (F.when(w.isin(PARTICLES), "surname").when(F.size(words) == 1, F.concat(F.lit("only-"), gender))
                .when(i < F.size(words) - 1, F.concat(F.lit("given-"), gender)).otherwise("surname"))

    names = F.transform(words, lambda w, i: F.struct(
        F.concat(F.lit("name-"), _script(w)).alias("type"), F.regexp_replace(F.lower(w), "’", "'").alias("canon"),
        role(w, i).alias("role")))
    single = F.array(F.struct(kind.alias("type"), whole.alias("canon"), F.lit("").alias("role")))
    return F.when(kind == "name", names).otherwise(single)


def resolved(found: DataFrame) -> DataFrame:
    """Distinct ``type, canon`` of entities, name words with one type each: given with a gender, or surname."""
    role = F.col("role")
    votes = found.groupBy("type", "canon").agg(
        F.max(role.startswith("given")).alias("given"), F.count_if(role.endswith("-m")).alias("m"),
        F.count_if(role.endswith("-f")).alias("f"),
    )
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("m") < F.col("f"), "f").otherwise("x")
    of = F.when(F.col("given"), F.concat(F.lit("given-"), gender)).otherwise("surname-x")
    name = F.concat(of, F.regexp_replace("type", "^name", ""))
    return votes.select(F.when(F.col("type").startswith("name-"), name).otherwise(F.col("type")).alias("type"), "canon")


def _digest(key: str, i: Column | int) -> Column:
    """64 hex digits that depend on key, entity, draw and block ``i``."""
    return F.sha2(F.concat_ws("|", F.lit(key), "type", "canon", F.col("draw").cast("string"),
                              F.lit(i).cast("string")), 256)


def _number(hex_: Column, at: Column | int, digits: int) -> Column:
    """The number of some hex digits from place ``at`` (from 0)."""
    return F.conv(F.substring(hex_, F.lit(at) + 1, F.lit(digits)), 16, 10).cast("long")


def candidate(key: str) -> Column:
    """The surrogate of columns ``type, canon, draw``, in canonical form."""
    canon, kind = F.col("canon"), F.col("type")
    # Three hex digits for each character, from as many digests as the form is long.
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.char_length(canon) / 20).cast("int")),
        lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, canon, F.col("draw").cast("string"), b.cast("string")), 256),
    )
    tail = F.char_length(canon) - F.when(kind == "email", F.char_length(F.regexp_extract(canon, r"\.[^.]*$", 0))).otherwise(0)
    is_hex = canon.rlike("^[0-9a-f]+$")

    def char(c: Column, i: Column) -> Column:
        n = _number(F.get(blocks, F.floor(i / 20).cast("int")), (i % 20) * 3, 3)
        digit = F.substring(F.lit("0123456789"), (n % 10 + 1).cast("int"), F.lit(1))
        hexa = F.substring(F.lit("0123456789abcdef"), (n % 16 + 1).cast("int"), F.lit(1))
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n % 26 + 1).cast("int"), F.lit(1))
        stays = (kind.isin(NUMBERS) & (i == 0)) | (i >= tail)
        return (F.when(stays, c).when((kind == "secret") & is_hex, hexa).when(c.rlike(r"^\d$"), digit)
                .when(c.rlike(r"^\p{L}$"), letter).otherwise(c))

    spelled = F.array_join(F.transform(F.split(canon, ""), char), "")
    head = _digest(key, 0)
    ip = F.concat_ws(".", (_number(head, 0, 4) % 223 + 1).cast("string"),
                     *[(_number(head, 4 * i, 4) % 256).cast("string") for i in (1, 2, 3)])
    out = F.when(kind == "ip", ip)
    for script, parts in SYLLABLES.items():
        table = F.array(*[F.lit(p) for p in parts])
        stem = F.concat(*[F.get(table, (_number(head, 4 * i, 4) % len(parts)).cast("int")) for i in range(4)])
        for (of, gender), ending in ENDINGS.items():
            if of == script:
                out = out.when(kind.rlike(f"-{gender}-{script}$"), F.concat(stem, F.lit(ending)))
    return out.otherwise(spelled)


def with_mentions(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, version, text, found`` (the mentions in order) of each row that has some."""
    text_ = F.col(text)
    # rlike first: rows without a mention, most of them, are read by one pattern once.
    return documents.filter(text_.rlike(PATTERN)).select(
        F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text_).alias("version"), text_.alias("text"),
        F.regexp_extract_all(text_, F.lit(PATTERN), F.lit(0)).alias("found"),
    )


def entities_of(held: DataFrame) -> DataFrame:
    """``doc, version, at, part, mention, type, canon, role``: a row per entity of each mention, in order."""
    each = held.select("doc", "version", F.posexplode("found").alias("at", "mention"))
    each = each.distinct()  # repeated rows have the same mentions
    return each.select("*", _type(F.col("mention")).alias("kind")).select(
        "doc", "version", "at", "mention", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("part", "e")
    ).select("doc", "version", "at", "part", "mention", "e.type", "e.canon", "e.role")


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """``type, canon, surrogate`` of distinct (type, canon), without collisions."""
    real = entities.select("type", "canon")
    open_ = real.withColumn("draw", F.lit(0))
    settled = None
    for _ in range(MAX_DRAWS):
        drawn = open_.withColumn("surrogate", candidate(key)).withColumn("taken", F.lit(0))
        pool = drawn if settled is None else drawn.unionAll(settled.select(*drawn.columns))
        # A real value counts as taken before any candidate; then those settled; then by canonical form.
        claims = pool.unionAll(real.select("type", "canon", F.lit(-1).alias("draw"), F.col("canon").alias("surrogate"),
                                           F.lit(2).alias("taken")))
        first = Window.partitionBy("type", "surrogate").orderBy(F.desc("taken"), "canon")
        ranked = stored(claims.withColumn("nth", F.row_number().over(first)).filter("taken < 2"), "surrogates")
        settled = ranked.filter("nth = 1 OR taken = 1").withColumn("taken", F.lit(1)).drop("nth")
        open_ = ranked.filter("nth > 1 AND taken = 0").select("type", "canon", (F.col("draw") + 1).alias("draw"))
        if open_.isEmpty():
            return settled.select("type", "canon", "surrogate")
    raise ValueError("a type has too few surrogates for its entities")


def _worded(mention: Column, surrogate: Column, kind: Column) -> Column:
    """A canonical surrogate in the format of the mention."""
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))

    def fill(c: Column, i: Column) -> Column:
        place = F.char_length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.substring(surrogate, place, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.split(mention, ""), fill), "")
    plain = F.when(kind.isin(NUMBERS), filled).otherwise(surrogate)
    name, letters = kind.startswith("name-"), F.char_length(F.regexp_replace(mention, r"[^\p{L}]", ""))
    plain = F.when(name & (mention != F.lower(mention)), F.initcap(surrogate)).otherwise(plain)
    return F.when(upper & ~(name & (letters == 1)), F.upper(plain)).otherwise(plain)


def with_surrogates(documents: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_mentions, types`` of each document that has some: its text with surrogates."""
    spark = documents.sparkSession
    texts = stored(with_mentions(documents, doc_id, text), "texts")
    found = stored(entities_of(texts), "mentions")
    mapping = surrogate_map(stored(resolved(found), "entities"), key)
    mapping = mapping.withColumn("type", F.regexp_replace("type", "^(given-.|surname-x)-", "name-"))
    at = ["doc", "version"]
    mention = F.col("mention")
    word = F.when(F.col("type").startswith("name-"), F.get(_name_words(mention), F.col("part"))).otherwise(mention)
    replaced = (
        found.join(mapping, ["type", "canon"])
        .select(*at, "at", "part", "mention", "type", _worded(word, F.col("surrogate"), F.col("type")).alias("new"))
        .repartition(shuffle_width(spark), *at)
        .groupBy(*at, "at", "mention")
        .agg(F.sort_array(F.collect_list(F.struct("part", "new"))).alias("words"), F.first("type").alias("type"))
        .withColumn("new", F.when(F.col("type").startswith("name-"), F.concat(
            _titles(mention), F.array_join("words.new", " "))).otherwise(F.col("words")[0]["new"]))
        .groupBy(*at)
        .agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("news"),
             F.array_sort(F.collect_set(F.regexp_replace("type", "^name-.*", "name"))).alias("types"))
    )
    joined = texts.join(
        replaced.withColumnsRenamed({"doc": "d", "version": "v"}),
        F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")),
    )
    # Between two mentions lies what the pattern splits off, so the two lists alternate.
    rest = F.split("text", PATTERN, -1)
    rebuilt = F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(F.col("news.new"), i), F.lit("")))), "")
    return joined.select(F.col("doc").alias("doc_id"), rebuilt.alias("text"),
                         F.size("news").cast("long").alias("n_mentions"), "types")
