"""Token-ID files in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id; each partition writes one file, so the files
in order are the corpus in order.  A file is a run of blocks of 512 ids.  A block stores its minimum, the
differences to it packed at a width that fits ``percentile`` of them, and an exception list (place and
high bits) for those that need more.  Behind the blocks stand the index of block starts and the
directory of documents, so any document is read without what lies before it:

    "PFB1" | blocks | block starts u64 | has id u8, id i64, end u64 of each document
    | blocks u64, documents u64, ids u64, index start u64 | "PFB1"
    block: minimum u32, width u8, exceptions u16, packed u64[8 width], places u16[], high bits u32[]

Each attempt of a task writes a file of its own name, and only the files that finished tasks report are
in the manifest: a lost executor leaves at worst an orphan, never a half file in the result.
Files are written with ``pyarrow.fs``, so the folder may be any store that it knows.

Texts are encoded word by word: this tokenizer drops white space and never joins across it, so a text's ids are
its words' ids in order, and the pieces of words met lately are remembered, up to a fixed number of bytes, instead of
encoded again.  A task holds one Arrow batch, 2 MB of text split into words, and the directory of its file.

Defined cases: null or empty text has only the end id; a null document id sorts first; rows that repeat an id are
documents of their own, ordered by a hash of the text; an empty table gives no files and no rows; very long
texts pass through in blocks; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.text import shuffle_width, stored
from pricewell.plans.session import new_path, ship_package

BLOCK = 512
ROWS = BLOCK // 64
AT_ONCE = 256  # blocks encoded or decoded together
MAGIC = b"PFB1"
HEAD = struct.Struct("<IBH")  # least, width, exceptions
PIECE = 1 << 21  # characters split into words together
REMEMBER = 16 << 20  # bytes of words and their ids
PLAIN = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)(?P<rest>[!-/:-@\[-`{-~]*)$"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` 64-bit words."""
    words = np.zeros((len(values), width), dtype=np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return words


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    values = np.zeros((len(words), 64), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        column = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            column = column | words[:, word + 1] << np.uint64(64 - shift)
        values[:, i] = column & mask
    return values


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """Blocks of a multiple of 512 ids (unsigned 32-bit)."""
    blocks = ids.reshape(-1, BLOCK).astype(np.uint64)
    least = blocks.min(axis=1)
    over = blocks - least[:, None]
    fits = np.sort(over, axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1]
    widths = np.frexp(fits.astype(np.float64))[1]
    high = over >> widths.astype(np.uint64)[:, None]
    low = over & ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1))[:, None]
    packed: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        words = pack(low[own].reshape(-1, 64), int(width)).reshape(len(own), ROWS * int(width))
        for i, row in zip(own.tolist(), words):
            packed[i] = row.tobytes()
    block, place = np.nonzero(high)
    rest = high[block, place].astype("<u4")
    place = place.astype("<u2")
    ends = np.searchsorted(block, np.arange(len(blocks) + 1)).tolist()
    out = []
    for i, (row, least_, width) in enumerate(zip(packed, least.tolist(), widths.tolist())):
        a, b = ends[i], ends[i + 1]
        out.append(HEAD.pack(least_, width, b - a) + row + place[a:b].tobytes() + rest[a:b].tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``starts`` in ``data``."""
    starts = np.asarray(starts).tolist()
    heads = [HEAD.unpack_from(data, s) for s in starts]
    widths = np.array([h[1] for h in heads])
    values = np.zeros((len(starts), ROWS, 64), dtype=np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        words = np.array([np.frombuffer(data, "<u8", ROWS * width, starts[i] + HEAD.size) for i in own.tolist()])
        values[own] = unpack(words.reshape(-1, width), width).reshape(len(own), ROWS, 64)
    values = values.reshape(len(starts), BLOCK)
    for i, (_, width, count) in enumerate(heads):
        if count:
            at = starts[i] + HEAD.size + 8 * ROWS * width
            places = np.frombuffer(data, "<u2", count, at)
            highs = np.frombuffer(data, "<u4", count, at + 2 * count).astype(np.uint64)
            values[i, places] |= highs << np.uint64(width)
    values += np.array([h[0] for h in heads], dtype=np.uint64)[:, None]
    return values.ravel().astype("<u4")


class BlockWriter:
    """Writes one file; ids and document ends arrive in order."""

    def __init__(self, sink, percentile: float):
        self.sink, self.percentile = sink, percentile
        self.starts = array("Q")
        self.docs = array("B"), array("q"), array("Q")  # has id, id, end
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list[int | None], ends: list[int]) -> None:
        """A run of ids, and the documents that end in it, behind its first ``ends`` ids."""
        for column, values in zip(self.docs, ([d is not None for d in doc_ids], [d or 0 for d in doc_ids],
                                              [self.ids + end for end in ends])):
            column.extend(values)
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= AT_ONCE * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, take: int) -> None:
        held = np.concatenate(self.waiting)
        for low in range(0, take, AT_ONCE * BLOCK):
            blocks = encode_blocks(held[low : min(take, low + AT_ONCE * BLOCK)], self.percentile)
            self.starts.extend((self.at + np.cumsum([0, *map(len, blocks[:-1])])).tolist())
            self.sink.write(b"".join(blocks))
            self.at += sum(map(len, blocks))
        self.waiting = [held[take:].copy()]
        self.held -= take

    def close(self) -> None:
        if self.held:  # the last block repeats its last id up to its full length
            held = np.concatenate(self.waiting)
            full = -(-self.held // BLOCK) * BLOCK
            self.waiting = [held, np.repeat(held[-1:], full - self.held)]
            self.held = full
            self._flush(full)
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        for kind, column in zip(("u1", "<i8", "<u8"), self.docs):
            self.sink.write(np.array(column, kind).tobytes())
        self.sink.write(np.array([len(self.starts), len(self.docs[0]), self.ids, self.at], "<u8").tobytes() + MAGIC)


class BlockFile:
    """Reads one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 36)
        tail = source.read(36)
        if tail[-4:] != MAGIC:
            raise ValueError("not a token block file")
        blocks, docs, self.ids, index = (int(x) for x in np.frombuffer(tail, "<u8", 4))
        source.seek(index)
        data = source.read(size - 36 - index)
        self.starts = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(index)).astype(np.int64)
        self.has_id = np.frombuffer(data, "u1", docs, 8 * blocks)
        self.doc_ids = np.frombuffer(data, "<i8", docs, 8 * blocks + docs)
        self.ends = np.frombuffer(data, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` up to ``last`` (exclusive), found through the index of block starts."""
        if first >= last:
            return np.empty(0, "<u4")
        low, high = first // BLOCK, -(-last // BLOCK)
        begin, end = self.starts[low], self.starts[high]
        self.source.seek(int(begin))
        ids = decode_blocks(self.source.read(int(end - begin)), self.starts[low:high] - begin)
        return ids[first - low * BLOCK : last - low * BLOCK]

    def documents(self):
        """(doc_id or None, ids before it in this file, its ids) in order."""
        held_from, held = 0, np.empty(0, "<u4")
        before = 0
        for known, doc_id, end in zip(self.has_id.tolist(), self.doc_ids.tolist(), self.ends.tolist()):
            if end > held_from + len(held):
                upto = min(self.ids, max(end, before + AT_ONCE * BLOCK))
                held, held_from = self.read(before, upto), before
            yield doc_id if known else None, before, held[before - held_from : end - held_from]
            before = end


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts, by their white-space separated words; the pieces of words met lately are remembered.

    A word of plain Latin letters with closing punctuation is two pieces to this tokenizer, lower case
    letters and the rest, of which the former go to its model at once; any other word takes the whole tokenizer.
    What is remembered takes at most ``remember`` bytes, however many and long the words are.
    """

    def __init__(self, vocabulary: str, end_id: int, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.end, self.remember = end_id, remember
        self.letters = _byte_letters()
        self.clock = 0
        self.known = pa.array([], pa.string())  # pieces, their ids one after the other, and when they were met last
        self.ids, self.lengths, self.met = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts):
        """Runs of ids, each with the places behind which a document ends; texts of any length are cut between words."""
        parts, whole, size = [], [], 0
        for text in texts:
            text, at = (text or "").replace("\n", " "), 0
            while at >= 0:
                cut = text.find(" ", at + PIECE)
                parts.append(text[at : cut if cut >= 0 else len(text)])
                whole.append(cut < 0)
                size += len(parts[-1])
                at = cut + 1 if cut >= 0 else -1
                if size >= PIECE:
                    yield self._run(parts, whole)
                    parts, whole, size = [], [], 0
        if parts:
            yield self._run(parts, whole)

    def _run(self, parts: list[str], whole: list[bool]) -> tuple[np.ndarray, list[int]]:
        split = pc.split_pattern(pa.array(parts, pa.string()), " ")
        words = split.values.dictionary_encode()
        # Of each distinct word, the two pieces or the word and nothing; then the distinct ones of these.
        plain = pc.extract_regex(words.dictionary, PLAIN)
        first = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "letters")), words.dictionary)
        rest = pc.fill_null(pc.struct_field(plain, "rest"), "")
        pieces = pa.concat_arrays([first, rest]).dictionary_encode()
        starts, lengths, pool = self._look_up(pieces.dictionary)
        codes = pieces.indices.to_numpy().reshape(2, -1)[:, words.indices.to_numpy()].T.ravel()
        # The end id follows the last word of each text that ends here, as a piece of its own.
        behind = split.offsets.to_numpy()[1:][np.array(whole)] * 2
        codes = np.insert(codes, behind, len(starts))
        starts, lengths = np.append(starts, len(pool)), np.append(lengths, 1)
        pool = np.append(pool, np.array([self.end], "<u4"))
        take = lengths[codes]
        ends = np.cumsum(take)
        ids = pool[np.repeat(starts[codes] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends[behind + np.arange(len(behind))].tolist()

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct piece start in a pool, their number, and the pool."""
        self.clock += 1
        place = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(place))
        place = pc.fill_null(place, -1).to_numpy()
        self.met[place[place >= 0]] = self.clock
        found, counts = array("I"), array("q")
        for piece in new.to_pylist():
            ids = self._encoded(piece)
            found.extend(ids)
            counts.append(len(ids))
        lengths = np.concatenate([self.lengths, np.array(counts, np.int64)])
        pool = np.concatenate([self.ids, np.array(found, "<u4")])
        starts = np.cumsum(lengths) - lengths
        place = np.where(place < 0, len(self.known) + np.cumsum(place < 0) - 1, place)
        self._keep(pa.concat_arrays([self.known, new]), lengths, pool,
                   np.concatenate([self.met, np.full(len(new), self.clock)]))
        return starts[place], lengths[place], pool

    def _keep(self, known: pa.Array, lengths: np.ndarray, pool: np.ndarray, met: np.ndarray) -> None:
        """Remember these; if they are too many, those met last, up to half of the room."""
        sizes = pc.binary_length(known).to_numpy() + 4 * lengths + 20
        if sizes.sum() > self.remember:
            latest = np.argsort(-met, kind="stable")
            stay = np.zeros(len(met), bool)
            stay[latest[np.cumsum(sizes[latest]) <= self.remember // 2]] = True
            known, pool = known.filter(pa.array(stay)), pool[np.repeat(stay, lengths)]
            lengths, met = lengths[stay], met[stay]
        self.known, self.lengths, self.ids, self.met = known, lengths, pool, met

    def _encoded(self, piece: str) -> list[int]:
        small = piece.isalpha() and piece.islower()
        if small and piece.isascii():
            spelled = piece
        elif small and max(piece) < "\u0250":
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        else:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [token.id for token in self.model.tokenize(spelled)]


_encoders: dict[tuple[int, int], WordEncoder] = {}


def _encoder(vocabulary: str, end_id: int) -> WordEncoder:
    """This worker's encoder; it goes on knowing the words of earlier tasks."""
    key = (zlib.crc32(vocabulary.encode()), end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(vocabulary, end_id)
    return _encoders[key]


def write_tokens(
    documents: DataFrame, vocabulary_path: str, folder: str, doc_id: str = "doc_id", text: str = "text",
    end_id: int = 2, percentile: float = 0.9,
) -> DataFrame:
    """Encode all texts into files under ``folder``; the manifest: ``part, path, docs, ids`` per file."""
    spark = documents.sparkSession
    ship_package(spark)
    with open(vocabulary_path, encoding="utf-8") as source:
        vocabulary = spark.sparkContext.broadcast(source.read())

    def run(batches):
        encoder = _encoder(vocabulary.value, end_id)
        writer = sink = path = part = None
        for batch in batches:
            if writer is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
                store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                store.create_dir(base, recursive=True)
                path = f"{base}/{part:06d}-{uuid.uuid4().hex}.pfb"
                sink = store.open_output_stream(path)
                writer = BlockWriter(sink, percentile)
            doc_ids = (value.as_py() for value in batch.column(0))
            for ids, ends in encoder.encode(value.as_py() for value in batch.column(1)):
                writer.add(ids, list(islice(doc_ids, len(ends))), ends)
        if writer is not None:
            writer.close()
            sink.close()
            name = f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "docs": [len(writer.docs[0])],
                                              "ids": [writer.ids]})

    rows = (
        documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(shuffle_width(spark), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    return stored(rows.mapInArrow(run, "part long, path string, docs long, ids long"), "token-files")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a manifest."""
    spark = manifest.sparkSession
    ship_package(spark)
    files, start = [], 0  # one row per file
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((row["path"], start))
        start += row["ids"]

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with store.open_input_file(name) as source:
                    rows = []
                    for doc_id, before, ids in BlockFile(source).documents():
                        rows.append((doc_id, base + before, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(files, "path string, base long").repartitionByRange(len(files), "base")
    return listed.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def token_digests(documents: DataFrame, vocabulary_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to the shared folder and read them back."""
    folder = new_path(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, vocabulary_path, folder, end_id=end_id))
