"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A conversation is legal if the initials of its roles form ``(s?(ua)+)?``.  A lattice node is (rows read, state):
nothing yet, after the system row, after a user, after an assistant.  Edges are the edits: Keep (0), Rerole to the
role that fits (3), Delete (4; the only one for blank and duplicate rows), Insert an empty row of the role that
fits (3); a truncated row that stays adds 3.  A forward heap starts at (0, nothing) and a reverse heap at the legal
ends; once their least costs together exceed the best crossing, every equal-cost crossing has been seen, and the
least concatenated audit (the edits' initials) wins.

Labels are (cost, audit).  Two audits of one cost that lead to the same node never continue each other (they read
the same rows, and further inserts cost more), so the least prefix stays least whatever follows.  Kept rows
cost nothing: equal costs are settled in the direction of reading, so that a label is final when it is settled.

Conversations of up to ``PIECE`` rows are solved at once.  A longer one, which may hold a third of all rows, is cut into
pieces that are solved for all pairs of states in tasks of their own; only these tables of 16 costs and audits
meet, per conversation.  Rows are ordered by a range sort, never gathered per conversation.

Defined cases: null roles and texts are one space; a null conversation id is a conversation of its own; null turns come
first; rows of one turn are ordered by role, then by a hash of role and text; repeated rows are duplicates of the first; roles that
begin with none of s, u, a fit nowhere and are reroled or deleted; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pricewell.llm.text import WORD, shuffle_width, stored
from pricewell.plans.session import ship_package

#: Rows of a conversation that are solved in one search.
PIECE = 4096
PIECE_BITS = PIECE.bit_length() - 1
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an initial, by (state, initial); the role that may follow a state, and the state after it.
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FIT = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER_FIT = {state: STEP[state, role[0]] for state, role in FIT.items()}
ENDS = (NOTHING, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")


def _edges_out(rows: list[tuple[str, int]], at: int, state: int):
    """(letter, cost, rows read, state) of the edits that leave a node."""
    if at < len(rows):
        initial, fault = rows[at]
        yield "D", DELETE, at + 1, state
        if fault in (SOUND, TRUNCATED):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            if (state, initial) in STEP:
                yield "K", KEEP + extra, at + 1, STEP[state, initial]
            yield "R", REROLE + extra, at + 1, AFTER_FIT[state]
    yield "I", INSERT, at, AFTER_FIT[state]


def _edges_in(rows: list[tuple[str, int]], at: int, state: int):
    """(letter, cost, rows read, state) of the edits that enter a node, with the node they leave."""
    if at > 0:
        initial, fault = rows[at - 1]
        yield "D", DELETE, at - 1, state
        if fault in (SOUND, TRUNCATED):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            for before in FIT:
                if STEP.get((before, initial)) == state:
                    yield "K", KEEP + extra, at - 1, before
                if AFTER_FIT[before] == state:
                    yield "R", REROLE + extra, at - 1, before
    for before in FIT:
        if AFTER_FIT[before] == state:
            yield "I", INSERT, at, before


def cheapest(rows: list[tuple[str, int]], begin: int = NOTHING, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, least audit) of repairing ``rows`` of (initial, fault) from a state to one of ``ends``; None: no way."""
    if not rows and begin in ends:
        return 0, ""
    # One entry per side: heap of (cost, order of reading, audit, rows read, state), best labels, settled labels.
    heaps = [[(0, 0, "", 0, begin)], [(0, -len(rows), "", len(rows), e) for e in ends]]
    for heap in heaps:
        heapq.heapify(heap)
    labels: list[dict] = [{(h[3], h[4]): (0, "") for h in heap} for heap in heaps]
    settled: list[dict] = [{}, {}]
    best = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        back = heaps[1][0][0] <= heaps[0][0][0]
        cost, _, audit, at, state = heapq.heappop(heaps[back])
        if (at, state) in settled[back]:
            continue
        settled[back][at, state] = (cost, audit)
        for letter, price, i, q in (_edges_in if back else _edges_out)(rows, at, state):
            crossing = settled[not back].get((i, q))
            if crossing is not None:
                whole = crossing[1] + letter + audit if back else audit + letter + crossing[1]
                total = (cost + price + crossing[0], whole)
                best = total if best is None or total < best else best
            label = (cost + price, letter + audit if back else audit + letter)
            if (i, q) not in settled[back] and label < labels[back].get((i, q), (float("inf"), "")):
                labels[back][i, q] = label
                heapq.heappush(heaps[back], (label[0], -i if back else i, label[1], i, q))
    return best


def diagnosed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """``conv, turn, role, text, initial, fault, ord, piece``, written once; ``ord`` is a row's place in the order."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("same", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    # Equal rows of one turn are told apart by a number, so that even they are spread over ranges.
    order = ["conv", "turn", "role", "same", "nth"]
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    placed = stored(
        rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
        .drop("nth").withColumn("ord", F.monotonically_increasing_id()), "conversation-rows",
    )
    firsts = placed.groupBy("conv", "same").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select(F.col("conv").alias("c"), F.col("same").alias("s"), "first")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(WORD), BLANK)
        .when(F.col("ord") > F.col("first"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    long = stored(
        placed.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE)
        .select(F.col("conv").alias("lc"), F.lit(True).alias("long")), "long-conversations",
    )
    found = placed.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    found = found.join(long, F.col("conv").eqNullSafe(F.col("lc")), "left")
    return stored(found.select(
        "conv", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"),
        "ord", F.when(F.col("long"), F.shiftright("ord", PIECE_BITS)).otherwise(F.lit(-1)).cast("long").alias("piece"),
    ), "diagnosed")


def _type(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    """A column's type, for Spark and for Arrow."""
    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _batch(rows, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _runs(batches, width: int):
    """Rows of sorted batches as (first ``width`` values, iterator of rows)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda row: row[:width])


def _illegal(initials) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def repairs(rows: DataFrame) -> DataFrame:
    """Per piece of a conversation: ``conv, piece, entry`` (state before it), ``cost, audit, illegal``."""
    ship_package(rows.sparkSession)
    kind, arrow_conv = _type(rows, "conv")
    schema = f"conv {kind}, piece long, ends string, illegal long, costs array<long>, audits array<string>"
    types = [arrow_conv, pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    names = ["conv", "piece", "ends", "illegal", "costs", "audits"]

    def solve(batches):
        out = []
        for (conv, piece), run in _runs(batches, 2):
            read = [row[3:] for row in run]
            initials = [initial for initial, _ in read]
            if piece == -1:
                ways = [cheapest(read)]
            else:
                ways = [cheapest(read, begin, (end,)) for begin in FIT for end in FIT]
            out.append((conv, piece, initials[0][:1].ljust(1) + initials[-1][:1].ljust(1), _illegal(initials),
                        [w and w[0] for w in ways], [w and w[1] for w in ways]))
            if len(out) == 1000 or piece != -1:
                yield _batch(out, names, types)
                out = []
        yield _batch(out, names, types)

    narrow = rows.select("conv", "piece", "ord", "initial", "fault")
    dealt = narrow.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "ord")
    solved = stored(dealt.mapInArrow(solve, schema), "solved")

    def join_pieces(group: pa.Table) -> pa.Table:
        """The cheapest way through a long conversation's pieces, from the last back to the first."""
        pieces = group.sort_by("piece").to_pylist()
        tail = {end: (0, "") for end in ENDS}
        chosen = []
        for piece in reversed(pieces):
            ways = {}
            for k, (cost, audit) in enumerate(zip(piece["costs"], piece["audits"])):
                begin, end = divmod(k, len(FIT))
                if cost is not None and end in tail:
                    label = (cost + tail[end][0], audit + tail[end][1], end, cost, audit)
                    if begin not in ways or label < ways[begin]:
                        ways[begin] = label
            tail = {begin: label[:2] for begin, label in ways.items()}
            chosen.append(ways)
        out, state, before = [], NOTHING, ""
        for piece, ways in zip(pieces, reversed(chosen)):
            _, _, end, cost, audit = ways[state]
            crossing = _illegal([before, piece["ends"][0]]) if before else 0
            out.append((piece["conv"], piece["piece"], state, cost, audit, piece["illegal"] + crossing))
            state, before = end, piece["ends"][1]
        own = [arrow_conv, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
        return pa.Table.from_batches([_batch(out, ["conv", "piece", "entry", "cost", "audit", "illegal"], own)])

    whole = solved.filter("piece = -1").select(
        "conv", "piece", F.lit(NOTHING).alias("entry"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"),
        "illegal",
    )
    joined = solved.filter("piece >= 0").groupBy("conv").applyInArrow(
        join_pieces, f"conv {kind}, piece long, entry int, cost long, audit string, illegal long"
    )
    return stored(whole.unionAll(joined), "repairs")


def summary(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    def faults(kind: int):
        return F.count_if(F.col("fault") == kind)

    counted = rows.groupBy("conv").agg(
        faults(BLANK).alias("blank"), faults(DUPLICATE).alias("duplicate"), faults(TRUNCATED).alias("truncated"),
        F.coalesce((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long"), F.lit(0)).alias("gaps"),
    )
    audits = F.array_sort(F.collect_list(F.struct("piece", "audit")))  # the audit is one value of the result
    solved = plan.groupBy(F.col("conv").alias("c")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(audits, lambda p: p["audit"]), "").alias("audit"),
    )
    return counted.join(solved, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def repaired(rows: DataFrame, plan: DataFrame, whole: bool = False) -> DataFrame:
    """The repaired conversations: ``conv, piece, nth, edit, turn, role, text``, in order by ``piece, nth``.

    With ``whole``, each conversation's rows follow each other in one partition (they pass through it one by
    one); otherwise the pieces of long conversations are spread.
    """
    (conv_kind, arrow_conv), (turn_kind, arrow_turn) = _type(rows, "conv"), _type(rows, "turn")
    schema = f"conv {conv_kind}, piece long, nth long, edit string, turn {turn_kind}, role string, text string"
    types = [arrow_conv, pa.int64(), pa.int64(), pa.string(), arrow_turn, pa.string(), pa.string()]
    names = ["conv", "piece", "nth", "edit", "turn", "role", "text"]

    def replay(batches):
        conv, piece, state, nth, left = None, None, NOTHING, 0, ""

        def inserts():
            """The inserted rows that come next."""
            nonlocal state, nth, left
            while left.startswith("I"):
                yield conv, piece, nth, "I", None, FIT[state], ""
                state, nth, left = AFTER_FIT[state], nth + 1, left[1:]

        for batch in batches:
            out = []
            for at_conv, at_piece, _, turn, role, text, audit, entry in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(inserts())
                if audit is not None:  # the head of a piece
                    conv, piece, state, nth, left = at_conv, at_piece, entry, 0, audit
                    continue
                edit, left = left[0], left[1:]
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = FIT[state], AFTER_FIT[state]
                else:
                    state = STEP[state, role[0]]
                out.append((conv, piece, nth, edit, turn, role, text))
                nth += 1
            yield _batch(out, names, types)
        yield _batch(list(inserts()), names, types)

    none = [F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("entry")]
    heads = plan.select(
        "conv", "piece", F.lit(-1).cast("long").alias("ord"), F.lit(None).cast(turn_kind).alias("turn"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "entry",
    )
    both = rows.select("conv", "piece", "ord", "turn", "role", "text", *none).unionAll(heads)
    dealt = both.repartition("conv") if whole else both.repartition("conv", "piece")
    return dealt.sortWithinPartitions("conv", "piece", "ord").mapInArrow(replay, schema)


def digests(whole_rows: DataFrame) -> DataFrame:
    """``conv, sha256`` of the ``role:text`` lines of ``repaired(..., whole=True)``, hashed as they pass."""
    kind, arrow_conv = _type(whole_rows, "conv")
    names, types = ["conv", "sha256"], [arrow_conv, pa.string()]

    def run(batches):
        out = []
        for (conv,), lines in _runs(batches, 1):
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(lines):
                digest.update(("\n" * (k > 0) + f"{role}:{text}").encode())
            out.append((conv, digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, names, types)
                out = []
        yield _batch(out, names, types)

    return whole_rows.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, sha256 string")
