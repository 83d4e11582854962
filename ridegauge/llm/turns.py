"""Repair of damaged conversations by weighted CYK parsing of intervals.

A repaired conversation's role initials are ``(s?(ua)+)?``. The grammar is in Chomsky normal form: a nonterminal (p, q) for each pair of states of
the language, binary rules (p, q) -> (p, r) (r, q), and terminal rules for the edits of one row: Keep (0), Rerole (2), Delete (3; the only one for
blank and repeated rows); a kept row that is truncated adds 1. Insertions (2 each) are closed beforehand: the cheapest ones that lead from p to
q without a row, put on both sides of every terminal. The cell of a span holds, for each nonterminal, the minimum of (cost, audit), the audit
being the initials of the edits. A derivation of a span can be cut behind any of its rows, because some state is passed there; so one
cut fills a cell with its minimum, and spans are combined bottom-up by length 1, 2, 4, ... No audit of a span is the front of another of
equal cost (what follows could only be paid insertions), so the least audit of a span comes from the least of its parts.

1. Rows are read without their texts as (turn, role, hash of role and text, faults); equal ones are counted before they are shuffled, and later
   repeats of a role and text are found by grouping on its hash.
2. Sorted ranges of (conversation, turn, role, hash) go to tasks, so a long conversation spreads over many; each task combines spans of its blocks and
   passes on one cell a block. One cell a block meets again per conversation.
3. Each conversation's audit is put in front of its rows, which stream past it once and come out repaired, in order.

Order: by turn, nulls first, then role, then hash. Null roles and texts are one space. Every conversation has a row in the summary, those without
rows zeros and an empty audit. Null conversation ids are one conversation. Further columns are not read. An empty table has no conversations.
A conversation's audit is one string, and its repaired rows come out of one task in order (a digest needs them so), in bounded memory otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ridegauge.llm.common import materialize, partitions, ready, table

BLOCK_ROWS = 4096
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: States: 0 before the first row, 1 behind s, 2 behind u, 3 behind a. What each initial leads to.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
START, ACCEPTED = 0, (0, 3)
GIVEN = {"u": "user", "a": "assistant"}
#: Faults of a row, the first counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_SPACES = " \t\n\x0b\x0c\r"
_STATES = range(4)

Cell = tuple  # 16 entries, (cost, audit) or None; entry 4 * p + q


def _least(options) -> tuple | None:
    return min((o for o in options if o is not None), default=None)


def join(a: Cell, b: Cell) -> Cell:
    """The binary rules: cell of two neighbouring spans."""
    out = []
    for p in _STATES:
        for q in _STATES:
            best = None
            for r in _STATES:
                x, y = a[4 * p + r], b[4 * r + q]
                if x is not None and y is not None:
                    cost = x[0] + y[0]
                    if best is None or cost <= best[0]:
                        found = (cost, x[1] + y[1])
                        if best is None or found < best:
                            best = found
            out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """Insertions without rows; three steps reach every state there is."""
    empty = tuple((0, "") if p == q else None for p in _STATES for q in _STATES)
    one = tuple(_least((COST[INSERT], INSERT) for c in GIVEN if STEP[c].get(p) == q) for p in _STATES for q in _STATES)
    found = empty
    for _ in range(3):
        longer = join(found, one)
        found = tuple(_least(x) for x in zip(found, longer, strict=True))
    return found


INSERTIONS = _closure()


def _row_cell(initial: str, fault: int) -> Cell:
    """The terminal rules of one row between insertions."""
    bare = []
    for p in _STATES:
        for q in _STATES:
            options = [(COST[DELETE], DELETE)] if p == q else []
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                if STEP.get(initial, {}).get(p) == q:
                    options.append((COST[KEEP] + more, KEEP))
                options += [(COST[REROLE] + more, REROLE) for c in GIVEN if STEP[c].get(p) == q]
            bare.append(_least(options))
    return join(join(INSERTIONS, tuple(bare)), INSERTIONS)


#: Terminal cells by initial (empty: none of the language's) and fault.
ROW_CELLS = {(initial, fault): _row_cell(initial, fault) for initial in ("s", "u", "a", "") for fault in (SOUND, BLANK, DUPLICATE, TRUNCATED)}
#: Short spans repeat; their joins are kept.
_JOINED: dict[tuple[Cell, Cell], Cell] = {}
JOINS_KEPT = 20_000


def _short_join(a: Cell, b: Cell) -> Cell:
    found = _JOINED.get((a, b))
    if found is None:
        if len(_JOINED) >= JOINS_KEPT:
            _JOINED.clear()
        found = _JOINED[a, b] = join(a, b)
    return found


def combine(cells: list[Cell]) -> Cell:
    """The cell of a whole span from those of its neighbouring parts, spans of equal length first."""
    if not cells:
        return INSERTIONS
    length = 1
    while len(cells) > 1:
        pair = _short_join if length <= 8 else join
        cells = [pair(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
        length *= 2
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the start symbol."""
    return _least(cell[4 * START + q] for q in ACCEPTED)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` chooses; dropped rows have ``copies`` 0, repeated ones 2."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(spaced("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows without texts: conv_id, turn, role, key, blank, truncated, n (how many), first (no earlier turn has this key)."""
    solid = F.rtrim(F.col("text"), F.lit(_SPACES))
    bare, last = solid == "", F.substring(solid, -1, 1)
    slim = rows.select(
        "conv_id", F.when(F.col("copies") > 0, F.col("turn")).alias("turn"), F.when(F.col("copies") > 0, F.col("role")).alias("role"),
        F.when(F.col("copies") > 0, _key()).alias("key"), bare.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "copies",
    )
    slim = slim.groupBy("conv_id", "turn", "role", "key").agg(
        F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
    )
    slim = materialize(slim)
    # Turns in order, nulls first.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = slim.filter("n > 0").groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("turns"), F.min(order).alias("first")).filter("turns > 1")
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "first.*").withColumnsRenamed({"known": "first_known", "turn": "first_turn"})
    later = slim.join(firsts, slim["conv_id"].eqNullSafe(firsts["of"]) & (slim["key"] == firsts["same"]), "left")
    first = F.col("same").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))
    return later.select("conv_id", "turn", "role", "key", "blank", "truncated", "n", first.alias("first"))


def _initial(role: str) -> str:
    return role[:1]


class _Block:
    """What one stretch of sorted rows of a conversation passes on."""

    fields = "conv_id {}, block bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, costs array<int>, audits array<string>, least bigint, most bigint, turns bigint, first_turn bigint, last_turn bigint"

    def __init__(self, conv, block: int):
        self.conv, self.block = conv, block
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = None
        self.least = self.most = self.first_turn = self.last_turn = None
        self.cells: list[Cell] = []

    def add(self, turn, role: str, n: int, blank: bool, truncated: bool, first: bool) -> None:
        if not n:
            return
        initial = _initial(role)
        own = BLANK if blank else DUPLICATE if not first else TRUNCATED if truncated else SOUND
        again = BLANK if blank else DUPLICATE
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - (own != DUPLICATE)
        self.truncated += own == TRUNCATED
        self.illegal += n - 1 + (self.tail is not None and not legal(self.tail, initial))
        self.head = initial if self.head is None else self.head
        self.tail = initial
        self.rows += n
        known = initial if initial in STEP else ""
        self.cells.append(ROW_CELLS[known, own])
        self.cells += [ROW_CELLS[known, again]] * (n - 1)
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.least = turn if self.least is None else self.least
            self.most = turn

    def record(self) -> tuple:
        cell = combine(self.cells)
        return (self.conv, self.block, self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail,
                [-1 if c is None else c[0] for c in cell], ["" if c is None else c[1] for c in cell], self.least, self.most, self.turns, self.first_turn, self.last_turn)


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(records: Iterator[tuple], schema: pa.Schema, rows: int, size=lambda record: 0, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for record in records:
        held.append(record)
        total += size(record)
        if len(held) >= rows or total > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _cells(faults: DataFrame) -> DataFrame:
    spark = faults.sparkSession
    kind = faults.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(_Block.fields.format(kind))
    target = _arrow(schema)

    def blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, block = TaskContext.get().partitionId() << 32, None
        for conv, turn, role, n, blank, truncated, first in rows:
            if block is not None and (block.conv != conv or block.rows >= BLOCK_ROWS):
                yield block.record()
                block = None
            if block is None:
                at += 1
                block = _Block(conv, at)
            while n > BLOCK_ROWS:  # equal rows are a block of their own now and then
                block.add(turn, role, BLOCK_ROWS, blank, truncated, first)
                yield block.record()
                n, first, at = n - BLOCK_ROWS, False, at + 1
                block = _Block(conv, at)
            block.add(turn, role, n, blank, truncated, first)
        if block is not None:
            yield block.record()

    def run(batches):
        return _batches(blocks(_records(batches)), target, 512, lambda r: sum(map(len, r[10])))

    ordered = faults.repartitionByRange(partitions(spark), "conv_id", "turn", "role", "key").sortWithinPartitions("conv_id", "turn", "role", "key")
    return ordered.select("conv_id", "turn", "role", F.col("n").cast("long").alias("n"), "blank", "truncated", "first").mapInArrow(run, schema)


def _summaries(cells: DataFrame) -> DataFrame:
    """One row a conversation from its blocks, which stream past in order."""
    spark = cells.sparkSession
    kind = cells.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
    target = _arrow(schema)

    def finish(blocks: list[tuple]) -> tuple:
        full = [b for b in blocks if b[2]]
        rows, blank, duplicate, truncated, illegal = (sum(b[k] for b in full) for k in (2, 3, 4, 5, 6))
        illegal += sum(not legal(x[8], y[7]) for x, y in zip(full, full[1:], strict=False))
        dated = [b for b in full if b[11] is not None]
        gaps = 0
        if dated:
            turns = sum(b[13] for b in dated) - sum(x[15] == y[14] for x, y in zip(dated, dated[1:], strict=False))
            gaps = max(b[12] for b in dated) - min(b[11] for b in dated) + 1 - turns
        cost, audit = cheapest(combine([tuple(None if c < 0 else (c, a) for c, a in zip(b[9], b[10], strict=True)) for b in full])) if full else (0, "")
        return blocks[0][0], rows, gaps, blank, duplicate, truncated, illegal, cost, audit

    def groups(records: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for record in records:
            if held and held[0][0] != record[0]:
                yield finish(held)
                held = []
            held.append(record)
        if held:
            yield finish(held)

    def run(batches):
        return _batches(groups(_records(batches)), target, 512, lambda r: len(r[8]))

    return cells.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def summarize(rows: DataFrame) -> DataFrame:
    """conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit for the rows of :func:`damage` (or others with ``copies``)."""
    ready(rows.sparkSession)
    return materialize(_summaries(_cells(_faults(rows))))


def apply_audit(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows. The audit alone fixes every given role: after u comes a, after anything else u."""
    before = ""

    def given() -> str:
        return GIVEN["a" if before == "u" else "u"]

    for edit in audit:
        if edit == INSERT:
            role, text = given(), ""
        else:
            role, text = next(rows)
            if edit == DELETE:
                continue
            role = given() if edit == REROLE else role
        before = _initial(role)
        yield edit, role, text


def repaired(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text of the repaired conversations; rows of one are in one partition, in order.

    A conversation without repaired rows has one row with a null position, so that it isn't lost.
    """
    spark = ready(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, position bigint, edit string, role string, text string")
    target = _arrow(schema)
    head = summary.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("key"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _key().alias("key"), "text", "copies")
    both = head.unionByName(body).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key")

    def conversations(records: Iterator[tuple]) -> Iterator[tuple]:
        record = next(records, None)
        while record is not None:
            conv, _, audit, _ = record[0], record[1], record[3], record[4]
            following: list = [None]

            def texts():
                for r in records:
                    if r[1] == 0:
                        following[0] = r
                        return
                    for _ in range(r[4]):
                        yield r[2], r[3]

            source, position = texts(), 0
            for edit, role, text in apply_audit(audit, source):
                yield conv, position, edit, role, text
                position += 1
            if not position:
                yield conv, None, None, None, None
            for _ in source:
                raise RuntimeError("a conversation has more rows than its audit")
            record = following[0]

    def run(batches):
        return _batches(conversations(_records(batches)), target, 512, lambda r: len(r[4] or ""))

    return both.select("conv_id", "kind", "role", "text", "copies").mapInArrow(run, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary and repaired rows of conversations as they are, without damage."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", spaced("role"), spaced("text"), F.lit(1).alias("copies"))
    summary = summarize(rows)
    return summary, repaired(rows, summary)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, from :func:`repaired`, whose order it relies on."""
    schema = StructType([repaired_rows.schema["conv_id"], StructField("repaired_sha256", StructType.fromDDL("x string")["x"].dataType)])
    target = _arrow(schema)

    def hashes(records: Iterator[tuple]) -> Iterator[tuple]:
        conv, digest = None, None
        for record in records:
            if not record[1]:  # the first row of a conversation
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = record[0], hashlib.sha256()
                if record[1] is None:
                    continue
            digest.update(f"{chr(10) if record[1] else ''}{record[2]}:{record[3]}".encode("utf-8", "surrogatepass"))
        if digest is not None:
            yield conv, digest.hexdigest()

    def run(batches):
        return _batches(hashes(_records(batches)), target, 512)

    return repaired_rows.select("conv_id", "position", "role", "text").mapInArrow(run, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    summary = summarize(rows)
    found = digests(repaired(rows, summary)).withColumnRenamed("conv_id", "of")
    joined = summary.join(found, summary["conv_id"].eqNullSafe(found["of"]))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
