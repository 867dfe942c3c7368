"""Repair of conversations: the cheapest edits that make their roles alternate.

A state says what the kept roles look like so far: none, a system turn, a user turn, an assistant
turn.  A turn is answered by a macro edit: a run of at most two inserted turns and what is done with
the turn itself.  Written as its edits' initials a macro is a prefix-free code, so whole audits
compare as the sequences of their codes.  A layer of the dynamic program therefore keeps, for each
state, the cost, the rank of its audit among the layer's states, and a pointer to the layer before,
instead of the audit; the audit is read back along the pointers.

A conversation may be long, so it's cut into segments of bounded size.  A segment is summed up by
what it costs from each state to each state, and how the audits from one state rank; such sums are
chained over a conversation's segments, which fixes every segment's first and last state, and then
all segments are reconstructed in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._columns import GAP_CHARS
from millrace.llm._shared import Rows, written

#: Most rows, and characters of roles and texts (or one row), of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
#: What the edits cost, and what a kept truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Longest run of inserted turns that can be cheapest: one more would only return to an earlier state.
RUN = 2

#: States: nothing kept yet, then the kind of the last kept turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_START = tuple(tuple((0, 0) if p == s else None for p in range(4)) for s in range(4))

Layer = tuple  # of (cost, rank) or None for each state
_steps: dict = {}


def step(kind: tuple[str, bool], layer: Layer) -> tuple[int, Layer, tuple]:
    """(cost taken off, next layer, (state before, code) for each state) after a turn.

    kind: the role's initial, or "" for a turn that must go, and whether it's truncated.  Costs are
    kept relative to the least, so only few layers differ and each is worked out once.
    """
    found = _steps.get((kind, layer))
    if found is None:
        initial, truncated = kind
        best: list = [None] * 4
        for before, entry in enumerate(layer):
            if entry is None:
                continue
            state = before
            for run in range(RUN + 1):
                cost = entry[0] + INSERT * run
                options = [(state, cost + DELETE, "D")]
                if initial:
                    options.append((_INSERTED[state], cost + REROLE + TRUNCATED * truncated, "R"))
                    if (state, initial) in _NEXT:
                        options.append((_NEXT[state, initial], cost + KEEP + TRUNCATED * truncated, "K"))
                for after, total, edit in options:
                    key = (total, entry[1], "I" * run + edit, before)
                    best[after] = key if best[after] is None else min(best[after], key)
                state = _INSERTED[state]
        least = min(k[0] for k in best if k)
        ranks = {k: i for i, k in enumerate(sorted((k[1:3] for k in best if k)))}
        found = (least, tuple(k and (k[0] - least, ranks[k[1:3]]) for k in best), tuple(k and (k[3], k[2]) for k in best))
        _steps[kind, layer] = found
    return found


def through(kinds: list[tuple[str, bool]], start: int) -> tuple[int, Layer, list[tuple]]:
    """(cost, last layer, pointers of all layers) of a segment that begins in the state `start`."""
    cost, layer, pointers = 0, _START[start], []
    for kind in kinds:
        more, layer, pointer = step(kind, layer)
        cost += more
        pointers.append(pointer)
    return cost, layer, pointers


def finish(layer: Layer) -> tuple[int, int, int]:
    """(cost, last state, inserted turns) of the best end of a whole conversation."""
    ends = []
    for state, entry in enumerate(layer):
        at = state
        for run in range(RUN + 1):
            if entry is not None and at in (NOTHING, ASSISTANT):
                ends.append((entry[0] + INSERT * run, entry[1], "I" * run, state, run))
            at = _INSERTED[at]
    cost, _, _, state, run = min(ends)
    return cost, state, run


def codes(pointers: list[tuple], last: int) -> list[str]:
    """The macros of a segment, read back from its last state."""
    out = []
    for pointer in reversed(pointers):
        last, code = pointer[last]
        out.append(code)
    return out[::-1]


def apply(first: int, edits: list[str], roles: list[str], texts: list[str], end: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows; `end`: turns inserted at the end."""
    state = first
    for code, role, text in zip([*edits, "I" * end], [*roles, ""], [*texts, ""], strict=True):
        for edit in code:
            if edit == "K":
                state = _NEXT[state, role[:1]]
                yield role, text
            elif edit != "D":
                state = _INSERTED[state]
                yield _ROLE[state], text if edit == "R" else ""


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text alone, whatever other columns there are."""
    rows = Rows(turns, "text")
    return rows.frame.select(*[rows.col(c).alias(c) for c in ("conv_id", "turn", "role", "text")])


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with their damage by crc32("conv_id:turn") modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 doubles the row, 4 makes it the user's.
    """
    turns = _plain(turns)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    rows = turns.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("col")


_SEGMENT = """conv_id {id}, no long, whole boolean, first_turn long, last_turn long, turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long,
 initials string, roles array<string>, texts array<string>, start int, last int, tail int, cost long, gaps long"""
_LEGAL = {"su", "ua", "au"}


class _Segment:
    """Rows of one conversation, in order."""

    def __init__(self):
        self.kinds, self.roles, self.texts = [], [], []
        self.turns: list[int | None] = [None, None]
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = self.chars = 0
        self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.kinds:
            self.illegal += self.last_role + initial not in _LEGAL
        else:
            self.first_role = initial
        self.last_role = initial
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
            self.n_turns += 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        gone = fault in ("blank", "duplicate")
        self.kinds.append(("" if gone else initial if initial in ("s", "u", "a") else "x", fault == "truncated"))
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.chars += len(role) + len(self.texts[-1])

    def row(self, conv, no: int, whole: bool) -> tuple:
        packed = "".join((i or "-") + ("!" if t else ".") for i, t in self.kinds)
        start = last = tail = cost = gaps = None
        if whole:
            cost, layer, _ = through(self.kinds, NOTHING)
            more, last, tail = finish(layer)
            start, cost = NOTHING, cost + more
            gaps = _gaps(*self.turns, self.n_turns)
        return (conv, no, whole, *self.turns, self.n_turns, self.first_role, self.last_role, self.blank, self.duplicate, self.truncated, self.illegal, packed, self.roles, self.texts, start, last, tail, cost, gaps)


def _gaps(first: int | None, last: int | None, n: int) -> int:
    return last - first + 1 - n if n else 0


def _kinds(packed: str) -> list[tuple[str, bool]]:
    return [("" if packed[i] == "-" else packed[i], packed[i + 1] == "!") for i in range(0, len(packed), 2)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; lists of texts count by their characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 256 + sum(32 + len(t) for c in r if isinstance(c, list) for t in c if isinstance(t, str))
        if size >= SEGMENT_CHARS:
            yield _table(held, schema)
            held, size = [], 0
    if held:
        yield _table(held, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in b.slice(i, 256).columns], strict=True)


def segments(turns: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The segments of all conversations in order, a written table; a conversation of one segment is solved already.

    Equal rows are counted before they move, so that ranges of rows by conversation, turn, role and
    text can be of equal size whatever repeats.
    """
    same = ["conv_id", "turn", "role", "text"]
    counted = turns.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.sha2("text", 256))
    first = turns.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.sha2("text", 256).alias("_d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    joined = counted.join(first, on).withColumn("seen", ~F.col("turn").eqNullSafe(F.col("first.turn")))
    shown = F.substring(F.btrim("text", F.lit(GAP_CHARS)), -1, 1)  # the last character that isn't blank
    fault = F.when(shown == "", "blank").when(F.col("seen"), "duplicate").when(~shown.isin(".", "!", "?"), "truncated").otherwise("")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = joined.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "n", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = _SEGMENT.format(id=turns.schema["conv_id"].dataType.simpleString())
    schema = _arrow(turns.sparkSession, ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32

        def made() -> Iterator[tuple]:
            held: list[tuple] = []  # segments of the conversation at hand but the open one
            no, conv, open_, n_convs, n_own = base, None, None, 0, 0
            for c, turn, role, text, n, fault in _rows(batches):
                if open_ is None or c != conv:
                    if open_ is not None:
                        # the first conversation may have begun in an earlier task
                        yield open_.row(conv, no, n_own == 0 and n_convs > 1)
                        no += 1
                    conv, open_, n_own = c, _Segment(), 0
                    n_convs += 1
                for i in range(n):
                    if len(open_.kinds) >= segment_rows or open_.chars + len(text) > segment_chars and open_.kinds:
                        yield open_.row(conv, no, False)
                        no, n_own, open_ = no + 1, n_own + 1, _Segment()
                    open_.add(turn, role, text, "duplicate" if i and fault != "blank" else fault)
            if open_ is not None:
                yield open_.row(conv, no, False)  # it may go on in the next task

        yield from _in_batches(made(), schema)

    return written(ranged.mapInArrow(cut, ddl), "conversation-segments")


_CHOICE = "no long, start int, last int, tail int, cost long, gaps long, illegal long"


def _chained(open_segments: DataFrame) -> DataFrame:
    """(no, start, last, tail, cost, gaps, illegal): each open segment's states; what its conversation's first segment reports.

    A task reads its conversations' segments in order and holds a few numbers for each.
    """
    own = "conv_id no first_turn last_turn turns first_role last_role illegal".split()
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_segments.select(*own).schema) + ", costs array<int>, ranks array<int>, base array<long>"
    schema, out = _arrow(open_segments.sparkSession, ddl), _arrow(open_segments.sparkSession, _CHOICE)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for *row, packed in _rows(batches):
                ends = [through(_kinds(packed), s)[:2] for s in range(4)]
                flat = [e for _, layer in ends for e in layer]
                yield (*row, [-1 if e is None else e[0] for e in flat], [-1 if e is None else e[1] for e in flat], [base for base, _ in ends])

        yield from _in_batches(made(), schema)

    summed = open_segments.select(*own, "initials").mapInArrow(sums, ddl)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(nos: list[int], steps: list[list], layer: list, seam: list) -> Iterator[tuple]:
            cost, last, tail = finish(tuple(layer))
            states = [last]
            for pointer in reversed(steps):
                states.append(pointer[states[-1]])
            states.reverse()
            first, last_turn, n, illegal, _ = seam
            for i, no in enumerate(nos):
                head = i == 0
                yield (no, states[i], states[i + 1], tail if i + 1 == len(nos) else 0, cost if head else 0, _gaps(first, last_turn, n) if head else 0, illegal if head else 0)

        def made():
            conv, nos = None, []
            steps, layer, seam = [], [], []
            for c, no, first, last, n, a, z, illegal, costs, ranks, base in _rows(batches):
                if nos and c != conv:
                    yield from solved(nos, steps, layer, seam)
                    nos = []
                if not nos:
                    conv, steps, layer, seam = c, [], list(_START[NOTHING]), [None, None, 0, 0, None]
                best: list = [None] * 4
                for s, entry in enumerate(layer):
                    for t in range(4):
                        if entry is not None and costs[4 * s + t] >= 0:
                            key = (entry[0] + base[s] + costs[4 * s + t], entry[1], ranks[4 * s + t], s)
                            best[t] = key if best[t] is None else min(best[t], key)
                order = {k: i for i, k in enumerate(sorted(k[1:3] for k in best if k))}
                layer = [k and (k[0], order[k[1:3]]) for k in best]
                steps.append([k and k[3] for k in best])
                nos.append(no)
                if n:
                    seam[2] += n - (seam[1] == first)
                    seam[:2] = [first if seam[0] is None else seam[0], last]
                seam[3] += illegal + (seam[4] is not None and seam[4] + a not in _LEGAL)
                seam[4] = z
            if nos:
                yield from solved(nos, steps, layer, seam)

        yield from _in_batches(made(), out)

    return summed.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "no").mapInArrow(chain, _CHOICE)


_PIECE = "conv_id {id}, no long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Pieces of the repaired conversations of turns(conv_id, turn, role, text): one for most conversations.

    (conv_id, no, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts): a conversation's
    pieces are in the order of `no`; its numbers are the pieces' sums, its audit and rows theirs one
    after another.  `whole` pieces are all of their conversation.

    Rows stand in the order of turn (null first), role, text.  A null role or text is one space; a
    null conv_id is a conversation.  A role without an initial, or with one that isn't s, u or a,
    can't be kept.  No rows give no piece.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _plain(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), name("role"), name("text"))
    cut = segments(rows, segment_rows, segment_chars)
    chosen = _chained(cut.where("not whole"))
    replaced = ("start", "last", "tail", "cost", "gaps")
    opened = cut.where("not whole").drop(*replaced).withColumnRenamed("illegal", "_inside").join(chosen, "no").drop("_inside").select(cut.columns)
    ddl = _PIECE.format(id=rows.schema["conv_id"].dataType.simpleString())
    schema = _arrow(turns.sparkSession, ddl)
    wanted = "conv_id no whole gaps blank duplicate truncated illegal cost initials roles texts start last tail".split()

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for *kept, packed, roles, texts, start, last, tail in _rows(batches):
                edits = codes(through(_kinds(packed), start)[2], last)
                said = list(apply(start, edits, roles, texts, tail))
                yield (*kept, "".join(edits) + "I" * tail, [r for r, _ in said], [t for _, t in said])

        yield from _in_batches(made(), schema)

    return cut.where("whole").unionByName(opened).select(*wanted).mapInArrow(rebuilt, ddl)


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, no, place, role, text): the repaired rows, in the order of no and place."""
    return pieces.select("conv_id", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m")).select("conv_id", "no", "place", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


_REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its numbers, audit and the SHA-256 of its repaired `role:text`, joined by newlines.

    A digest is sequential, so a conversation's pieces are streamed through one task, which holds
    one piece and the audit, itself a value of the result; whole conversations don't move.
    """
    ddl = _REPORT.format(id=pieces.schema["conv_id"].dataType.simpleString())
    schema = _arrow(pieces.sparkSession, ddl)

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            conv, sums, audit, digest, begun = None, None, [], None, False
            for c, whole, *numbers, own, roles, texts in _rows(batches):
                if sums is not None and (whole or c != conv):
                    yield (conv, *sums, "".join(audit), digest.hexdigest())
                    sums = None
                if sums is None:
                    conv, sums, audit, digest, begun = c, [0] * len(numbers), [], hashlib.sha256(), False
                sums = [a + b for a, b in zip(sums, numbers, strict=True)]
                audit.append(own)
                for role, text in zip(roles, texts, strict=True):
                    digest.update((("\n" if begun else "") + role + ":" + text).encode())
                    begun = True
            if sums is not None:
                yield (conv, *sums, "".join(audit), digest.hexdigest())

        yield from _in_batches(made(), schema)

    pieces = pieces.select("conv_id", "no", "whole", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts")
    several = pieces.where("not whole").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "no").drop("no")
    return pieces.where("whole").drop("no").mapInArrow(stitched, ddl).unionByName(several.mapInArrow(stitched, ddl))


def with_empty(reported: DataFrame, turns: DataFrame) -> DataFrame:
    """The report with a row of zeros, an empty audit and the digest of nothing for each conversation of `turns` that it lacks."""
    ids = _plain(turns).select(F.col("conv_id").alias("_c")).distinct()
    zero = {f.name: F.lit("" if f.name == "audit" else hashlib.sha256().hexdigest() if f.name == "repaired_sha256" else 0) for f in reported.schema if f.name != "conv_id"}
    joined = ids.join(reported, ids["_c"].eqNullSafe(reported["conv_id"]), "left")
    return joined.select(F.col("_c").alias("conv_id"), *[F.coalesce(F.col(k), v).alias(k) for k, v in zero.items()])
