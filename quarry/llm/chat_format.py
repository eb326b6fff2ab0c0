"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is rows of (conversation, position, text); lines of text show who speaks by a marker, a quote sign, a
question, or not at all. States are system, user, assistant; each line gives symbols (its marker if any, question mark,
leading list sign, length class) and Viterbi finds the likeliest states. Scores are integers, so sums don't depend on the
order of adding; of equally likely paths the one with the first state in ROLES at the latest difference counts.

No conversation is gathered in one task. Rows are dealt and sorted by range of (conversation, position, text), which
splits a long conversation, and stream through in order as blocks of at most BLOCK lines. A conversation that one block
holds is decoded there. Of others, each block is reduced to a matrix of best scores from state to state (max-plus), the
matrices of a conversation, nine numbers and nine ranks a block, are chained to give each block its first and last state,
and each block is decoded alone. Runs of lines that go on over a block's end are joined, and turns are numbered by
conversation, so the result doesn't depend on BLOCK or on how rows are dealt.

Edge cases: null and blank texts have no lines and form no turn. Rows with null conversation id are one conversation,
apart from one whose id is empty; null positions come first, rows with equal positions are ordered by text, repeated rows
are repeated lines. Lines before any marker get the likeliest role. Empty tables give empty results. Extra columns are
left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, written

ROLES = ("system", "user", "assistant")
#: Lines and characters of a block at most; a longer line is a block of its own.
BLOCK, BLOCK_CHARS = 2048, 1_000_000
MARKERS = {
    "system": ("system", "instructions", "setting"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent"),
}
_NAMES = {m: k for k, r in enumerate(ROLES) for m in MARKERS[r]}
MARK = re.compile(r"^\s*(?:\*\*|<\|?|\[|#+\s*)?\s*(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\s*(?:\*\*|\|?>|\])?\s*(?::|>|-(?=\s))\s*(?:\*\*)?\s*", re.IGNORECASE)


def _logs(*shares: float) -> tuple[int, ...]:
    return tuple(round(math.log(x) * 2**20) for x in shares)


START = _logs(0.3, 0.6, 0.1)
#: From line to line, without a marker, most lines go on with the same speaker; nobody returns to system.
STEP = (_logs(0.6, 0.35, 0.05), _logs(0.01, 0.69, 0.3), _logs(0.01, 0.19, 0.8))
#: When a blank line lies between, the speaker changes more often.
STEP_BLANK = (_logs(0.2, 0.75, 0.05), _logs(0.01, 0.34, 0.65), _logs(0.01, 0.64, 0.35))
#: A line with a marker mostly tells that the speaker changed.
STEP_MARKED = (_logs(0.2, 0.75, 0.05), _logs(0.01, 0.09, 0.9), _logs(0.01, 0.9, 0.09))
MARKED, UNMARKED = _logs(0.996, 0.002)
QUESTION, LISTED = _logs(0.02, 0.3, 0.08), _logs(0.2, 0.15, 0.5)
LENGTHS = (_logs(0.3, 0.5, 0.2), _logs(0.3, 0.4, 0.35), _logs(0.3, 0.25, 0.5))


def features(line: str) -> tuple[int, bool, int, bool]:
    """Role of the marker (3: none), question, length class, list sign."""
    m = MARK.match(line)
    words = line.count(" ") + 1
    return _NAMES[m[1].lower()] if m else 3, line.rstrip().endswith("?"), 0 if words < 8 else 1 if words < 30 else 2, line.lstrip().startswith(("- ", "* ", "```", "1."))


def scores(mark: int, question: bool, length: int, listed: bool) -> tuple[int, ...]:
    """Log probability, up to a constant, of a line's features under each role."""
    of = lambda k: (0 if mark == 3 else MARKED if mark == k else UNMARKED) + LENGTHS[length][k] + question * QUESTION[k] + listed * LISTED[k]
    return of(0), of(1), of(2)


def steps(mark: int, blank: bool) -> tuple[tuple[int, ...], ...]:
    return STEP_MARKED if mark < 3 else STEP_BLANK if blank else STEP


def code_of(line: str, blank: bool) -> int:
    mark, question, length, listed = features(line)
    return ((((mark * 2 + question) * 3) + length) * 2 + listed) * 2 + blank


def _step(code: int) -> tuple[int, ...]:
    """Scores from state i to state j at 3 i + j, for a line of this code."""
    code, blank = divmod(code, 2)
    code, listed = divmod(code, 2)
    code, length = divmod(code, 3)
    mark, question = divmod(code, 2)
    line = scores(mark, bool(question), length, bool(listed))
    return tuple(steps(mark, bool(blank))[i][j] + line[j] for i in range(3) for j in range(3))


STEPS = [_step(c) for c in range(4 * 2 * 3 * 2 * 2)]
NEVER = -(2**60)


def viterbi(codes: list[int], before: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[int, int, int]]]:
    """Scores of the states at the end, and from which state each one came, line by line."""
    x, y, z = before
    back = []
    for c in codes:
        t, out, way = STEPS[c], [], []
        for j in (0, 1, 2):
            best, at = x + t[j], 0
            if y + t[3 + j] > best:
                best, at = y + t[3 + j], 1
            if z + t[6 + j] > best:
                best, at = z + t[6 + j], 2
            out.append(best)
            way.append(at)
        x, y, z = out
        back.append(tuple(way))
    return (x, y, z), back


def path(back: list[tuple[int, int, int]], last: int) -> list[int]:
    """The states, last line first, and the one before the first line."""
    out = [last]
    for way in reversed(back):
        last = way[last]
        out.append(last)
    return out


def _lines(text: str | None) -> Iterator[tuple[str, bool]]:
    """Lines with ink, and whether a blank line comes before."""
    blank = False
    for x in (text or "").split("\n"):
        if x.strip():
            yield x, blank
        blank = not x.strip()


def blocks(transcripts: DataFrame, conv: str, pos: str, text: str, block: int) -> DataFrame:
    """(conv, part, block, alone, codes, pos, lines): blocks of lines, in order of part and block within a conversation.
    alone: the block holds its whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, kind = TaskContext.get().partitionId(), 0, None
        ready: list[tuple] = []
        held: list[tuple[int, int | None, str]] = []
        chars, now, whole, any_row = 0, None, False, False

        def out() -> pa.RecordBatch:
            cols = list(zip(*ready, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv", "part", "block", "alone", "codes", "pos", "lines"])
            ready.clear()
            return made

        def close(alone: bool) -> None:
            nonlocal n, chars
            if held:
                ready.append((now, part, n, alone, *map(list, zip(*held, strict=True))))
                n += 1
                held.clear()
                chars = 0

        size = 0
        for b in batches:
            kind = b.column("conv").type
            for c, p, t in zip(b.column("conv").to_pylist(), b.column("pos").to_pylist(), b.column("text"), strict=True):
                if not any_row or c != now:
                    close(whole)  # the first conversation of a part may have begun in the part before
                    whole, now, any_row = any_row, c, True
                for x, blank in _lines(t.as_py()):
                    if held and (len(held) >= block or chars + len(x) > BLOCK_CHARS):
                        whole = False
                        close(False)
                    held.append((code_of(x, blank), p, x))
                    chars += len(x)
                    size += len(x)
                if ready and (size > 2 * BLOCK_CHARS or len(ready) > 5000):
                    yield out()
                    size = 0
        close(False)
        if ready:
            yield out()

    rows = transcripts.select(F.col(conv).alias("conv"), F.col(pos).cast("long").alias("pos"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    order = ("conv", "pos", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv {kind}, part long, block long, alone boolean, codes array<int>, pos array<long>, lines array<string>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: best score from state i before it to state j at its end at 3 i + j, and, of the paths to j, the rank of
    the one from i among equally good ones."""
    for b in batches:
        best, ranks = [], []
        for codes in b.column("codes").to_pylist():
            ways = [viterbi(codes, tuple(0 if k == i else NEVER for k in range(3))) for i in range(3)]
            best.append([ways[i][0][j] for i in range(3) for j in range(3)])
            paths = [[path(ways[i][1], j) for j in range(3)] for i in range(3)]
            ranks.append([sum(paths[k][j] < paths[i][j] for k in range(3)) for i in range(3) for j in range(3)])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "block")), pa.array(best, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], names=["conv", "part", "block", "best", "ranks"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the sorted blocks of conversations: the states before and at the end of each, and whether it is the first or
    the last of its conversation. A conversation's matrices are held, nothing of its text."""
    now, held, any_row = None, [], False

    def out() -> pa.RecordBatch:
        score, before = START, []
        for _, _, best, _ in held:
            before.append(score)
            score = tuple(max(score[i] + best[3 * i + j] for i in range(3)) for j in range(3))
        at, rows = max(range(3), key=lambda j: (score[j], -j)), []
        for k in range(len(held) - 1, -1, -1):
            part, block, best, ranks = held[k]
            enter = min(range(3), key=lambda i: (-(before[k][i] + best[3 * i + at]), ranks[3 * i + at], i))
            rows.append((part, block, enter, at, k == 0, k == len(held) - 1))
            at = enter
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "block", "enter", "leave", "opens", "ends"])

    for b in batches:
        for c, *row in zip(*(b.column(x).to_pylist() for x in ("conv", "part", "block", "best", "ranks")), strict=True):
            if any_row and c != now:
                yield out()
                held = []
            now, any_row = c, True
            held.append(row)
    if held:
        yield out()


def _decoded(row: dict) -> list[int]:
    """The states of a block's lines."""
    if row["alone"]:
        score, back = viterbi(row["codes"], START)
        last = max(range(3), key=lambda j: (score[j], -j))
    else:
        _, back = viterbi(row["codes"], tuple(0 if k == row["enter"] else NEVER for k in range(3)))
        last = row["leave"]
    return path(back, last)[-2::-1]


def _plain(line: str) -> str:
    return MARK.sub("", line, count=1).strip()


def _is_marked(code: int) -> bool:
    return code // 24 < 3


def _each(rows_of, names: list[str], types: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x for row in b.to_pylist() for x in rows_of(row)]
            conv = b.column("conv").type
            cols = zip(*made, strict=True) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t or conv) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _line_rows(row: dict) -> Iterator[tuple]:
    for k, (s, c, p, x) in enumerate(zip(_decoded(row), row["codes"], row["pos"], row["lines"], strict=True)):
        yield row["conv"], row["part"], row["block"], k, p, ROLES[s], _is_marked(c), _plain(x)


def _piece_rows(row: dict) -> Iterator[tuple]:
    """Runs of lines of one role, or up to a marker. open: the run may go on in another block."""
    states, codes = _decoded(row), row["codes"]
    starts = [k for k in range(len(states)) if not k or states[k] != states[k - 1] or _is_marked(codes[k])]
    goes_on = not row["alone"] and not row["opens"] and states[0] == row["enter"] and not _is_marked(codes[0])
    for i, (x, y) in enumerate(zip(starts, [*starts[1:], len(states)], strict=True)):
        open_ = not i and goes_on or y == len(states) and not row["alone"] and not row["ends"]
        yield row["conv"], row["part"], row["block"], i - goes_on, row["pos"][x], ROLES[states[x]], "\n".join(map(_plain, row["lines"][x:y])), open_, row["alone"]


def _with_ends(transcripts: DataFrame, conv: str, pos: str, text: str, block: int) -> DataFrame:
    spark = transcripts.sparkSession
    bound_batches(spark)
    cut = written(blocks(transcripts, conv, pos, text, block), "chat-blocks")
    kind = cut.schema["conv"].dataType.simpleString()
    sums = cut.where("not alone").select("conv", "part", "block", "codes").mapInArrow(_summed, f"conv {kind}, part long, block long, best array<long>, ranks array<int>")
    ends = sums.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(_chained, "part long, block long, enter int, leave int, opens boolean, ends boolean")
    return cut.join(ends, ["part", "block"], "left")


def line_roles(transcripts: DataFrame, conv: str = "conv_id", pos: str = "turn", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, part, block, line, pos, role, marked, text): a row per line with ink, markers removed; within a conversation
    lines are in the order of part, block and line."""
    cut = _with_ends(transcripts, conv, pos, text, block)
    kind = cut.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "block", "line", "pos", "role", "marked", "text"]
    types = [None, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    return cut.mapInArrow(_each(_line_rows, names, types), f"conv {kind}, part long, block long, line int, pos long, role string, marked boolean, text string")


def canonical_turns(transcripts: DataFrame, conv: str = "conv_id", pos: str = "turn", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, turn, pos, role, text): runs of lines of one role, or up to a marker, as one turn, numbered from 0 in each
    conversation; pos is that of the turn's first line."""
    cut = _with_ends(transcripts, conv, pos, text, block)
    kind = cut.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "block", "k", "pos", "role", "text", "open", "alone"]
    types = [None, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    pieces = written(cut.mapInArrow(_each(_piece_rows, names, types), f"conv {kind}, part long, block long, k int, pos long, role string, text string, open boolean, alone boolean"), "chat-turns")
    # turns begun before a block: counts of blocks are summed, not turns
    begun = pieces.where("not alone").groupBy("conv", "part", "block").agg((F.max("k") + 1).alias("n"))
    order = Window.partitionBy("conv").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("part", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    numbered = pieces.join(begun, ["part", "block"], "left").withColumn("turn", F.coalesce("before", F.lit(0)) + F.col("k"))
    parts = F.array_sort(F.collect_list(F.struct("part", "block", "k", "pos", "text"))).alias("p")
    cut_turns = numbered.where("open").groupBy("conv", "turn", "role").agg(parts)
    joined = cut_turns.select("conv", "turn", F.get("p", F.lit(0))["pos"].alias("pos"), "role", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return numbered.where("not open").select("conv", "turn", "pos", "role", "text").union(joined)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))


def shown(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, text): turns as exports show them, by a marker whose form changes from conversation to
    conversation, and on every fifth turn not at all."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    name = lambda *names: F.element_at(F.array(*map(F.lit, names)), (style + 1).cast("int"))
    marker = F.when(F.col("role") == "user", name("User: ", "Human: ", "Q: ")).when(F.col("role") == "assistant", name("Assistant: ", "AI: ", "A: ")).when(F.col("role") == "system", F.lit("System: ")).otherwise("")
    return conversations.select("conv_id", "turn", F.concat(F.when(F.pmod(F.col("turn"), F.lit(5)) == 4, F.lit("\n")).otherwise(marker), F.coalesce("text", F.lit(""))).alias("text"))


def op7_chat_format(conversations: DataFrame) -> DataFrame:
    """Roles of all turns of conversations, recovered from transcripts that show them as exports do (see shown). A row per
    recovered turn: turn is the position of its first line, part its number in the conversation."""
    out = canonical_turns(shown(conversations))
    text = rendered(F.col("role"), F.col("text"))
    return out.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), F.col("turn").cast("long").alias("part"), "role", F.length("text").cast("long").alias("n_chars"), F.sha1(text.cast("binary")).alias("rendered_sha1"))
