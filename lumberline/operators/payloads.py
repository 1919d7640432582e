"""JSON payloads inside record texts.

A record may be as long as its file, so its lines are not brought together.  Each block of lines is read by itself
and tells which payloads it holds, which brackets it closes that an earlier block must have opened, and which
it leaves open.  Depths are summed along the blocks, as record numbers are; brackets that meet across blocks
give the few stretches of lines that are read once more as a whole.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.operators.records import KEYS, record_carry
from lumberline.session import staged


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODE = json.JSONDecoder(parse_constant=_no_constant).raw_decode

# What an open bracket may go on with, one bit each: an array that is empty, has one plain value, has something to tell, or
# has just had a comma; an object that is empty, has a key, a colon, a value, or has just had a comma.
_EMPTY, _ONE, _SOME, _NEXT, _BARE, _KEY, _COLON, _VALUE, _MORE = (1 << i for i in range(9))
_ANY = 511
_TOLD = _SOME | _VALUE


def _moves(by: dict[int, int]) -> list[int]:
    """What any set of such states becomes; 0 if none of them allows the token."""
    return [sum({to for bit, to in by.items() if states & bit}) for states in range(_ANY + 1)]


_NEST = _moves({_EMPTY: _SOME, _NEXT: _SOME, _COLON: _VALUE})
_AFTER = {
    3: _moves({_ONE: _NEXT, _SOME: _NEXT, _VALUE: _MORE}),  # a comma
    4: _moves({_KEY: _COLON}),  # a colon
    5: _moves({_EMPTY: _SOME, _NEXT: _SOME, _BARE: _KEY, _MORE: _KEY, _COLON: _VALUE}),  # a text
    6: _moves({_EMPTY: _ONE, _NEXT: _SOME, _COLON: _VALUE}),  # a number or a word
}
_CLOSES = {"]": _EMPTY | _ONE | _SOME, "}": _BARE | _VALUE}
_TOKEN = re.compile(
    r"""[ \t\r\n]*+(?:([\[{])|([\]}])|(,)|(:)|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*+)*+")"""
    r"""|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(\Z))"""
)
_OPENING = re.compile(r"[\[{]")
_ENDED, _DEAD, _OPEN = range(3)

#: A place in a file as one number: the line above, the character below.
_COLUMN_BITS = 31


class Lines:
    """Finds the payloads in lines that come one after the other, in time linear in their length.

    A payload is JSON from the first bracket on that begins one, none inside another.  A wrong token ends all
    brackets that are open at it, so that there is one stack of open brackets; brackets inside a text may yet begin
    payloads if the text's own brackets come to nothing, and since a text ends with its line, these are looked
    at line by line.  With ``inherited`` brackets of unknown kind may be open at the beginning: ``closes``
    are the places behind the brackets that close such ones.
    """

    def __init__(self, inherited: bool = False):
        self.numbers: list[int] = []
        self.texts: list[str] = []
        self.stack: list[list[int]] = []  # place, states
        self.base = _ANY if inherited else 0  # states of the last unknown bracket
        self.closes: list[int] = []
        self.spans: list[tuple[int, int]] = []

    def cut(self) -> None:
        """What stands between the lines before and after is no JSON."""
        self.stack, self.base = [], 0

    def add(self, number: int, text: str, begin: int = 0, end: int | None = None) -> None:
        """The next line, or its characters from ``begin`` to ``end``."""
        self.numbers.append(number)
        self.texts.append(text)
        line, text = number << _COLUMN_BITS, text if end is None else text[:end]
        seen: set[int] = set()
        at, ends = begin, None
        if self.stack or self.base:
            how, to = self._run(line, text, begin, self.stack, True, seen)
            if how == _DEAD:
                self.cut()
            elif how == _ENDED:
                at = to
        while found := _OPENING.search(text, at):
            at = found.start()
            if at in seen:
                at += 1
                continue
            if ends is None:
                ends = {"[": text.rfind("]"), "{": text.rfind("}")}
            value = None
            if at < ends[text[at]]:  # a refusal counts the lines before it, which adds up
                try:
                    value, to = _DECODE(text, at)
                except (ValueError, RecursionError):
                    pass
            if value is None:
                stack: list[list[int]] = []
                how, to = self._run(line, text, at, stack, False, seen)
                if how == _OPEN and not self.stack and not self.base:
                    self.stack = stack
                at = to if how == _ENDED else at + 1
            else:
                if (value if isinstance(value, dict) else len(value) > 1 or (value and isinstance(value[0], (dict, list, str)))):
                    self.spans.append((line + at, line + to))
                at = to

    def _run(self, line: int, text: str, at: int, stack: list[list[int]], based: bool, seen: set[int]) -> tuple[int, int]:
        """Reads tokens until no bracket is open, one is wrong or the line ends: how it went, and where to."""
        match = _TOKEN.match
        while True:
            found = match(text, at)
            if found is None:
                return _DEAD, at
            kind, at = found.lastindex, found.end()
            if kind == 7:
                return _OPEN, at
            inside = bool(stack)
            states = stack[-1][1] if inside else self.base if based else 0
            if kind == 1:
                if inside or states:
                    states = _NEST[states]
                    if not states:
                        return _DEAD, at - 1
                    if inside:
                        stack[-1][1] = states
                    else:
                        self.base = states
                seen.add(at - 1)
                stack.append([line + at - 1, _EMPTY if text[at - 1] == "[" else _BARE])
            elif kind == 2:
                if not states & _CLOSES[text[at - 1]]:
                    return _DEAD, at - 1
                if inside:
                    place, _ = stack.pop()
                    if states & _TOLD:
                        self.spans.append((place, line + at))
                    if not stack and not (based and self.base):
                        return _ENDED, at
                else:
                    self.closes.append(line + at)
                    self.base = _TOLD  # whatever it stood in has a value now
            else:
                states = _AFTER[kind][states]
                if not states:
                    return _DEAD, at
                if inside:
                    stack[-1][1] = states
                else:
                    self.base = states

    def islands(self) -> list[tuple[int, int]]:
        """Stretches covered by payloads that overlap, in order."""
        out: list[list[int]] = []
        for begin, end in sorted(self.spans):
            if out and begin < out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([begin, end])
        return [(a, b) for a, b in out]

    def found(self) -> list[tuple[int, int, str]]:
        """The payloads: begin, end, text."""
        out, upto = [], -1
        for begin, end in sorted(self.spans, key=lambda s: (s[0], -s[1])):
            if begin >= upto:
                out.append((begin, end, self._text(begin, end)))
                upto = end
        return out

    def _text(self, begin: int, end: int) -> str:
        low = (1 << _COLUMN_BITS) - 1
        first, last = (bisect_left(self.numbers, place >> _COLUMN_BITS) for place in (begin, end))
        if first == last:
            return self.texts[first][begin & low : end & low]
        return "\n".join([self.texts[first][begin & low :], *self.texts[first + 1 : last], self.texts[last][: end & low]])


def find_json(text: str, max_blocks: int | None = None) -> list[str]:
    """The JSON objects and arrays in a text, from left to right, none inside another."""
    lines = Lines()
    for number, line in enumerate(text.split("\n")):
        lines.add(number, line)
    return [found for _, _, found in lines.found()[:max_blocks]]


def json_blocks(records: DataFrame, keys: list[str] | None = None, max_blocks: int | None = None) -> DataFrame:
    """One row per JSON block of a record: its keys, the number of the block, the text.

    Spark drops records without a bracket before anything goes to Python.  All blocks of the column
    ``text`` are found; ``max_blocks=3`` gives those a record's detail view shows.
    """
    keys = ["file_path", "first_line"] if keys is None else keys
    candidates = records.where(F.col("text").rlike(r"[{\[]")).select(*keys, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.select(*keys).schema)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*key, number, block)
                for key, text in zip(batch[keys].itertuples(index=False, name=None), batch["text"])
                for number, block in enumerate(find_json(text, max_blocks))
            ]
            yield pd.DataFrame(rows, columns=[*keys, "block_no", "json"], dtype=object)

    return candidates.mapInPandas(scan, f"{types}, block_no int, json string")


#: Lines that may stand inside a payload although they have no bracket.
_INSIDE = r'^(?:[\s,:0-9.eE+\-]|true|false|null|"(?:[^"\\]|\\.)*+")*+$'
_READ = (
    "file_path string, block bigint, logical_id bigint, begin_line bigint, place bigint, upto bigint, json string, "
    "first_id bigint, last_id bigint, first_line bigint, closes array<bigint>, cut boolean, opens array<bigint>"
)
_READ_COLUMNS = [c.split()[0] for c in _READ.split(", ")]


def _moved(places: list[int], islands: list[tuple[int, int]], side: int) -> list[int]:
    """Places, or the begin or end of the island around them."""
    begins = [a for a, _ in islands]
    out = []
    for place in places:
        i = bisect_left(begins, place) - 1
        inside = i >= 0 and islands[i][0] < place < islands[i][1]
        out.append(islands[i][side] if inside else place)
    return out


def _read_block(file_path: str, block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The payloads of a block, and one row for what it closes, cuts and leaves open."""
    first = last = None
    closes, cut, cuts = [], False, 0
    for (logical_id, begin), lines in groupby(rows, key=itemgetter(3, 4)):
        scanner = Lines(inherited=first is None)
        # Lines between that were not sent: they end what is open.
        for _, _, line_no, _, _, cuts_now, text in lines:
            if first is None:
                first = (logical_id, line_no)
            if cuts_now != cuts or text is None:
                scanner.cut()
                cuts = cuts_now
            if text is not None:
                scanner.add(line_no, text)
            if last is None and not scanner.base:
                cut = True
        islands = scanner.islands()
        if last is None:
            closes = _moved(scanner.closes, islands, 1)
        else:
            cut = True
        last = logical_id
        yield from ((file_path, block, logical_id, begin, a, b, text, *[None] * 6) for a, b, text in scanner.found())
        opens = _moved([place for place, _ in scanner.stack], islands, 0)
    yield (file_path, block, *[None] * 5, first[0], last, first[1], closes, cut, opens)


def _read_blocks(lines: DataFrame) -> DataFrame:
    """All blocks, each by itself.  Lines that cannot be part of a payload leave Spark as a count only."""
    order = Window.partitionBy(*KEYS).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.col("text")
    # A missing text ends what is open, like any line that is no JSON.
    telling = F.coalesce(text.rlike(r"[{\[\]}]") | text.rlike(_INSIDE), F.lit(False))
    narrow = lines.select(*KEYS, "line_no", "logical_id", F.when(telling, text).alias("text"))
    changes = ~F.col("logical_id").eqNullSafe(F.lag("logical_id").over(order))
    sent = (
        narrow.withColumns({
            "cuts": F.count(F.when(F.col("text").isNull(), 1)).over(upto),
            "_begins": F.when(changes, F.col("line_no")),
            "_last": F.lead("line_no").over(order).isNull(),
        })
        .withColumn("begin", F.last("_begins", ignorenulls=True).over(upto))
        .where(F.col("text").isNotNull() | F.col("_last"))
        .sortWithinPartitions(*KEYS, "line_no")
        .select(*KEYS, "line_no", "logical_id", "begin", "cuts", "text")
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for (file_path, block), own in groupby(rows, key=itemgetter(0, 1)):
            out += _read_block(file_path, block, own)
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=_READ_COLUMNS, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=_READ_COLUMNS, dtype=object)

    return sent.mapInPandas(scan, _READ)


def _stretches(blocks: DataFrame) -> DataFrame:
    """Stretches of lines between brackets that meet across blocks: ``(file_path, block, place, upto)`` for each block of each.

    The windows run over one row per block, or over the brackets that are open where a block ends.
    """
    along = Window.partitionBy("file_path").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.lag("last_id").over(along) == F.col("first_id"), F.lit(False))
    n, m = F.size("opens"), F.size("closes")
    summed = (
        blocks.withColumn("_on", goes_on)
        .withColumns({"cut": F.col("cut") | ~F.col("_on"), "closes": F.when(F.col("_on"), F.col("closes")).otherwise(F.array().cast("array<bigint>"))})
        .withColumns({"_gain": n - m, "_cuts": F.col("cut").cast("int")})
        .withColumns({"_sum": F.coalesce(F.sum("_gain").over(before), F.lit(0)), "_seg": F.coalesce(F.sum("_cuts").over(before), F.lit(0))})
        .withColumn("_out", F.col("_seg") + F.col("_cuts"))
        # The depth behind a block is the greater of what it opens and the depth before it plus its gain.
        .withColumn("_least", n - F.col("_sum") - F.col("_gain"))
    )
    # Blocks without a cut go on from the block that had the last one; brackets before the first of a file are none.
    segment = Window.partitionBy("file_path", "_out").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    came = F.when(F.col("cut"), None).otherwise(F.max("_least").over(segment))
    depths = summed.withColumn("_own", came).withColumn("_before", F.lag(F.greatest("_least", F.coalesce("_own", F.col("_least")))).over(along))
    depths = depths.withColumn("_depth", F.coalesce(F.col("_sum") + F.col("_before"), F.lit(0)))
    rest = F.when(F.col("cut"), 0).otherwise(F.greatest(F.col("_depth") - m, F.lit(0)))
    closing = depths.select("file_path", "block", F.col("_seg").alias("seg"), "_depth", F.posexplode("closes").alias("_i", "at")).select(
        "file_path", "block", "seg", (F.col("_depth") - F.col("_i")).alias("level"), "at", F.lit(False).alias("opens")).where("level > 0")
    opening = depths.select("file_path", "block", F.col("_out").alias("seg"), rest.alias("_rest"), F.posexplode("opens").alias("_i", "at")).select(
        "file_path", "block", "seg", (F.col("_rest") + F.col("_i") + 1).alias("level"), "at", F.lit(True).alias("opens"))
    level = Window.partitionBy("file_path", "seg", "level").orderBy("block", "opens", "at")
    pairs = (
        opening.unionByName(closing)
        .withColumns({"_next": F.lead("opens").over(level), "upto": F.lead("at").over(level)})
        .where(F.col("opens") & ~F.col("_next"))
    )
    # Stretches that overlap are one.
    by_place = Window.partitionBy("file_path").orderBy("at", F.desc("upto"))
    so_far = by_place.rowsBetween(Window.unboundedPreceding, -1)
    joined = pairs.withColumn("_new", F.coalesce(F.col("at") >= F.max("upto").over(so_far), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(by_place))
    whole = joined.groupBy("file_path", "_island").agg(F.min("at").alias("place"), F.max("upto").alias("upto"), F.min("block").alias("block"))
    whole = staged(whole.select("file_path", "block", "place", "upto"), "payload-stretches")
    # The last stretch that began in an earlier block may reach into a block.
    began = whole.groupBy("file_path", "block").agg(F.max(F.struct("place", "upto")).alias("_began"))
    reached = blocks.select("file_path", "block", "first_line").join(began, KEYS, "left").withColumn("_in", F.last("_began", ignorenulls=True).over(before))
    inner = reached.where(F.col("_in.upto") >= F.shiftleft("first_line", _COLUMN_BITS)).select("file_path", "block", "_in.place", "_in.upto")
    return whole.unionByName(inner)


def _read_stretches(lines: DataFrame, stretches: DataFrame) -> DataFrame:
    """The payloads of whole stretches.  A group is one stretch: no longer than a payload that only fails where blocks meet."""
    line = lambda place: F.shiftright(place, _COLUMN_BITS)
    inside = lines.select(*KEYS, "line_no", "logical_id", "text").join(stretches, KEYS).where(F.col("line_no").between(line("place"), line("upto")))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("line_no")
        place, upto = int(group["place"].iloc[0]), int(group["upto"].iloc[0])
        low, scanner = (1 << _COLUMN_BITS) - 1, Lines()
        for number, text in zip(group["line_no"].tolist(), group["text"].tolist(), strict=True):
            begin = place & low if number == place >> _COLUMN_BITS else 0
            scanner.add(number, text, begin, upto & low if number == upto >> _COLUMN_BITS else None)
        one = group.iloc[0]
        where = dict(zip(group["line_no"].tolist(), group["block"].tolist(), strict=True))
        rows = [(one["file_path"], where[a >> _COLUMN_BITS], one["logical_id"], a, text) for a, _, text in scanner.found()]
        return pd.DataFrame(rows, columns=["file_path", "block", "logical_id", "place", "json"], dtype=object)

    return inside.groupBy("file_path", "place").applyInPandas(scan, "file_path string, block bigint, logical_id bigint, place bigint, json string")


def line_json_blocks(lines: DataFrame, max_blocks: int | None = None) -> DataFrame:
    """``json_blocks`` of whole records, read from their lines: ``file_path, first_line, block_no, json``.

    No record is put together and none is one task's work; only what stands between brackets that meet across blocks is.
    """
    plain = lines.where("is_plain").select("file_path", F.col("line_no").alias("first_line"), "text")
    others = lines.where(~F.col("is_plain"))
    read = staged(_read_blocks(others), "payloads")
    found = read.where(F.col("json").isNotNull()).select(*KEYS, "logical_id", "place", "json")
    stretches = staged(_stretches(read.where(F.col("json").isNull()).drop("json", "place", "upto", "logical_id", "begin_line")), "payload-blocks")
    if not stretches.isEmpty():
        span = stretches.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, "place", "upto")])
        within = (F.col("file_path") == F.col("_file_path")) & (F.col("block") == F.col("_block")) & (F.col("place") >= F.col("_place")) & (F.col("place") < F.col("_upto"))
        found = found.join(span, within, "left_anti").unionByName(_read_stretches(others, stretches))

    # Numbers within a record, and the record's first line: what stands in the block, and what the blocks before carry.
    parts = others.groupBy(*KEYS, "logical_id").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.lit(0).alias("n_chars"))
    carry = record_carry(parts).select(*KEYS, F.col("first_id").alias("logical_id"), "start_line")
    starts = parts.join(carry, [*KEYS, "logical_id"], "left").select(*KEYS, "logical_id", F.coalesce("start_line", "first_line").alias("first_line"))
    found = staged(found.join(starts, [*KEYS, "logical_id"]), "payloads-found")
    counts = found.groupBy(*KEYS, "logical_id").agg(F.min("first_line").alias("first_line"), F.count("*").alias("n_lines"), F.lit(0).alias("n_chars"))
    already = record_carry(counts).select(*KEYS, F.col("first_id").alias("logical_id"), "lines_before")
    here = Window.partitionBy(*KEYS, "logical_id").orderBy("place")
    numbered = found.withColumn("_row", F.row_number().over(here)).join(already, [*KEYS, "logical_id"], "left")
    number = (F.col("_row") - 1 + F.coalesce("lines_before", F.lit(0))).cast("int")
    rows = numbered.select("file_path", "first_line", number.alias("block_no"), "json")
    if max_blocks is not None:
        rows = rows.where(F.col("block_no") < max_blocks)
    return rows.unionByName(json_blocks(plain, max_blocks=max_blocks))


def json_values(blocks: DataFrame) -> DataFrame:
    """One row per top-level key of each object block, with its value as text."""
    entries = F.from_json("json", "map<string,string>")
    return blocks.where(F.col("json").startswith("{")).select(
        *[c for c in blocks.columns if c != "json"], F.explode(entries).alias("key", "value")
    )


def json_keys(blocks: DataFrame) -> DataFrame:
    """How many objects have each key, and how many different values it takes."""
    return json_values(blocks).groupBy("key").agg(
        F.count(F.lit(1)).alias("objects"), F.count_distinct("value").alias("distinct_values")
    )
