"""Level, time and text filters; search."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.detect import LEVELS
from lumberline.functions.rules import Rule, rules_to_column
from lumberline.operators.order import POSITION, time_range, with_row_no

Moment = int | str | datetime | None
DAY_MS = 86_400_000


def to_ms(moment: Moment) -> int | None:
    """Wall-clock milliseconds of a datetime, an ISO text or a number that already is one."""
    if moment is None or isinstance(moment, int):
        return moment
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    return round((moment.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1000)


def level_numbers(levels: list[int | str]) -> list[int]:
    return [LEVELS.index("WARN" if n == "WARNING" else n) for n in
            (LEVELS[x] if isinstance(x, int) else x.strip().upper() for x in levels)]


def filter_levels(lines: DataFrame, levels: list[int | str]) -> DataFrame:
    """Keep the named levels; an empty list keeps all."""
    return lines.where(F.col("level").isin(level_numbers(levels))) if levels else lines


def time_condition(start: Moment, end: Moment) -> Column | None:
    """Both bounds inclusive.  A line without time fails a start bound but passes a bare end bound.

    A range that ends before it starts is no filter.
    """
    lo, hi = to_ms(start), to_ms(end)
    if lo is not None and hi is not None and lo > hi:
        return None
    conditions = []
    if lo is not None:
        conditions.append(F.col("ts_ms") >= lo)
    if hi is not None:
        late = F.col("ts_ms") <= hi
        conditions.append(late if lo is not None else late | F.col("ts_ms").isNull())
    if not conditions:
        return None
    return conditions[0] if len(conditions) == 1 else conditions[0] & conditions[1]


def filter_time(lines: DataFrame, start: Moment = None, end: Moment = None, picked: bool = False) -> DataFrame:
    """Keep a time range.

    ``picked`` is for a range drawn on the timeline: one that covers the whole document is then no
    filter, so that lines without time stay.  An empty or reversed picked range is ignored as well.
    """
    condition = time_condition(start, end)
    if condition is None or (picked and to_ms(start) == to_ms(end)):
        return lines
    if picked:
        span = time_range(lines)
        covered = (F.lit(to_ms(start)) <= span.select("from_ms").scalar()) & (
            F.lit(to_ms(end)) >= span.select("to_ms").scalar()
        )
        condition = F.coalesce(covered, F.lit(False)) | condition
    elif dict(lines.dtypes).get("log_date") == "date":
        condition = days_condition(start, end) & condition
    return lines.where(condition)


def days_condition(start: Moment, end: Moment) -> Column:
    """The days of a table by ``log_date`` that a time range can touch; lines without time have no day."""
    day, condition = F.col("log_date"), F.lit(True)
    first, last = (None if m is None else date(1970, 1, 1).toordinal() + m // DAY_MS for m in (to_ms(start), to_ms(end)))
    if first is not None and 1 <= first <= date.max.toordinal():
        condition = condition & (day >= F.lit(date.fromordinal(first)))
    if last is not None and 1 <= last <= date.max.toordinal():
        early = day <= F.lit(date.fromordinal(last))
        condition = condition & (early if start is not None else early | day.isNull())
    return condition


def field_columns(lines: DataFrame, fields: str = "fields") -> dict[str, Column]:
    """The extracted fields by name, for rules bound to a field."""
    if fields not in lines.columns:
        return {}
    return {f.name: F.col(fields)[f.name] for f in lines.schema[fields].dataType.fields}


def filter_rules(lines: DataFrame, rules: list[Rule], field_scope: bool = False) -> DataFrame:
    """Keep the lines that satisfy the rules; all lines if no rule is usable."""
    condition = rules_to_column(rules, F.col("text"), field_columns(lines) if field_scope else None)
    return lines if condition is None else lines.where(condition)


@dataclass(frozen=True)
class FilterSpec:
    """A view of a document: levels, time range, text rules."""

    levels: list[int | str] = field(default_factory=list)
    start: Moment = None
    end: Moment = None
    rules: list[Rule] = field(default_factory=list)
    field_scope: bool = False


def apply_filters(lines: DataFrame, spec: FilterSpec) -> DataFrame:
    """All filters of a view.  Level and time come first: they need no text and prune a Parquet scan."""
    kept = filter_time(filter_levels(lines, spec.levels), spec.start, spec.end)
    return filter_rules(kept, spec.rules, spec.field_scope)


def search(view: DataFrame, rules: list[Rule], field_scope: bool = False) -> DataFrame:
    """The lines of a view that satisfy the rules, with their position in the view.

    Unlike a filter, a search without a usable rule finds nothing.
    """
    condition = rules_to_column(rules, F.col("text"), field_columns(view) if field_scope else None)
    found = F.lit(False) if condition is None else condition
    # All positions are sorted, but only hits take their columns along.
    row = F.struct(*[F.col(f"`{c}`") for c in view.columns if c != "row_no"])
    numbered = with_row_no(view.select(*POSITION, F.when(found, row).alias("_hit")))
    return numbered.where("_hit is not null").select("_hit.*", "row_no")
