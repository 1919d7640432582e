"""Field extraction with a block schema: fields, match reports, coverage, projections."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.functions.detect import classify, ms_to_ntz, with_timestamp
from lumberline.functions.markers import Markers
from lumberline.operators.records import assign_records
from lumberline.plans.blocks import FREE_TEXT, UNTRIMMED, Block, Schema, SchemaError, checked, schema_from_json
from lumberline.plans.importers import PRESETS, line_shape, schema_from_grok, schema_from_log4j, suggest_schema
from lumberline.plans.regexes import Variant, variants

#: Candidates of one pass over a table; more of them take more passes, so that the plan does not grow with their number.
RANKED_TOGETHER = 20

#: Cells before those of the fields: the number of the variant, what it left over, what it skipped.
REPORT = 3


def _cells(schema: Schema, variant: Variant, number: int) -> list[str]:
    """Replacement text of one variant: its report, then one cell per field block."""
    blocks = schema.blocks
    tail_at = max((i for i in schema.field_blocks if blocks[i].kind in FREE_TEXT), default=-1)
    value = {i: f"${{lv{i}}}" for i in variant.matched}
    unparsed = hole = ""
    if variant.resume is not None:
        hole = "${lvskip}"
        weak = [i for i in range(variant.prefix, variant.resume) if i in schema.field_blocks]
        target = next((i for i in weak if blocks[i].kind in FREE_TEXT), None)
        if target is not None:
            value[target] = hole
    elif variant.prefix < len(blocks):
        unparsed = "${lvtail}"
        if tail_at >= variant.prefix:
            value[tail_at] = unparsed
    return [str(number), unparsed, hole] + [value.get(i, "") for i in schema.field_blocks]


def _attempt(text: Column, schema: Schema, variant: Variant, number: int, marks: Markers) -> Column:
    """The cells of a line that the variant matches, else null.  The expression runs once per line."""
    replacement = marks.first + marks.second.join(_cells(schema, variant, number)) + marks.first
    cells = F.get(F.split(F.regexp_replace(text, variant.pattern, replacement), marks.first, -1), F.lit(1))
    # Cheap tests first: a line without a literal of the variant cannot match it.
    possible = [F.contains(text, F.lit(part)) for part in variant.literals]
    if variant.probe:
        possible.append(text.rlike(variant.probe))
    for test in reversed(possible):
        cells = F.when(test, cells)
    return cells


# Fixed value: all blanks of Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trimmed(cell: Column) -> Column:
    """Most texts begin and end with a visible character of ASCII; only the others are looked at blank by blank."""
    visible = lambda end: F.ascii(end).between(33, 126)
    return F.when(visible(cell) & visible(F.substring(cell, -1, 1)), cell).otherwise(F.btrim(cell, F.lit(BLANKS)))


def _present(cell: Column) -> Column:
    return F.when(cell != "", cell)


def _with_cells(lines: DataFrame, schema: Schema, text: str) -> DataFrame:
    """The cells of the strongest variant in ``_cells``: its number, what it left over and what it skipped, both
    trimmed, then the fields.  Markers that a line itself holds are out of the way while it is matched.

    Each step is a column of its own, so that it runs once per line.
    """
    forms = variants(checked(schema))
    marks = Markers(*(v.pattern for v in forms))
    attempts = [_attempt(F.col("_clear"), schema, v, i, marks) for i, v in enumerate(forms)]
    matched = lines.withColumn("_pair", marks.pair(F.col(text))).withColumn("_clear", marks.cleared(F.col(text), F.col("_pair")))
    # One row again, from a step that filters on fields are not moved below: they would match each line several times.  A
    # function of arrays is not compiled into one method with the steps around it, which together are too long for Java to compile.
    split = F.transform(F.array(F.coalesce(*attempts)), lambda joined: F.split(joined, marks.second, -1))
    matched = matched.withColumn("_split", F.explode(split))
    blanks = [False] + [True] * (REPORT - 1) + [schema.blocks[i].kind not in UNTRIMMED for i in schema.field_blocks]
    cells = {f"_cell{at}": F.get(F.col("_split"), F.lit(at)) for at in range(len(blanks))}
    matched = matched.withColumns({name: marks.restored(cell, F.col("_pair")) for name, cell in cells.items()})
    return matched.withColumns({name: _trimmed(F.col(name)) for name, trim in zip(cells, blanks, strict=True) if trim}).drop("_pair", "_clear", "_split")


def _cell_names(schema: Schema) -> list[str]:
    return [f"_cell{at}" for at in range(REPORT + len(schema.field_blocks))]


def _status() -> Column:
    left_over = (F.col("_cell1") != "") | (F.col("_cell2") != "")
    return F.when(F.col("_cell0").isNull(), "none").when(left_over, "partial").otherwise("full")


def _report(schema: Schema) -> Column:
    forms = variants(schema)
    number = F.col("_cell0").cast("int")
    of_form = lambda values: F.get(F.array(*[F.lit(v).cast("int") for v in values]), number)
    return F.struct(
        _status().alias("status"),
        F.coalesce(of_form([len(v.matched) for v in forms]), F.lit(0)).alias("matched_blocks"),
        _present(F.col("_cell1")).alias("unparsed"),
        of_form([None if v.resume is None else v.prefix for v in forms]).alias("skipped_from"),
        of_form([v.resume for v in forms]).alias("skipped_to"),
        _present(F.col("_cell2")).alias("hole"),
    )


def _fields(schema: Schema) -> Column:
    values = [_present(F.col(f"_cell{REPORT + at}")).alias(name) for at, name in enumerate(schema.field_names)]
    return F.struct(*values) if values else F.lit(None).cast("struct<_none:string>")


def extract_fields(lines: DataFrame, schema: Schema, text: str = "text", out: str = "fields") -> DataFrame:
    """Add a struct with one string per field; null if the line yields no field at all."""
    found = _with_cells(lines, schema, text).withColumn(out, _fields(schema))
    names = schema.field_names
    some = F.coalesce(*[F.col(out)[n] for n in names]).isNotNull() if names else F.lit(False)
    return found.withColumn(out, F.when(some, F.col(out))).drop(*_cell_names(schema))


def structured_log(lines: DataFrame, schema: Schema) -> DataFrame:
    """Lines of a log whose records a schema recognises, in records and with their fields.

    A line the schema matches opens a record even if it lacks a time or a level.  Where both are
    there they decide first, so that the schema is not tried only to find the records.  For lines
    straight from files use ``read_log`` with a schema.
    """
    found = extract_fields(lines, schema)
    return assign_records(classify(found, F.col("fields").isNotNull()), fields="fields")


def match_report(lines: DataFrame, schema: Schema, text: str = "text", out: str = "match") -> DataFrame:
    """Add how the schema matched the line: status, number of blocks, what was left over or skipped.

    ``full`` means nothing of the line was left over, ``partial`` that something was, ``none``
    that the schema did not match.
    """
    return _with_cells(lines, schema, text).withColumn(out, _report(schema)).drop(*_cell_names(schema))


def schema_coverage(lines: DataFrame, schema: Schema, by: list[str] | None = None) -> DataFrame:
    """How many lines the schema matches fully, partially, not at all, and how many are blank."""
    blank = _trimmed(F.col("text")) == ""
    status = F.when(blank, F.lit("blank")).otherwise(F.col("match.status"))
    reported = match_report(lines, schema).withColumn("status", status)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("full", "partial", "none", "blank")]
    return reported.groupBy(*(by or [])).agg(*counts)


def extract_grok(lines: DataFrame, expression: str) -> DataFrame:
    return extract_fields(lines, schema_from_grok(expression))


def extract_log4j(lines: DataFrame, pattern: str) -> DataFrame:
    return extract_fields(lines, schema_from_log4j(pattern))


def extract_preset(lines: DataFrame, name: str) -> DataFrame:
    return extract_fields(lines, PRESETS[name])


def suggested_schemas(lines: DataFrame) -> DataFrame:
    """Every schema that a line of a table suggests, as ``schema`` (its blocks in JSON), with the number of its lines ``n``.

    The lines of a batch are counted by their schema before anything is shuffled; lines that differ in digits only suggest
    the same one, so that one of them is looked at.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[Schema] = Counter()
            for shape, n in Counter(map(line_shape, batch["text"])).items():
                found[suggest_schema(shape)] += n
            rows = [(json.dumps([astuple(b) for b in schema.blocks]), n) for schema, n in found.items()]
            yield pd.DataFrame(rows, columns=["schema", "n"])

    texts = lines.where(_trimmed(F.col("text")) != "").select("text")
    return texts.mapInPandas(count, "schema string, n bigint").groupBy("schema").agg(F.sum("n").alias("n"))


def infer_schema(lines: DataFrame) -> tuple[Schema, DataFrame]:
    """The schema that covers most lines of a table, among those its lines suggest.

    Returns the schema and the ranking of all candidates (``name, full, partial, none, blank``), named by
    their place when they are ordered by the number of lines that suggest them.  ``RANKED_TOGETHER``
    candidates are counted in one pass over the table.
    """
    suggested = suggested_schemas(lines).orderBy(F.desc("n"), "schema").collect()
    candidates = [Schema(tuple(Block(*b) for b in json.loads(r["schema"]))) for r in suggested]
    if not candidates:
        raise SchemaError("no line to infer a schema from")
    rows = []
    for start in range(0, len(candidates), RANKED_TOGETHER):
        some = candidates[start : start + RANKED_TOGETHER]
        rows += rank_schemas(lines, {str(i): c for i, c in enumerate(some, start)}).collect()
    best = max(rows, key=lambda r: (r["full"], r["partial"], -int(r["name"])))
    ranking = lines.sparkSession.createDataFrame(rows, "name string, full bigint, partial bigint, none bigint, blank bigint")
    return candidates[int(best["name"])], ranking


def rank_schemas(lines: DataFrame, schemas: dict[str, Schema], by: list[str] | None = None) -> DataFrame:
    """Coverage of several schemas, counted in one pass: ``name, full, partial, none, blank``."""
    out = lines
    for at, schema in enumerate(schemas.values()):
        out = match_report(out, schema, out=f"_m{at}")
    blank = _trimmed(F.col("text")) == ""
    counts = [F.count_if(blank).alias("blank")]
    for at in range(len(schemas)):
        counts += [
            F.count_if(~blank & (F.col(f"_m{at}.status") == s)).alias(f"{s}{at}") for s in ("full", "partial", "none")
        ]
    wide = out.groupBy(*(by or [])).agg(*counts)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("name"), *[F.col(f"{s}{at}").alias(s) for s in ("full", "partial", "none")])
            for at, name in enumerate(schemas)
        ]
    )
    return wide.select(*(by or []), F.inline(rows), "blank")


def load_schemas(spark: SparkSession, folder: str) -> dict[str, Schema]:
    """The readable schemas of a folder by file name; files that are none are left out."""
    files = (
        spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
        .select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), "value")
        .orderBy("name")
    )
    schemas = {}
    for row in files.toLocalIterator():
        try:
            schemas[row["name"]] = schema_from_json(row["value"])
        except SchemaError:
            continue
    return schemas


def best_schema(lines: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """For each file the schema that matches most of its lines, with its counts."""
    ranked = rank_schemas(lines, schemas, by=["file_path"]).withColumn("matched", F.col("full") + F.col("partial"))
    best = F.max_by(
        F.struct("name", "full", "partial", "none", "blank"), F.struct("matched", "full", F.col("name"))
    )
    return ranked.where("matched > 0").groupBy("file_path").agg(best.alias("b")).select("file_path", "b.*")


def project_view(lines: DataFrame, chosen: list[str], fields: str = "fields", out: str = "shown") -> DataFrame:
    """What a view shows of a line: the chosen fields in schema order, or the raw line if it has none."""
    known = [f.name for f in lines.schema[fields].dataType.fields]
    kept = [F.col(fields)[n] for n in known if n in set(chosen)]
    joined = F.concat_ws(" ", *kept) if kept else F.lit("")
    return lines.withColumn(out, F.when(F.col(fields).isNull(), F.col("text")).otherwise(joined))


def typed_fields(lines: DataFrame, schema: Schema, fields: str = "fields") -> DataFrame:
    """One typed column per field; a text that is no value of its kind becomes null."""
    columns = []
    for at in schema.field_blocks:
        block = schema.blocks[at]
        value = F.col(fields)[block.name]
        if block.kind == "integer":
            value = value.try_cast("bigint")
        elif block.kind == "hex":
            digits = F.regexp_extract(value, "^(?:0[xX])?0*([0-9A-Fa-f]{1,16})$", 1)  # more do not fit 64 bits
            value = F.when(digits != "", F.conv(digits, 16, 10)).try_cast("decimal(20,0)")
        elif block.kind == "timestamp":
            lines = with_timestamp(lines.withColumn("_value", value), "_value", f"_ms{at}")
            value = ms_to_ntz(F.col(f"_ms{at}"))
        columns.append(value.alias(block.name))
    kept = [c for c in lines.columns if c != "_value" and not c.startswith("_ms")]
    return lines.select(*kept, *columns)
