"""Whitespace-delimited histories and end-of-life files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import fields, parse_u32, to_double, to_u32
from ..schema import CYCLES, FILES, NUM_FIELDS, subset_code


class SourceError(Exception):
    """A file cannot be read."""


class ParseError(SourceError):
    """The first bad line of a file: path, 1-based line number, text and reason."""

    def __init__(self, path: str, line_number: int, raw_line: str, reason: str):
        super().__init__(f"parse error in {path} at line {line_number}: {reason} (raw line: {raw_line!r})")
        self.path, self.line_number, self.raw_line, self.reason = path, line_number, raw_line, reason


def paths(data_dir: str, subset: str) -> dict[str, str]:
    """Paths of a subset's three files."""
    code = subset_code(subset)
    return {kind: f"{data_dir.rstrip('/')}/{name}_{code}.txt" for kind, name in (("train", "train"), ("test", "test"), ("rul", "RUL"))}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with 1-based numbers; blank lines are counted, then left out.

    Files are read in splits.  A line's number is its place in its split, as rows of a
    split keep their order, and the lines of the file's earlier splits, which are
    counted first: one row a split.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), "value")
    earlier = Window.partitionBy("path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("path", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("n"))
    splits = splits.select("path", "__start", "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    lines = raw.join(splits, ["path", "__start"]).select("path", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.where(F.size(fields(F.col("line"))) > 0)


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the 26 readings and ``reason``: null for a good line."""

    def judged(f: Column) -> Column:
        values = F.when(F.size(f) == NUM_FIELDS, F.transform(f, to_double))
        return F.transform(F.array(F.struct(f.alias("f"), values.alias("v"))), lambda p: F.struct(p["f"].alias("f"), p["v"].alias("v"), F.array_position(F.transform(p["v"], lambda x: x.isNull()), True).alias("bad")))[0]

    # the lambdas and explode() hold a line's fields and values, so that each is made once however often it is named
    split = lines.select("*", F.explode(F.transform(F.array(fields(F.coalesce(line, F.lit("")))), judged)).alias("__p")).select(*lines.columns, "__p.f", "__p.v", "__p.bad")
    split = split.toDF(*lines.columns, "__f", "__v", "__bad")
    what = F.when(F.col("__bad") == 1, "unit").when(F.col("__bad") == 2, "cycle").when(F.col("__bad") <= 2 + len(FILES.settings), "op_setting").otherwise("sensor")
    reason = F.when(F.col("__v").isNull(), F.concat(F.lit(f"expected {NUM_FIELDS} fields, found "), F.greatest(F.size("__f"), F.lit(0)).cast("string")))
    reason = reason.when(F.col("__bad") > 0, F.concat(F.lit("could not parse "), what, F.lit(" ("), F.get("__f", F.col("__bad").cast("int") - 1), F.lit(") as a number")))
    values = [F.when(F.col("__bad") == 0, F.get("__v", F.lit(i))) for i in range(NUM_FIELDS)]
    named = [to_u32(values[0]).alias("unit"), to_u32(values[1]).alias("cycle"), *(v.alias(c) for v, c in zip(values[2:], FILES.settings + FILES.sensors))]
    return split.select(*lines.columns, reason.alias("reason"), *named)


def bad_rows(lines: DataFrame) -> DataFrame:
    """(path, line_no, line, reason) of the lines that do not parse."""
    return parsed(lines).where("reason is not null").select("path", "line_no", "line", "reason")


def raise_first(bad: DataFrame) -> None:
    """Raise :class:`ParseError` for the first bad line, if there is one."""
    first = bad.orderBy("path", "line_no").limit(1).collect()
    if first:
        raise ParseError(first[0]["path"], first[0]["line_no"], first[0]["line"], first[0]["reason"])


def read_cycles(spark: SparkSession, data_dir: str, subset: str, split: str, strict: bool = True) -> DataFrame:
    """The ``cycles`` table of one file.  ``strict``: the first bad line is an error; else bad lines are left out."""
    code, path = subset_code(subset), paths(data_dir, subset)[split]
    try:
        lines = read_lines(spark, path)
    except Exception as e:  # Spark has no narrower class for a missing path here
        raise SourceError(f"I/O error reading {path}: {e}") from e
    if strict:
        raise_first(bad_rows(lines))
    rows = parsed(lines).where("reason is null").withColumn("subset", F.lit(code)).withColumn("split", F.lit(split))
    return rows.select(*CYCLES.names)


def read_truth(spark: SparkSession, data_dir: str, subset: str, strict: bool = True) -> DataFrame:
    """(subset, ord, final_rul): the i-th non-blank line belongs to the i-th test unit."""
    code, path = subset_code(subset), paths(data_dir, subset)["rul"]
    try:
        lines = read_lines(spark, path)
    except Exception as e:
        raise SourceError(f"I/O error reading {path}: {e}") from e
    return truth_of(lines, code, strict)


def truth_of(lines: DataFrame, code: str, strict: bool = True) -> DataFrame:
    values = lines.withColumn("final_rul", parse_u32(F.array_join(fields(F.col("line")), " ")))
    if strict:
        raise_first(values.where("final_rul is null").withColumn("reason", F.lit("not a whole number")).select("path", "line_no", "line", "reason"))
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return values.withColumn("ord", ordinal).where("final_rul is not null").select(F.lit(code).alias("subset"), "ord", "final_rul")
