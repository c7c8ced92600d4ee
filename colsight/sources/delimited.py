"""Delimited files whose quoted fields hold line breaks, read in splits.

A line of such a file may begin inside a quoted field, which only the lines before it tell. Each
byte range of a file is a function from "its first line begins a record" or "begins inside quotes"
to the same for the line behind it, and there are four such functions. They are found for all
ranges at once, a window over the ranges of a file (a row each) composes them, and then every task
knows how its ranges begin and joins their lines to records. Pieces of records that cross ranges
are put together afterwards. No file is read by one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.session import materialize

RANGE_LIMIT = 1_000_000
RANGE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("plain", pa.bool_()), ("quoted", pa.bool_())])
PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
#: Kinds of pieces, in their order within a range: end of an earlier record, whole record, begin of one.
END, WHOLE, BEGIN = range(3)


def line_ends(options: Mapping[str, str]) -> Callable[[str], tuple[bool, bool]]:
    """For a line: whether it ends inside a quoted field if it begins a record, and if it begins
    inside quotes. A quote opens a field only at its start; elsewhere it is a letter like any other."""
    quote, escape = options.get("quote", '"'), options.get("escape", "\\")
    sep = options.get("sep", options.get("delimiter", ","))
    q, e, s = (re.escape(x) for x in (quote, escape, sep))
    inner = f"(?:[^{q}]++|{q}{q})*+" if quote == escape else f"(?:[^{q}{e}]++|{e}(?:.|$))*+"
    space = "[ \\t]*+" if str(options.get("ignoreLeadingWhiteSpace", "false")).lower() == "true" else ""
    field = f"(?:{space}{q}{inner}{q}[^{s}]*+|{space}[^{q}{s}][^{s}]*+)?+"
    ends_open = re.compile(f"(?:{field}{s})*+{space}{q}{inner}", re.DOTALL)
    comment = options.get("comment")

    def ends(line: str) -> tuple[bool, bool]:
        if quote not in line:
            return False, True
        plain = not (comment and line.startswith(comment)) and ends_open.fullmatch(line) is not None
        return plain, ends_open.fullmatch(quote + line) is not None

    return ends


def splittable(options: Mapping[str, str]) -> bool:
    """Whether these reader options have the plain form that ranges can be read with."""
    single = all(len(options.get(k, ",")) == 1 for k in ("sep", "delimiter", "quote", "escape"))
    plain = not {"encoding", "charset", "lineSep"} & set(options)
    return single and plain and str(options.get("mode", "PERMISSIVE")).upper() != "DROPMALFORMED"


def as_path(address: str) -> str:
    """A file's address, however its slashes and special characters are written, as a path."""
    parts = urlsplit(address)
    path = unquote(parts.path)
    return f"{parts.scheme}://{parts.netloc}{path}" if parts.scheme else path


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, text): every line with its byte range."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text")
    )


def _functions(lines: DataFrame, options: Mapping[str, str]) -> DataFrame:
    """(file, start, plain, quoted) per range: whether it ends inside quotes if it begins outside or
    inside them. Only lines that hold a quote matter; a range without any has no row."""
    ends = line_ends(options)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, (False, True)
        out: list[tuple] = []
        for batch in batches:
            for file, start, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "text"))):
                if (file, start) != at:
                    if at:
                        out.append((*at, *state))
                    at, state = (file, start), (False, True)
                line = ends(text)
                state = (line[state[0]], line[state[1]])
        if at:
            out.append((*at, *state))
        yield pa.RecordBatch.from_pylist([dict(zip(RANGE.names, r)) for r in out], RANGE)

    touched = lines.filter(F.contains("text", F.lit(options.get("quote", '"'))))
    return touched.mapInArrow(run, "file string, start bigint, plain boolean, quoted boolean")


def broken_files(spark: SparkSession, path: str, options: Mapping[str, str]) -> list[str]:
    """Files with a line break inside quotes. The first of a file is behind a line that begins a
    record and ends inside quotes, and a line that would do so if it began a record is found in
    such files only, or inside quotes."""
    ends = line_ends(options)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            found |= {f for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()) if f not in found and ends(t)[0]}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["file"])

    lines = _lines(spark, path).filter(F.contains("text", F.lit(options.get("quote", '"'))))
    return sorted(r["file"] for r in lines.mapInArrow(run, "file string").distinct().collect())  # a row per such file


def _begun_inside(functions: DataFrame) -> DataFrame:
    """(file, start, inside) for the ranges listed: the state behind each. A constant
    function settles the state, a swap turns it, so the state is that of the last constant one
    turned by the swaps since."""
    order = Window.partitionBy("file").orderBy("start")
    constant = F.col("plain") == F.col("quoted")
    swaps = F.sum(F.when(F.col("plain") & ~F.col("quoted"), 1).otherwise(0)).over(order)
    turned = functions.withColumn("swaps", swaps)
    last = F.last(F.when(constant, F.struct("plain", "swaps")), ignorenulls=True).over(order)
    settled = turned.withColumn("last", last)
    base, before = F.coalesce(F.col("last.plain"), F.lit(False)), F.coalesce(F.col("last.swaps"), F.lit(0))
    return settled.select("file", "start", (base != ((F.col("swaps") - before) % 2 == 1)).alias("inside"))


def _joined(lines: DataFrame, options: Mapping[str, str]) -> DataFrame:
    """Lines of a range as records and pieces of records; ``inside`` says how the range begins.
    ``first`` marks the first record that begins in a range."""
    ends, quote, comment = line_ends(options), options.get("quote", '"'), options.get("comment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, held, kind, first = None, False, [], WHOLE, False

        def rows(*found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(PIECES.names, r)) for r in found], PIECES)

        def unfinished() -> pa.RecordBatch:
            return rows((*at, BEGIN, first, "\n".join(held)) if kind == WHOLE else (*at, END, False, "\n".join(held)))

        def counts(text: str) -> bool:
            return text.strip() != "" and not (comment and text.startswith(comment))

        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            texts, begins = batch.column("text"), batch.column("inside").to_numpy(zero_copy_only=False)
            marked = pc.match_substring(texts, quote).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (files.slice(1).to_numpy(False) != files.slice(0, len(files) - 1).to_numpy(False))) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = (files[int(a)].as_py(), int(starts[a]))
                if here != at:
                    if held:  # a record that goes on in the next range
                        yield unfinished()
                    at, inside, held = here, bool(begins[a]), []
                    kind, first = END if inside else WHOLE, True
                out = []
                turns = np.flatnonzero(marked[a:b]) + a  # lines without a quote leave the state as it is
                place = a
                for t in [*turns, b]:
                    t = int(t)
                    if place < t and inside:
                        held += texts.slice(place, t - place).to_pylist()
                    elif place < t:
                        out += [(*at, WHOLE, False, x) for x in texts.slice(place, t - place).to_pylist()]
                    if t < b:
                        line = texts[t].as_py()
                        held.append(line)
                        inside = ends(line)[inside]
                        if not inside:
                            out.append((*at, kind, False, "\n".join(held)))
                            held, kind = [], WHOLE
                    place = t + 1
                if first:
                    seen = next((i for i, r in enumerate(out) if r[2] == WHOLE and counts(r[4])), None)
                    if seen is not None:
                        out[seen], first = (*out[seen][:3], True, out[seen][4]), False
                if out:
                    yield rows(*out)
        if held:
            yield unfinished()

    return lines.mapInArrow(run, "file string, start bigint, kind int, first boolean, text string")


def records(spark: SparkSession, path: str | list[str], options: Mapping[str, str]) -> DataFrame:
    """(file, start, first, text): the records of delimited files, whatever breaks their quoted
    fields hold; ``first`` marks the first record of a file that is not blank. Blank records and
    comments are left out."""
    lines = _lines(spark, path)
    behind = _begun_inside(_functions(lines, options))
    ranges = lines.select("file", "start").distinct()
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("inside", ignorenulls=True).over(order)
    state = materialize(ranges.join(behind, ["file", "start"], "left").select("file", "start", before.alias("inside")).filter("inside"))
    if state.count() <= RANGE_LIMIT:
        begun = lines.join(F.broadcast(state), ["file", "start"], "left")
    else:  # the order of lines in a range has to be made again behind a shuffle
        begun = lines.withColumn("line", F.monotonically_increasing_id()).join(state, ["file", "start"], "left")
        begun = begun.repartition("file", "start").sortWithinPartitions("file", "start", "line")
    pieces = materialize(_joined(begun.select("file", "start", "text", F.coalesce("inside", F.lit(False)).alias("inside")), options))
    # A file's first record begins in the first range in which any does.
    head = pieces.filter("first").groupBy("file").agg(F.min("start").alias("head"))
    marked = pieces.join(F.broadcast(head), "file", "left").withColumn("first", F.col("first") & (F.col("start") == F.col("head")))
    whole = marked.filter(F.col("kind") == WHOLE).select("file", "start", "first", "text")
    part = marked.filter(F.col("kind") != WHOLE)
    number = F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "kind"))
    crossing = part.withColumn("number", number).groupBy("file", "number")
    crossing = crossing.agg(F.min("start").alias("start"), F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("of"))
    crossing = crossing.select("file", "start", "first", F.array_join(F.col("of.text"), "\n").alias("text"))
    both = whole.unionByName(crossing).withColumn("text", F.regexp_replace("text", "\\r$", "")).filter(F.trim("text") != "")
    comment = options.get("comment")
    return both.filter(~F.startswith("text", F.lit(comment))) if comment else both


def read(found: DataFrame, options: Mapping[str, str], names: list[str]) -> DataFrame:
    """Text columns of ``records``."""
    if str(options.get("header", "false")).lower() == "true":
        found = found.filter(~F.col("first"))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    return found.select(F.from_csv("text", fields, _parser(options)).alias("r")).select("r.*").toDF(*names)


def _parser(options: Mapping[str, str]) -> dict[str, str]:
    return {k: str(v) for k, v in options.items() if k not in ("header", "multiLine")} | {"multiLine": "true"}


def first_fields(found: DataFrame, options: Mapping[str, str]) -> list[str | None]:
    """Fields of the first record of the first file."""
    first = found.filter("first").orderBy("file").select("text").first()
    if first is None:
        return []
    text = F.lit(first["text"])
    one = found.sparkSession.range(1)
    kind = one.select(F.schema_of_csv(text, _parser(options))).first()[0]
    width = len(T.StructType.fromDDL(kind.removeprefix("STRUCT<").removesuffix(">")).fields)
    return list(one.select(F.from_csv(text, ", ".join(f"c{i} string" for i in range(width)), _parser(options)).alias("r")).select("r.*").first())
