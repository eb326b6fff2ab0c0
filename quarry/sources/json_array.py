"""Large JSON arrays read by many tasks.

A file is read in records that end at a closing brace, which Spark's text source can split anywhere. What such a record does
to the depth of nesting depends on nothing but whether it begins within a string, so every block of a file first says for
both cases how it ends; these answers are chained block by block, one small row each, and then every block knows its state
and the number of its first element. Elements that lie in one block are cut out there; pieces of those that don't are put
together by their number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A whole string, the quote of one that doesn't end here, or a sign of structure.
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|["\[\]{},]', re.S)
REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
OUTCOME = "struct<string:boolean,depth:int,commas:map<int,int>>"


def tokens(record: str, within: bool) -> Iterator[tuple[str, int]]:
    """Signs of structure outside strings with their places; at last '"' if the record ends within a string."""
    at = 0
    if within:
        m = REST.match(record)
        if not m:
            yield '"', len(record)
            return
        at = m.end()
    for m in TOKEN.finditer(record, at):
        sign = m[0]
        if len(sign) == 1:
            yield sign, m.start()
            if sign == '"':
                return


def _outcome(state: dict, record: str) -> None:
    """Follows a record and the brace after it."""
    depth, within = state["depth"], False
    for sign, _ in tokens(record, state["string"]):
        if sign == ",":
            state["commas"][depth] = state["commas"].get(depth, 0) + 1
        elif sign == '"':
            within = True
        else:
            depth += 1 if sign in "[{" else -1
    state["string"], state["depth"] = within, depth if within else depth - 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: how it ends if it begins outside a string, and if within one."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), *((n, pa.struct([("string", pa.bool_()), ("depth", pa.int32()), ("commas", pa.map_(pa.int32(), pa.int32()))])) for n in ("outside", "inside"))])
    row: dict | None = None

    def made(row: dict) -> pa.RecordBatch:
        out = row | {n: row[n] | {"commas": list(row[n]["commas"].items())} for n in ("outside", "inside")}
        return pa.RecordBatch.from_pylist([out], schema=schema)

    for b in batches:
        for text, file, block in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
            if row is None or (row["file"], row["block"]) != (file, block):
                if row:
                    yield made(row)
                row = {"file": file, "block": block, "first": "", **{n: {"string": n == "inside", "depth": 0, "commas": {}} for n in ("outside", "inside")}}
            row["first"] = row["first"] or text.lstrip("\ufeff \t\r\n")[:1]
            _outcome(row["outside"], text)
            _outcome(row["inside"], text)
    if row:
        yield made(row)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, number, whole, text) of the elements of each block; those at its ends may be pieces."""
    names = ["file", "block", "number", "whole", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    key = state = None

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    for b in batches:
        out: list = []
        for text, file, block, string, depth, number in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block", "string", "depth", "number")), strict=True):
            if key != (file, block):
                if key and state["held"]:
                    out.append((*key, state["number"], False, "".join(state["held"])))
                key, state = (file, block), {"string": string, "depth": depth, "number": number, "held": [], "whole": depth < 1}
            begin, within = 0, False
            for sign, at in tokens(text, state["string"]):
                if sign == '"':
                    within = True
                elif sign in "[{":
                    if state["depth"] == 0:
                        begin, state["whole"] = at + 1, True
                    state["depth"] += 1
                else:
                    ends = state["depth"] == 1
                    state["depth"] -= sign != ","
                    if ends:
                        out.append((*key, state["number"], state["whole"], "".join([*state["held"], text[begin:at]])))
                        state["held"], state["whole"], state["number"], begin = [], True, state["number"] + (sign == ","), at + 1
            state["string"] = within
            if state["depth"] >= 1 or within:
                state["held"].append(text[begin:] + "}")
            state["depth"] -= not within
        yield rows(out)
    if key and state["held"]:
        yield rows([(*key, state["number"], False, "".join(state["held"]))])


def array_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements, bad files) of the files at a path: (file, number, item), the JSON text of every element of an array with its
    number from 0, and (file) of those that aren't arrays; an empty file is
    in neither, as Spark leaves it out."""
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    blocks = lines.mapInArrow(_blocks, f"file string, block long, first string, outside {OUTCOME}, inside {OUTCOME}")
    # one row a block, chained file by file
    start = "struct<block:bigint,string:boolean,depth:int,number:bigint>"
    none = F.struct(F.lit(False).alias("string"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("number"), F.array().cast(f"array<{start}>").alias("out"))

    def chain(a, b):
        end = F.when(a["string"], b["inside"]).otherwise(b["outside"])
        commas = F.coalesce(end["commas"][1 - a["depth"]], F.lit(0))
        own = F.struct(b["block"].alias("block"), a["string"].alias("string"), a["depth"].alias("depth"), a["number"].alias("number"))
        return F.struct(end["string"].alias("string"), (a["depth"] + end["depth"]).alias("depth"), (a["number"] + commas).alias("number"), F.concat(a["out"], F.array(own)).alias("out"))

    # maps have no order, so blocks are sorted by their numbers alone
    by_block = lambda x, y: F.when(x["block"] < y["block"], -1).when(x["block"] > y["block"], 1).otherwise(0)
    chained = blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "first", "outside", "inside")), by_block).alias("b"))
    files = chained.select("file", F.aggregate("b", none, chain).alias("end"), F.array_join(F.transform("b", lambda x: x["first"]), "").alias("first"))
    # the brace that ends the last record isn't there: a whole array ends one level below the ground
    ok = (F.substring("first", 1, 1) == "[") & ~F.col("end.string") & (F.col("end.depth") == -1)
    files = files.withColumn("ok", ok)
    starts = files.where("ok").select("file", F.explode("end.out").alias("s")).select("file", "s.*")
    # a row for every block of at least some megabytes; the records keep their order beside it
    placed = lines.join(F.broadcast(starts), ["file", "block"])
    pieces = placed.select("value", "file", "block", "string", "depth", "number").mapInArrow(_pieces, "file string, block long, number long, whole boolean, text string")
    cut = pieces.where("not whole").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("item"))
    items = pieces.where("whole").select("file", "number", F.col("text").alias("item")).unionByName(cut)
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    return items.where("number > 0 or trim(item) <> ''"), listed.join(files.where("ok").select("file"), "file", "left_anti")
