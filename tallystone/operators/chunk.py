"""Chunkers: texts of notes, turns of sessions and other JSON into (section, body) arrays, without a shuffle."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tallystone.functions.text import CHUNK, FOLD, OVERLAP, rstrip, split_long, squeeze, strip

PIECE = "array<struct<section:string,body:string>>"
HEADING = re.compile("(?m)(?=^#{1,4} .+$)")
#: Unicode's white space, as text.strip() takes it; str.strip() by itself takes four control characters more.
BLANK = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def fold(pieces: Column) -> Column:
    """Blank pieces dropped; one of under FOLD characters is joined to the piece before, if there is one."""

    def step(done: Column, x: Column) -> Column:
        bare = strip(x["body"])
        last = F.element_at(done, -1)
        joined = F.struct(last["section"].alias("section"), F.concat(rstrip(last["body"]), F.lit("\n"), bare).alias("body"))
        return (
            F.when(bare == "", done)
            .when((F.length(bare) < FOLD) & (F.size(done) > 0), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))
            .otherwise(F.concat(done, F.array(x)))
        )

    return F.aggregate(pieces, F.array().cast(PIECE), step)


def _pieces(section: Column, text: Column) -> Column:
    return F.transform(split_long(text), lambda b: F.struct(section.alias("section"), b.alias("body")))


def markdown_pieces(text: str) -> list[tuple[str, str]]:
    """(section, body) of a note's chunks: cut at headings and into windows, then folded as fold() does."""
    out: list[tuple[str, str]] = []
    for part in HEADING.split(text) if "#" in text else (text,):
        title = re.match("#{1,4} .+", part)
        section = title[0].lstrip("# ").strip(BLANK) if title else ""
        for at in range(0, max(len(part) - OVERLAP, 1), CHUNK - OVERLAP):
            body = part[at : at + CHUNK]
            bare = body.strip(BLANK)
            if bare and len(bare) < FOLD and out:
                out[-1] = (out[-1][0], f"{out[-1][1].rstrip(BLANK)}\n{bare}")
            elif bare:
                out.append((section, body))
    return out


@F.arrow_udf(ArrayType(StructType().add("section", StringType()).add("body", StringType())))
def markdown_chunks(text: pa.Array) -> pa.Array:
    """At headings of levels 1 to 4; what stands before the first has no section."""
    offsets, sections, bodies = [], [], []
    for x in text:
        x = x.as_py()
        offsets.append(None if x is None else len(bodies))
        for section, body in () if x is None else markdown_pieces(x):
            sections.append(section)
            bodies.append(body)
    pieces = pa.StructArray.from_arrays([pa.array(sections, pa.string()), pa.array(bodies, pa.string())], ["section", "body"])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(bodies)], pa.int32()), pieces)


def session_chunks(turns: Column) -> Column:
    """Turns (role, content, timestamp) joined until a chunk's worth is reached; only what is left over is folded."""
    state = f"struct<buf:string,at:string,out:{PIECE}>"
    text = lambda c, d: F.coalesce(c, F.lit(d))

    def step(s: Column, t: Column) -> Column:
        at = text(t["timestamp"], "")
        line = F.concat(F.lit("["), F.substring(at, 1, 16), F.lit("] "), text(t["role"], "?"), F.lit(": "), t["content"])
        buf = F.when(s["buf"].isNull(), line).otherwise(F.concat(s["buf"], F.lit("\n"), line))
        since = F.coalesce(s["at"], at)
        full = F.struct(F.lit(None).cast("string").alias("buf"), F.lit(None).cast("string").alias("at"), F.concat(s["out"], _pieces(F.substring(since, 1, 10), buf)).alias("out"))
        more = F.struct(buf.alias("buf"), since.alias("at"), s["out"].alias("out"))
        return F.when(text(t["content"], "") == "", s).when(F.length(buf) >= CHUNK, full).otherwise(more)

    def finish(s: Column) -> Column:
        # pieces of full buffers are never folded into one another, the rest's first may be folded into the last of them
        rest = _pieces(F.substring(s["at"], 1, 10), s["buf"])

        def add(done: Column, x: Column) -> Column:
            bare, last = strip(x["body"]), F.element_at(done, -1)
            joined = F.struct(last["section"].alias("section"), F.concat(rstrip(last["body"]), F.lit("\n"), bare).alias("body"))
            short = (F.length(bare) < FOLD) & (F.size(done) > 0)
            return F.when(bare == "", done).when(short, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

        return F.when(s["buf"].isNull(), s["out"]).otherwise(F.aggregate(rest, s["out"], add))

    zero = F.struct(F.lit(None).cast("string").alias("buf"), F.lit(None).cast("string").alias("at"), F.array().cast(PIECE).alias("out")).cast(state)
    return F.aggregate(turns, zero, step, finish)


@F.pandas_udf(StringType())
def pretty_json(raw: pd.Series) -> pd.Series:
    """JSON text laid out with one space a level; Spark's own layout differs."""
    return raw.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, indent=1), na_action="ignore")


def json_chunks(pretty: Column) -> Column:
    """Of a column that pretty_json made (it can't stand within a lambda)."""
    return fold(_pieces(F.lit(""), pretty))


def raw_chunks(text: Column) -> Column:
    """Windows of the text as they are (logs, and JSON that can't be read)."""
    return F.filter(_pieces(F.lit(""), text), lambda p: strip(p["body"]) != "")


def session_tail(turns: Column) -> Column:
    """The last turn that isn't the user's, in one line; empty if there is none."""
    said = F.filter(turns, lambda t: (F.coalesce(t["role"], F.lit("")) != "user") & (F.coalesce(t["content"], F.lit("")) != ""))
    last = F.element_at(F.when(F.size(said) > 0, said), -1)
    line = F.concat(F.lit("["), F.substring(F.coalesce(last["timestamp"], F.lit("")), 1, 16), F.lit("] "), F.coalesce(last["role"], F.lit("assistant")), F.lit(": "), squeeze(last["content"], 80))
    return F.when(F.size(said) > 0, line).otherwise("")


def explode_chunks(files: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """A row for each chunk, with its number in the file (from 1) and how many there are."""
    rows = files.withColumn("__c", chunks)
    rows = rows.select(*keep, F.size("__c").alias("nseq"), F.posexplode("__c").alias("__i", "__p"))
    return rows.select(*keep, F.col("__p.section").alias("section"), F.col("__p.body").alias("body"), (F.col("__i") + 1).alias("seq"), "nseq")


def turns_to_sessions(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Rows of turns to (session, turns) in order."""
    item = F.struct(F.col(turn).alias("i"), F.col(role).alias("role"), F.col(content).alias("content"), F.lit(None).cast("string").alias("timestamp"))
    return turns.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("turns"))


