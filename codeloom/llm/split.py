"""Splitting oversized items at natural boundaries (problem 1)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

KINDS = ("function", "block", "raw_text")

PIECE_SCHEMA = (
    "file_id string, item_kind string, item_no int, piece_no int, n_pieces int, start_char int, end_char int, "
    "overlap_chars int, start_line int, end_line int, boundary string, text string"
)

#: Kinds of boundaries from the most to the least natural.
KINDS_OF_CUTS = ("blank", "line", "sentence", "word")
_TOKEN = re.compile(r"\n|[^\S\n]+|\S+")
_SENTENCE_END = re.compile(r"[.!?;][\"')\]]*$")
#: A piece cut at a more natural boundary must still use this share of the limit.
_LEAST_FILL = 0.5


class Boundaries:
    """Sorted cut positions of one text, per kind, from prefix sums of its tokens' lengths.

    Tokens are line ends, other white space and runs of other characters; the prefix sums of their lengths are all token offsets. Each offset is a
    cut of the kind that the tokens before it make: after a blank line, a line, a sentence, or else between words.
    """

    def __init__(self, text: str):
        words = _TOKEN.findall(text)
        self.offsets = list(accumulate(map(len, words), initial=0))
        blank, line, sentence = [], [], []
        empty = False
        for i, w in enumerate(words):
            if w == "\n":
                line.append(self.offsets[i + 1])
                if empty:
                    blank.append(self.offsets[i + 1])
                empty = True
            elif not w.isspace():
                empty = False
                if i + 1 < len(words) and words[i + 1].isspace() and _SENTENCE_END.search(w[-8:]):
                    sentence.append(self.offsets[i + 2])
        self.kinds = list(zip(KINDS_OF_CUTS, (blank, line, sentence, self.offsets)))

    def last(self, low: int, high: int) -> tuple[int, str]:
        """The best cut in (low, high]: the last one of the most natural kind that leaves a well-filled piece."""
        least = low + int((high - low) * _LEAST_FILL)
        for floor in (least, low):
            for name, at in self.kinds:
                i = bisect_right(at, high) - 1
                if i >= 0 and at[i] > floor:
                    return at[i], name
        return high, "hard"

    def before(self, low: int, at: int) -> int:
        """The last token offset in (low, at], or ``at`` itself."""
        i = bisect_right(self.offsets, at) - 1
        return self.offsets[i] if i >= 0 and self.offsets[i] > low else at


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of a text, in code points.

    Pieces are at most ``limit`` long, cover the text and share at least ``overlap`` characters
    (lowered to ``limit`` - 1). A piece starts at the last token offset from which the overlap is reached, if that is at most as much again (or 32 characters) back and leaves
    half of a piece for new text; else exactly ``overlap`` before the end of the one before.
    A text within the limit is one piece; the empty text is one empty piece.
    """
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    overlap = max(0, min(overlap, limit - 1))
    n = len(text)
    if n <= limit:
        return [(0, n, "whole")]
    b, out, start, end = Boundaries(text), [], 0, 0
    while True:
        if n - start <= limit:
            out.append((start, n, "end"))
            return out
        # A cut must lie beyond the overlap and the end before, else the next piece would not advance.
        end, kind = b.last(max(start + overlap, end), start + limit)
        # CRLF stays together.
        if kind == "hard" and text[end - 1 : end + 1] == "\r\n" and end - 1 > start + overlap:
            end -= 1
        out.append((start, end, kind))
        exact = end - overlap
        furthest = max(start, exact - min(max(overlap, 32), (limit - overlap) // 2))
        start = b.before(furthest, exact) if overlap else exact


def first_line(code: str, raw: str | None, start: int | None, end: int | None) -> int:
    """The line at which an item begins in its file.

    Stated lines may be null, zero or swapped. Where the code stands in the raw text, the
    occurrence nearest to the stated line counts; else the smaller positive stated line; else 1.
    """
    stated = [int(x) for x in (start, end) if x is not None and x == x and x > 0]
    guess = min(stated) if stated else None
    if raw:
        if guess is not None:
            at = 0
            for _ in range(guess - 1):
                at = raw.find("\n", at) + 1
                if not at:
                    break
            else:
                # The code may begin after the line's indentation.
                line_end = raw.find("\n", at)
                if 0 <= raw.find(code, at, at + len(code) + max(0, (line_end if line_end >= 0 else len(raw)) - at)):
                    return guess
        best, at = None, raw.find(code)
        line, seen = 1, 0
        while at >= 0:
            line += raw.count("\n", seen, at)
            seen = at
            if best is None or (guess is not None and abs(line - guess) < abs(best - guess)):
                best = line
            if guess is None:
                break
            at = raw.find(code, at + 1)
        if best is not None:
            return best
    return guess or 1


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, raw, found in zip(pdf.file_id, pdf.raw_text, pdf["items"]):
            for r in found:
                text = r["code"]
                if r["item_kind"] == "raw_text":
                    text, base = raw, 1
                else:
                    base = first_line(text, raw, r["start_line"], r["end_line"])
                pieces = cut(text, int(r["max_chars"]), int(r["overlap"]))
                # Prefix sums of newlines, at the ends of lines.
                newlines = [m.start() for m in re.finditer("\n", text)]
                previous = 0
                for k, (a, z, kind) in enumerate(pieces, 1):
                    first = base + bisect_left(newlines, a)
                    last = base + bisect_left(newlines, max(a, z - 1))
                    rows.append((file_id, r["item_kind"], r["item_no"], k, len(pieces), a, z, max(0, previous - a), first, last, kind, text[a:z]))
                    previous = z
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])


def _limits(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """(max_chars, overlap) by kind; at most one row for each of KINDS comes to the driver."""
    per_kind = limits.where(F.col("item_kind").isin(*KINDS) & (F.col("max_chars") > 0)).groupBy("item_kind").agg(
        F.min("max_chars").alias("max_chars"), F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("overlap")
    )
    return {r["item_kind"]: (r["max_chars"], r["overlap"]) for r in per_kind.collect()}


def oversized(files: DataFrame, limits: DataFrame) -> DataFrame:
    """(file_id, raw_text, items) of the files that have items with more code points than their kind's ``max_chars``, a row per file.

    Functions and blocks by their place in their array from 1, raw texts as item 1 where functions and
    classes are empty or null; the code of a raw text is left null, since it stands beside. Null arrays, elements and codes give no items; kinds without a limit, or
    with a null one, are never oversized. A file's text is carried once however many of its items are too long, and only of files that have any. Re-delivered rows are dropped after that filter.
    """
    of = _limits(limits)
    a = "analysis"

    def item(kind: str, no, code, start, end) -> Column:
        most, overlap = of[kind]
        text = lambda x, t: F.lit(None).cast(t) if x is None else x.cast(t)
        return F.struct(
            F.lit(kind).alias("item_kind"), no.cast("int").alias("item_no"), text(code, "string").alias("code"), text(start, "int").alias("start_line"), text(end, "int").alias("end_line"), F.lit(most).alias("max_chars"), F.lit(overlap).alias("overlap")
        )

    def long_ones(kind: str, array: str) -> Column:
        each = F.transform(f"{a}.{array}", lambda x, i: item(kind, i + 1, x["code"], x["start_line"], x["end_line"]))
        return F.coalesce(F.filter(each, lambda x: F.length(x["code"]) > of[kind][0]), F.array())

    parts = [long_ones(kind, array) for kind, array in (("function", "functions"), ("block", "blocks")) if kind in of]
    if "raw_text" in of:
        empty = lambda c: F.coalesce(F.size(f"{a}.{c}"), F.lit(0)) <= 0
        long = empty("functions") & empty("classes") & (F.length(f"{a}.raw_text") > of["raw_text"][0])
        parts.append(F.when(long, F.array(item("raw_text", F.lit(1), None, F.lit(1), None))).otherwise(F.array()))
    base = files.where(F.col(a).isNotNull() & F.col("id").isNotNull())
    if not parts:
        return base.select(F.col("id").alias("file_id"), F.col(f"{a}.raw_text").alias("raw_text"), F.array().alias("items")).limit(0)
    rows = base.select(F.col("id").alias("file_id"), F.col(f"{a}.raw_text").alias("raw_text"), F.concat(*parts).alias("items"))
    return rows.where(F.size("items") > 0).dropDuplicates(["file_id"])


def split_items(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of all oversized items, with the schema PIECE_SCHEMA.

    ``start_char`` and ``end_char`` are code point offsets in the item, ``start_line`` and ``end_line``
    lines of the file from 1, counted at ``\\n``. Items within their limit, empty and null codes give
    no rows; empty tables give none. Other columns of ``files`` are ignored.
    """
    rows = oversized(files, limits)
    if "void" in rows.schema["items"].dataType.simpleString():
        return files.sparkSession.createDataFrame([], PIECE_SCHEMA)
    return rows.mapInPandas(_split_batches, PIECE_SCHEMA)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_items(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunk_limits"))
    # An item that was cut has a first piece among several.
    return pieces.where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("file_id", "item_kind", "item_no")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunk_limits"))


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item that was cut: its length and whether its pieces keep to the limit, cover it without a gap, share the overlap, and hold its text."""
    limits = _limits(table(spark, sf_dir, "chunk_limits"))
    most = F.coalesce(*[F.when(F.col("item_kind") == k, F.lit(m)) for k, (m, _) in limits.items()], F.lit(0))
    least = F.coalesce(*[F.when(F.col("item_kind") == k, F.lit(min(o, m - 1))) for k, (m, o) in limits.items()], F.lit(0))
    fine = (F.length("text") == F.col("end_char") - F.col("start_char")) & (F.length("text") <= most) & ((F.col("piece_no") == 1) & (F.col("start_char") == 0) | (F.col("overlap_chars") >= least)) & (F.col("start_line") <= F.col("end_line"))
    per = p1_pieces(spark, sf_dir).groupBy("file_id", "item_kind", "item_no").agg(
        F.max("end_char").alias("n_chars"), F.min(fine).alias("fine"), F.count(F.lit(1)).alias("n"), F.first("n_pieces").alias("n_pieces"), F.sum(F.col("end_char") - F.col("start_char") - F.col("overlap_chars")).alias("fresh")
    )
    return per.select("file_id", "item_kind", "item_no", "n_chars", (F.col("fine") & (F.col("n") == F.col("n_pieces")) & (F.col("fresh") == F.col("n_chars"))).alias("whole"))


_ITEMS = """
with f as (select distinct id, analysis from files where analysis is not null),
items as (
  select id as file_id, 'function' as item_kind, i as item_no, analysis.functions[i].code as code
  from (select id, analysis, unnest(range(1, coalesce(len(analysis.functions), 0) + 1)) as i from f)
  union all
  select id, 'block', i, analysis.blocks[i].code
  from (select id, analysis, unnest(range(1, coalesce(len(analysis.blocks), 0) + 1)) as i from f)
  union all
  select id, 'raw_text', 1, analysis.raw_text from f
  where coalesce(len(analysis.functions), 0) = 0 and coalesce(len(analysis.classes), 0) = 0)
"""
QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_check": p1_check}
SQL = {
    "p1_found": _ITEMS
    + """select distinct i.file_id, i.item_kind, cast(i.item_no as int) as item_no
    from items i join chunk_limits l on l.item_kind = i.item_kind where length(i.code) > l.max_chars""",
    "p1_check": _ITEMS
    + """select distinct i.file_id, i.item_kind, cast(i.item_no as int) as item_no, cast(length(i.code) as int) as n_chars, true as whole
    from items i join chunk_limits l on l.item_kind = i.item_kind where length(i.code) > l.max_chars""",
}
