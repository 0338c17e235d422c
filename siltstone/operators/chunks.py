"""Texts to rows: sections, paragraphs, sentences, chunks, tables of Markdown pages."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.functions.scalars import short_hash

SIZE, OVERLAP = 512, 64
#: Letters of texts, and rows cut from them, that a task holds as Python's objects at a time.
SLICE, SLICE_ROWS = 1 << 20, 10_000
FIRST_SECTION = "正文"
_HEADING = re.compile(r"^#{1,3}\s+.+$", re.M)
_SENTENCE = re.compile(r"(?<=[。！？.!?\n])\s*")

TABLE = r"((?:^|\n)\|[^\n]*\|[ \t]*\n\|[ \t]*:?-[-:| \t]*\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)+)"


def cut_sections(text: str | None) -> Iterator[tuple[int, str, str]]:
    """pos, section, text of one page: cut at headings of level 1 to 3; empty sections are dropped."""
    text = text or ""
    heads = list(_HEADING.finditer(text))
    names = [FIRST_SECTION, *(h[0].strip("# \t") for h in heads)]
    bodies = [text[a:b].strip() for a, b in zip([0, *(h.end() for h in heads)], [*(h.start() for h in heads), len(text)], strict=True)]
    yield from ((pos, *row) for pos, row in enumerate(row for row in zip(names, bodies, strict=True) if row[1]))


def _cut(rows: DataFrame, schema: str, cut: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The rows that cut(*row) gives for each row, whose last column is a text.  No shuffle.

    A task holds a batch as Arrow, and about SLICE letters of its texts, with what is cut from them, as Python's objects.
    """
    empty = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(empty)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, letters = [], 0
            for n in range(batch.num_rows):
                row = [column[n].as_py() for column in batch.columns]
                letters += len(row[-1] or "")
                for one in cut(*row):
                    out.append(one)
                    if len(out) >= SLICE_ROWS:
                        yield packed(out)
                        out = []
                if letters >= SLICE and out:
                    yield packed(out)
                    out, letters = [], 0
            if out:
                yield packed(out)

    return rows.mapInArrow(run, empty)


def sections(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, section, text: pages cut at headings of level 1 to 3; empty sections are dropped."""
    return _cut(pages.select("doc_id", "page", "text"), "doc_id long, page int, pos int, section string, text string", lambda doc, page, text: ((doc, page, *row) for row in cut_sections(text)))


def paragraphs(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, paragraph: breaks at blank lines and before headings; trimmed, without empty ones."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n(?=#{1,6}\s)", "\n\n")
    parts = F.filter(F.transform(F.split(marked, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    return texts.select(key, F.posexplode(parts).alias("pos", "paragraph"))


def sentences(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, sentence: cuts after 。！？.!? or a line end, spaces after them go; blank parts are dropped."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[。！？.!?\n])\s*"), lambda p: p.rlike(r"(?U)\S"))
    return texts.select(key, F.posexplode(parts).alias("pos", "sentence"))


def _paragraphs_of(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", re.sub(r"\n(?=#{1,6}\s)", "\n\n", text)) if p.strip()]


def _units(text: str, size: int, overlap: int) -> Iterator[tuple[str, bool, str | None]]:
    """What a chunk is made of: a paragraph, or a sentence of a paragraph longer than a chunk.

    With each: whether a chunk must begin here, and how one that begins here for want of room opens (None: with the end of the last chunk).
    """
    for paragraph in _paragraphs_of(text):
        if len(paragraph) <= size:
            yield paragraph, False, None
            continue
        own = [s for s in _SENTENCE.split(paragraph) if s.strip()]
        place = {s: k for k, s in reversed(list(enumerate(own)))}  # the first of equal sentences
        for k, s in enumerate(own):
            yield s, k == 0, own[place[s] - 1][-overlap:] if place[s] and overlap else ""


def pack(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of about `size` letters, untrimmed: paragraphs are joined while they fit, long ones are cut at sentences.

    A new chunk begins with the last `overlap` letters of the one before; within a long paragraph with the sentence before, if
    that is short enough (the first of equal sentences counts).  A sentence longer than a chunk is one chunk.  The cuts are found in
    the running sums of the units' lengths.
    """
    units = list(_units(text, size, overlap))
    sums = list(accumulate((len(u) for u, _, _ in units), initial=0))
    fresh = [*(n for n, (_, must, _) in enumerate(units) if must), len(units)]
    out: list[str] = []
    begin, opening = 0, ""
    while begin < len(units):
        room = bisect_right(sums, sums[begin] + size - len(opening)) - 1
        end = min(max(room, begin + 1), fresh[bisect_right(fresh, begin)])
        out.append(opening + "".join(u for u, _, _ in units[begin:end]))
        begin = end
        if begin < len(units):
            _, must, own = units[begin]
            opening = "" if must else out[-1][len(out[-1]) - min(overlap, len(out[-1])) :] if own is None else own
    return out


CHUNK = "id string, doc_id long, page int, section string, pos int, text string, char_count int"


def _chunks_of(doc, page, section, text: str | None, size: int, overlap: int) -> Iterator[tuple]:
    for pos, chunk in enumerate(pack(text or "", size, overlap)):
        yield hashlib.md5(f"{doc}|{page}|{section}|{pos}|{chunk}".encode()).hexdigest()[:12], doc, page, section, pos, chunk.strip(), len(chunk)


def chunk_texts(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, doc_id, page, section, pos, text, char_count of the chunks of rows (doc_id, page, section, text).  No shuffle."""
    return _cut(rows.select("doc_id", "page", "section", "text"), CHUNK, lambda *row: _chunks_of(*row, size, overlap))


def tables(pages: DataFrame) -> DataFrame:
    """doc_id, page, table_index, markdown, rows, cols of the Markdown tables (header, dash line, one row at least)."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TABLE), F.lit(1))
    rows = pages.select("doc_id", "page", F.posexplode(found).alias("table_index", "markdown")).withColumn("markdown", F.trim(F.regexp_replace("markdown", r"^\n", "")))
    lines = F.split("markdown", "\n")
    return rows.withColumns({"rows": F.size(lines) - 2, "cols": F.size(F.split(F.regexp_replace(F.trim(lines[0]), r"^\||\|$", ""), r"\|"))})


def grid_to_markdown(cells):
    """Markdown of ARRAY<ARRAY<STRING>>: blank rows go, the first is the header; null for fewer than two rows."""
    clean = F.transform(cells, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    dashes = F.transform(full[0], lambda c: F.lit("---"))
    return F.when(F.size(full) >= 2, F.array_join(F.concat(F.array(line(full[0]), line(dashes)), F.transform(F.slice(full, 2, F.size(full)), line)), "\n"))


def chunk_tables(found: DataFrame) -> DataFrame:
    """One chunk for each table, never cut, with number, source and page before it."""
    text = F.concat(F.format_string("[Table %d, %s, page %d]\n", F.col("table_index") + 1, F.col("doc_id").cast("string"), F.col("page")), F.col("markdown"))
    return found.select(short_hash("doc_id", "page", "table_index", text).alias("id"), "doc_id", "page", text.alias("text"), F.lit("table").alias("chunk_type"), "rows", "cols")


def numbered_table_chunks(found: DataFrame) -> DataFrame:
    """One chunk for each table (doc_id, page, table_index, markdown, rows, cols; source and bbox if known), never cut, with its metadata.

    Tables are numbered through their document, and the text begins with number, source and page.  Only rows of tables are shuffled.
    """
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_index")) - 1).alias("number")
    source = (F.col("source") if "source" in found.columns else F.col("doc_id").cast("string")).alias("source")
    bbox = (F.col("bbox") if "bbox" in found.columns else F.lit(None).cast("array<double>")).alias("bbox")
    rows = found.select("doc_id", "page", "table_index", number, source, bbox, "markdown", "rows", "cols")
    # fixed value: the form of the prefix
    text = F.concat(F.format_string("[表格 %d] 来源: %s, 第 %d 页\n", F.col("number") + 1, "source", "page"), F.col("markdown"))
    place = F.concat(F.col("source"), F.lit("_table_"), F.col("page").cast("string"), F.lit("_"), F.col("number").cast("string"))
    metadata = F.struct(F.col("number").alias("table_index"), "rows", "cols", "bbox").alias("metadata")
    return rows.select(short_hash(place).alias("id"), "doc_id", "page", F.lit("表格").alias("section"), text.alias("text"), F.lit("table").alias("chunk_type"), F.length(text).alias("char_count"), metadata)


def chunk_documents(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Text chunks of all sections and table chunks together, without a shuffle.

    Only a blank page has no sections, and chunking it whole gives no chunk either.  Sections are chunked where they are cut.
    """
    both = lambda doc, page, text: (row for _, section, own in cut_sections(text) for row in _chunks_of(doc, page, section, own, size, overlap))
    text = _cut(pages.select("doc_id", "page", "text"), CHUNK, both).select("id", "doc_id", "page", "text", F.lit("text").alias("chunk_type"))
    return text.unionByName(chunk_tables(tables(pages)).select("id", "doc_id", "page", "text", "chunk_type"))


def repair_tables(primary: DataFrame, second: DataFrame, share: float = 0.3) -> DataFrame:
    """Tables of documents of which too many are poor, mended by a second engine's (doc_id, page, table_index, rows, cols, ...).

    Poor: fewer than two columns or no row.  Then one-column tables take the first second-engine table within a page that is as
    wide at least, and pages without any primary table take all of the second engine's.
    """
    poor = primary.groupBy("doc_id").agg((F.expr("count_if(cols < 2 or rows < 1)") / F.count("*")).alias("p")).filter(F.col("p") > share).select("doc_id")
    mend = primary.join(poor, "doc_id", "left_semi").filter("cols = 1").select("doc_id", "page", "table_index", "cols")
    near = mend.withColumn("at", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    other = second.select("doc_id", F.col("page").alias("at"), F.col("table_index").alias("k"), F.struct(*second.columns).alias("s"))
    best = near.join(other, ["doc_id", "at"]).filter("s.cols >= cols").groupBy("doc_id", "page", "table_index").agg(F.min_by("s", F.struct("at", "k")).alias("s"))
    mended = primary.join(best, ["doc_id", "page", "table_index"], "left")
    keep = [F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in primary.columns]
    more = second.join(poor, "doc_id", "left_semi").join(primary.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return mended.select(*keep).unionByName(more.select(*primary.columns))
