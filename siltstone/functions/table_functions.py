"""Table functions for SQL: the sections, and the chunks, of a text, to be called with LATERAL.

    SELECT doc_id, s.* FROM documents, LATERAL text_sections(text) AS s
    SELECT doc_id, c.* FROM documents, LATERAL text_chunks(text, 512, 64) AS c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.operators import chunks


# What Python's \s and strip() take, and lines that end with \n only, as in chunks.cut_sections.  Backslashes are doubled for SQL.
_BLANK = r"[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_HEADING = rf"(?md)^#{{1,3}}{_BLANK}+.+$"
_ENDS = rf"\\A{_BLANK}+|(?<!{_BLANK}){_BLANK}+\\z"

#: pos, section, text; a null text has no sections.  In Spark's own functions: a call for each row costs no round to Python.
_SECTIONS = f"""CREATE OR REPLACE TEMPORARY FUNCTION text_sections(md STRING) RETURNS TABLE (pos INT, section STRING, text STRING)
RETURN SELECT p, r.section, r.text FROM posexplode(filter(zip_with(
  concat(array('{chunks.FIRST_SECTION}'), transform(regexp_extract_all(md, '{_HEADING}', 0), h -> btrim(h, '# \\t'))),
  transform(split(md, '{_HEADING}', -1), b -> regexp_replace(b, '{_ENDS}', '')),
  (h, b) -> named_struct('section', h, 'text', b)), r -> r.text <> '')) AS t(p, r)"""


class TextChunks:
    """pos, text, char_count; a null text has no chunks."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int]]:
        for pos, chunk in enumerate(chunks.pack(text or "", size, overlap)):
            yield pos, chunk.strip(), len(chunk)


def register(spark: SparkSession) -> None:
    """Makes text_sections(text) and text_chunks(text, size, overlap) known to the session's SQL; rows of the latter travel as Arrow batches."""
    spark.sql(_SECTIONS)
    spark.udtf.register("text_chunks", F.udtf(TextChunks, returnType="pos int, text string, char_count int", useArrow=True))
