"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from siltstone.llm.dataset_files import op5_token_files
from siltstone.llm.decontamination import op4_decontamination
from siltstone.llm.fingerprints import op9_fingerprints
from siltstone.llm.html_text import op3_html_text
from siltstone.llm.language_id import op13_language_id
from siltstone.llm.language_model import op6_language_model
from siltstone.llm.line_dedup import op8_line_dedup
from siltstone.llm.near_duplicates import op7_near_duplicates
from siltstone.llm.sentencepieces import op1_sentencepieces
from siltstone.llm.sharding import op10_sharding
from siltstone.llm.token_alignment import op12_token_alignment
from siltstone.llm.toxicity import op2_toxicity
from siltstone.llm.word_runs import op11_word_runs

QUERIES = {f.__name__: f for f in (op1_sentencepieces, op2_toxicity, op3_html_text, op4_decontamination, op5_token_files, op6_language_model, op7_near_duplicates, op8_line_dedup, op9_fingerprints, op10_sharding, op11_word_runs, op12_token_alignment, op13_language_id)}

_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SHINGLES = "SELECT DISTINCT {id}, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') END AS s FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {id}, " + _WORDS.format(text="text") + " AS w FROM {table} WHERE text IS NOT NULL) x WHERE len(w) > 0) y"

SQL = {
    "op4_decontamination": f"""
WITH tests AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
held AS ({_SHINGLES.format(id="doc_id", table="documents")}),
sizes AS (SELECT item_id, count(*) AS n FROM tests GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS k FROM held JOIN tests USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(k AS INTEGER) AS n_shared, CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM hits JOIN sizes USING (item_id) WHERE k >= 0.8 * n - 1e-9""",
}
