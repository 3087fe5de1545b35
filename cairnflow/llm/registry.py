"""Queries of this subpackage and the SQL that their results are held against."""

from __future__ import annotations

from . import conversation_trie
from .boosted_rules import op7_boosted_rules
from .conversation_trie import op11_conversation_trie
from .hilbert import op6_hilbert
from .html_text import op4_html_text
from .language import op12_language
from .mixing import op1_mixing
from .packing import op8_packing
from .quadratic import op5_quadratic
from .simhash import op10_simhash
from .suffix_dedup import op3_suffix_dedup
from .warc import op9_warc
from .webp import op2_webp
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_mixing, op2_webp, op3_suffix_dedup, op4_html_text, op5_quadratic, op6_hilbert, op7_boosted_rules, op8_packing, op9_warc, op10_simhash, op11_conversation_trie, op12_language, op13_whitening)}

ORACLES: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
            CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to
        FROM m
    """,
    "op11_conversation_trie": conversation_trie.ORACLE_SQL,
}
