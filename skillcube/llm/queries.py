"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from skillcube.llm.bpe import op7_bpe
from skillcube.llm.decontam import op6_decontam, proximity_matches
from skillcube.llm.exact_dedup import op11_exact_dedup
from skillcube.llm.filter_audit import op12_filter_audit
from skillcube.llm.html_extract import op8_html_extract
from skillcube.llm.jaccard_join import op10_jaccard_join
from skillcube.llm.oracle import ORACLE_SQL
from skillcube.llm.pii import op2_pii
from skillcube.llm.quality import op3_quality
from skillcube.llm.secrets import op9_secrets
from skillcube.llm.source_audit import op13_source_audit
from skillcube.llm.token_output import op1_token_output
from skillcube.llm.topk import op5_topk
from skillcube.llm.warc import op4_warc

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_decontam": op6_decontam,
    "op7_bpe": op7_bpe,
    "op8_html_extract": op8_html_extract,
    "op9_secrets": op9_secrets,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_audit": op13_source_audit,
    "proximity_matches": proximity_matches,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
