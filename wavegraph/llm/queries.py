"""The registered queries of the training-data operators, and the SQL of those that have one."""

from __future__ import annotations

from wavegraph.llm.alignment import op13_alignment
from wavegraph.llm.bpe import op12_bpe
from wavegraph.llm.decontaminate import OP1_SQL, op1_decontaminate
from wavegraph.llm.divergence import OP11_SQL, op11_source_audit
from wavegraph.llm.jaccard_join import OP10_SQL, op10_jaccard_join
from wavegraph.llm.language import op3_language
from wavegraph.llm.licenses import op8_license_scan
from wavegraph.llm.mixing import op5_mix
from wavegraph.llm.pii import op4_pii
from wavegraph.llm.quality import op2_quality
from wavegraph.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from wavegraph.llm.url_filter import OP6_SQL, op6_url_filter
from wavegraph.llm.vector_search import op7_vector_search

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_mix": op5_mix,
    "op6_url_filter": op6_url_filter,
    "op7_vector_search": op7_vector_search,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_audit": op11_source_audit,
    "op12_bpe": op12_bpe,
    "op13_alignment": op13_alignment,
}
ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op6_url_filter": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_source_audit": OP11_SQL,
}
