"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_format
from .decontaminate import OP1_SQL, op1_decontaminate
from .filter_audit import OP13_SQL, op13_filter_audit
from .idfiles import op10_id_files
from .langid import op9_language
from .packing import op3_pack_sequences
from .quality_model import op6_quality_scores
from .quality_rules import OP4_SQL, op4_quality_rules
from .repair import OP12_SQL, op12_repair
from .sharding import OP5_SQL, op5_histogram_shards
from .simhash import op8_simhash_components
from .sliced_index import OP11_SQL, op11_exact_topk
from .token_counts import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_chat_format,
        op3_pack_sequences,
        op4_quality_rules,
        op5_histogram_shards,
        op6_quality_scores,
        op7_token_counts,
        op8_simhash_components,
        op9_language,
        op10_id_files,
        op11_exact_topk,
        op12_repair,
        op13_filter_audit,
    )
}
SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_histogram_shards": OP5_SQL,
    "op11_exact_topk": OP11_SQL,
    "op12_repair": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
