"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat_formatting
from .embeddup import op6_embedding_near_dedup
from .interaction import OP11_SQL, op11_filter_interaction_audit
from .mixing import OP10_SQL, op10_mixing
from .neardup import op1_minhash_near_dedup
from .packing import op9_packing
from .quality import op2_quality_classifier
from .repeats import op3_suffix_array_dedup
from .secrets import OP13_SQL, op13_secret_scans
from .sharding import op5_sharding
from .topk import OP8_SQL, op8_exact_top_k
from .toxicity import op4_toxicity
from .trie import OP12_SQL, op12_conversation_prefix_trie

QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_classifier, op3_suffix_array_dedup, op4_toxicity, op5_sharding, op6_embedding_near_dedup, op7_chat_formatting, op8_exact_top_k, op9_packing, op10_mixing, op11_filter_interaction_audit, op12_conversation_prefix_trie, op13_secret_scans)}
SQL = {"op7_chat_formatting": OP7_SQL, "op8_exact_top_k": OP8_SQL, "op10_mixing": OP10_SQL, "op11_filter_interaction_audit": OP11_SQL, "op12_conversation_prefix_trie": OP12_SQL, "op13_secret_scans": OP13_SQL}
