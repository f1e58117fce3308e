"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op1_nn_descent_search
from .bitslice import OP7_SQL, op7_exact_top_k
from .decontamination import OP12_SQL, op12_decontamination
from .langid import op8_language_id
from .lexical import OP13_SQL, op13_ranked_lexical_search
from .packing import op4_best_fit_packing
from .pieces import op9_sentencepiece_sampling
from .simhash import op5_simhash_near_dedup
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op3_suffix_array_dedup
from .toxicity import op2_toxicity
from .warc import OP10_SQL, op10_warc_merkle_audit
from .whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_nn_descent_search, op2_toxicity, op3_suffix_array_dedup, op4_best_fit_packing, op5_simhash_near_dedup, op6_substring_dedup, op7_exact_top_k, op8_language_id,
    op9_sentencepiece_sampling, op10_warc_merkle_audit, op11_embedding_whitening, op12_decontamination, op13_ranked_lexical_search,
)}
ORACLE_SQL: dict[str, str] = {"op7_exact_top_k": OP7_SQL, "op10_warc_merkle_audit": OP10_SQL, "op12_decontamination": OP12_SQL, "op13_ranked_lexical_search": OP13_SQL}
