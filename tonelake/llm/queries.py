"""The queries of this package, and their SQL."""

from __future__ import annotations

from tonelake.llm import exact, jaccard, lexical
from tonelake.llm.align import op13_token_alignment
from tonelake.llm.exact import op11_exact_dedup
from tonelake.llm.jaccard import op8_ngram_jaccard_join
from tonelake.llm.lexical import op12_lexical_search
from tonelake.llm.media import op1_media_copies
from tonelake.llm.mixing import op7_mixing
from tonelake.llm.packing import op5_packing
from tonelake.llm.pii import op10_pii
from tonelake.llm.rules import op9_quality_rules
from tonelake.llm.secrets import op4_secret_scans
from tonelake.llm.sharding import op6_sharding
from tonelake.llm.tokens import op3_token_counts
from tonelake.llm.toxicity import op2_toxicity

QUERIES = {
    q.__name__: q
    for q in [
        op1_media_copies,
        op2_toxicity,
        op3_token_counts,
        op4_secret_scans,
        op5_packing,
        op6_sharding,
        op7_mixing,
        op8_ngram_jaccard_join,
        op9_quality_rules,
        op10_pii,
        op11_exact_dedup,
        op12_lexical_search,
        op13_token_alignment,
    ]
}
SQL: dict[str, str] = {"op8_ngram_jaccard_join": jaccard.ORACLE_SQL, "op11_exact_dedup": exact.ORACLE_SQL, "op12_lexical_search": lexical.ORACLE_SQL}
