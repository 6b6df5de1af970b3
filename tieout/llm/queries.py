"""The subpackage's queries, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .chat import ORACLE as CHAT
from .chat import op12_chat_formatting
from .decontaminate import op5_benchmark_decontamination
from .gam import op8_quality_classifier
from .hnsw import op7_embedding_near_dedup
from .htmltext import op1_html_extraction
from .huffman import op9_token_output
from .ranking import ORACLE as RANKING
from .ranking import op13_ranked_search
from .secrets import op3_secret_scan
from .sentencepiece import op10_sentencepiece
from .shards import op2_sharding
from .simhash import op4_simhash_near_dedup
from .spelling import ORACLE as SPELLING
from .spelling import op11_spelling_variants
from .suffixes import op6_suffix_array_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_sharding,
        op3_secret_scan,
        op4_simhash_near_dedup,
        op5_benchmark_decontamination,
        op6_suffix_array_dedup,
        op7_embedding_near_dedup,
        op8_quality_classifier,
        op9_token_output,
        op10_sentencepiece,
        op11_spelling_variants,
        op12_chat_formatting,
        op13_ranked_search,
    )
}

#: The others can't be put as SQL in full; each has a brute-force version in the tests.
ORACLES: dict[str, str] = {"op11_spelling_variants": SPELLING, "op12_chat_formatting": CHAT, "op13_ranked_search": RANKING}
