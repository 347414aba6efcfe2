"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, embedding_dedup, merkle, near_dedup, prefix_trie, quality_rules
from .bpe_codec import op10_bpe_codec
from .chat_format import op11_chat_format
from .embedding_dedup import op2_embedding_dedup
from .hmm_lm import op1_hmm_lm
from .merkle import op13_merkle_manifest
from .near_dedup import op7_near_dedup
from .packing import op6_best_fit_packing
from .pii_tagger import op8_pii_tagger
from .prefix_trie import op12_prefix_trie
from .quality_rules import op9_quality_rules
from .secret_scan import op3_secret_scan
from .token_counts import op4_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_hmm_lm": op1_hmm_lm,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii_tagger": op8_pii_tagger,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_chat_format": op11_chat_format,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

#: Only where SQL can express the whole result.
ORACLE_SQL = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_chat_format": chat_format.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
