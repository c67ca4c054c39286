"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op5_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .language_id import op4_language_id
from .media import op9_media
from .packing import op7_packing
from .pii import op2_pii
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op3_quality
from .quality_rules import op13_quality_rules
from .sharding import op8_sharding
from .simhash_dedup import op6_simhash_dedup
from .token_alignment import op12_token_alignment
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_media": op9_media,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_rules": op13_quality_rules,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_warc": OP1_SQL, "op10_exact_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
