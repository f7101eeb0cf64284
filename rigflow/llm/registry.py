"""Queries of the text operators, and their DuckDB SQL where SQL can express them."""

import corpus_pipeline
from rigflow.llm.bpe_replay import op12_byte_bpe
from rigflow.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from rigflow.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from rigflow.llm.language_id import op2_language_id
from rigflow.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from rigflow.llm.mixing import OP6_SQL, op6_mixing
from rigflow.llm.near_dedup import op4_near_dedup
from rigflow.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from rigflow.llm.recurrent_lm import op5_lm_score
from rigflow.llm.secrets import op9_secrets
from rigflow.llm.sentencepiece_codec import op10_sentencepiece
from rigflow.llm.toxicity import op8_toxicity
from rigflow.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_mixing": op6_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_url_filter": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_mixing": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
