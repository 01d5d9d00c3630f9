"""The training-data operators as registered queries, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from chirpflow.llm.bpe import op2_bpe
from chirpflow.llm.chat_format import OP9_SQL, op9_chat_format
from chirpflow.llm.fingerprint import op10_fingerprint
from chirpflow.llm.jaccard_join import op8_ngram_jaccard
from chirpflow.llm.language_id import op6_language_id
from chirpflow.llm.mixing import op3_mixing
from chirpflow.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from chirpflow.llm.ppm import op4_lm_score
from chirpflow.llm.quality_classifier import op13_quality_classifier
from chirpflow.llm.quality_rules import op1_quality_rules
from chirpflow.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from chirpflow.llm.toxicity import op7_toxicity
from chirpflow.llm.whitening import op11_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_chat_format": op9_chat_format,
    "op10_fingerprint": op10_fingerprint,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_classifier": op13_quality_classifier,
}

SQL = {"op5_substring_dedup": OP5_SQL, "op9_chat_format": OP9_SQL, "op12_periodic_runs": OP12_SQL}
