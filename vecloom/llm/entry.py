"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from vecloom.llm import decontaminate, line_dedup, ngram_join
from vecloom.llm.bpe_codec import op10_bpe_codec
from vecloom.llm.decontaminate import op6_decontaminate
from vecloom.llm.hmm_lm import op9_hmm_lm
from vecloom.llm.line_dedup import op4_line_dedup
from vecloom.llm.media import op3_media
from vecloom.llm.ngram_join import op2_ngram_join
from vecloom.llm.pii import op8_pii
from vecloom.llm.token_count import op5_token_count
from vecloom.llm.token_output import op1_token_output
from vecloom.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_token_output, op2_ngram_join, op3_media, op4_line_dedup, op5_token_count, op6_decontaminate, op7_toxicity, op8_pii, op9_hmm_lm, op10_bpe_codec)
}
ORACLES = {"op2_ngram_join": ngram_join.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op6_decontaminate": decontaminate.ORACLE}
