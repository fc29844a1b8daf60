"""The queries of the training-data operators, and their SQL where SQL can express them."""

from .chat import chat_call_order, op5_chat
from .collocations import op13_collocations
from .debruijn import op12_debruijn_dedup
from .decontamination import op7_decontamination
from .mixing import op6_mixing
from .oracles import ORACLES
from .quality_mil import op3_quality_mil
from .quality_rules import op2_quality_rules
from .sharding import op1_sharding, shard_growth
from .simhash import op9_simhash
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op10_token_counts
from .toxicity import op8_toxicity
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_mil": op3_quality_mil,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_debruijn_dedup": op12_debruijn_dedup,
    "op13_collocations": op13_collocations,
    "chat_call_order": chat_call_order,
    "shard_growth": shard_growth,
}

__all__ = ["ORACLES", "QUERIES"]
