"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm.chat import OP8_SQL, op8_chat_grammar
from tessera.llm.collocations import OP12_SQL, op12_phrase_collocations
from tessera.llm.decontam import op10_decontaminate_lsa
from tessera.llm.langid import op4_language_viterbi
from tessera.llm.maxscore import OP13_SQL, op13_maxscore_search
from tessera.llm.mixing import op2_mix_sources
from tessera.llm.periodic import op11_periodic_runs
from tessera.llm.pii import op9_personal_data
from tessera.llm.resample import op1_importance_resampling
from tessera.llm.simhash import op3_simhash_golay
from tessera.llm.tokens import op6_token_binary
from tessera.llm.toxicity import op5_toxicity_segments
from tessera.llm.vptree import op7_vantage_point_trees

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash_golay": op3_simhash_golay,
    "op4_language_viterbi": op4_language_viterbi,
    "op5_toxicity_segments": op5_toxicity_segments,
    "op6_token_binary": op6_token_binary,
    "op7_vantage_point_trees": op7_vantage_point_trees,
    "op8_chat_grammar": op8_chat_grammar,
    "op9_personal_data": op9_personal_data,
    "op10_decontaminate_lsa": op10_decontaminate_lsa,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_maxscore_search": op13_maxscore_search,
}
ORACLE_SQL: dict[str, str] = {
    "op8_chat_grammar": OP8_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_maxscore_search": OP13_SQL,
}
