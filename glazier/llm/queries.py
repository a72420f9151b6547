"""The package's named queries: (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from glazier.llm import hard_negatives
from glazier.llm.byte_bpe import op13_byte_bpe
from glazier.llm.embedding_dedup import op10_e8_near_duplicates
from glazier.llm.fingerprints import op7_imatch_fingerprints
from glazier.llm.hard_negatives import op11_onebit_hard_negatives
from glazier.llm.html_extraction import op5_tag_path_ratios
from glazier.llm.mixing import op4_ipf_mixing
from glazier.llm.ngram_join import op3_set_relation_join
from glazier.llm.packing import op9_ffd_packing
from glazier.llm.periodic_runs import op12_periodic_runs
from glazier.llm.quotation_linking import op1_quotation_linking
from glazier.llm.sharding import op8_jump_sharding
from glazier.llm.token_counts import op2_trie_token_counts
from glazier.llm.toxicity import op6_toxic_lexicon

QUERIES = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_trie_token_counts": op2_trie_token_counts,
    "op3_set_relation_join": op3_set_relation_join,
    "op4_ipf_mixing": op4_ipf_mixing,
    "op5_tag_path_ratios": op5_tag_path_ratios,
    "op6_toxic_lexicon": op6_toxic_lexicon,
    "op7_imatch_fingerprints": op7_imatch_fingerprints,
    "op8_jump_sharding": op8_jump_sharding,
    "op9_ffd_packing": op9_ffd_packing,
    "op10_e8_near_duplicates": op10_e8_near_duplicates,
    "op11_onebit_hard_negatives": op11_onebit_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {"op11_onebit_hard_negatives": hard_negatives.ORACLE_SQL}
