"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from framelake.llm.ann import op5_neighbours
from framelake.llm.cover_tree import OP11_SQL, op11_cover_tree
from framelake.llm.decontaminate import OP10_SQL, op10_decontaminate
from framelake.llm.filter_audit import OP13_SQL, op13_filter_audit
from framelake.llm.language import op9_language
from framelake.llm.lm_score import op6_lm_score
from framelake.llm.mixing import OP4_SQL, op4_mix
from framelake.llm.neardup import op7_near_duplicates
from framelake.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from framelake.llm.substring import OP1_SQL, op1_substring
from framelake.llm.suffix import OP2_SQL, op2_suffix
from framelake.llm.tokens import op3_tokens
from framelake.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_substring": op1_substring,
    "op2_suffix": op2_suffix,
    "op3_tokens": op3_tokens,
    "op4_mix": op4_mix,
    "op5_neighbours": op5_neighbours,
    "op6_lm_score": op6_lm_score,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_decontaminate": op10_decontaminate,
    "op11_cover_tree": op11_cover_tree,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}
SQL = {"op1_substring": OP1_SQL, "op2_suffix": OP2_SQL, "op4_mix": OP4_SQL, "op8_warc": OP8_SQL, "op10_decontaminate": OP10_SQL, "op11_cover_tree": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
