"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from prefloom.llm.chat import op3_chat_formatting, op3_typed_parts
from prefloom.llm.fingerprints import op1_fingerprints
from prefloom.llm.licenses import op9_license_scan
from prefloom.llm.lines import op8_line_dedup, op8_line_members
from prefloom.llm.mixing import op10_mixing
from prefloom.llm.packing import op2_packing
from prefloom.llm.phrases import op11_phrases
from prefloom.llm.quality import op6_quality_rules
from prefloom.llm.recompress import op7_substring_dedup
from prefloom.llm.simhash import op5_simhash
from prefloom.llm.tokens import op4_token_counts
from prefloom.llm.variants import op12_variants
from prefloom.llm.wrappers import op13_main_text

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op3_typed_parts": op3_typed_parts,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op8_line_members": op8_line_members,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_phrases": op11_phrases,
    "op12_variants": op12_variants,
    "op13_main_text": op13_main_text,
}

ORACLE_SQL = {}
