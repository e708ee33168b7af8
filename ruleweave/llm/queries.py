"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from ruleweave.llm import mixing, url_filter
from ruleweave.llm.decontaminate import op6_decontamination
from ruleweave.llm.html_text import op5_html_extraction
from ruleweave.llm.language import op1_language_id
from ruleweave.llm.media import op7_media_columns
from ruleweave.llm.mixing import op10_mixing
from ruleweave.llm.quality import op9_quality_classifier
from ruleweave.llm.simhash import op8_simhash_near_dedup
from ruleweave.llm.substrings import op4_substring_dedup
from ruleweave.llm.url_filter import op2_url_filters
from ruleweave.llm.wavelet import op3_token_output

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_token_output": op3_token_output,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_media_columns": op7_media_columns,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": url_filter.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
