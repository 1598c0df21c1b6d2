"""The corpus operators' queries and, where SQL can express one, its SQL."""

from corrspark.llm.balltree import OP11_SQL, op11_ranked_search
from corrspark.llm.classifier import op12_quality_classifier
from corrspark.llm.decontaminate import op10_decontamination
from corrspark.llm.linededup import op1_line_dedup
from corrspark.llm.lmscore import op6_lm_score
from corrspark.llm.neardup import op4_near_dedup
from corrspark.llm.negatives import OP13_SQL, op13_hard_negatives
from corrspark.llm.packing import op7_packing
from corrspark.llm.pii import op5_personal_data
from corrspark.llm.quality import op3_quality_rules
from corrspark.llm.secrets import op9_secret_scan
from corrspark.llm.suffixdedup import op2_suffix_dedup
from corrspark.llm.urls import op8_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op11_ranked_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}
