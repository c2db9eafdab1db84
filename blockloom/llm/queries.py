"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op10_benchmark_decontamination
from .jaccard_join import op8_jaccard_join
from .language_id import op2_language_id
from .license_scan import op4_license_scan
from .packing import op5_best_fit_packing
from .preferences import OP9_SQL, op9_preferences
from .quality import op6_quality_rules
from .suffix_dedup import op1_suffix_dedup
from .token_output import op7_token_output
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_language_id,
        op3_toxicity,
        op4_license_scan,
        op5_best_fit_packing,
        op6_quality_rules,
        op7_token_output,
        op8_jaccard_join,
        op9_preferences,
        op10_benchmark_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {"op9_preferences": OP9_SQL}
