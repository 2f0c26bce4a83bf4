"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audio import op1_audio_features
from .decontaminate import OP5_SQL, op5_decontamination
from .language import op9_language
from .near_dup import op3_near_duplicates
from .packing import op10_best_fit_packing
from .quality import op6_quality
from .secrets import op2_secret_scan
from .token_counts import op8_token_counts
from .token_files import op7_token_files
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_secret_scan": op2_secret_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": OP4_SQL,
    "op5_decontamination": OP5_SQL,
}
