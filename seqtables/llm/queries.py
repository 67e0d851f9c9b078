"""The queries of this package and the SQL of those that SQL can express."""

from seqtables.llm import (
    byte_pairs,
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    mixing,
    near_dedup,
    resampling,
    secrets,
    subword,
    token_files,
    urls,
    whitening,
)

QUERIES = {
    "op4_token_counts": token_files.op4_token_counts,
    "op10_subword_score": subword.op10_subword_score,
    "op3_url_filter": urls.op3_url_filter,
    "op1_language_id": language.op1_language_id,
    "op2_secrets": secrets.op2_secrets,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_resampling": resampling.op12_resampling,
    "op13_byte_pairs": byte_pairs.op13_byte_pairs,
}

ORACLES = {
    "op3_url_filter": urls.OP3_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_resampling": resampling.OP12_SQL,
}
