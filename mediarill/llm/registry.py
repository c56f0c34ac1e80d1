"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

import corpus_pipeline

from . import decontaminate, fill_middle, licences, lines, main_text, near_dups, periodic, pieces, quality, token_files, top_k, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_main_text": main_text.op2_main_text,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_files": token_files.op5_token_files,
    "op6_near_dups": near_dups.op6_near_dups,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_exact_top_k": top_k.op9_exact_top_k,
    "op10_quality": quality.op10_quality,
    "op11_licences": licences.op11_licences,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_line_dedup": lines.OP1_SQL,
    "op6_near_dups": near_dups.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_exact_top_k": top_k.OP9_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
}
