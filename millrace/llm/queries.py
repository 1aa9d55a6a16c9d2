"""The registered queries of this subpackage, and SQL for those that SQL can express.

None is given for op1 (the offset is drawn by a keyed hash), op2, op7, op8 and op9 (columns of the method), op3 (a trained
model), op5 (a tokenizer) and the pipeline (both); tests hold these against brute force, round trips or held-out labels.
"""

from __future__ import annotations

import corpus_pipeline
from millrace.llm.decontamination import OP10_SQL, op10_decontamination
from millrace.llm.embeddings import op7_embedding_duplicates
from millrace.llm.licenses import op2_license_scan
from millrace.llm.mixing import op1_mixing
from millrace.llm.near_duplicates import OP4_SQL, op4_near_duplicates
from millrace.llm.pii import op9_pii
from millrace.llm.secret_scans import op8_secret_scan
from millrace.llm.tokens import op5_token_files
from millrace.llm.toxicity import op3_toxicity
from millrace.llm.urls import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_files": op5_token_files,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_duplicates": op7_embedding_duplicates,
    "op8_secret_scan": op8_secret_scan,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op4_near_duplicates": OP4_SQL, "op6_url_filter": OP6_SQL, "op10_decontamination": OP10_SQL}
