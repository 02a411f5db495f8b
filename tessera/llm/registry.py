"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.ann import op3_rotated_codes
from tessera.llm.imatch import OP10_SQL, op10_imatch
from tessera.llm.language import op8_language_id
from tessera.llm.maxent import op5_hashed_maxent
from tessera.llm.mixing import OP7_SQL, op7_curriculum_mix
from tessera.llm.packing import op2_best_fit_packing
from tessera.llm.quality import op4_pu_quality
from tessera.llm.sharding import op6_ring_shards
from tessera.llm.simhash import op1_simhash
from tessera.llm.warc import OP9_SQL, op9_capture_histories

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash": op1_simhash,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_rotated_codes": op3_rotated_codes,
    "op4_pu_quality": op4_pu_quality,
    "op5_hashed_maxent": op5_hashed_maxent,
    "op6_ring_shards": op6_ring_shards,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_language_id": op8_language_id,
    "op9_capture_histories": op9_capture_histories,
    "op10_imatch": op10_imatch,
}
ORACLE_SQL: dict[str, str] = {"op7_curriculum_mix": OP7_SQL, "op9_capture_histories": OP9_SQL, "op10_imatch": OP10_SQL}
