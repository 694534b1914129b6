"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_decontaminate
from .fingerprints import op5_bottomk_fingerprints
from .grammar import op6_repair_shards
from .licences import op8_license_digests
from .licences import oracle as licence_oracle
from .nearduplicates import op9_minmax_duplicates
from .oracles import OP9, OP10
from .packing import op3_pack_sequences
from .pii import op2_pii_spans
from .quality import op1_pu_quality
from .secrets import op4_entropy_secrets
from .sharding import op7_minimax_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_pii_spans": op2_pii_spans,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_entropy_secrets": op4_entropy_secrets,
    "op5_bottomk_fingerprints": op5_bottomk_fingerprints,
    "op6_repair_shards": op6_repair_shards,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_license_digests": op8_license_digests,
    "op9_minmax_duplicates": op9_minmax_duplicates,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {"op8_license_digests": licence_oracle(), "op9_minmax_duplicates": OP9, "op10_decontaminate": OP10}
