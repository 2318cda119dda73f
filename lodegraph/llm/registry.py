"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .html_text import op9_consensus_html
from .licenses import op4_dice_license_scan
from .mixing import op8_sainte_lague_mixing
from .near_dedup import op6_tensored_minhash_dedup
from .neighbours import op2_projected_neighbours
from .packing import op1_nnls_packing
from .quality_classifier import op10_rule_ensemble_quality
from .quality_rules import op7_mcd_quality_rules
from .sharding import op3_rendezvous_sharding
from .warc import op5_warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_projected_neighbours": op2_projected_neighbours,
    "op3_rendezvous_sharding": op3_rendezvous_sharding,
    "op4_dice_license_scan": op4_dice_license_scan,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_tensored_minhash_dedup": op6_tensored_minhash_dedup,
    "op7_mcd_quality_rules": op7_mcd_quality_rules,
    "op8_sainte_lague_mixing": op8_sainte_lague_mixing,
    "op9_consensus_html": op9_consensus_html,
    "op10_rule_ensemble_quality": op10_rule_ensemble_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_round_trip": oracles.WARC,
    "op6_tensored_minhash_dedup": oracles.DEDUP,
    "op8_sainte_lague_mixing": oracles.MIXING,
}
