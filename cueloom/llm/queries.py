"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import licenses, mixing
from .bpe import op9_bpe_round_trip
from .language_id import op10_language_id
from .licenses import op7_license_scan
from .mixing import op4_temperature_mixing
from .ngram_join import op5_ngram_join
from .order_minhash import op3_order_minhash
from .pii import op8_pii
from .progressive_jpeg import op1_media_jpeg
from .token_counts import op2_token_counts
from .toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_jpeg": op1_media_jpeg,
        "op2_token_counts": op2_token_counts,
        "op3_order_minhash": op3_order_minhash,
        "op4_temperature_mixing": op4_temperature_mixing,
        "op5_ngram_join": op5_ngram_join,
        "op6_toxicity": op6_toxicity,
        "op7_license_scan": op7_license_scan,
        "op8_pii": op8_pii,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_language_id": op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_temperature_mixing": mixing.ORACLE, "op7_license_scan": licenses.ORACLE}
