"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import op13_filters
from .imatch import op9_imatch
from .langid import op6_langid
from .media import op3_media
from .merkle import op11_manifest
from .mixing import op4_mixing
from .neardup import op7_neardup
from .oracles import oracle_sql
from .pieces import op2_pieces
from .pii import op12_pii
from .quality import op10_quality
from .repeats import op5_repeats
from .toxicity import op1_toxicity
from .urls import op8_urls

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pieces, op3_media, op4_mixing, op5_repeats, op6_langid, op7_neardup, op8_urls, op9_imatch, op10_quality, op11_manifest, op12_pii, op13_filters)}
