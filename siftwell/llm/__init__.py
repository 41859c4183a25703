"""Operators for corpora of language-model training data, and their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fill_in_middle import op11_fill_in_middle
from .language_id import op1_language_id
from .mixing import op10_pareto_mixing
from .neardup import op4_minhash_near_dedup
from .oracles import ORACLES
from .packing import op8_best_fit_packing
from .pii import op5_weak_supervision_pii
from .search import op6_block_max_wand
from .secret_ledger import op7_secret_ledger
from .sharding import op2_histogram_sort
from .syncmers import op9_closed_syncmers
from .token_store import op12_shared_dictionary_ids
from .warc import op3_warc_bundles
from .whitening import op13_tsqr_whitening

_QUERIES = (op1_language_id, op2_histogram_sort, op3_warc_bundles, op4_minhash_near_dedup, op5_weak_supervision_pii, op6_block_max_wand, op7_secret_ledger, op8_best_fit_packing, op9_closed_syncmers, op10_pareto_mixing, op11_fill_in_middle, op12_shared_dictionary_ids, op13_tsqr_whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force."""
    return dict(ORACLES)
