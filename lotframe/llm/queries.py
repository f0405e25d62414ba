"""The registered queries of this subpackage, and the SQL of those that can be stated in SQL as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op2_spaced_seeds
from .html import op6_tree_scores
from .language import op10_language_profiles
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL, op13_line_dedup
from .mixing import op1_mix_sources
from .near_duplicates import op9_simhash_components
from .periodic_runs import op11_periodic_runs
from .quality import op7_quality_outliers
from .secrets import op4_guess_cost_secrets
from .sharding import op8_hilbert_shards
from .spelling import op12_permuterm_variants
from .substring_dedup import op3_relative_parsing
from .token_files import op5_token_files

_ALL = (
    op1_mix_sources,
    op2_spaced_seeds,
    op3_relative_parsing,
    op4_guess_cost_secrets,
    op5_token_files,
    op6_tree_scores,
    op7_quality_outliers,
    op8_hilbert_shards,
    op9_simhash_components,
    op10_language_profiles,
    op11_periodic_runs,
    op12_permuterm_variants,
    op13_line_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {query.__name__: query for query in _ALL}
ORACLES: dict[str, str] = {op13_line_dedup.__name__: LINE_DEDUP_SQL}
