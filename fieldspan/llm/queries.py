"""The subpackage's queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP3_SQL, op3_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .jaccard_join import op5_jaccard_join
from .language_id import op1_language_id
from .piece_lattice import op6_piece_lattice
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op7_token_counts
from .token_files import op9_token_files
from .topk_search import OP2_SQL, op2_topk_search
from .url_filter import op8_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_topk_search": op2_topk_search,
        "op3_chat_format": op3_chat_format,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_piece_lattice": op6_piece_lattice,
        "op7_token_counts": op7_token_counts,
        "op8_url_filter": op8_url_filter,
        "op9_token_files": op9_token_files,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": OP2_SQL, "op3_chat_format": OP3_SQL, "op10_decontaminate": OP10_SQL}
