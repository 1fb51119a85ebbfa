"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, mixing, substrings, warc
from .alignment import op11_token_alignment
from .chat import op13_chat
from .extract import op9_main_text
from .jaccard import op3_near_copies
from .media import op2_media
from .mixing import op4_mix
from .packing import op7_best_fit
from .pii import op10_pii
from .quality import op5_robust_outliers
from .repair import op12_repair
from .substrings import op6_repeated_passages
from .token_store import op1_token_store
from .warc import op8_warc

QUERIES = (
    op1_token_store, op2_media, op3_near_copies, op4_mix, op5_robust_outliers, op6_repeated_passages, op7_best_fit, op8_warc, op9_main_text, op10_pii,
    op11_token_alignment, op12_repair, op13_chat,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_copies": jaccard.OP3_SQL, "op4_mix": mixing.OP4_SQL, "op6_repeated_passages": substrings.OP6_SQL, "op8_warc": warc.OP8_SQL, "op13_chat": chat.OP13_SQL}
