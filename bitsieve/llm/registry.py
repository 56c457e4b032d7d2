"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitsieve.llm.decontaminate import OP7_SQL, op7_decontaminate
from bitsieve.llm.quality import op1_quality
from bitsieve.llm.simhash import op3_simhash
from bitsieve.llm.tokencount import op9_token_counts
from bitsieve.llm.toxicity import op2_toxicity
from bitsieve.llm.embeddings import OP10_SQL, op10_embeddings
from bitsieve.llm.language import op4_language
from bitsieve.llm.mixing import OP8_SQL, op8_mixing
from bitsieve.llm.substrings import op6_substrings
from bitsieve.llm.tokenbin import op5_token_ids


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_simhash": op3_simhash, "op4_language": op4_language, "op5_token_ids": op5_token_ids, "op6_substrings": op6_substrings, "op7_decontaminate": op7_decontaminate, "op8_mixing": op8_mixing, "op9_token_counts": op9_token_counts, "op10_embeddings": op10_embeddings}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontaminate": OP7_SQL, "op8_mixing": OP8_SQL, "op10_embeddings": OP10_SQL}
