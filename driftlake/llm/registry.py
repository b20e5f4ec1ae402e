"""Queries of the training-data operators, by the names they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlake.llm.bpe import op5_bpe
from driftlake.llm.collocations import OP11_SQL, op11_collocations
from driftlake.llm.decontaminate import OP9_SQL, op9_decontaminate
from driftlake.llm.html_text import op6_html_text
from driftlake.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from driftlake.llm.language_id import op1_language_id
from driftlake.llm.line_dedup import OP4_SQL, op4_line_dedup
from driftlake.llm.quality import op7_quality
from driftlake.llm.sentence_pieces import op13_sentencepiece
from driftlake.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from driftlake.llm.token_alignment import op12_token_alignment
from driftlake.llm.topk import OP10_SQL, op10_topk
from driftlake.llm.warc import OP8_SQL, op8_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_topk": op10_topk,
    "op11_collocations": op11_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_sentencepiece": op13_sentencepiece,
    "pipeline": pipeline,
}

#: DuckDB SQL for those that SQL expresses over whole tables.
SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_topk": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
