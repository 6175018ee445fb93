"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmd.llm import centroids, decontaminate, merkle, neardup, urlfilter, warc
from docmd.llm.centroids import op13_sort_means
from docmd.llm.decontaminate import op8_decontaminate
from docmd.llm.langid import op1_langid
from docmd.llm.linedup import op4_line_dedup
from docmd.llm.media import op6_media
from docmd.llm.merkle import op11_merkle
from docmd.llm.neardup import op9_near_duplicates
from docmd.llm.ngramlm import op7_lm_score
from docmd.llm.piecebpe import op10_sentencepiece
from docmd.llm.tokencount import op5_token_counts
from docmd.llm.toxicity import op2_toxicity
from docmd.llm.urlfilter import op12_url_filter
from docmd.llm.warc import op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_langid, op2_toxicity, op3_warc, op4_line_dedup, op5_token_counts, op6_media, op7_lm_score, op8_decontaminate, op9_near_duplicates, op10_sentencepiece, op11_merkle, op12_url_filter, op13_sort_means)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL, "op9_near_duplicates": neardup.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_url_filter": urlfilter.ORACLE_SQL, "op13_sort_means": centroids.ORACLE_SQL}
