"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.bpe import op1_bpe
from quillspark.llm.lm import op4_lm
from quillspark.llm.mixing import op11_mixing
from quillspark.llm.negatives import op13_negatives
from quillspark.llm.oracles import ORACLES
from quillspark.llm.packing import op2_packing
from quillspark.llm.quality import op7_quality
from quillspark.llm.secrets import op8_secrets
from quillspark.llm.simhash import op3_simhash
from quillspark.llm.substring import op5_substring
from quillspark.llm.urlfilter import op10_urlfilter
from quillspark.llm.vectors import op9_embeddings
from quillspark.llm.warc import op6_warc
from quillspark.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_packing, op3_simhash, op4_lm, op5_substring, op6_warc, op7_quality, op8_secrets, op9_embeddings, op10_urlfilter, op11_mixing, op12_whitening, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
