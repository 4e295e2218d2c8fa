"""The registered queries of this subpackage. Those without SQL are not expressible in it whole; they are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import merkle, quality
from .additive import op4_additive
from .align import op13_align
from .language import op7_language
from .licenses import op9_licenses
from .merkle import op12_merkle
from .minhash import op3_minhash
from .mixing import op10_mixing
from .packing import op1_packing
from .pq import op5_pq
from .quality import op11_quality
from .secrets import op6_secrets
from .toxicity import op2_toxicity
from .warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_packing, op2_toxicity, op3_minhash, op4_additive, op5_pq, op6_secrets, op7_language, op8_warc, op9_licenses, op10_mixing, op11_quality, op12_merkle, op13_align)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op11_quality": quality.ORACLE, "op12_merkle": merkle.ORACLE}
