"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from quillmark.llm.ann import op1_ann
from quillmark.llm.filter_audit import OP13_SQL, op13_filters
from quillmark.llm.jaccard import OP5_SQL, op5_jaccard
from quillmark.llm.language import op11_language
from quillmark.llm.licenses import OP6_SQL, op6_licenses
from quillmark.llm.manifest import OP12_SQL, op12_manifest
from quillmark.llm.mixing import OP10_SQL, op10_mixing
from quillmark.llm.neardup_vectors import OP8_SQL, op8_vectors
from quillmark.llm.packing import op4_packing
from quillmark.llm.pii import op7_pii
from quillmark.llm.pii_sql import OP7_SQL
from quillmark.llm.quality import op2_quality
from quillmark.llm.substrings import OP3_SQL, op3_substrings
from quillmark.llm.warc import OP9_SQL, op9_warc


def queries() -> dict:
    return {
        "op1_ann": op1_ann,
        "op2_quality": op2_quality,
        "op3_substrings": op3_substrings,
        "op4_packing": op4_packing,
        "op5_jaccard": op5_jaccard,
        "op6_licenses": op6_licenses,
        "op7_pii": op7_pii,
        "op8_vectors": op8_vectors,
        "op9_warc": op9_warc,
        "op10_mixing": op10_mixing,
        "op11_language": op11_language,
        "op12_manifest": op12_manifest,
        "op13_filters": op13_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substrings": OP3_SQL,
        "op5_jaccard": OP5_SQL,
        "op6_licenses": OP6_SQL,
        "op7_pii": OP7_SQL,
        "op8_vectors": OP8_SQL,
        "op9_warc": OP9_SQL,
        "op10_mixing": OP10_SQL,
        "op12_manifest": OP12_SQL,
        "op13_filters": OP13_SQL,
    }
