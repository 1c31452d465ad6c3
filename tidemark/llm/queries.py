"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import collocations, licenses, secrets, topk, urls
from .alignment import op11_alignment
from .collocations import op13_collocations
from .decontamination import op7_decontamination
from .licenses import op6_licenses
from .mixing import op5_mixing
from .neardup import op8_simhash
from .quality import op9_quality
from .rules import op12_rules
from .secrets import op2_secrets
from .sharding import op1_sharding
from .topk import op3_topk
from .toxicity import op4_toxicity
from .urls import op10_urls

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secrets": op2_secrets,
    "op3_topk": op3_topk,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_urls": op10_urls,
    "op11_alignment": op11_alignment,
    "op12_rules": op12_rules,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op2_secrets": secrets.ORACLE,
    "op3_topk": topk.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op10_urls": urls.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
