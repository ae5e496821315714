"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .embedding_dedup import op3_embeddings
from .fill_middle import op11_fill_middle
from .html_text import op12_html_text
from .lexical_search import op13_search
from .lm_scoring import op1_lm
from .minhash_dedup import op5_minhash
from .mixing import op2_mixing
from .oracle import ORACLE
from .quality import op8_quality
from .secrets import op9_secrets
from .sharding import op10_sharding
from .toxicity import op7_toxicity
from .url_filter import op6_urls

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_lm": op1_lm,
    "op2_mixing": op2_mixing,
    "op3_embeddings": op3_embeddings,
    "op4_decontamination": op4_decontamination,
    "op5_minhash": op5_minhash,
    "op6_urls": op6_urls,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_fill_middle": op11_fill_middle,
    "op12_html_text": op12_html_text,
    "op13_search": op13_search,
}
