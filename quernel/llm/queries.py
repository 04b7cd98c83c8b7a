"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from quernel.llm.bpe import op4_bpe
from quernel.llm.centroids import ORACLE as OP13
from quernel.llm.centroids import op13_centroids
from quernel.llm.exact_dedup import ORACLE as OP9
from quernel.llm.exact_dedup import op9_exact_dedup
from quernel.llm.html_extraction import ORACLE as OP10
from quernel.llm.html_extraction import op10_html_extraction
from quernel.llm.language_id import op6_language_id
from quernel.llm.media import op7_media_columns
from quernel.llm.merkle import ORACLE as OP11
from quernel.llm.merkle import op11_merkle_manifest
from quernel.llm.ngram_join import ORACLE as OP5
from quernel.llm.ngram_join import op5_ngram_jaccard
from quernel.llm.packing import op12_packing
from quernel.llm.sharding import op8_sharding
from quernel.llm.source_mixing import ORACLE as OP2
from quernel.llm.source_mixing import op2_source_mixing
from quernel.llm.suffix_dedup import ORACLE as OP1
from quernel.llm.suffix_dedup import op1_suffix_array_dedup
from quernel.llm.url_filters import ORACLE as OP3
from quernel.llm.url_filters import op3_url_filters

QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_source_mixing, op3_url_filters, op4_bpe, op5_ngram_jaccard, op6_language_id, op7_media_columns, op8_sharding, op9_exact_dedup, op10_html_extraction, op11_merkle_manifest, op12_packing, op13_centroids)}
ORACLES = {"op1_suffix_array_dedup": OP1, "op2_source_mixing": OP2, "op3_url_filters": OP3, "op5_ngram_jaccard": OP5, "op9_exact_dedup": OP9, "op10_html_extraction": OP10, "op11_merkle_manifest": OP11, "op13_centroids": OP13}
