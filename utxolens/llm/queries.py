"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import mixing, warc
from .alignment import op12_cross_tokenizer_alignment
from .language import op5_language_id
from .mixing import op10_mix_sources
from .packing import op2_harmonic_packing
from .pii import op6_personal_data
from .quality import op9_quality
from .runs import op13_periodic_runs
from .simhash import op1_simhash_near_dedup
from .tokenstore import op4_token_shards
from .toxicity import op7_toxicity
from .vectors import op3_embedding_near_dedup, op8_nearest_neighbours
from .warc import op11_warc_chunks

QUERIES = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_harmonic_packing, op3_embedding_near_dedup, op4_token_shards, op5_language_id, op6_personal_data, op7_toxicity, op8_nearest_neighbours, op9_quality, op10_mix_sources, op11_warc_chunks, op12_cross_tokenizer_alignment, op13_periodic_runs)
}
SQL: dict[str, str] = {"op10_mix_sources": mixing.SQL, "op11_warc_chunks": warc.SQL}
