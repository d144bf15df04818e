"""The queries of this subpackage and their DuckDB counterparts."""

from . import licences, mixing, packing, quality, quotes, sharding, simhash, tokens, urls, vectors

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_ring_shards": sharding.op4_ring_shards,
    "op5_licences": licences.op5_licences,
    "op6_packing": packing.op6_packing,
    "op7_url_templates": urls.op7_url_templates,
    "op8_quotations": quotes.op8_quotations,
    "op9_near_vectors": vectors.op9_near_vectors,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op7_url_templates": urls.OP7_SQL,
    "op8_quotations": quotes.OP8_SQL,
    "op9_near_vectors": vectors.OP9_SQL,
    "op10_quality": quality.OP10_SQL,
}
