"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from . import licenses, minhash, mixing, pieces, quality, search, tokenfile, toxicity, vectors, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_quality": quality.op2_quality,
    "op3_tokens": tokenfile.op3_tokens,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_search": search.op5_search,
    "op6_warc": warc.op6_warc,
    "op7_vectors": vectors.op7_vectors,
    "op8_licenses": licenses.op8_licenses,
    "op9_minmax": minhash.op9_minmax,
    "op10_pieces": pieces.op10_pieces,
}

ORACLE_SQL = {
    "op1_mix": mixing.ORACLE,
    "op5_search": search.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_vectors": vectors.ORACLE,
    "op9_minmax": minhash.ORACLE,
}
