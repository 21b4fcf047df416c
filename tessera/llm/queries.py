"""Registered queries of the text operators: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from tessera.llm import ctw, decontaminate, html, langid, linechunks, mixture, quality, shard, simhash, toxicity

QUERIES = {
    "op1_langid": langid.query,
    "op2_mixture": mixture.query,
    "op3_quality": quality.query,
    "op4_ctw": ctw.query,
    "op5_shard": shard.query,
    "op6_linechunks": linechunks.query,
    "op7_toxicity": toxicity.query,
    "op8_simhash": simhash.query,
    "op9_decontaminate": decontaminate.query,
    "op10_html": html.query,
}
ORACLES: dict[str, str] = {
    "op5_shard": shard.ORACLE,
}
