"""The queries of this subpackage: opN_<name>(spark, sf_dir), each over the whole of its tables."""

from __future__ import annotations

from pipelens.llm import chat, gif, langid, line_dedup, lm_scoring, mixing, rabitq, sentencepiece_ops, simhash, warc
from pipelens.llm._shared import table

QUERIES = {
    "op1_lm_scoring": lambda spark, d: lm_scoring.scored(spark, table(spark, d, "documents")),
    "op2_sentencepiece": lambda spark, d: sentencepiece_ops.digests(spark, table(spark, d, "documents")),
    "op3_mixing": lambda spark, d: mixing.placed(spark, table(spark, d, "documents")),
    "op4_chat_format": lambda spark, d: chat.formatted_digest(spark, table(spark, d, "conversations")),
    "op5_gif_media": lambda spark, d: gif.as_media(table(spark, d, "documents")),
    "op6_embedding_near_dedup": lambda spark, d: rabitq.near_dups(table(spark, d, "embeddings")),
    "op7_language_id": lambda spark, d: langid.classify(spark, table(spark, d, "documents")),
    "op8_warc": lambda spark, d: warc.round_trip(spark, table(spark, d, "pages")),
    "op9_simhash": lambda spark, d: simhash.near_dups(spark, table(spark, d, "documents")),
    "op10_line_dedup": lambda spark, d: line_dedup.digest(spark, table(spark, d, "documents")),
}

ORACLE = {
    "op4_chat_format": chat.ORACLE,
    "op6_embedding_near_dedup": rabitq.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
