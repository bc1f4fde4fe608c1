"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from tidefold.llm import audio, chat, fingerprints, minhash, packing, pieces, quality, substring_dedup, url_filters, warc

QUERIES = {
    "op1_url_filters": url_filters.op1,
    "op10_document_fingerprints": fingerprints.op10,
    "op2_minhash_near_dedup": minhash.op2,
    "op4_packing": packing.op4,
    "op3_warc": warc.op3,
    "op5_sentencepiece": pieces.op5,
    "op6_quality_classifier": quality.op6,
    "op7_chat_formatting": chat.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_telephony_audio": audio.op9,
}
SQL = {
    "op7_chat_formatting": chat.OP7_SQL,
    "op3_warc": warc.OP3_SQL,
    "op1_url_filters": url_filters.OP1_SQL,
    "op2_minhash_near_dedup": minhash.OP2_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
}
