"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_codec, chat_windows, feistel_shard, imatch, langid_crf, media_copies, mixture, secret_index, simhash_ball, token_store

QUERIES = {
    "op1_imatch": imatch.op1_imatch,
    "op2_bpe_codec": bpe_codec.op2_bpe_codec,
    "op3_feistel_shard": feistel_shard.op3_feistel_shard,
    "op4_simhash_ball": simhash_ball.op4_simhash_ball,
    "op5_token_store": token_store.op5_token_store,
    "op6_secret_index": secret_index.op6_secret_index,
    "op7_langid_crf": langid_crf.op7_langid_crf,
    "op8_mixture": mixture.op8_mixture,
    "op9_media_copies": media_copies.op9_media_copies,
    "op10_chat_windows": chat_windows.op10_chat_windows,
}


def oracles() -> dict[str, str]:
    return {
        "op3_feistel_shard": feistel_shard.oracle_sql(),
        "op6_secret_index": secret_index.oracle_sql(),
        "op10_chat_windows": chat_windows.oracle_sql(),
    }
