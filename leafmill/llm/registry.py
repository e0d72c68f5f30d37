"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from leafmill.llm import conversations, decontaminate, embeddings, mixing, names, neighbours, sharding, simhash, substrings, tokens, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_decontamination": decontaminate.query,
        "op3_warc": warc.query,
        "op4_sharding": sharding.query,
        "op5_substring_dedup": substrings.query,
        "op6_embedding_near_dedup": embeddings.query,
        "op7_mixing": mixing.query,
        "op8_toxicity": toxicity.query,
        "op9_url_filter": urls.query,
        "op10_token_counts": tokens.query,
        "op11_prefix_trie": conversations.query,
        "op12_nearest_neighbours": neighbours.query,
        "op13_name_join": names.query,
    }


def oracle_sql() -> dict:
    return {
        "op2_decontamination": decontaminate.SQL,
        "op3_warc": warc.SQL,
        "op4_sharding": sharding.SQL,
        "op6_embedding_near_dedup": embeddings.SQL,
        "op7_mixing": mixing.SQL,
        "op11_prefix_trie": conversations.SQL,
        "op13_name_join": names.SQL,
    }
