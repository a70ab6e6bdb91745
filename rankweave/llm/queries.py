"""The operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from rankweave.llm import contextmix, embedding, mixing, packing, pii, quality, simhash, tokencount, toxicity, urlfilter, vafile, validtime, warc


def queries() -> dict:
    return {
        "op1_language_model": contextmix.op1_language_model,
        "op2_warc_pages": warc.op2_warc_pages,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_personal_data": pii.op4_personal_data,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_embedding_near_duplicates": embedding.op7_embedding_near_duplicates,
        "op8_pack_documents": packing.op8_pack_documents,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_simhash_near_duplicates": simhash.op10_simhash_near_duplicates,
        "op11_vector_codes": vafile.op11_vector_codes,
        "op12_url_filter": urlfilter.op12_url_filter,
        "op13_valid_time_sales": validtime.op13_valid_time_sales,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_pages": warc.ORACLE_SQL,
        "op7_embedding_near_duplicates": embedding.ORACLE_SQL,
        "op9_mix_sources": mixing.ORACLE_SQL,
        "op11_vector_codes": vafile.ORACLE_SQL,
        "op12_url_filter": urlfilter.ORACLE_SQL,
        "op13_valid_time_sales": validtime.ORACLE_SQL,
    }
