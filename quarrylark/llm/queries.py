"""The operators' queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from quarrylark.llm import decontaminate, filter_audit, languages, licenses, minhash, packing, pii, quality, repair, substrings, urls, vector_packing, vectors

QUERIES = {
    "op1_licenses": licenses.op1,
    "op2_pii": pii.op2,
    "op3_substrings": substrings.op3,
    "op4_languages": languages.op4,
    "op5_packing": packing.op5,
    "op6_urls": urls.op6,
    "op7_quality": quality.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_vectors": vectors.op9,
    "op10_minhash": minhash.op10,
    "op11_vectors_packed": vector_packing.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_repair": repair.op13,
}

ORACLE_SQL = {
    "op1_licenses": licenses.SQL,
    "op6_urls": urls.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_vectors": vectors.SQL,
    "op10_minhash": minhash.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_repair": repair.SQL,
}
