"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quireflow.llm import chat, fingerprints, licenses, mixing, mtree, neardup, pieces, quality, suffixes, url_filter

QUERIES = {
    "op1_mtree_top_k": mtree.query,
    "op2_mix_sources": mixing.query,
    "op3_license_digests": licenses.query,
    "op4_bagminhash_classes": neardup.query,
    "op5_host_quality": quality.query,
    "op6_url_filter": url_filter.query,
    "op7_perspective_rotation": chat.query,
    "op8_suffix_dedup": suffixes.query,
    "op9_sentencepiece": pieces.query,
    "op10_fingerprint_dedup": fingerprints.query,
}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL expresses on whole tables (4 and 9 are tested otherwise)."""
    return {
        "op1_mtree_top_k": mtree.ORACLE,
        "op2_mix_sources": mixing.ORACLE,
        "op3_license_digests": licenses.oracle(),
        "op5_host_quality": quality.ORACLE,
        "op6_url_filter": url_filter.oracle(),
        "op7_perspective_rotation": chat.ORACLE,
        "op8_suffix_dedup": suffixes.oracle(),
        "op10_fingerprint_dedup": fingerprints.oracle(),
    }
