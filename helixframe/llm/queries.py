"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from helixframe.llm import decontaminate, jaccard, language, licenses, lines, media, mixing, packing, periodic, search, secrets, substrings, vectors

QUERIES = {
    "op1_media_chunks": media.op1_media_chunks,
    "op2_secret_ledger": secrets.op2_secret_ledger,
    "op3_cross_polytope": vectors.op3_cross_polytope,
    "op4_language_mixture": language.op4_language_mixture,
    "op5_pack_dp": packing.op5_pack_dp,
    "op6_token_groups": jaccard.op6_token_groups,
    "op7_suffix_buckets": substrings.op7_suffix_buckets,
    "op8_line_alignment": lines.op8_line_alignment,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_license_dice": licenses.op10_license_dice,
    "op11_prefix_join": decontaminate.op11_prefix_join,
    "op12_block_max": search.op12_block_max,
    "op13_scale_tiles": periodic.op13_scale_tiles,
}
ORACLES = {
    "op2_secret_ledger": secrets.ORACLE,
    "op3_cross_polytope": vectors.ORACLE,
    "op6_token_groups": jaccard.ORACLE,
    "op7_suffix_buckets": substrings.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op10_license_dice": licenses.ORACLE,
    "op11_prefix_join": decontaminate.ORACLE,
    "op12_block_max": search.ORACLE,
    "op13_scale_tiles": periodic.ORACLE,
}
