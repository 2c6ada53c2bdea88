"""Queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from tabulon.llm import components, linkage, mixing, overlap, packing, pii, splits, survivors
from tabulon.llm.sql import ORACLE

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_splits": splits.p1_splits,
    "p1_split_report": splits.p1_split_report,
    "p1_invariants": splits.p1_invariants,
    "p2_found": overlap.p2_found,
    "p2_overlap_report": overlap.p2_overlap_report,
    "p4_found": survivors.p4_found,
    "p4_survivors": survivors.p4_survivors,
    "p4_filled": survivors.p4_filled,
    "p5_found": linkage.p5_found,
    "p5_links": linkage.p5_links,
    "p6_found": components.p6_found,
    "p6_group_sizes": components.p6_group_sizes,
    "p7_packed": packing.p7_packed,
    "p7_space_report": packing.p7_space_report,
    "p7_invariants": packing.p7_invariants,
    "p8_mix": mixing.p8_mix,
    "p8_share_report": mixing.p8_share_report,
    "p8_invariants": mixing.p8_invariants,
    "p9_found": pii.p9_found,
    "p9_redacted": pii.p9_redacted,
}

__all__ = ["ORACLE", "QUERIES"]
