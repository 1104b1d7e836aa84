"""Bundled subtype specifications of the header-described format."""

from __future__ import annotations

# Key -> (adherence, headers, columns).
SUBTYPES: dict[str, tuple[str, dict[str, str], str]] = {
    "bed3": ("extensible", {"track type": "segments", "uninterrupted data lines": "true"}, "seqid start end"),
    "bed4": ("extensible", {"track type": "segments", "uninterrupted data lines": "true"}, "seqid start end name"),
    "bed5": ("extensible", {"track type": "valued segments", "uninterrupted data lines": "true"}, "seqid start end name value"),
    "bed6": ("extensible", {"track type": "valued segments", "uninterrupted data lines": "true"}, "seqid start end name value strand"),
    "bed9": ("extensible", {"track type": "valued segments", "uninterrupted data lines": "true"},
             "seqid start end name value strand thickstart thickend itemrgb"),
    "bed_direct": ("extensible", {"track type": "valued segments", "uninterrupted data lines": "true"},
                   "seqid start end name value strand thickstart thickend itemrgb blockcount blocksizes blockstarts"),
    "bed_linked": ("extensible", {"track type": "linked valued segments", "uninterrupted data lines": "true"},
                   "seqid start end name value strand thickstart thickend itemrgb edges"),
    "bedgraph": ("strict", {"track type": "valued segments", "value type": "number", "value dimension": "scalar", "uninterrupted data lines": "true"},
                 "seqid start end value"),
    "fasta": ("strict", {"track type": "function", "value type": "character", "fixed-size data lines": "true", "data line size": "1"}, "value"),
    "gff_ad_hoc": ("redefinable", {"track type": "linked valued segments", "value type": "category", "1-indexed": "true", "end inclusive": "true"},
                   "source value start end score strand phase id name edges"),
    "gff_direct": ("redefinable", {"track type": "valued segments", "value type": "number", "1-indexed": "true", "end inclusive": "true"},
                   "seqid source type start end value strand phase attributes"),
    "gff_direct_low": ("redefinable", {"track type": "valued segments", "value type": "number"},
                       "seqid source type start end value strand phase attributes"),
    "mean_sd": ("reorderable", {"value type": "number", "value dimension": "pair"}, "value"),
    "mean_sd_weights": ("reorderable", {"edge weights": "true", "edge weight type": "number", "edge weight dimension": "pair"}, "edges"),
    "shortreads_example": ("redefinable", {"track type": "segments"}, "seqid start end strand read quality"),
    "wig_fixedstep": ("strict", {"value type": "number", "value dimension": "scalar", "1-indexed": "true", "end inclusive": "true"}, "value"),
    "wig_fixedstep_low": ("strict", {"value type": "number", "value dimension": "scalar"}, "value"),
    "wig_variablestep": ("strict", {"value type": "number", "value dimension": "scalar", "1-indexed": "true", "end inclusive": "true"}, "start value"),
    "wig_variablestep_low": ("strict", {"value type": "number", "value dimension": "scalar"}, "start value"),
}


def find(url: str) -> tuple[str, dict[str, str], list[str]] | None:
    """Subtype by the last part of its address; nothing is fetched from a network."""
    key = url.rstrip("/").rpartition("/")[2].partition(".")[0].lower()
    if key not in SUBTYPES:
        return None
    adherence, headers, columns = SUBTYPES[key]
    return adherence, headers, columns.split()
