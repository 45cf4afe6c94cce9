"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from marketloom.llm import fingerprints, hamming, jaccard, langid, licences, merkle, mixing, packing, pieces, secrets, substrings, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_language": langid.op3_language,
    "op4_secrets": secrets.op4_secrets,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_pieces": pieces.op6_pieces,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_substrings": substrings.op8_substrings,
    "op9_neighbours": hamming.op9_neighbours,
    "op10_licences": licences.op10_licences,
    "op11_whitening": whitening.op11_whitening,
    "op12_manifest": merkle.op12_manifest,
    "op13_packing": packing.op13_packing,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op10_licences": licences.ORACLE, "op12_manifest": merkle.oracle()}
