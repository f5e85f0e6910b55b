"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loomgraph.llm import cascade, chat, classifier, decontam, fixity, jaccard, kdtree, licenses, mixing, rules

QUERIES = {
    "op1_fixity": fixity.op1_fixity,
    "op1_fixity_audit": fixity.op1_fixity_audit,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_kdtree": kdtree.op3_kdtree,
    "op4_perspectives": chat.op4_perspectives,
    "op5_licenses": licenses.op5_licenses,
    "op6_mixing": mixing.op6_mixing,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_quality_classifier": classifier.op8_quality_classifier,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_url_filters": cascade.op10_url_filters,
}

ORACLES = {
    "op1_fixity": fixity.ORACLE,
    "op1_fixity_audit": fixity.AUDIT_ORACLE,
    "op4_perspectives": chat.ORACLE,
    "op5_licenses": licenses.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op9_quality_rules": rules.ORACLE,
    "op10_url_filters": cascade.ORACLE,
}
