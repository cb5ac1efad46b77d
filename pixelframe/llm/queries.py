"""The registered queries of this subpackage and the SQL that stands beside them."""

from pixelframe.llm import (
    centroids, classifier, decontaminate, innerproduct, linedup, negatives, neardup, packing, quality_rules, secrets,
    sitetree, substrings, warc,
)

QUERIES = {
    "op1_suffix_dedup": substrings.query,
    "op2_packing": packing.query,
    "op3_line_dedup": linedup.query,
    "op4_quality_rules": quality_rules.query,
    "op5_warc": warc.query,
    "op6_decontamination": decontaminate.query,
    "op7_quality_classifier": classifier.query,
    "op8_near_duplicates": neardup.query,
    "op9_html_extraction": sitetree.query,
    "op10_secret_scan": secrets.query,
    "op11_hard_negatives": negatives.query,
    "op12_inner_products": innerproduct.query,
    "op13_centroid_clustering": centroids.query,
}

ORACLES = {
    "op3_line_dedup": linedup.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_inner_products": innerproduct.ORACLE,
    "op13_centroid_clustering": centroids.ORACLE,
}
