"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from rillmill.llm.fingerprints import document_fingerprints
from rillmill.llm.html_extract import extract_html
from rillmill.llm.license_scan import license_scan
from rillmill.llm.line_dedup import MIN_CHARS, dedup_lines
from rillmill.llm.ngram_join import THRESHOLD, similar_documents
from rillmill.llm.packing import pack
from rillmill.llm.quality_bayes import quality_documents
from rillmill.llm.quality_rules import quality_rules
from rillmill.llm.shared import read
from rillmill.llm.source_mixing import PRODUCTION, mix
from rillmill.llm.sql import LICENSE_SQL, MIX_SQL, line_dedup_sql, ngram_join_sql
from rillmill.llm.toxicity import toxic_documents


def op1_license_scan(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents"))


def op2_html_extract(spark, sf_dir):
    return extract_html(read(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_source_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents"), PRODUCTION)
    return out.withColumnsRenamed({"_domain": "domain", "_lang": "lang", "_source": "source", "_epoch": "epoch"})


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(read(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark, sf_dir):
    return document_fingerprints(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_join(spark, sf_dir):
    return similar_documents(read(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op10_quality_bayes(spark, sf_dir):
    return quality_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_html_extract": op2_html_extract,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mixing": op4_source_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_packing": op9_packing,
    "op10_quality_bayes": op10_quality_bayes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": LICENSE_SQL,
    "op4_source_mixing": MIX_SQL,
    "op5_line_dedup": line_dedup_sql(MIN_CHARS),
    "op8_ngram_join": ngram_join_sql(THRESHOLD),
}
