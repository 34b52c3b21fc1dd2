"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from soundrows.llm import (
    alignment, decontaminate, minhash, mixing, packing, pii, quality, secrets, spelling, sql, suffixes, tokens,
    urlfilter, warc,
)
from soundrows.queries.register import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query of the subpackage, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


@query("op1_decontaminate", sql.DECONTAMINATE)
def op1_decontaminate(spark, folder):
    documents, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.digest(decontaminate.contamination(documents, benchmark))


@query("op7_secret_scan")
def op7_secret_scan(spark, folder):
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


@query("op9_quality_rules", sql.QUALITY)
def op9_quality_rules(spark, folder):
    return quality.digest(quality.judged(table(spark, folder, "documents")))


@query("op8_mix_sources", sql.MIX)
def op8_mix_sources(spark, folder):
    return mixing.mixed(table(spark, folder, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark, folder):
    return tokens.context_limits(tokens.histogram(table(spark, folder, "documents")))


@query("op6_url_filter", sql.URLS)
def op6_url_filter(spark, folder):
    pages = table(spark, folder, "pages")
    return urlfilter.judged(pages, urlfilter.RULES, urlfilter.keys_on_hosts(pages))


@query("op3_warc", sql.WARC)
def op3_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query("op10_minhash_dedup", sql.NEAR_DUPLICATES)
def op10_minhash_dedup(spark, folder):
    return minhash.judged(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


@query("op5_suffix_dedup", sql.SUFFIXES)
def op5_suffix_dedup(spark, folder):
    return suffixes.digest(suffixes.deduplicated(table(spark, folder, "documents")))


@query("op4_pii_surrogates")
def op4_pii_surrogates(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymized(documents, key="surrogates of the registered query")


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark, folder):
    return packing.digest(packing.pieces(table(spark, folder, "documents")))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, folder):
    return spelling.forms(spelling.vocabulary(table(spark, folder, "documents")))


@query("op13_token_alignment")
def op13_token_alignment(spark, folder):
    return alignment.digest(alignment.aligned(table(spark, folder, "documents")))
