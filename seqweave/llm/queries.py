"""The subpackage's queries and their SQL, by name."""

from seqweave.llm import decontaminate, hmm, html, mixing, sharding, simhash, topk, toolcalls, toxicity, urlfilter

MODULES = {
    "op1_html_extraction": html,
    "op2_lm_scoring": hmm,
    "op3_mixing": mixing,
    "op4_exact_topk": topk,
    "op5_toxicity": toxicity,
    "op6_sharding": sharding,
    "op7_decontamination": decontaminate,
    "op8_simhash": simhash,
    "op9_chat_formatting": toolcalls,
    "op10_url_filters": urlfilter,
}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: m.query for k, m in MODULES.items()} | {"pipeline": pipeline}


def oracle_sql():
    return {k: m.ORACLE for k, m in MODULES.items() if hasattr(m, "ORACLE")}
