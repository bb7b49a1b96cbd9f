"""The folder's queries and their SQL twins, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wardwatch.llm.exact import OP9_SQL, op9_exact_dedup
from wardwatch.llm.leaks import OP11_SQL, op11_benchmark_decontamination
from wardwatch.llm.licences import OP8_SQL, op8_license_rules
from wardwatch.llm.mixing import OP6_SQL, op6_source_mix
from wardwatch.llm.packing import op10_best_fit_packing
from wardwatch.llm.periods import op12_periodic_runs
from wardwatch.llm.quality import op5_quality_classifier
from wardwatch.llm.simhash import op4_simhash
from wardwatch.llm.tokencount import op7_token_counts
from wardwatch.llm.urls import op2_url_filter
from wardwatch.llm.vectors import OP3_SQL, op3_embedding_pigeonhole
from wardwatch.llm.warc import OP1_SQL, op1_warc_salvage
from wardwatch.llm.whitening import op13_embedding_whitening


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_salvage, op2_url_filter, op3_embedding_pigeonhole, op4_simhash, op5_quality_classifier, op6_source_mix,
        op7_token_counts, op8_license_rules, op9_exact_dedup, op10_best_fit_packing,
        op11_benchmark_decontamination, op12_periodic_runs, op13_embedding_whitening, pipeline,
    )
}
ORACLES = {
    "op1_warc_salvage": OP1_SQL, "op3_embedding_pigeonhole": OP3_SQL, "op6_source_mix": OP6_SQL, "op8_license_rules": OP8_SQL,
    "op9_exact_dedup": OP9_SQL, "op11_benchmark_decontamination": OP11_SQL,
}
