"""The operators as queries on the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import manifest, minhash, neighbours, packing, pages, pieces, quality, rules, simhash, spelling, suffixes, token_blocks, token_counts
from strandline.llm.common import ship
from strandline.session import tune


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {
    fn.__name__: _query(fn)
    for fn in (
        token_blocks.op1_token_blocks, neighbours.op2_neighbours, rules.op3_rules, pages.op4_pages, token_counts.op5_token_counts,
        packing.op6_packing, simhash.op7_simhash, quality.op8_quality, pieces.op9_pieces, suffixes.op10_suffix_dedup,
        minhash.op11_minhash, spelling.op12_spelling, manifest.op13_manifest,
    )
}
ORACLES = {"op3_rules": rules.ORACLE, "op11_minhash": minhash.ORACLE, "op12_spelling": spelling.ORACLE, "op13_manifest": manifest.ORACLE}
