"""Queries and SQL of this folder, by the names that the entry file lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_cnn, decontam, dual_tree, fixity, langid, lattice, manifest, ngram_join, packing, quality, secrets, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_ftrl": lambda spark, sf_dir: toxicity.query(spark, sf_dir),
        "op2_decontamination": lambda spark, sf_dir: decontam.query(spark, sf_dir),
        "op3_language_svm": lambda spark, sf_dir: langid.query(spark, sf_dir),
        "op4_sharding": lambda spark, sf_dir: sharding.query(spark, sf_dir),
        "op5_secret_guess_cost": lambda spark, sf_dir: secrets.query(spark, sf_dir),
        "op6_lattice_likelihood": lambda spark, sf_dir: lattice.query(spark, sf_dir),
        "op7_ngram_join": lambda spark, sf_dir: ngram_join.query(spark, sf_dir),
        "op8_fixity_audit": lambda spark, sf_dir: fixity.query(spark, sf_dir),
        "op9_packing": lambda spark, sf_dir: packing.query(spark, sf_dir),
        "op10_quality_ledger": lambda spark, sf_dir: quality.query(spark, sf_dir),
        "op11_dual_tree": lambda spark, sf_dir: dual_tree.query(spark, sf_dir),
        "op12_merkle_manifest": lambda spark, sf_dir: manifest.query(spark, sf_dir),
        "op13_byte_cnn": lambda spark, sf_dir: byte_cnn.query(spark, sf_dir),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.SQL, "op7_ngram_join": ngram_join.SQL, "op8_fixity_audit": fixity.SQL, "op10_quality_ledger": quality.SQL, "op11_dual_tree": dual_tree.SQL, "op12_merkle_manifest": manifest.SQL}
