"""Queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, consensus, packing, residue, tokenizer, variants
from tessera.sources.tables import scan


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizer.encode(scan(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container and the place in it of every text, or piece of a text longer than a container."""
    return packing.pack_texts(scan(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the reference list that each typed value means, 0 for none."""
    return canonical.resolve(scan(spark, sf_dir, "gold"), scan(spark, sf_dir, "canonical_values"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of values without an entry, and how many records hold each."""
    gold = scan(spark, sf_dir, "gold")
    found = canonical.resolve(gold, scan(spark, sf_dir, "canonical_values")).where("canonical_id = 0")
    rows = canonical.typed_values(gold).join(found, ["record_id", "field", "pos"])
    return rows.groupBy("field", "value").agg(F.countDistinct("record_id").alias("n_records"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus label of every paper with a successful run and every closed attribute."""
    return consensus.labels(scan(spark, sf_dir, "results"), scan(spark, sf_dir, "attr_schema"))


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of claims and the share that agrees."""
    return consensus.consensus(scan(spark, sf_dir, "results"), scan(spark, sf_dir, "attr_schema"))


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, its upper bound and the weight of each model for each attribute."""
    return consensus.reliability(scan(spark, sf_dir, "results"), scan(spark, sf_dir, "attr_schema"))


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of each attribute."""
    return consensus.agreement(scan(spark, sf_dir, "results"), scan(spark, sf_dir, "attr_schema"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two spellings of the same person or organisation."""
    return variants.links(scan(spark, sf_dir, "gold"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that each typed string names."""
    return variants.memberships(scan(spark, sf_dir, "gold")).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are or hold template residue, filler, error pages or notices."""
    return residue.found(scan(spark, sf_dir, "documents"))


def p8_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without those."""
    return residue.corpus(scan(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_consensus": p1_consensus, "p1_reliability": p1_reliability, "p1_agreement": p1_agreement,
    "p4_found": p4_found, "p4_unmatched": p4_unmatched,
    "p5_found": p5_found, "p5_entities": p5_entities, "p6_ids": p6_ids, "p7_containers": p7_containers,
    "p8_found": p8_found, "p8_corpus": p8_corpus,
}
ORACLES: dict[str, str] = {}
