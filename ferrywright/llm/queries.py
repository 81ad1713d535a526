"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywright.llm import (
    byte_pairs,
    license_scan,
    line_frequency,
    line_join,
    packing,
    pieces,
    prefix_trie,
    pseudonyms,
    secrets,
    simhash_trie,
    spelling,
    toxicity,
    vector_graph,
)
from ferrywright.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.ferrywright.pseudonym.key", pseudonyms.DEMO_KEY)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict per document from its own measures and from lines that its source repeats."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_frequency.line_frequency(docs).drop("source")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document, without two near copies in a bin."""
    return packing.pack_apart(_table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced by pseudonyms."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark))


def op4_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that match an earlier line of the table."""
    return line_join.line_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    found = simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence family of every document and the lines that name it."""
    return license_scan.licences(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of near-duplicates of every vector."""
    return vector_graph.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, decoded again."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-pair ids of every document and of what they decode to."""
    return byte_pairs.digests(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form and root of every frequent word of the documents."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with what sharing it saves."""
    return prefix_trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES["op1_line_frequency"] = op1_line_frequency
ORACLES["op1_line_frequency"] = line_frequency.ORACLE
QUERIES["op2_packing"] = op2_packing
QUERIES["op3_pseudonyms"] = op3_pseudonyms
QUERIES["op4_line_join"] = op4_line_join
ORACLES["op4_line_join"] = line_join.ORACLE
QUERIES["op5_toxicity"] = op5_toxicity
QUERIES["op6_simhash"] = op6_simhash
QUERIES["op7_licences"] = op7_licences
QUERIES["op8_secrets"] = op8_secrets
QUERIES["op9_vector_graph"] = op9_vector_graph
QUERIES["op10_pieces"] = op10_pieces
QUERIES["op11_byte_pairs"] = op11_byte_pairs
QUERIES["op12_spelling"] = op12_spelling
ORACLES["op12_spelling"] = spelling.ORACLE
QUERIES["op13_prefix_trie"] = op13_prefix_trie
ORACLES["op13_prefix_trie"] = prefix_trie.ORACLE
