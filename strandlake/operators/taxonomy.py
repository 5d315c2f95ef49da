"""Taxonomy: levels of ranks, ancestors at a rank, accessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.schema import RANKS
from strandlake.shared import discard, durable, few


def level(rank: Column) -> Column:
    return reduce(lambda e, r: e.when(rank == r[0], r[1]), list(RANKS.items())[1:], F.when(rank == "species", 0)).otherwise(0)


def rank_level(rank: str) -> int:
    """Level of a rank name; an unknown name falls back to species."""
    return RANKS.get(rank, 0)


def nodes_with_levels(nodes: DataFrame) -> DataFrame:
    return nodes.select("taxid", "parent", "rank", level(F.col("rank")).alias("level"))


def climb(taxids: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """(taxid, rank_taxid) for the taxids that are nodes: the nearest node upwards whose level reaches the rank's.

    A lineage without one gives the taxid itself; so does one that ends at a parent that is no node, or in a circle.
    Ancestors are found by pointer doubling: a round joins the nodes that are not done to where these point to, so that
    steps of one become steps of two, four and so on, and the rounds are as many as the logarithm of the tree's depth.
    A node points to itself once it has arrived, at a node of the rank or at the end. Rounds are written, so none is
    computed twice; there is no bound on the depth, and a circle ends because its steps lead nowhere new.
    """
    target = rank_level(rank)
    tree = nodes_with_levels(nodes)
    known = tree.select("taxid", "parent", (F.col("level") >= target).alias("reached"))
    over = known.select(F.col("taxid").alias("parent"), F.lit(True).alias("there"))
    # to: where a node points; done: whether that is final; found: whether it is a node of the rank, which a root never is
    start = known.join(over, "parent", "left")
    root = F.col("parent") == F.col("taxid")
    final = F.col("reached") | F.col("there").isNull() | root
    ahead = durable(start.select("taxid", F.when(final, F.col("taxid")).otherwise(F.col("parent")).alias("to"), final.alias("done"), (F.col("reached") & ~root).alias("found")), "ancestors")
    moving, span = ahead.where("not done").count(), 1
    nodes_n = known.count() if moving else 0
    while moving and span <= nodes_n:  # a path that never ends has gone round more nodes than there are
        next_ = ahead.select(F.col("taxid").alias("to"), F.col("to").alias("then"), F.col("done").alias("then_done"), F.col("found").alias("then_found"))
        step = ahead.where("not done").join(next_, "to").select("taxid", F.col("then").alias("to"), F.col("then_done").alias("done"), F.col("then_found").alias("found"))
        made = durable(ahead.where("done").unionByName(step), "ancestors")
        discard(ahead)
        ahead, moving, span = made, made.where("not done").count(), span * 2
    found = ahead.select("taxid", F.when(F.col("done") & F.col("found"), F.col("to")).otherwise(F.col("taxid")).alias("rank_taxid"))
    return taxids.select("taxid").distinct().join(found, "taxid")


def accessions(acc2tax: DataFrame, order: str | None = None) -> DataFrame:
    """One taxid for each accession: the first by order, the least without one."""
    return acc2tax.groupBy("accession").agg((F.min_by("taxid", order) if order else F.min("taxid")).alias("taxid"))


def accession_table(acc2tax: DataFrame) -> DataFrame:
    """(accession, accession_version, taxid): the whole map, one row an accession, as the writers take it."""
    return accessions(acc2tax, "ord").select("accession", F.col("accession").alias("accession_version"), "taxid")


def conflicts(acc2tax: DataFrame) -> DataFrame:
    """(conflicts): rows whose taxid differs from the first of their accession."""
    first = F.first("taxid").over(Window.partitionBy("accession").orderBy("ord"))
    return acc2tax.withColumn("first_taxid", first).agg(F.count_if(F.col("taxid") != F.col("first_taxid")).alias("conflicts"))


def scientific_names(names: DataFrame) -> DataFrame:
    return names.groupBy("taxid").agg(F.min_by("name", "ord").alias("name"))


def resolve(reference: DataFrame, acc2tax: DataFrame, nodes: DataFrame, rank: str, key: str = "tid") -> DataFrame:
    """(key, rname, ref_len, acc_taxid, rank_taxid); the taxids are null where they cannot be told.

    The lineage is resolved once for each reference, not for each alignment.
    """
    named = reference.join(accessions(acc2tax), reference["rname"] == F.col("accession"), "left").select(key, "rname", "ref_len", F.col("taxid").alias("acc_taxid"))
    lineage = climb(named.where("acc_taxid is not null").select(F.col("acc_taxid").alias("taxid")), nodes, rank)
    return named.join(lineage.withColumnRenamed("taxid", "acc_taxid"), "acc_taxid", "left").select(key, "rname", "ref_len", "acc_taxid", "rank_taxid")


def missing_references(reference: DataFrame, acc2tax: DataFrame) -> DataFrame:
    return reference.join(acc2tax, reference["rname"] == acc2tax["accession"], "left_anti")


def present_accessions(reference: DataFrame, acc2tax: DataFrame) -> DataFrame:
    """(accession, accession_version, taxid) of the references that the map knows, once each."""
    return reference.select("rname").distinct().join(accessions(acc2tax), F.col("rname") == F.col("accession")).select("accession", F.col("accession").alias("accession_version"), "taxid")


def tagged(df: DataFrame, resolved: DataFrame, key: str = "tid") -> DataFrame:
    """Alignments with xt, the accession's taxid, and xr, its ancestor; 0 where unknown."""
    tags = resolved.select(key, F.coalesce("acc_taxid", F.lit(0)).alias("xt"), F.coalesce("rank_taxid", F.lit(0)).alias("xr"))
    return df.drop("xt", "xr").join(few(tags), key, "left").fillna(0, ["xt", "xr"])
