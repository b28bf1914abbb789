"""Mixing sources to target weights down a domain, language and source tree.

A token budget is handed down the tree. Each node's children share its budget by their weights;
a child cannot take more than its tokens times the allowed epochs, and what it leaves goes to its
siblings first. As a node's budget never exceeds what its subtree can give, a shortage reaches the
node's own siblings only when all its children are full. All amounts are whole tokens; what the
division leaves over is not spent.

A leaf whose budget is e times its tokens and r more gives every document e times and the
documents of a prefix once more: the longest prefix of r tokens or less in the order of a hash of
seed, epoch and document. The prefix is found as a cut in hash space, so no leaf is sorted in one
task and rows are chosen by comparing their hash with their leaf's cut.

Defined results: documents are told apart by id, those without id by text; rows that repeat a
document in a leaf are taken or left together; null and empty texts have no tokens and are never
taken; a null or unlisted domain, language or source is the child "other" of its node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens.llm.common import small, stored

LEVELS = ("domain", "lang", "source")
OTHER = "other"


@dataclass(frozen=True)
class Mix:
    """Integer weights of the children by level; a child that is not listed has the default weight."""

    domains: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "web": [f"src{i}" for i in range(0, 8)],
            "books": [f"src{i}" for i in range(8, 14)],
            "forums": [f"src{i}" for i in range(14, 20)],
        }
    )
    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "forums": 20})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    source_weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 5
    budget_percent: int = 50
    max_epochs: int = 2
    seed: int = 7


def _weight(column: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast("decimal(38,0)")


def leaves_of(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents under ``_row``, with their leaf, tokens and identity."""
    domain = F.lit(OTHER)
    for name, sources in mix.domains.items():
        domain = F.when(F.col("source").isin(list(sources)), F.lit(name)).otherwise(domain)
    identity = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(domain, F.lit(OTHER)).alias("domain"),
        F.coalesce(F.col("lang"), F.lit(OTHER)).alias("lang"),
        F.coalesce(F.col("source"), F.lit(OTHER)).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        identity.alias("_id"),
    )


def _shared(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``budget`` of each node from its parent's ``total``, by weight, none above ``cap``."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    # Nodes fill in the order of cap / weight; a node is full if those from it on would reach its cap.
    order = by.orderBy((F.col("cap") / F.col("weight")).cast("double"), "name")
    down = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)"))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    marked = nodes.select("*", (F.col("cap") * rest <= F.col("weight") * (F.col("total") - down)).alias("full"))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0).cast("decimal(38,0)"))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    share = F.expr("cast((weight * (total - _used)) div _free as decimal(38,0))")
    out = marked.select("*", used.alias("_used"), free.alias("_free"))
    return out.select("*", F.when(F.col("full"), F.col("cap")).otherwise(share).alias("budget")).drop("_used", "_free", "full")


def budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf, from the tokens of the leaves."""
    number = "decimal(38,0)"
    leaves = tokens.select(*LEVELS, F.col("tokens").cast(number).alias("tokens"), (F.col("tokens") * mix.max_epochs).cast(number).alias("cap"))
    total = leaves.agg(F.expr(f"cast((sum(tokens) * {mix.budget_percent}) div 100 as {number})").alias("total"))
    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)
    above = None
    for depth in range(1, 4):
        parent, name = list(LEVELS[: depth - 1]), LEVELS[depth - 1]
        nodes = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("cap").cast(number).alias("cap"), F.sum("tokens").cast(number).alias("tokens"))
        nodes = nodes.select("*", F.col(name).alias("name"), _weight(name, weights[depth - 1], mix.default_weight).alias("weight"))
        nodes = nodes.join(above, parent) if above is not None else nodes.withColumn("total", total.scalar())
        above = _shared(nodes, parent).select(*LEVELS[:depth], "tokens", F.col("budget").alias("total"))
        if depth < 3:
            above = above.drop("tokens")
    return above.select(*LEVELS, F.col("tokens").cast("long"), F.col("total").cast("long").alias("budget"))


def cuts(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, epochs, cut): whole epochs and the last hash of the prefix, or null."""
    plan = leaves.where("tokens > 0").select(*LEVELS, F.expr("cast(budget div tokens as int)").alias("epochs"), F.expr("budget % tokens").alias("rest"))
    units = rows.where("n_tokens > 0").join(small(plan), list(LEVELS))
    units = units.groupBy(*LEVELS, "epochs", "rest", place(mix.seed).alias("h")).agg(F.sum("n_tokens").alias("n"))
    units = stored(units.select("*", F.substring("h", 1, 3).alias("chunk")), "units")
    chunks = units.groupBy(*LEVELS, "rest", "chunk").agg(F.sum("n").alias("n"), F.max("h").alias("h"))
    over = W.partitionBy(*LEVELS).orderBy("chunk")
    chunks = chunks.select("*", F.sum("n").over(over).alias("end"))
    whole = chunks.where("end <= rest").groupBy(*LEVELS).agg(F.max("h").alias("h"))
    # The chunk in which the rest runs out is the only one whose rows are put in order.
    edge = chunks.where("end > rest and end - n < rest").select(*LEVELS, "chunk", (F.col("end") - F.col("n")).alias("start"))
    inside = W.partitionBy(*LEVELS).orderBy("h")
    part = units.join(edge, [*LEVELS, "chunk"]).select(*LEVELS, "h", "rest", (F.col("start") + F.sum("n").over(inside)).alias("end"))
    part = part.where("end <= rest").groupBy(*LEVELS).agg(F.max("h").alias("h"))
    cut = whole.unionByName(part).groupBy(*LEVELS).agg(F.max("h").alias("cut"))
    return plan.join(cut, list(LEVELS), "left").select(*LEVELS, "epochs", "cut")


def place(seed: int) -> Column:
    """A document's place in the order of its leaf's unfinished epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("_id")))


def mixed(docs: DataFrame, mix: Mix | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, domain, lang, source, n_tokens, copies) of the documents that are taken at least once."""
    mix = mix or Mix()
    rows = leaves_of(docs, mix, key, text)
    totals = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    leaves = stored(budgets(totals, mix), "budgets")
    chosen = rows.where("n_tokens > 0").join(small(stored(cuts(rows, leaves, mix), "cuts")), list(LEVELS))
    extra = F.when(place(mix.seed) <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    return chosen.select("_row", *LEVELS, "n_tokens", (F.col("epochs") + extra).alias("copies")).where("copies > 0")
