"""Mixing sources to target weights by hierarchical budgeting.

The targets' weights are propagated through a tree of domains, languages and sources: a source's weight falls to its
languages in proportion to their tokens, and a node's weight is the sum of its leaves'. Budgets then come from the root
down: each node's budget is shared among its children by weight, and what a child cannot use, because all below it times
the cap on repeats is less, goes to its siblings first; only what a whole family cannot use goes to the family's
siblings. Every leaf takes a prefix of seeded epochs: its documents in an order drawn anew for each epoch, up to its
budget.

Sharing with caps is solved in closed form with sums over the siblings in the order of capacity to weight (``fill``), so
that neither nodes nor leaves reach the driver. Prefixes come from token sums over hash buckets, so that a source with a
third of all rows is summed in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_collect, cut, strip_blanks
from .tokens import VOCABULARY, with_tokens

BUCKETS = 4096
#: Leaves and epochs up to this number are sent to the tasks; beyond it they are joined by a shuffle.
MOST_SENT = 100_000
PATH = ("domain", "lang", "source")


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, tokens``; a doc_id counts once, null texts have no tokens, source and language are lower
    case and trimmed, an unknown language is ``und``. ``size`` stands for the tokenizer's count if given."""
    docs = documents.select(
        "doc_id",
        F.lower(strip_blanks("source")).alias("source"),
        F.coalesce(F.nullif(F.lower(strip_blanks("lang")), F.lit("")), F.lit("und")).alias("lang"),
        "text",
    ).where("doc_id is not null and source is not null")
    of = with_tokens(docs, "text", ["doc_id", "source", "lang"], vocabulary) if size is None else docs.select("doc_id", "source", "lang", F.coalesce(size, F.lit(0)).cast("long").alias("tokens"))
    return of.dropDuplicates(["doc_id"])


def wanted(targets: DataFrame) -> DataFrame:
    """``domain, source, target_weight, max_repeats`` of each source; a repeated source counts once (its largest values),
    null weights are 0, null caps 1. Without a column ``domain`` all sources are of one."""
    domain = strip_blanks("domain") if "domain" in targets.columns else F.lit("all")
    return (
        targets.where("source is not null")
        .groupBy(F.lower(strip_blanks("source")).alias("source"))
        .agg(F.coalesce(F.max(domain), F.lit("all")).alias("domain"), F.coalesce(F.max("target_weight"), F.lit(0.0)).cast("double").alias("target_weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("int").alias("max_repeats"))
    )


def leaves(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The leaves of the tree: ``domain, lang, source, max_repeats, tokens, weight, capacity``. A source without documents
    is a leaf of the language ``und`` without tokens."""
    have = sizes.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    of = wanted(targets).join(have, "source", "left").withColumns({"lang": F.coalesce("lang", F.lit("und")), "tokens": F.coalesce("tokens", F.lit(0))})
    all_, count = F.sum("tokens").over(Window.partitionBy("source")), F.count("*").over(Window.partitionBy("source"))
    part = F.when(all_ > 0, F.col("tokens") / all_).otherwise(1 / count)
    return of.withColumns({"weight": F.col("target_weight") * part, "capacity": (F.col("tokens") * F.col("max_repeats")).cast("double")}).drop("target_weight")


def fill(nodes: DataFrame, family: list[str]) -> DataFrame:
    """Adds ``budget`` to ``nodes(<family>, weight, capacity, amount)``: the family's ``amount`` shared by weight within
    the capacities.

    Nodes are taken in the order of capacity to weight. If those before a node are full, the open ones, it among them,
    are filled to the level (amount - capacities before) / (weights from it on); the level grows while nodes are full
    and falls behind them, so the largest is the one that holds.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    ranked = Window.partitionBy(*family).orderBy("_ratio")
    before = F.coalesce(F.sum("capacity").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    levels = nodes.withColumn("_ratio", ratio).withColumn("_level", F.when(F.col("weight") > 0, (F.col("amount") - before) / open_))
    level = F.greatest(F.coalesce(F.max("_level").over(Window.partitionBy(*family)), F.lit(0.0)), F.lit(0.0))
    return levels.withColumn("budget", F.least("capacity", F.col("weight") * level)).drop("_ratio", "_level")


def budgets(tree: DataFrame, total: float, path: tuple[str, ...] = PATH) -> DataFrame:
    """``tree`` (see ``leaves``) with ``offer``, what a leaf's weight alone gives it, and ``budget``."""
    amounts = None
    for depth in range(1, len(path) + 1):
        node, family = list(path[:depth]), list(path[: depth - 1])
        nodes = tree.groupBy(*node).agg(F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("amount", F.lit(float(total))) if amounts is None else nodes.join(amounts.select(*family, F.col("budget").alias("amount")), family)
        amounts = fill(nodes, family)
    return tree.withColumn("offer", F.col("weight") * F.lit(float(total))).join(amounts.select(*path, "budget"), list(path))


def planned(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """The leaves with their budgets; ``total`` is by default all tokens of the targets' sources, each document once."""
    tree = cut(leaves(sizes, targets))
    if total is None:
        total = float(tree.agg(F.sum("tokens")).first()[0] or 0)
    return budgets(tree, total)


def report(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """One row for each target: ``source, target_weight, max_repeats, tokens, wanted, budget, short``.

    ``wanted`` is its share of all the targets' tokens, ``short`` whether its leaves had to give some of that back,
    ``budget`` what it gets after shortages are shared out.
    """
    back = F.col("offer") - F.least("offer", "capacity")
    by = planned(sized(documents, vocabulary, size), targets).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.sum("offer").alias("wanted"), F.sum("budget").alias("budget"), (F.sum(back) > 1e-9 * F.sum("offer")).alias("short")
    )
    return wanted(targets).join(by, "source").select("source", "target_weight", "max_repeats", "tokens", "wanted", "budget", "short")


def drawn_place(seed: int) -> Column:
    """A document's place in the order of an epoch: the first 60 bits of a hash of seed, epoch and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id").cast("binary")), 1, 15), 16, 10).cast("long")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, epoch, tokens``: the mixture; a document stands once for each epoch that takes it.

    Of every leaf's epochs, in order, the documents are taken while the tokens before them are below the budget, so a
    leaf exceeds its budget by less than one document. Documents without tokens are left out. Empty input or targets
    without documents give no rows.
    """
    sizes = cut(sized(documents, vocabulary, size).where("tokens > 0"))
    full = F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.col("max_repeats")).cast("int")
    rest = F.col("budget") - F.col("_full") * F.col("tokens")
    last = F.when((F.col("_full") < F.col("max_repeats")) & (rest > 1e-6), F.col("_full") + 1).otherwise(F.col("_full"))
    plan = cut(
        planned(sizes, targets).where("tokens > 0 and budget > 0").withColumn("_full", full).withColumn("_last", last).where("_last > 0")
        .select("source", "lang", F.col("tokens").alias("_all"), "_full", rest.alias("_rest"), F.explode(F.sequence(F.lit(0), F.col("_last") - 1)).alias("epoch"))
        .select("source", "lang", "epoch", F.when(F.col("epoch") < F.col("_full"), F.col("_all").cast("double")).otherwise(F.col("_rest")).alias("budget"))
    )
    sent = F.broadcast(plan) if bounded_collect(plan.select("epoch"), MOST_SENT) is not None else plan
    drawn = sizes.join(sent, ["source", "lang"]).withColumn("_h", drawn_place(seed)).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    leaf = ["source", "lang", "epoch"]
    sums = (
        drawn.groupBy(*leaf, "_b").agg(F.sum("tokens").alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*leaf).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_s")
    )
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf, "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        drawn.join(sums, [*leaf, "_b"])
        .withColumn("_at", F.col("_before") + inside)
        .where(F.col("_at") < F.col("budget"))
        .select("doc_id", "source", "lang", "epoch", "tokens")
    )


def shares(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """Shares reached: ``source, target_weight, documents, tokens, share, most_used`` (0 and null where nothing came)."""
    taken = mix(documents, targets, seed, vocabulary)
    by = taken.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_used"))
    out = wanted(targets).join(by, "source", "left").fillna(0, ["documents", "tokens", "most_used"])
    return out.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).select(
        "source", "target_weight", "documents", "tokens", "share", "most_used"
    )


def found(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``source`` of the targets whose leaves had to give back some of what their weight offers them."""
    return report(documents, targets, vocabulary).where("short").select("source")


WORDS = r"[a-zA-Z]+|[^a-zA-Z\s]"


def word_mixture(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix`` with words and marks for tokens."""
    return mix(documents, targets, size=F.regexp_count("text", F.lit(WORDS)))


def word_budgets(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``report`` with words and marks for tokens, amounts rounded to whole ones."""
    r = report(documents, targets, size=F.regexp_count("text", F.lit(WORDS)))
    return r.select("source", "tokens", F.round("wanted").cast("long").alias("wanted"), F.round("budget").cast("long").alias("budget"), "short")
