"""Mixing sources to target weights.

The corpus is a tree of domains, languages and sources. A token budget goes
down the tree by weight; no node gets more than its leaves can give in
``max_epochs`` passes, and what a node can't use goes to its siblings before
it goes to its parent's siblings: at every node the children share the budget
as min(capacity, level * weight) with one level for all. Each leaf then takes
whole epochs and, of the last epoch, a prefix in an order seeded by leaf and epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.llm.packing import word_counts
from rillmill.llm.shared import cut, sheltered


@dataclass(frozen=True)
class Recipe:
    """Weights of the tree; what isn't named has ``other``."""

    domain_of: dict[str, str] = field(default_factory=dict)
    domains: dict[str, float] = field(default_factory=dict)
    langs: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 0.05
    other_domain: str = "other"
    budget_share: float = 0.8
    max_epochs: int = 3
    seed: int = 7


PRODUCTION = Recipe(
    domain_of={f"src{i}": ("web", "books", "code", "reference")[i // 5] for i in range(20)},
    domains={"web": 0.4, "books": 0.25, "code": 0.2, "reference": 0.15},
    langs={"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    sources={f"src{i}": 1.0 for i in range(20)},
)


def _lookup(key: Column, table: dict, default) -> Column:
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def leaf_columns(docs: DataFrame, recipe: Recipe) -> dict[str, Column]:
    """Domain, language and source of a row; null or absent ones are ''."""
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return {"_domain": _lookup(source, recipe.domain_of, recipe.other_domain), "_lang": lang, "_source": source}


def share(children: DataFrame, parent: list[str], name: str, budget: Column) -> DataFrame:
    """children (parent keys, name, _w, _cap) with _x, each one's part of its parent's budget.

    In order of capacity over weight, child i is the first not to be full at level
    (budget - capacities before i) / (weights from i on); the true level is the greatest of these.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("_cap") / F.col("_w"), name)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    with_level = children.withColumn("_level", (budget - before) / after)
    return with_level.withColumn("_x", F.least(F.col("_cap"), F.col("_w") * F.max("_level").over(by)))


def leaf_budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """(_domain, _lang, _source, _tokens, _budget) from (_domain, _lang, _source, _tokens); _budget in whole tokens."""
    leaves = leaves.where("_tokens > 0").withColumn("_cap", F.col("_tokens").cast("double") * recipe.max_epochs)
    root = leaves.agg((F.floor(F.sum("_tokens") * F.lit(recipe.budget_share))).cast("double").alias("_b"))
    weight = lambda c, t: F.greatest(_lookup(F.col(c), t, recipe.other), F.lit(1e-12))
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("_cap").alias("_cap"))
    domains = langs.groupBy("_domain").agg(F.sum("_cap").alias("_cap")).withColumn("_w", weight("_domain", recipe.domains)).withColumn("_root", F.lit(0))
    domains = share(domains.crossJoin(F.broadcast(root)), ["_root"], "_domain", F.col("_b")).select("_domain", F.col("_x").alias("_b"))
    langs = share(langs.withColumn("_w", weight("_lang", recipe.langs)).join(domains, "_domain"), ["_domain"], "_lang", F.col("_b"))
    langs = langs.select("_domain", "_lang", F.col("_x").alias("_b"))
    out = share(leaves.withColumn("_w", weight("_source", recipe.sources)).join(langs, ["_domain", "_lang"]), ["_domain", "_lang"], "_source", F.col("_b"))
    return out.select("_domain", "_lang", "_source", "_tokens", F.floor(F.col("_x") + F.lit(1e-6)).cast("bigint").alias("_budget"))


def seeded(recipe: Recipe, epoch: Column) -> Column:
    """Place of a row in the order of an epoch; rows of one doc_id stay together."""
    return F.md5(F.concat_ws("|", F.lit(str(recipe.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_plan(counted: DataFrame, recipe: Recipe) -> DataFrame:
    """(_domain, _lang, _source, _full, _last): whole epochs of each leaf, and the greatest place that is still taken in the next one ('' if none).

    A row is taken while the tokens before it are fewer than the remainder.
    Sums over ranges of the order find the one range where the remainder ends; only its rows are sorted.
    """
    leaf = ["_domain", "_lang", "_source"]
    leaves = counted.groupBy(*leaf).agg(F.sum("_n").alias("_tokens"))
    budgets = cut(leaf_budgets(leaves, recipe).select(*leaf, F.floor(F.col("_budget") / F.col("_tokens")).alias("_full"), (F.col("_budget") % F.col("_tokens")).alias("_rest")))
    rows = counted.where("_n > 0").join(budgets.where("_rest > 0"), leaf).withColumn("_at", seeded(recipe, F.col("_full")))
    rows = rows.withColumn("_bucket", F.conv(F.substring("_at", 1, 3), 16, 10).cast("int"))
    # one row for each place of the order: repeated rows of an id count together
    places = rows.groupBy(*leaf, "_rest", "_bucket", "_at").agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy(*leaf).orderBy("_bucket")
    sums = rows.groupBy(*leaf, "_rest", "_bucket").agg(F.sum("_n").alias("_bn"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_bn").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at_end = sums.where("_before < _rest and _rest <= _before + _bn").select(*leaf, "_bucket", "_before")
    inside = places.join(at_end, [*leaf, "_bucket"])
    place = Window.partitionBy(*leaf).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_sum", F.col("_before") + F.coalesce(F.sum("_n").over(place), F.lit(0)))
    last = inside.where("_sum < _rest").groupBy(*leaf).agg(F.max("_at").alias("_last"))
    return budgets.join(last, leaf, "left").select(*leaf, "_full", F.coalesce("_last", F.lit("")).alias("_last"))


def mix(docs: DataFrame, recipe: Recipe = PRODUCTION, keep_all: bool = False) -> DataFrame:
    """doc_id, or with keep_all all columns of docs (extra ones by other names, see ``sheltered``), with _domain, _lang, _source and _epoch: a row for each epoch in which a row of docs is taken.

    Tokens are white-space separated words. Rows without any (null, empty or
    blank texts) are never taken. Null or absent languages and sources form
    leaves of their own, named ''; null ids share one place in the order;
    rows that repeat an id are taken together. A leaf exceeds its budget by less than
    the last id's tokens. Siblings of equal weight and capacity get equal budgets; whole texts are counted, however long. An empty table gives an empty result. Other columns aren't read, whatever their names.
    """
    docs = sheltered(docs)
    site = leaf_columns(docs, recipe)
    leaves = docs.select("doc_id", "text", *(c.alias(n) for n, c in site.items()))
    counted = cut(word_counts(leaves, ["doc_id", *site]))
    plan = cut(leaf_plan(counted, recipe))
    keep = docs.columns if keep_all else ["doc_id"]
    if not keep_all:
        rows = counted.where("_n > 0")
    else:
        rows = docs.select(*keep, *(c.alias(n) for n, c in site.items())).where(F.col("text").rlike(r"(?U)\S"))
    taken = rows.join(plan, list(site))
    last = F.when(seeded(recipe, F.col("_full")) <= F.col("_last"), F.col("_full")).otherwise(F.col("_full") - 1)
    taken = taken.withColumn("_until", last).where("_until >= 0")
    return taken.select(*keep, *site, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_until"))).alias("_epoch"))
