"""Mixing sources to target weights: hierarchical budgets over domain, language and source.

A node's budget goes to its children by weight, none above its capacity (its tokens times `most_epochs`). What a child
cannot take goes to its siblings by their weights first; only what a whole subtree cannot take is shared one level up,
because a parent's capacity is the sum of its children's. Budgets are whole tokens, reckoned exactly; what rounding down
leaves over goes to the largest remainders, a token each.

A leaf takes whole epochs of its documents and of the next epoch the prefix, in an order seeded by (seed, epoch,
doc_id), whose documents begin before the rest of the budget is used up. The prefix is found by three sums: over 256
ranges of the order for each leaf, over 256 parts of each range, and inside the one part where the budget ends, so that a
leaf with most of all rows is no single task. Texts are read once, for their numbers of tokens.

Defined cases: null domains, languages and sources are leaves of their own, with the default weight unless named None;
a null or empty text has no tokens and is taken with its epoch; rows with equal doc_id (null ids too) have one place in
the order and are taken together; a weight of 0 or less gives no budget; a very long text is taken or left whole; an
empty table gives no rows; columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm import _store, _text

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "lang", "source"]
#: Tokens and weights; a product of the two is exact.
WHOLE, WEIGHT = "decimal(22,0)", "decimal(15,0)"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _weight(name: str, weights: dict[str | None, int], default: int) -> Column:
    out = F.lit(default)
    for value, w in weights.items():
        out = F.when(F.col(name).eqNullSafe(F.lit(value).cast("string")), F.lit(w)).otherwise(out)
    return out.cast(WEIGHT)


def _shared(nodes: DataFrame, parent: list[str], name: str, weights: dict[str | None, int], default: int) -> DataFrame:
    """nodes(parent.., name, capacity, budget of the parent) with each node's own budget instead."""
    w = nodes.withColumn("w", _weight(name, weights, default)).withColumn("capacity", F.when(F.col("w") > 0, F.col("capacity")).otherwise(0).cast(WHOLE))
    w = w.withColumn("w", F.greatest("w", F.lit(0).cast(WEIGHT)))
    # Children in order of capacity per weight: those that fill up are a prefix of it.
    by = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.when(F.col("w") > 0, F.col("w").cast("double"))).asc_nulls_last(), name)
    ahead = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    sums = {"c_ahead": F.sum("capacity").over(ahead).cast(WHOLE), "w_ahead": F.sum("w").over(ahead).cast(WEIGHT), "w_all": F.sum("w").over(whole).cast(WEIGHT)}
    w = w.withColumns({k: F.coalesce(v, F.lit(0)).cast(WEIGHT if k[0] == "w" else WHOLE) for k, v in sums.items()})
    left_w, left = (F.col("w_all") - F.col("w_ahead")).cast(WEIGHT), (F.col("budget") - F.col("c_ahead")).cast(WHOLE)
    w = w.withColumn("full", (F.col("w") > 0) & (F.col("capacity") * left_w <= F.col("w") * left))
    # What is left is shared by weight; rounding leaves less than a token for each child.
    w = w.withColumn("rest", F.greatest(F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)), F.lit(0)).cast(WHOLE))
    w = w.withColumn("open_w", F.sum(F.when(~F.col("full") & (F.col("w") > 0), F.col("w"))).over(whole).cast(WEIGHT))
    shared = ~F.col("full") & (F.col("w") > 0)
    w = w.withColumn("part", F.when(shared, F.call_function("div", F.col("rest") * F.col("w"), F.col("open_w"))).cast(WHOLE)).withColumn("over", F.when(shared, F.col("rest") * F.col("w") % F.col("open_w")))
    w = w.withColumn("spare", F.col("rest") - F.coalesce(F.sum("part").over(whole), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(F.col("over").desc_nulls_last(), F.col(name).asc_nulls_first()))
    mine = F.when(F.col("full"), F.col("capacity")).when(shared, F.col("part") + (place <= F.col("spare")).cast("int")).otherwise(0)
    return w.withColumn("budget", mine.cast(WHOLE)).select(*parent, name, "budget")


def budgets(leaves: DataFrame, target: int | None, share: float, weights: dict[str, dict[str | None, int]], most_epochs: int, default: int = 1) -> DataFrame:
    """leaves(domain, lang, source, tokens) with the budget of each. The target in tokens; or else a share of all."""
    caps = leaves.withColumn("capacity", (F.col("tokens") * most_epochs).cast(WHOLE))
    # A child without weight takes nothing, so it adds nothing to its parent's capacity.
    for name in LEAF:
        caps = caps.withColumn("capacity", F.when(_weight(name, weights.get(name, {}), default) > 0, F.col("capacity")).otherwise(0).cast(WHOLE))
    total = caps.agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("c")).select(F.least(F.lit(target) if target is not None else F.floor(F.col("t") * share), F.col("c")).cast(WHOLE).alias("budget"))
    out = total
    for depth, name in enumerate(LEAF):
        above, here = LEAF[:depth], LEAF[: depth + 1]
        nodes = caps.groupBy(*here).agg(F.sum("capacity").cast(WHOLE).alias("capacity"))
        parents = out.select(*[F.col(c).alias(f"__{c}") for c in above], "budget")
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in above]
        joined = nodes.join(parents, on, "inner") if on else nodes.join(F.broadcast(parents))  # one row
        out = _shared(joined.select(*here, "capacity", "budget"), above, name, weights.get(name, {}), default)
    mine = out.select(*[F.col(c).alias(f"__{c}") for c in LEAF], "budget")
    return leaves.join(mine, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEAF]).select(*LEAF, "tokens", "budget")


def select(docs: DataFrame, domain: Column, weights: dict[str, dict[str | None, int]], target: int | None = None, share: float = 0.5, most_epochs: int = 2, seed: int = 1) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of every row taken at least once; `__row` tells rows of one doc_id
    and one text apart from others, for joining them back."""
    rows = docs.select("doc_id", domain.alias("domain"), "lang", "source", n_words().alias("n_tokens"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__row"))
    rows = _store.written(rows, "mixing-tokens")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    planned = budgets(leaves, target, share, weights, most_epochs)
    planned = planned.withColumn("epochs", F.when(F.col("tokens") > 0, F.call_function("div", F.col("budget"), F.col("tokens").cast(WHOLE))).otherwise(0).cast("long"))
    planned = planned.withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long"))
    plan = _store.written(planned.select(*[F.col(c).alias(f"__{c}") for c in LEAF], "epochs", "rest"), "mixing-plan")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEAF]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(plan, same).drop(*[f"__{c}" for c in LEAF]).withColumn("key", key).withColumn("range", F.substring("key", 1, 2)).withColumn("part", F.substring("key", 3, 2))
    parts = placed.groupBy(*LEAF, "range", "part").agg(F.sum("n_tokens").alias("size"))
    ranges = parts.groupBy(*LEAF, "range").agg(F.sum("size").alias("size"))

    def ahead(group: list[str], order: str) -> Column:
        return F.coalesce(F.sum("size").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = ranges.select(*[F.col(c).alias(f"__{c}") for c in LEAF], F.col("range").alias("__range"), ahead(LEAF, "range").alias("before"))
    parts = parts.withColumn("inside", ahead([*LEAF, "range"], "part")).join(ranges, [*same, F.col("range") == F.col("__range")])
    parts = parts.select(*[f"__{c}" for c in LEAF], "__range", F.col("part").alias("__part"), (F.col("before") + F.col("inside")).alias("ahead"), "size")
    parts = _store.written(parts, "mixing-parts")
    placed = placed.join(parts, [*same, F.col("range") == F.col("__range"), F.col("part") == F.col("__part")]).drop(*[f"__{c}" for c in LEAF], "__range", "__part")
    clear = placed.where("ahead + size <= rest OR ahead >= rest").withColumn("taken", F.col("ahead") < F.col("rest"))
    cut = placed.where("ahead + size > rest AND ahead < rest")
    inside = F.sum("n_tokens").over(Window.partitionBy(*LEAF, "range", "part").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)) - F.sum("n_tokens").over(Window.partitionBy(*LEAF, "range", "part", "key"))
    cut = cut.withColumn("taken", F.col("ahead") + inside < F.col("rest"))
    out = clear.unionByName(cut).withColumn("copies", F.col("epochs") + F.col("taken").cast("long")).where("copies > 0")
    return out.select("doc_id", *LEAF, "n_tokens", "copies", "__row")


def mixed(docs: DataFrame, domain: Column, weights: dict[str, dict[str | None, int]], **how) -> DataFrame:
    """docs as the mixture has them: rows taken more than once are repeated."""
    doc, same, copies, n = _text.unused(docs.columns, "__id", "__same", "__copies", "__n")
    chosen = select(docs, domain, weights, **how).groupBy("doc_id", "__row").agg(F.max("copies").alias(copies))
    chosen = chosen.select(F.col("doc_id").alias(doc), F.col("__row").alias(same), copies).hint("shuffle_hash")
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(doc)) & (row == F.col(same)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
