"""Truth maintenance in batch: which nodes are believed, given premises and justifications.

justifications(node, jid) and antecedents(jid, antecedent, positive): a justification holds when its positive
antecedents are believed and its negative ones are not; a node is believed when it is a premise or one of its
justifications holds. With negation the well-founded model is taken by alternating fixpoints; what it leaves open is not
believed. Retracting is leaving out a premise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.tables import written


def _closure(premises: DataFrame, justifications: DataFrame, antecedents: DataFrame, barred: DataFrame | None) -> DataFrame:
    """Least set with the premises that holds the justified, where a negative antecedent fails if it is in `barred`."""
    blocked = antecedents.where("NOT positive")
    if barred is not None:
        blocked = blocked.join(barred.select(F.col("node").alias("antecedent")), "antecedent", "left_semi")
        usable = justifications.join(blocked.select("jid").distinct(), "jid", "left_anti")
    else:
        usable = justifications
    usable = written(usable.select("jid", "node"), "usable")
    needs = antecedents.where("positive").select("jid", "antecedent").distinct()
    believed = written(premises.select("node").distinct(), "believed")
    while True:
        missing = needs.join(believed.select(F.col("node").alias("antecedent")), "antecedent", "left_anti").select("jid").distinct()
        new = usable.join(missing, "jid", "left_anti").select("node").distinct().join(believed, "node", "left_anti")
        new = written(new, "new")
        if new.isEmpty():
            return believed
        believed = written(believed.unionByName(new), "believed")


def believed(premises: DataFrame, justifications: DataFrame, antecedents: DataFrame) -> DataFrame:
    """The believed nodes as (node)."""
    if antecedents.where("NOT positive").isEmpty():
        return _closure(premises, justifications, antecedents, None)
    certain = written(premises.select("node").distinct(), "certain")
    while True:
        # What may be believed if only the certain bars anything; then what must be, if all of that bars.
        possible = _closure(premises, justifications, antecedents, certain)
        following = _closure(premises, justifications, antecedents, possible)
        if following.join(certain, "node", "left_anti").isEmpty():
            return following
        certain = following
