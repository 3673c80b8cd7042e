"""What a clean-up may move: items with what stands in their way, the answers to duplicates, and the moves that follow.

A plan never chooses a side of a duplicate; an answer does. Answers are taken together as a graph of kept and dropped skills: what one answer
keeps no other one drops, whatever their order. All of it is joins by skill and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.scalar import inside

#: What stands in the way. Fixed values.
SIDE, SAME, OUTSIDE, PROTECTED, MOVED, NO_SKILL = "side-selection-required", "same-target", "target-outside-root", "protected", "already-quarantined", "not-under-skills"
#: Where moved content lies, and files and folders that are never moved. Fixed values.
TRASH = ".trash"
SECURITY = ("settings.json", "settings.local.json", "hooks", "CLAUDE.md")


def move_blocker(root: str, real: str) -> Column:
    """Why what lies at the path `real` (links followed) may not be moved, else null: only what is installed below skills/ of its root may."""
    inner = F.expr(f"substring({real}, length({root}) + 2)")
    top = F.substring_index(inner, "/", 1)
    return (
        F.when(~inside(real, root) | (F.col(real) == F.col(root)), OUTSIDE)
        .when(top.isin(*SECURITY), PROTECTED)
        .when(top == TRASH, MOVED)
        .when((top != "skills") | ~F.contains(inner, F.lit("/")), NO_SKILL)
    )


def plan(unused: DataFrame, pairs: DataFrame, skills: DataFrame) -> DataFrame:
    """item, kind, targets, blockers and executable of the clean-up's items, each blocker once, in the order of its finding.

    unused: skill; pairs: a, b (a < b); skills: skill, root, real. A pair always asks for a side; an item is executable with nothing in its way.
    A pair of which one skill is unknown is no item.
    """
    known = skills.select("skill", "real", move_blocker("root", "real").alias("blocker"))
    single = unused.join(known, "skill").select(F.concat(F.lit("unused:"), "skill").alias("item"), F.lit("unused").alias("kind"), F.array("skill").alias("targets"), F.array_compact(F.array("blocker")).alias("blockers"))
    side = lambda k: known.select(F.col("skill").alias(k), F.col("real").alias(f"real_{k}"), F.col("blocker").alias(f"blocker_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    found = F.array(F.lit(SIDE), F.when(F.col("real_a") == F.col("real_b"), SAME), F.col("blocker_a"), F.col("blocker_b"))
    double = both.select(F.concat(F.lit("pair:"), "a", F.lit(":"), "b").alias("item"), F.lit("duplicate").alias("kind"), F.array("a", "b").alias("targets"), F.array_distinct(F.array_compact(found)).alias("blockers"))
    return single.unionByName(double).withColumn("executable", F.size("blockers") == 0)


def resolve(items: DataFrame, answers: DataFrame) -> DataFrame:
    """item, kept, dropped and outcome of answers (item, keep): `moved`; `conflict` where another answer keeps what this one drops; `unknown item`;
    `no side` where keep is no target; or the blockers that an answer does not lift, joined by commas.

    An item that is answered twice with different sides is in conflict with itself; the same answer twice is one.
    """
    asked = answers.select("item", "keep").distinct().join(items.filter("kind = 'duplicate'").select("item", "targets", "blockers"), "item", "left")
    rest = F.array_join(F.filter("blockers", lambda b: b != SIDE), ",")
    drop = F.get(F.array_except("targets", F.array("keep")), F.lit(0))
    judged = asked.withColumn("dropped", drop).withColumn("outcome", F.when(F.col("targets").isNull(), "unknown item").when(~F.coalesce(F.array_contains("targets", F.col("keep")), F.lit(False)), "no side").when(rest != "", rest))
    open_ = judged.filter("outcome is null")
    kept = open_.select(F.col("keep").alias("dropped"), F.lit(True).alias("_kept")).distinct()
    moves = open_.drop("outcome").join(kept, "dropped", "left").withColumn("outcome", F.when(F.col("_kept"), "conflict").otherwise("moved"))
    refused = judged.filter("outcome is not null").withColumn("dropped", F.lit(None).cast("string"))
    return moves.select("item", F.col("keep").alias("kept"), "dropped", "outcome").unionByName(refused.select("item", F.col("keep").alias("kept"), "dropped", "outcome"))


def strays(outputs: DataFrame, listed: DataFrame) -> DataFrame:
    """The samples of outputs that no work list names, with how often: a fold with any is refused."""
    return outputs.join(listed.select("sample").distinct(), "sample", "left_anti").groupBy("sample").agg(F.count("*").alias("n"))
