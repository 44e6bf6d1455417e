"""Connected components of a table of links, by the large-star and small-star steps of Kiveris et al.

Each step is an aggregation (with partial sums before the exchange) and a join, so a node with very many
links is split by the skew join and never gathers in one task. Each round is written to the shared
folder; nothing but one bit a round comes to the driver. A round follows only while some id is not yet linked to its root alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.shared import release, written


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(links: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Two links (u, v) for each row, of the columns named, in one pass over it."""
    pair = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (one, other)]
    return links.select(F.explode(F.array(*pair)).alias("link")).select("link.*")


def _open(links: DataFrame) -> bool:
    """Whether any id has more than one smaller end, or both a smaller and a larger one. If not, links go from each id to the least of its component."""
    end = [F.struct(F.col(x).alias("id"), F.lit(int(x == "u")).alias("down"), F.lit(int(x == "v")).alias("up")) for x in "uv"]
    ends = links.select(F.explode(F.array(*end)).alias("end")).select("end.*").groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.agg(F.max((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1)))).first()[0] or False


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, component) of every end of the links (u, v): component is the least id that links reach. Ends must not be
    null. A link of an id with itself makes it a component of its own; repeated links count once. links is read once. tasks: how many write the links of a
    round at most; all of the exchange, if not given."""

    def kept(df: DataFrame) -> DataFrame:
        return written(df.coalesce(tasks) if tasks else df, "links")

    # every link as (larger, smaller)
    given = kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    ids, now = given.select(F.explode(F.array("u", "v")).alias("id")).distinct(), given.where("u <> v")
    while _open(now):
        both = _both(now, ("u", "v"), ("v", "u"))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = kept(_both(large.join(_least(large), "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct())
        release(links.sparkSession)
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
