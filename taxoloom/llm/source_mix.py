"""Mixing sources to target weights by weighted fair queueing.

Each source has a target number of words. Its documents queue in shuffled order, each pass
over the source behind the one before. A document's virtual finish time is the number of the
source's words up to its end, divided by the target; the queue is sorted by that time over
all sources and cut at the total budget. So at any cut the sources hold words in the
proportion of their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.numbering import contiguous_ids
from ..plans.scratch import settle
from .common import WORD, free_name, prepare
from .ordered import running_sum

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, in parts of 100 of all words.
BUDGET_PERCENT = 150
#: Times that a source may be used.
MOST_USES = 2


def _targets(sources: DataFrame, weights: tuple[int, ...], percent: int, uses: int) -> tuple[DataFrame, float]:
    """Add ``target`` to ``sources`` (``source, source_size``), and the budget.

    Every source gets its weight's share; what lies above ``uses`` times its size is shared
    anew among the others until no target is above. A round is one sum over the sources.
    """
    ranked = settle(
        contiguous_ids(sources, "rank", [F.col("source").asc_nulls_last()])
        .withColumn("weight", F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")])
        .withColumn("most", F.col("source_size") * uses),
        "sources",
    )
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, full = 0.0, -1
    while True:
        above = F.col("most") <= F.col("weight") * level
        r = ranked.agg(
            F.count_if(above).alias("full"), F.sum(F.when(above, F.col("most")).otherwise(0)).alias("given"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if r["full"] == full or not r["open"]:
            break
        level, full = (budget - (r["given"] or 0)) / r["open"], r["full"]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", "rank", target.alias("target")), budget


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = BUDGET_PERCENT,
    uses: int = MOST_USES,
    seed: int = 0,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words (runs without blank, tab, line feed, vertical tab, form feed
    and carriage return), ``target`` the words that the document's source should give, ``taken``
    the words that the mix takes from the document, each pass counted. Sources are ordered by code
    point, a null source last and on its own. The order of a queue comes from a digest of
    id and seed, so reruns agree.

    A null or empty text has size 0 and is never taken. A null id is shuffled as the empty text;
    rows that repeat a document are separate members of the queue. An empty table, or one without
    words, takes nothing. Other columns are not read.
    """
    prepare(docs.sparkSession)
    sized = settle(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sources, budget = _targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, uses
    )
    shuffled = sized.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queued = running_sum(shuffled, ["source"], [F.col("place"), F.col("doc_id"), F.col("size")], "size", "upto")
    queued = queued.withColumnRenamed("row", "member")
    named = sources.withColumnRenamed("source", "name")
    passes = (
        queued.join(named, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(uses - 1))))
        .withColumn(
            "finish",
            F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")).otherwise(F.lit(0.0)),
        )
        .select("doc_id", "size", "source_size", "target", "rank", "member", "pass", "finish", "place")
    )
    order = [F.col(c) for c in ("finish", "rank", "pass", "place", "member")]
    taken = F.sum(F.when(F.col("spent") <= budget, F.col("size")).otherwise(0)).cast("long")
    return (
        running_sum(passes, [], order, "size", "spent")
        .groupBy("member", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"))
        .drop("member")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with ``copies``, the number of times that it takes them.

    Rows that share an id, or have none, each get the most copies of any of them. A column
    ``copies`` of ``docs`` is replaced.
    """
    doc_id, name = how.get("doc_id", "doc_id"), free_name(docs, "taken_id")
    taken = mix_sources(docs, **how).filter("taken > 0").groupBy(F.col("doc_id").alias(name)).agg(
        F.max(F.col("taken") / F.col("size")).cast("int").alias("copies")
    )
    return docs.drop("copies").join(taken, F.col(doc_id).eqNullSafe(F.col(name))).drop(name)
