"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks.  With target weight w, block j of a source
is released at floor((j - 1) / w) and due at ceil(j / w), and earliest deadline
first fills the slots: at any slot a source is less than one block from its share.

Weights are whole numbers of blocks in a cycle, so the schedule of a cycle repeats
for as long as every source lasts.  A source that runs dry gives what it still
has to one last cycle; the sources that remain then keep their proportions in
shorter cycles.  So no document is dropped or repeated, and a corpus has at most
2 * sources + 1 kinds of cycle.  Each kind is simulated once, in a fold over its
slots; blocks find their slot by an equi-join on (kind, source, place in cycle).
That fold takes slots x sources steps for each kind, so it is meant for up to some
hundreds of sources, not for one a web host.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

#: Rows of a (source, bucket) group that one window task numbers.
BUCKET_ROWS = 4096
#: Columns of the result besides those of the documents.
SCHEDULE = ("source_block", "slot", "place", "due")
#: Rows of the plan of cycles that may be sent to every task.  A bound on memory only: beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def _schedule(quotas: str = "quotas") -> Column:
    """array<int>: for each slot of a cycle the place in ``quotas`` of the source that it serves.

    Earliest deadline first among the released blocks; ties go to the earlier
    source.  Whole quotas fill the cycle, so there is always a released block.
    """
    return F.expr(f"""
      aggregate(
        sequence(1, aggregate({quotas}, 0, (a, q) -> a + q)),
        struct(transform({quotas}, q -> 0) AS done, cast(array() AS array<int>) AS slots),
        (s, t) -> transform(
          array(array_min(transform(sequence(0, size({quotas}) - 1), i -> IF(
            s.done[i] < {quotas}[i] AND s.done[i] * cast(aggregate({quotas}, 0, (a, q) -> a + q) AS bigint) < cast(t AS bigint) * {quotas}[i],
            struct(((s.done[i] + 1) * cast(aggregate({quotas}, 0, (a, q) -> a + q) AS bigint) + {quotas}[i] - 1) div {quotas}[i] AS due, i AS i),
            struct(cast(9223372036854775807 AS bigint) AS due, i AS i))))),
          best -> struct(transform(s.done, (d, i) -> IF(i = best.i, d + 1, d)) AS done, concat(s.slots, array(best.i)) AS slots))[0],
        s -> s.slots)""")


#: Names that a row has while it is scheduled.
_KEY, _ORDER, _ID, _COPY = "__key", "__order", "__id", "__copy"


def _marked(docs: DataFrame, doc_id: Column, text: Column, source: Column, seed: int) -> DataFrame:
    """``docs`` with what tells its rows apart in the schedule: source, seeded hash of id and text, id."""
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))
    return docs.withColumns({_KEY: key, _ORDER: F.xxhash64(F.lit(seed), doc_id, text), _ID: doc_id})


def schedule_sources(docs: DataFrame, weights: Mapping[str, int] | None = None, cycle: int = 1000, temperature: float = 0.5, block_docs: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, source, source_block, slot, place, due, and __key, __order, __id, __copy: a row for each row of ``docs``, without its text.

    ``docs`` needs doc_id, text and source; other columns are not read.  The text
    is hashed where it is read and goes no further.  See :func:`mix_sources`.
    """
    keyed = _marked(docs.select("doc_id", "text", "source"), F.col("doc_id"), F.col("text"), F.col("source"), seed).drop("text")
    # a source is numbered by buckets of its hash range, so that a large source is many groups
    total = docs.count()
    bits = max(0, min(40, (max(1, total // BUCKET_ROWS) - 1).bit_length()))
    keyed = keyed.withColumn("__bucket", F.shiftrightunsigned(_ORDER, 64 - bits) if bits else F.lit(0).cast("long"))

    sizes = stored(keyed.groupBy(_KEY, "__bucket").agg(F.count("*").alias("n")), "mixture-sizes")
    running = Window.partitionBy(_KEY).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_KEY, "__bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("__before"))

    # one row a source from here to the slots
    sources = sizes.groupBy(_KEY).agg(F.ceil(F.sum("n") / block_docs).cast("int").alias("blocks"))
    if weights is None:
        share = F.pow("blocks", F.lit(temperature)) / F.sum(F.pow("blocks", F.lit(temperature))).over(Window.partitionBy())
        quota = F.greatest(F.lit(1), F.round(F.lit(cycle) * share).cast("int"))
    else:
        given = F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in ("s" + k, int(v)))) if weights else F.create_map().cast("map<string,int>")
        quota = F.greatest(F.lit(1), F.coalesce(F.try_element_at(given, F.col(_KEY)), F.lit(1)).cast("int"))
    sources = sources.withColumn("quota", quota)
    whole = F.floor(F.col("blocks") / F.col("quota")).cast("int")
    everyone = sources.agg(F.array_sort(F.collect_list(F.struct(_KEY, "quota", "blocks", whole.alias("whole")))).alias("all"))
    # cycles change at each source's last whole cycle and at the one after
    breaks = sources.select(F.explode(F.array(F.lit(0), whole, whole + 1)).alias("first")).distinct()
    ordered = Window.partitionBy().orderBy("first")
    kinds = breaks.select("first", F.lead("first").over(ordered).alias("next")).crossJoin(everyone)  # everyone: one row
    kinds = kinds.withColumn("quotas", F.expr("transform(all, x -> IF(first < x.whole, x.quota, IF(first = x.whole, x.blocks - x.whole * x.quota, 0)))"))
    kinds = kinds.withColumn("length", F.expr("aggregate(quotas, 0, (a, q) -> a + q)")).where("length > 0")
    before = Window.partitionBy().orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("begin", F.coalesce(F.sum(F.col("length").cast("long") * (F.col("next") - F.col("first"))).over(before), F.lit(0)))
    plan = kinds.withColumn("slots", _schedule())
    plan = plan.select("first", "next", "begin", "length", "quotas", "all", F.posexplode("slots").alias("at", "s"))
    place = Window.partitionBy("first", "s").orderBy("at")
    plan = plan.select(
        F.element_at(F.col("all"), F.col("s") + 1).getField(_KEY).alias(_KEY),
        "first", "next", "begin", "length", "at",
        (F.row_number().over(place) - 1).alias("__i"),
        F.element_at(F.col("quotas"), F.col("s") + 1).alias("quota"),
    )

    plan = stored(plan.withColumn("due", F.expr("((__i + 1) * cast(length AS bigint) + quota - 1) div quota")).select(_KEY, "__i", "first", "next", "begin", "length", "at", "due"), "mixture-plan")
    # (2 * sources + 1) * cycle rows, however many documents: sent to all tasks if that is few, else joined by source and place
    sent = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan

    # equal rows stand together and are told apart by their number among themselves
    number = Window.partitionBy(_KEY, "__bucket").orderBy(_ORDER, _ID)
    numbered = keyed.withColumn("__in_bucket", F.row_number().over(number) - 1).withColumn(_COPY, F.col("__in_bucket") - F.rank().over(number) + 1)
    numbered = numbered.join(starts.join(sources.select(_KEY, "quota"), _KEY), [_KEY, "__bucket"])
    index = F.col("__before") + F.col("__in_bucket")
    numbered = numbered.withColumn("__block", F.floor(index / block_docs)).withColumn("place", (index % block_docs).cast("int"))
    numbered = numbered.withColumn("__cycle", F.floor(F.col("__block") / F.col("quota"))).withColumn("__i", (F.col("__block") % F.col("quota")).cast("int"))
    out = numbered.alias("d").join(sent.alias("p"), (F.col(f"d.{_KEY}") == F.col(f"p.{_KEY}")) & (F.col("d.__i") == F.col("p.__i")) & (F.col("d.__cycle") >= F.col("p.first")) & (F.col("d.__cycle") < F.col("p.next")))
    offset = F.col("p.begin") + (F.col("d.__cycle") - F.col("p.first")) * F.col("p.length")
    out = stored(out.select(
        "d.doc_id", "d.source",
        F.col("d.__block").cast("long").alias("source_block"),
        (offset + F.col("p.at")).cast("long").alias("slot"),
        F.col("d.place").alias("place"),
        (offset + F.col("p.due")).cast("long").alias("due"),
        *(F.col(f"d.{c}").alias(c) for c in (_KEY, _ORDER, _ID)), F.col(f"d.{_COPY}").cast("int").alias(_COPY),
    ), "mixture")
    dropped(sizes, plan)
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, int] | None = None, cycle: int = 1000, temperature: float = 0.5, block_docs: int = 16, seed: int = 42) -> DataFrame:
    """``docs`` with source_block, slot, place and due: read in order of (slot, place) they are the mixture.

    ``docs`` needs doc_id, text and source; other columns pass through, those that
    bear a name of SCHEDULE with ``_in`` after it.
    ``weights``: whole blocks a cycle for each source; sources that it lacks get
    one.  Without it a source's weight is its number of blocks to the power
    ``temperature``, scaled to ``cycle`` blocks a cycle, one at least.

    Within a source documents stand in the order of a seeded hash of id and text.
    Null and empty sources are sources of their own; rows that repeat id, text and
    source stay and stand together, in the order of a hash of all their columns;
    null text counts as a document; an empty table gives no rows.

    The schedule is made from narrow rows; the text moves once, to meet it (twice if rows repeat).
    """
    names, inner = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    slots = schedule_sources(docs, weights, cycle, temperature, block_docs, seed)
    doc_id, text, source = (F.col(inner[names.index(c)]) for c in ("doc_id", "text", "source"))
    d, s = _marked(docs.toDF(*inner), doc_id, text, source, seed), slots.drop("doc_id", "source")
    same = [F.col(f"d.{_ORDER}") == F.col(f"s.{_ORDER}"), F.col(f"d.{_KEY}") == F.col(f"s.{_KEY}"), F.col(f"d.{_ID}").eqNullSafe(F.col(f"s.{_ID}"))]
    if slots.agg(F.max(_COPY)).first()[0]:
        number = Window.partitionBy(_ORDER, _KEY, _ID).orderBy(F.xxhash64(*inner))
        d = d.withColumn(_COPY, (F.row_number().over(number) - 1).cast("int"))
        same.append(F.col(f"d.{_COPY}") == F.col(f"s.{_COPY}"))
    both = d.alias("d").join(s.alias("s"), functools.reduce(Column.__and__, same))
    return both.select(*(F.col(f"d.{c}").alias(f"{n}_in" if n in SCHEDULE else n) for c, n in zip(inner, names)), *(F.col(f"s.{c}") for c in SCHEDULE))


def in_mixture_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The mixture in ``parts`` partitions that follow each other by (slot, place), each sorted, without the schedule's columns.

    A slot is one block, so equal ranges of slots are equal parts; by default as many as a shuffle has.
    """
    parts = parts or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = mixed.agg(F.max("slot")).first()[0] or 0
    part = F.floor(F.col("slot") * parts / F.lit(last + 1)).cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions("slot", "place").drop(*SCHEDULE)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = schedule_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", *SCHEDULE)
