"""Mixing sources to target weights with Sainte-Laguë apportionment.

Words are handed out in blocks of equal size. The seats of a divisor method go
to the highest quotients votes / (2 k + 1): first to sources, by their targets,
then to the shards of a source, by their words. A shard lays its documents on a
line in a seeded order; its quota is a number of whole passes and a run of
blocks from a seeded start, and a document is taken as often as blocks on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.shared import staged

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2  # times a source or a document may be taken
BLOCK = 16  # words
SHARD = 65_536  # words of a shard, on average
TOGETHER = 512  # shards that share a quota before it is dealt to them
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _drawn(*parts: Column) -> Column:
    """A number below 2**32 from a seeded digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, target) from (source, size).

    Sources come in the order of code points, the missing one last. Their
    weights share SHARE of all words; a target stops at MOST times its source's
    size, and what is cut goes to the others by weight until none is above:
    with sources in the order of limit to weight, the level of the rest is the
    largest that any number of full ones leaves.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = reduce(lambda otherwise, i: F.when(F.col("rank") % len(WEIGHTS) == (i + 1) % len(WEIGHTS), F.lit(WEIGHTS[i])).otherwise(otherwise), range(len(WEIGHTS)), F.lit(None))
    limited = ordered.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * MOST)
    before = Window.orderBy((F.col("most") / F.col("weight")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy((F.col("most") / F.col("weight")), "rank").rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) * F.lit(SHARE) - F.coalesce(F.sum("most").over(before), F.lit(0))
    levels = limited.withColumn("level", left / F.sum("weight").over(onward))
    target = F.least(F.col("most").cast("double"), F.max("level").over(all_rows) * F.col("weight"))
    return levels.select("source", "rank", "source_size", target.alias("target"))


def apportioned(units: DataFrame, parents: list[str], unit: str) -> DataFrame:
    """`units` with `seats`: the `quota` of each parent goes to its units by the
    highest quotients of `votes`, ties to the smaller `unit`, none beyond `most`.

    A divisor method's share differs from the proportional one by at most half
    the number of units times the unit's part of the votes. Only quotients
    within that bound are ranked, three or four for each unit on average.
    """
    within = Window.partitionBy(*parents)
    part = F.coalesce(F.try_divide(F.col("votes").cast("double"), F.sum(F.col("votes").cast("double")).over(within)), F.lit(0.0))
    half = F.count("*").over(within) / F.lit(2.0)
    low = F.least(F.greatest(F.floor(part * (F.col("quota") - half) - 1.5), F.lit(0)), F.col("most"))
    high = F.least(F.ceil(part * (F.col("quota") + half) + 1.5), F.col("most"))
    bounded = units.withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
    open_ = bounded.withColumn("open", F.col("quota") - F.sum("low").over(within))
    each = open_.withColumn("k", F.explode(F.sequence("low", F.greatest("low", F.col("high") - 1))))
    quotient = F.when(F.col("k") < F.col("high"), F.col("votes").cast("double") / (2 * F.col("k") + 1)).otherwise(F.lit(-1.0))
    place = F.row_number().over(within.orderBy(quotient.desc(), unit, "k"))
    won = each.withColumn("won", ((place <= F.col("open")) & (quotient > 0)).cast("long"))
    return won.groupBy(*units.columns).agg((F.first("low") + F.sum("won")).alias("seats"))


def mix(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per row of `documents`.

    size is the number of words between white space (null: 0), target what the
    mix wants of the document's source, and taken the words it takes of the
    document, repeats counted: never more than MOST times its size. The words
    taken of a source differ from its target by some blocks at most. The same
    rows give the same result on every run. A null source is a source of its
    own, the last; rows that repeat a doc_id stand side by side on the line, and
    rows without one come first. An empty table, or one without words, gives
    targets of 0. Other columns are not looked at.

    Shards, not sources, are what a task sorts, so a source of any size is
    spread; quotas go to groups of shards and then to shards.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), words_in(F.col(text_column).cast("string")).alias("size"))
    sizes = staged(rows, "sizes")
    sources = staged(source_targets(sizes), "sources")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    named = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop("source")
    shard = F.pmod(_drawn(F.lit("shard"), key), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)))
    placed = named.withColumns({"shard": shard.cast("long"), "order": F.md5(F.concat_ws(":", F.lit(SEED), key))})

    blocks = F.ceil(F.col("words") / BLOCK)
    shards = staged(placed.groupBy("rank", "shard").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("shard") / TOGETHER)), "shards")
    sized = shards.select("rank", "group", "shard", "words", (blocks * MOST).alias("most"))
    roots = sized.groupBy("rank").agg(F.sum("most").alias("most")).join(sources.select("rank", F.col("target").alias("votes")), "rank")
    total = sources.agg(F.coalesce(F.floor(F.sum("source_size") * F.lit(SHARE) / BLOCK + 0.5), F.lit(0))).first()[0]
    of_source = staged(apportioned(roots.withColumn("quota", F.lit(total)), [], "rank").select("rank", F.col("seats").alias("quota")), "quotas")
    groups = sized.groupBy("rank", "group").agg(F.sum("words").alias("votes"), F.sum("most").alias("most"))
    of_group = staged(apportioned(groups.join(of_source, "rank"), ["rank"], "group").select("rank", "group", F.col("seats").alias("quota")), "quotas")
    each = sized.withColumnRenamed("words", "votes").join(of_group, ["rank", "group"])
    quotas = staged(apportioned(each, ["rank", "group"], "shard").select("rank", "shard", "seats"), "quotas")

    line = Window.partitionBy("rank", "shard").orderBy("order", "doc_id", "size")
    whole = Window.partitionBy("rank", "shard")
    lined = placed.withColumns({"stop": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)), "words": F.sum("size").over(whole)})
    dealt = lined.join(quotas, ["rank", "shard"]).withColumns({"start": F.col("stop") - F.col("size"), "n": F.greatest(blocks, F.lit(1))})
    first = F.pmod(_drawn(F.lit("start"), F.col("rank"), F.col("shard")), F.col("n")) * BLOCK
    run = dealt.withColumns({"passes": F.floor(F.col("seats") / F.col("n")), "from": first, "to": first + (F.col("seats") % F.col("n")) * BLOCK})
    shared = lambda a, b: F.greatest(F.lit(0), F.least(b, F.col("stop")) - F.greatest(a, F.col("start")))
    taken = F.col("passes") * F.col("size") + shared(F.col("from"), F.col("to")) + shared(F.lit(0), F.col("to") - F.col("n") * BLOCK)
    return run.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, texts whole: the number of
    copies is the words taken over the size, rounded. Documents that are taken
    by less than half, and those without words, do not appear."""
    taken = mix(documents).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = taken.select("doc_id", F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5).cast("int").alias("copies")).where("copies > 0")
    found = documents.alias("d").join(copies.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")))
    each = F.explode(F.sequence(F.lit(1), F.col("c.copies")))
    return found.select(F.struct("d.*").alias("document"), each.alias("copy")).select("document.*")


_IN = lambda x: f"('0x' || substr(md5('{SEED}:' || {x}), 1, 8))::BIGINT"


def _seats(name: str, units: str, parents: str, unit: str) -> str:
    """SQL of `apportioned`; named <name>."""
    columns, over = f"{parents + ', ' if parents else ''}{unit}", f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_a AS (SELECT *, coalesce(votes::DOUBLE / nullif(sum(votes::DOUBLE) OVER ({over}), 0), 0.0) AS part, count(*) OVER ({over}) / 2.0 AS half FROM ({units})),
{name}_b AS (SELECT *, least(greatest(floor(part * (quota - half) - 1.5), 0), most)::BIGINT AS low, least(ceil(part * (quota + half) + 1.5), most)::BIGINT AS high FROM {name}_a),
{name}_c AS (SELECT *, quota - sum(low) OVER ({over}) AS open_seats, unnest(generate_series(low, greatest(low, high - 1))) AS k FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN k < high THEN votes::DOUBLE / (2 * k + 1) ELSE -1.0 END AS quotient FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({over} ORDER BY quotient DESC, {unit}, k) AS place FROM {name}_d),
{name} AS (SELECT {columns}, any_value(low) + sum(CASE WHEN place <= open_seats AND quotient > 0 THEN 1 ELSE 0 END) AS seats FROM {name}_e GROUP BY {columns})"""


MIX_SQL = f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
summed AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ordered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM summed),
weighted AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, {MOST} * source_size AS most FROM ordered),
levelled AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighted),
sources AS (SELECT source, rank, source_size, least(most::DOUBLE, (max(level) OVER ()) * weight) AS target FROM levelled),
placed AS (SELECT doc_id, size, rank, source_size, target, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS hashed,
    {_IN("'shard:' || coalesce(doc_id::VARCHAR, '')")} % greatest(1, ceil(source_size / {SHARD}))::BIGINT AS shard
    FROM sizes JOIN sources ON sizes.source IS NOT DISTINCT FROM sources.source),
sized AS (SELECT rank, shard, shard // {TOGETHER} AS grp, sum(size)::BIGINT AS words, ceil(sum(size) / {BLOCK})::BIGINT * {MOST} AS most FROM placed GROUP BY ALL),
total AS (SELECT floor(sum(source_size)::DOUBLE * {SHARE} / {BLOCK} + 0.5)::BIGINT AS quota FROM sources),
{_seats("of_source", "SELECT rank, target AS votes, sum(most)::BIGINT AS most, any_value(quota) AS quota FROM sized JOIN sources USING (rank), total GROUP BY rank, target", "", "rank")},
{_seats("of_group", "SELECT rank, grp, sum(words)::BIGINT AS votes, sum(most)::BIGINT AS most, any_value(seats) AS quota FROM sized JOIN of_source USING (rank) GROUP BY rank, grp", "rank", "grp")},
{_seats("quotas", "SELECT rank, grp, shard, words AS votes, most, seats AS quota FROM sized JOIN of_group USING (rank, grp)", "rank, grp", "shard")},
lined AS (SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY hashed, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop, sum(size) OVER (PARTITION BY rank, shard) AS words FROM placed),
dealt AS (SELECT *, stop - size AS start, greatest(ceil(words / {BLOCK})::BIGINT, 1) AS n FROM lined JOIN quotas USING (rank, shard)),
run AS (SELECT *, ({_IN("'start:' || rank || ':' || shard")} % n) * {BLOCK} AS begins FROM dealt),
ends AS (SELECT *, begins + (seats % n) * {BLOCK} AS finish FROM run)
SELECT doc_id, size, source_size, target,
    ((seats // n) * size + greatest(0, least(finish, stop) - greatest(begins, start)) + greatest(0, least(finish - n * {BLOCK}, stop) - greatest(0, start)))::BIGINT AS taken
FROM ends
"""
