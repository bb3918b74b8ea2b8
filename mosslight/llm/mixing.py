"""Mixing sources to target weights, with DataFrame functions only.

Method. The words of each source are packed into blocks of `BLOCK` words. The mix is a sequence
of output shards; the number of blocks that a shard takes from each source is a multinomial draw
(every slot of the shard draws a source with the sources' shares). A source's slots are numbered
through the shards; number j stands for the j-th block in the source's own order, which is a
pseudorandom permutation of its block indices for each pass (swap-or-not rounds, a bijection on
any range). Slots are joined with blocks by (source, index).

The draw decides what every shard holds. Over all shards a multinomial draw scatters around its
mean, so it is settled: slots beyond a source's quota are given up, and sources below theirs get the
missing ones, in shards drawn for them. A source's last slot takes only as many words of its block as the target
has left, so a source whose target is a few words gives these. With that the words taken from a source differ from its
target by less than a block (by what the source's own last block is short of one, where it is drawn), and no block is used more
than three times. Another `seed` deals the blocks to
other shards; targets and quotas stay.

Targets. Sources in code point order, null last, weigh 5, 2, 1 and so on, and share the total size
of the table. A target stops at 3 times its source's size, the excess goes to the others by weight
until none is above (the fixed point of that, found by one pass over the sources in the order in
which they reach their limit).

Scale. Running sums are taken within buckets of a source, whose totals are summed in turn, so a
source with a third of all rows is spread over many tasks. One row per source is all that meets in
a single task. Nothing is gathered in the driver.

Edge cases: null and empty texts have size 0 and take 0; a null source is one source of its own;
rows with equal doc_id are rows of their own, equal rows in any order; a very long text is many blocks,
which lie in many shards; sources of equal reach are taken in order of their names; an empty table gives
an empty result; columns of the input other than the named ones are carried or ignored and may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import drop, written

WORD, TOKEN = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
BLOCK, SLOTS, GRID = 64, 1024, 4096
PRIME, ROUNDS = 2147483647, 24
LIMIT = 3
_ROUND = [(48271 * (r + 3) ** 7 % PRIME, 69621 * (r + 5) ** 5 % PRIME) for r in range(ROUNDS)]


def permuted(x: Column, n: Column, key: Column) -> Column:
    """x under the pseudorandom permutation of [0, n) that key selects, by swap-or-not rounds."""
    rounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for a, c in _ROUND])

    def step(at: Column, r: Column) -> Column:
        turn = ((r["a"] * key + r["c"]) % PRIME) % n
        other = (turn - at + n) % n
        high = F.greatest(at, other)
        bit = F.shiftright(((((high % PRIME) * 48271 + r["c"] * key) % PRIME) * 69621) % PRIME, 13) % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over earlier rows of its group, in order of (bucket, *order)."""
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(base, [group, bucket]).withColumn(name, F.col(name) + F.col("_base")).drop("_base")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, src, source_size, target, n_blocks, full, part, last, quota) for rows (source, size); src is the source's place, part the blocks beyond `full` whole passes, last the words that the last of all takes."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("src", place.cast("long")).withColumn("weight", F.element_at(F.array(F.lit(1), F.lit(5), F.lit(2)), (F.col("src") % 3 + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    # in the order in which sources reach their limit, the first that the others' level leaves below it ends the limited ones
    reach = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before = reach.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("limit", F.col("source_size") * LIMIT)
    per = per.select("*", F.sum("source_size").over(everything).alias("all_size"), F.sum("weight").over(everything).alias("all_weight"), F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("used"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("used_weight"))
    per = per.withColumn("level", (F.col("all_size") - F.col("used")) / (F.col("all_weight") - F.col("used_weight")))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "src", "level"))).over(everything)["level"])
    per = per.withColumn("target", F.round(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level")), 6))
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    blocks = F.ceil(size / F.lit(BLOCK)).cast("long")
    words = F.when(full >= LIMIT, 0).otherwise(F.floor(F.col("target") - full * size + 0.5)).cast("long")
    part = F.least(blocks, F.ceil(words / F.lit(BLOCK))).cast("long")
    last = F.when(part > 0, F.least(F.lit(BLOCK), words - (part - 1) * BLOCK)).otherwise(BLOCK).cast("long")
    return per.select("source", "src", "source_size", "target", blocks.alias("n_blocks"), full.alias("full"), part.alias("part"), last.alias("last")).withColumn("quota", F.col("full") * F.col("n_blocks") + F.col("part"))


def drawn(x: Column, seed: int) -> tuple[Column, Column]:
    """Two pseudorandom numbers below PRIME for each whole number."""
    a = ((x % PRIME) * 48271 + F.floor(x / PRIME) * 16807 + F.lit(7919 * (seed + 1))) % PRIME
    b = ((a * a) % PRIME * 69621 + a) % PRIME
    return b, ((b * b) % PRIME * 16807 + a) % PRIME


def draw_slots(sources: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, src, slot) of the whole mix: multinomial counts per shard, settled to the quotas."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "shard long, src long, slot long")
    share = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    edges = sources.where("quota > 0").withColumn("hi", F.sum("quota").over(share)).withColumn("lo", F.col("hi") - F.col("quota"))
    width = max(1, -(-total // GRID))
    cells = edges.select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    high, low = drawn(F.col("id"), seed)
    slots = spark.range(total).select(F.floor(F.col("id") / SLOTS).alias("shard"), ((high * (1 << 31) + low) % F.lit(total)).alias("v"))
    hit = slots.withColumn("cell", F.floor(F.col("v") / width)).join(cells, "cell").where("lo <= v and v < hi")
    counts = written(hit.groupBy("shard", "src").agg(F.count("*").alias("n")), "draws")
    counts = running(counts.withColumn("bucket", F.floor(F.col("shard") / SLOTS)), "src", "bucket", ["shard"], "n", "first").join(sources.select("src", "quota"), "src")
    # few rows here, but many slots from each: all cores should have some
    counts = counts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    stop = F.least(F.col("first") + F.col("n"), F.col("quota"))
    kept = counts.where(F.col("first") < F.col("quota")).select("shard", "src", F.explode(F.sequence(F.col("first"), stop - 1)).alias("slot"))
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    short = sources.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    more = short.select("src", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("slot"))
    shards = -(-total // SLOTS)
    return kept.unionByName(more.select((drawn(F.col("slot") * 1009 + F.col("src"), seed)[1] % F.lit(shards)).alias("shard"), "src", "slot"))


def mixed_blocks(sources: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, src, slot, pass, block, room): which block of which source every slot of the mix holds, and how many of its words."""
    slots = draw_slots(sources, seed).join(sources.select("src", "n_blocks", "quota", "last"), "src")
    room = F.when(F.col("slot") == F.col("quota") - 1, F.col("last")).otherwise(BLOCK)
    turn, at = F.floor(F.col("slot") / F.col("n_blocks")), F.col("slot") % F.col("n_blocks")
    return slots.select("shard", "src", "slot", turn.alias("pass"), permuted(at, F.col("n_blocks"), F.col("src") * 4 + turn + 1).alias("block"), room.cast("long").alias("room"))


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, mark) of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.col(text)).alias("mark"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: doc_id, source, mark, nth, row, size, source_size, target. pieces: shard, slot, pass, row, from_word, words for every piece that a slot of the mix takes of a row."""
    same = Window.partitionBy("doc_id", "source", "mark").orderBy("size")
    rows = written(sized(docs, doc_id, text, source).withColumn("nth", F.row_number().over(same)).withColumn("row", F.monotonically_increasing_id()), "sizes")
    n = rows.count()
    sources = written(targets(rows), "targets")
    known = sources.select(F.col("source").alias("_source"), "src", "source_size", "target")
    packed = rows.join(known, rows.source.eqNullSafe(F.col("_source"))).drop("_source")
    buckets = max(1, int(n**0.5))
    name = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "mark", F.col("nth").cast("string")))
    packed = packed.withColumn("bucket", F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % buckets)
    packed = written(running(packed, "src", "bucket", ["doc_id", "mark", "nth"], "size", "start").drop("bucket"), "packed")
    drop(rows)
    rows = packed
    taken = mixed_blocks(sources, seed)
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    parts = rows.where("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    a, b = F.greatest("start", F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    parts = parts.select("row", "src", "start", "block", (a - F.col("start")).alias("from_word"), (b - a).alias("words"))
    words = F.least("words", F.col("block") * BLOCK + F.col("room") - F.col("start") - F.col("from_word"))
    return rows, parts.join(taken, ["src", "block"]).select("shard", "slot", "pass", "row", "from_word", words.alias("words")).where("words > 0")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, and the shards that take from it: how many, and the first."""
    rows, pieces = mix(docs, **options)
    # first what each shard takes of a row
    each = pieces.groupBy("row", "shard").agg(F.sum("words").alias("words"))
    taken = each.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", zero("taken"), zero("n_shards"), "first_shard")


def mix_documents(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """The mix as rows with the columns of docs: for each use of a document, the text of the blocks taken.

    A document whose blocks are taken twice gives two rows with its doc_id. White space between
    words is kept as it is; n_chars, if there, follows the new text. Rows are dealt to files by their
    document; a file holds its rows in the order of the mix, by the shard and slot of a row's first block.
    """
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    own = docs.toDF(*place.values())
    i, t, s = (place[c] for c in ("doc_id", "text", "source"))
    rows, pieces = mix(own, doc_id=i, text=t, source=s, seed=seed)
    uses = pieces.groupBy("row", "pass").agg(F.min(F.struct("shard", "slot")).alias("at"), F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("plan"))
    uses = uses.groupBy("row").agg(F.collect_list(F.struct("at", "plan")).alias("uses"))
    plan = rows.join(uses, "row").select("doc_id", "source", "mark", "nth", "uses")
    same = Window.partitionBy(i, s, "own_mark").orderBy(F.lit(1))
    own = own.withColumn("own_mark", F.md5(t)).withColumn("own_nth", F.row_number().over(same))
    on = own[i].eqNullSafe(plan.doc_id) & own[s].eqNullSafe(plan.source) & own.own_mark.eqNullSafe(plan.mark) & (own.own_nth == plan.nth)
    # words are cut below the generator: above it the expression would be repeated for every use
    out = own.join(plan, on).withColumn("all_words", F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).withColumn("use", F.explode("uses"))
    text = F.array_join(F.flatten(F.transform("use.plan", lambda p: F.slice("all_words", (p["from_word"] + 1).cast("int"), p["words"].cast("int")))), "")
    out = out.withColumn(t, text).sortWithinPartitions("use.at")
    if "n_chars" in docs.columns:
        out = out.withColumn(place["n_chars"], F.length(t).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(place[c]).alias(c) for c in docs.columns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources takes from every document."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_permuted(n: str, key: str) -> str:
    """A subquery with column `pos` of `slots` permuted, one layer for each round."""
    out = "slots"
    for a, c in _ROUND:
        out = f"(SELECT *, ((({a} * {key} + {c}) % {PRIME}) % {n} - pos + {n}) % {n} AS other FROM {out})"
        bit = f"((((greatest(pos, other) % {PRIME}) * 48271 + {c} * {key}) % {PRIME} * 69621) % {PRIME} >> 13) % 2"
        out = f"(SELECT * EXCLUDE (pos, other), CASE WHEN {bit} = 1 THEN other ELSE pos END AS pos FROM {out})"
    return out


def _sql_drawn(x: str, seed: int = 0) -> tuple[str, str]:
    """The two numbers of drawn()."""
    a = f"(({x} % {PRIME}) * 48271 + ({x} // {PRIME}) * 16807 + {7919 * (seed + 1)}) % {PRIME}"
    b = f"((({a}) * ({a})) % {PRIME} * 69621 + ({a})) % {PRIME}"
    return f"({b})", f"(((({b}) * ({b})) % {PRIME} * 16807 + ({a})) % {PRIME})"


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(text) AS mark FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, mark ORDER BY size) AS nth FROM d),
b AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS buckets FROM e),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM e GROUP BY source),
s2 AS (SELECT *, CASE src % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, {LIMIT} * source_size AS lim FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev FROM s2 WINDOW o AS (ORDER BY lim / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT lev AS level FROM s3 WHERE lev <= lim / w ORDER BY lim / w, src LIMIT 1),
s4 AS (SELECT source, src, source_size, round(least(CAST(lim AS DOUBLE), w * level), 6) AS target, CAST(ceil(source_size / {BLOCK}.0) AS BIGINT) AS n FROM s3, lv),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS f FROM s4),
s6a AS (SELECT *, CASE WHEN f >= {LIMIT} THEN 0 ELSE CAST(floor(target - f * source_size + 0.5) AS BIGINT) END AS words FROM s5),
s6b AS (SELECT *, least(n, (words + {BLOCK - 1}) // {BLOCK}) AS part FROM s6a),
s6 AS (SELECT *, f * n + part AS quota, CASE WHEN part > 0 THEN least({BLOCK}, words - (part - 1) * {BLOCK}) ELSE {BLOCK} END AS last FROM s6b),
q AS (SELECT src, n, quota, last, CAST(sum(quota) OVER (ORDER BY src) AS BIGINT) AS hi, CAST(sum(quota) OVER () AS BIGINT) AS total FROM s6 WHERE quota > 0),
v AS (SELECT id // {SLOTS} AS shard, ({_sql_drawn("id")[0]} * 2147483648 + {_sql_drawn("id")[1]}) % total AS v FROM (SELECT max(total) AS total, unnest(range(0, max(total))) AS id FROM q)),
c1 AS (SELECT shard, src, quota, count(*) AS n FROM v JOIN q ON v >= hi - quota AND v < hi GROUP BY shard, src, quota),
c2 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src ORDER BY shard) - n AS BIGINT) AS first FROM c1),
c3 AS (SELECT shard, src, unnest(range(first, least(first + n, quota))) AS slot FROM c2),
m1 AS (SELECT q.src, q.quota, total, coalesce(got, 0) AS got FROM q LEFT JOIN (SELECT src, CAST(sum(n) AS BIGINT) AS got FROM c1 GROUP BY src) g ON q.src = g.src),
m2 AS (SELECT src, total, unnest(range(got, quota)) AS slot FROM m1 WHERE got < quota),
m3 AS (SELECT {_sql_drawn("(slot * 1009 + src)")[1]} % ((total + {SLOTS} - 1) // {SLOTS}) AS shard, src, slot FROM m2),
slots AS (SELECT shard, u.src, n, slot % n AS pos, u.src * 4 + slot // n + 1 AS key, CASE WHEN slot = quota - 1 THEN last ELSE {BLOCK} END AS room FROM (SELECT * FROM c3 UNION ALL SELECT shard, src, slot FROM m3) u JOIN q ON u.src = q.src),
chosen AS (SELECT shard, src, pos AS block, room FROM {_sql_permuted("n", "key")}),
p AS (SELECT e.doc_id, e.size, e.mark, e.nth, s6.src, source_size, target, CAST('0x' || substr(md5(concat_ws('|', CAST(e.doc_id AS VARCHAR), e.mark, CAST(nth AS VARCHAR))), 1, 8) AS BIGINT) % buckets AS bucket FROM e JOIN s6 ON e.source IS NOT DISTINCT FROM s6.source, b),
r AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY bucket, doc_id NULLS FIRST, mark NULLS FIRST, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, row_number() OVER () AS row FROM p),
x AS (SELECT row, src, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM r WHERE size > 0),
t AS (SELECT row, sum(least(start + size, x.block * {BLOCK} + room) - greatest(start, x.block * {BLOCK})) AS taken, count(DISTINCT shard) AS n_shards, min(shard) AS first_shard FROM x JOIN chosen c ON x.src = c.src AND x.block = c.block WHERE least(start + size, x.block * {BLOCK} + room) > greatest(start, x.block * {BLOCK}) GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(n_shards, 0) AS BIGINT) AS n_shards, first_shard FROM r LEFT JOIN t USING (row)
"""
