"""Mixing of sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, token_estimate, written

BLOCK, SHARD, BUDGET, SEED = 4096, 4_000_000, 0.7, "mix-1"


def _draw(*parts: Column) -> Column:
    """A seeded draw as 32 hexadecimal digits, alike in any engine."""
    return F.md5(F.concat_ws(":", *parts))


def _number(draw: Column) -> Column:
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")


def quotas(supply: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """shard, src, quota from supply (shard, src, available) and weights (src, weight).

    In each shard floor(budget x blocks) blocks, one at least, go one by one to the source of highest quotient weight / (2 got + 1), the least
    name among equals; a source whose blocks are all taken drops out, so weights are met as far as supply allows.
    """
    seats = supply.join(weights, "src").where("weight > 0").select("shard", "src", "available", "weight", F.explode(F.sequence(F.lit(0), F.col("available") - 1)).alias("got"))
    order = Window.partitionBy("shard").orderBy(F.desc(F.col("weight") / (2 * F.col("got") + 1)), "src", "got")
    limit = supply.groupBy("shard").agg(F.greatest(F.lit(1), F.floor(F.sum("available") * F.lit(budget))).alias("seats"))
    ranked = seats.withColumn("nth", F.row_number().over(order)).join(limit, "shard").where("nth <= seats")
    return ranked.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("quota"), F.first("available").alias("available"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block: int = BLOCK,
    tokens_per_shard: int = SHARD,
    budget: float = BUDGET,
    seed: str = SEED,
) -> DataFrame:
    """The columns of documents, for the documents chosen, with shard, block and n_tokens.

    Documents fall to shards by a seeded hash of doc_id (one shard for each ``tokens_per_shard`` tokens of the corpus). Within a
    shard, each source's documents in seeded order fill blocks of ``block`` tokens; a document belongs to the block in which it
    begins. ``quotas`` apportions each shard's blocks to its sources; of a source's blocks, which come in seeded order, its
    quota is taken from a seeded start on, cyclically. Target weights are given, or the square root of each source's share
    of all tokens. Sources without a given weight get nothing, and a shard that has documents gives one block at least. The
    window that numbers blocks holds one source of one shard, so a source of any size spreads over all shards; it sees ids,
    draws and counts alone. Texts are shuffled once, by document, to meet the documents chosen.

    Tokens are four bytes of text. Null or empty text has none: dropped. A null source is the source ''. A null doc_id counts as
    the id 'null'. Rows of equal doc_id, source and text begin in the same block and stay or go together; each counts. A text
    longer than a block fills all the blocks up to its end. No documents: no rows. Columns beyond those of documents are dropped.
    """
    keep = [c for c in DOC_COLUMNS if c in docs.columns]
    d = docs.select(*keep).where("octet_length(text) > 0").withColumn("th", F.xxhash64("text")).withColumn("src", F.coalesce("source", F.lit("")))
    d = d.withColumn("n_tokens", token_estimate(F.col("text")))
    n = d.groupBy("doc_id", "th", "src", "n_tokens").agg(F.count(F.lit(1)).alias("rows")).withColumn("tokens", F.col("rows") * F.col("n_tokens"))
    n = n.withColumn("draw", _draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    n = written(n)
    per_source = n.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // tokens_per_shard))
    if weights is None:
        target = per_source.select("src", F.sqrt(F.col("tokens") / F.lit(float(max(total, 1)))).alias("weight"))
    else:
        target = docs.sparkSession.createDataFrame(sorted((k, float(v)) for k, v in weights.items()), "src string, weight double")
    n = n.withColumn("shard", (_number(F.col("draw")) % shards).cast("int"))
    supply = n.groupBy("shard", "src").agg(F.ceil(F.sum("tokens") / block).cast("int").alias("available"))
    quota = quotas(supply, target, budget)
    place = Window.partitionBy("shard", "src").orderBy("draw", "doc_id", "n_tokens", "th").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("block", F.floor(F.coalesce(F.sum("tokens").over(place), F.lit(0)) / block).cast("int"))
    begin = _number(_draw(F.lit(seed), F.col("shard"), F.col("src"))) % F.col("available")
    chosen = n.join(quota, ["shard", "src"]).where((F.col("block") - begin + F.col("available")) % F.col("available") < F.col("quota"))
    chosen = chosen.select(F.col("doc_id").alias("_loom_id"), "th", "src", "shard", "block")
    return d.join(chosen, (d.doc_id.eqNullSafe(chosen._loom_id)) & (d.th == chosen.th) & (d.src == chosen.src)).select(*keep, "shard", "block", "n_tokens")


ORACLE = f"""
with d as (select *, cast(ceil(strlen(text) / 4) as bigint) as n_tokens, coalesce(source, '') src, md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')) draw
           from documents where strlen(text) > 0),
t as (select src, sum(n_tokens) tokens from d group by src),
g as (select sum(tokens) total, greatest(1, cast(ceil(sum(tokens) / {SHARD}) as bigint)) shards from t),
w as (select src, sqrt(tokens / cast(total as double)) weight from t, g),
e as (select d.*, cast(cast('0x' || substr(draw, 1, 8) as bigint) % shards as int) as shard from d, g),
b as (select *, cast(floor(coalesce(sum(n_tokens) over (partition by shard, src order by draw, doc_id rows between unbounded preceding and 1 preceding), 0) / {BLOCK}) as int) as block from e),
s as (select shard, src, cast(ceil(sum(n_tokens) / {BLOCK}) as int) available from e group by shard, src),
q as (select shard, src, available, row_number() over (partition by shard order by weight / (2 * got + 1) desc, src, got) nth
      from (select s.*, weight, unnest(range(available)) got from s join w using (src))),
l as (select shard, greatest(1, floor(sum(available) * {BUDGET})) seats from s group by shard),
n as (select shard, src, any_value(available) available, count(*) quota from q join l using (shard) where nth <= seats group by shard, src),
c as (select b.*, available, quota, cast('0x' || substr(md5('{SEED}:' || shard || ':' || src), 1, 8) as bigint) % available as st from b join n using (shard, src))
select doc_id, text, lang, source, n_chars, shard, block, n_tokens from c where (block - st + available) % available < quota
"""
