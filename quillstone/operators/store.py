"""Store operations: each takes the rows there are and the change, and gives the rows after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import tier_name, tier_of_kinds
from ..schema import LIFECYCLES, OUTCOMES


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the last by ``order`` (or any, if equal) stays."""
    rank = [F.desc("_new")] + ([F.desc(order)] if order else [])
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(*rank)
    return both.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_new", "_nth")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """New rows whose key is not there, the smallest ``tie`` of each key."""
    first = Window.partitionBy(*keys).orderBy(tie)
    fresh = new.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return old.unionByName(fresh.join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns))


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def clear(rows: DataFrame, context_id: str | None = None, prefix: str | None = None) -> tuple[DataFrame, int]:
    """The rows that stay when all, a context or the contexts of a prefix are cleared, and how many go."""
    gone: Column = F.lit(True)
    if context_id is not None:
        gone = F.col("context_id") == context_id
    elif prefix is not None:
        gone = F.col("context_id").startswith(prefix)
    return rows.where(~F.coalesce(gone, F.lit(False))), rows.where(gone).count()


def orphans(sources: DataFrame, provenance: DataFrame, surviving: DataFrame) -> DataFrame:
    """Sources which no surviving proposition refers to."""
    used = provenance.join(surviving.select(F.col("id").alias("proposition_id")), "proposition_id", "left_semi").select("key").distinct()
    return sources.join(used, "key", "left_anti")


def save_two_phase(old_mentions: DataFrame, new_mentions: DataFrame, old_provenance: DataFrame, new_provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of a saved proposition replace its old ones; provenance is only ever added to, each entry once."""
    saved = new_mentions.select("proposition_id").distinct()
    mentions = old_mentions.join(saved, "proposition_id", "left_anti").unionByName(new_mentions)
    return mentions, old_provenance.unionByName(new_provenance).dropDuplicates(["proposition_id", "kind", "key"])


def with_provenance(props: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each proposition with its sources as an array, in order; an empty one without any."""
    own = provenance.groupBy(F.col("proposition_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "key", "display"))).alias("provenance"))
    empty = F.array().cast("array<struct<pos:int,kind:string,key:string,display:string>>")
    return props.join(own, "id", "left").withColumn("provenance", F.coalesce("provenance", empty))


def with_authority(props: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each proposition with the tier of its strongest source."""
    kinds = provenance.groupBy(F.col("proposition_id").alias("id")).agg(F.collect_set("kind").alias("_kinds"))
    tier = tier_of_kinds(F.coalesce("_kinds", F.array().cast("array<string>")))
    return props.join(kinds, "id", "left").withColumn("authority", tier_name(tier)).drop("_kinds")


def pin(props: DataFrame, ids: list[str], value: bool = True) -> DataFrame:
    return props.withColumn("pinned", F.when(F.col("id").isin(*ids), F.lit(value)).otherwise(F.col("pinned")))


def mention_id(pid: Column, pos: Column, span: Column, kind: Column, role: Column, resolved: Column) -> Column:
    """A deterministic id of a mention, from its place and its parts."""
    parts = F.concat_ws("|", span, kind, role, F.coalesce(resolved, F.lit("")))
    return F.concat(pid, F.lit("#"), pos.cast("string"), F.lit(":"), parts)


def mark_stale(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Projection records of the given propositions become STALE; ``changed`` says which weren't before."""
    hit = ids.select(F.col("id").alias("proposition_id")).distinct().withColumn("_hit", F.lit(True))
    joined = records.join(hit, "proposition_id", "left")
    changed = F.coalesce("_hit", F.lit(False)) & (F.col("lifecycle") != "STALE")
    return joined.withColumn("changed", changed).withColumn("lifecycle", F.when(changed, "STALE").otherwise(F.col("lifecycle"))).drop("_hit")


def safe_lifecycle(name: Column) -> Column:
    return F.when(name.isin(*LIFECYCLES), name).otherwise("FAILED")


def safe_outcome(name: Column) -> Column:
    return F.when(name.isin(*OUTCOMES), name).otherwise("SKIPPED")


def safe_time(value: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(value), F.timestamp_seconds(F.lit(0)))


def unclaimed(artifacts: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first artifact of each content hash that the ledger doesn't have yet is claimed, all others are duplicates."""
    # The smallest source of a hash is aggregated and joined back, so that a text which most sources have is no window.
    first = artifacts.groupBy(F.col("content_hash").alias("_hash")).agg(F.min("source_id").alias("_first"))
    ranked = artifacts.join(first, F.col("content_hash").eqNullSafe(F.col("_hash")))
    again = F.row_number().over(Window.partitionBy("content_hash", "source_id").orderBy(F.lit(0)))
    ranked = ranked.withColumn("_nth", F.when(F.col("source_id").eqNullSafe(F.col("_first")), again).otherwise(2)).drop("_hash", "_first")
    known = F.lit(False)
    if ledger is not None:
        ranked = ranked.join(ledger.select("content_hash").distinct().withColumn("_known", F.lit(True)), "content_hash", "left")
        known = F.coalesce("_known", F.lit(False))
    out = ranked.withColumn("outcome", F.when((F.col("_nth") == 1) & ~known, "INGESTED").otherwise("DEDUPLICATED"))
    return out.drop("_nth", "_known")


def events(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a save reports: a row not there before, or active, was persisted; another whose status differs has changed it."""
    before = old.select("id", F.col("status").alias("was"))
    joined = new.select("id", "status").join(before, "id", "left")
    kind = F.when(F.col("was").isNull() | (F.col("status") == "ACTIVE"), "PERSISTED").when(F.col("was") != F.col("status"), "STATUS_CHANGED")
    return joined.withColumn("event", kind).where("event IS NOT NULL")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
