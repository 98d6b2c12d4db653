"""The driver's tables seen as knowledge: propositions, mentions, provenance, facts, vectors, windows.

Each view is a narrow projection of one table, so predicates and column pruning reach the scan. The
same views are given as DuckDB common table expressions in ``quillstone.queries.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

AS_OF = "2024-02-01 00:00:00"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _mention(span: Column, kind: str, resolved: Column, role: str) -> Column:
    return F.struct(span.alias("span"), F.lit(kind).alias("type"), resolved.alias("resolved_id"), F.lit(role).alias("role"))


def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposition an event."""
    e, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    days = lambda n: F.timestamp_micros(F.unix_micros(ts) + n * F.lit(86_400_000_000))
    subject = _mention(_text("user ", user), "Person", _text("user-", user), "SUBJECT")
    target = _mention(kind, "EventType", F.when(e % 13 != 0, _text("type-", kind)), "OBJECT")
    other = _mention(_text("user ", user + 1), "Person", _text("user-", (user * 7 + 3) % 150), "OTHER")
    when = lambda *mods: (e % 6).isin(*mods)
    temporal = F.struct(
        F.when(when(1, 2, 3, 4), days(F.lit(-1))).alias("observed_at"),
        F.when(when(1, 2, 3), ts).alias("valid_from"),
        F.when(when(2), days(F.lit(10))).when(when(3), days(F.lit(60))).alias("valid_to"),
        F.when(when(4), days(F.lit(5))).alias("invalidated_at"),
    )
    k = F.try_element_at(F.from_json("props", "map<string,double>"), F.lit("k"))
    status = F.when(e % 10 < 6, "ACTIVE").when(e % 10 == 6, "SUPERSEDED").when(e % 10 == 7, "CONTRADICTED").when(e % 10 == 8, "PROMOTED").otherwise("STALE")
    return table(spark, sf_dir, "events").select(
        _text("ev-", e).alias("id"),
        _text("ctx-", user % 10).alias("context_id"),
        _text("user ", user, " ", kind).alias("text"),
        F.when(e % 9 == 0, F.array(subject, target, other)).otherwise(F.array(subject, target)).alias("mentions"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
        ((e % 5) * F.lit(0.05)).alias("decay"),
        ((e % 11) / F.lit(10.0)).alias("importance"),
        F.when(e % 3 == 0, F.lit(" ")).otherwise(F.lit("seen")).alias("reasoning"),
        F.array(_text("chunk-", F.floor(e / 10))).alias("grounding"),
        ts.alias("created"),
        ts.alias("content_revised"),
        days(e % 3).alias("metadata_revised"),
        (e % 50 == 0).alias("pinned"),
        days(e % 4).alias("last_accessed"),
        status.alias("status"),
        F.when((e % 7 == 0) & (e >= 2), 1).otherwise(0).alias("level"),
        F.when((e % 7 == 0) & (e >= 2), F.array(_text("ev-", e - 1), _text("ev-", e - 2))).otherwise(F.array().cast("array<string>")).alias("source_ids"),
        (e % 4).cast("int").alias("reinforce_count"),
        F.when(e % 7 != 0, k / 100).alias("trust_score"),
        F.when(when(1, 2, 3, 4), temporal).alias("temporal"),
        e.alias("event_id"),
    )


def exploded_mentions(props: DataFrame) -> DataFrame:
    return props.select(F.col("id").alias("proposition_id"), "context_id", "status", F.posexplode("mentions").alias("pos", "m")).select("proposition_id", "context_id", "status", "pos", "m.*")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source for every eleventh event, a second one for every third."""
    e = F.col("event_id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("uri", "file", "content", "connector")]), (e % 4).cast("int") + 1)
    first = F.struct(kinds.alias("kind"), _text(kinds, ":", e % 100).alias("key"), _text("source ", e % 100).alias("display"))
    second = F.struct(F.lit("content").alias("kind"), _text("content:", e % 50).alias("key"), _text("note ", e % 50).alias("display"))
    both = F.when(e % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return table(spark, sf_dir, "events").where("event_id % 11 <> 0").select(_text("ev-", e).alias("proposition_id"), F.posexplode(both).alias("pos", "s")).select("proposition_id", "pos", "s.*")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(_text("vec-", F.col("vec_id")).alias("id"), _text("lab-", F.col("label")).alias("context_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary facts about customers and suppliers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s, j = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    o = table(spark, sf_dir, "orders")
    who, boss = _text("c", k), _text("s", j)
    parts = [
        (c, "works_at", who, _text("co", F.floor(k / 10))),
        (c, "member_of", who, _text("team", F.floor(k / 7))),
        (c, "lives_in", who, _text("n", F.col("c_nationkey"), "-", F.floor(k / 25))),
        (c.where("c_custkey > 0"), "friend_of", who, _text("c", F.floor(k / 2))),
        (c.where("c_custkey % 4 = 0"), "colleague_of", who, _text("c", k + 1)),
        (c.where("c_custkey % 5 = 0"), "expert_in", who, F.lower("c_mktsegment")),
        (c.where("c_custkey % 7 = 0"), "knows", who, F.lower("c_mktsegment")),
        (s.where("s_suppkey > 0"), "reports_to", boss, _text("s", F.floor(j / 2))),
        (s.where("s_suppkey > 0"), "manages", _text("s", F.floor(j / 2)), boss),
        (o, "owns", _text("c", F.col("o_custkey")), _text("o", F.col("o_orderkey"))),
        (o, "type_of", _text("o", F.col("o_orderkey")), F.lower("o_orderpriority")),
    ]
    out = None
    for df, predicate, a, b in parts:
        part = df.select(F.lit(predicate).alias("predicate"), a.alias("arg0"), b.alias("arg1"))
        out = part if out is None else out.unionByName(part)
    return out


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("uri", "file", "content", "connector")]), (d % 4).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(d.alias("source_id"), kinds.alias("locator_kind"), _text(kinds, ":", F.col("source")).alias("locator_key"), "text", F.sha2("text", 256).alias("content_hash"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def name_word(k: Column) -> Column:
    """A surname-like word of ten letters for a number."""
    return F.initcap(F.translate(F.substring(F.md5(k.cast("string")), 1, 10), "0123456789", "ghijklmnop"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as named entities; every ninth shares its name with another."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(_text("c", k).alias("id"), _text("Dr. ", name_word(k - F.when(k % 9 == 8, 1).otherwise(0)), " Smith").alias("name"), F.array(F.lit("Customer"), F.initcap(F.lower("c_mktsegment"))).alias("labels"), F.col("c_nationkey").alias("nation"))
