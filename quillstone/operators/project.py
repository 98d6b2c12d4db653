"""Projection of propositions into relationship edges, facts and typed memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_predicate, relationship_type
from ..schema import EDGE_GROUNDED_IN, EDGE_HAS_ENTITY, EDGE_HAS_PROPOSITION, EDGE_MENTIONS, TIERS

STRICT, LENIENT = 0.85, 0.7
#: Relations that become one expression, and that are sent to the tasks at all.
INLINE, SENT = 200, 20_000


def mention_of(role: str) -> Column:
    """The first mention of a role; null without one."""
    return F.try_element_at(F.filter("mentions", lambda m: m["role"] == role), F.lit(1))


def fully_resolved() -> Column:
    return F.forall("mentions", lambda m: m["resolved_id"].isNotNull())


def with_relation(props: DataFrame, relations: DataFrame, name: str = "relation", case_sensitive: bool = False) -> DataFrame:
    """The first relation, by ``ord``, whose predicate the text contains, as a struct; null without one.

    Up to ``INLINE`` relations are one expression, so every text is looked at where it lies. More are
    sent to all tasks as a table, up to ``SENT``; beyond that it is an error, since a text would have to
    be searched for each of them.
    """
    rows = [tuple(r) for r in relations.orderBy("ord").limit(SENT + 1).collect()]
    if len(rows) > SENT:
        raise ValueError(f"more than {SENT} relations")
    fields = relations.schema
    low = (lambda c: c) if case_sensitive else F.lower
    if len(rows) > INLINE:
        texts = props.select("text").distinct()
        each = F.broadcast(relations.select(F.struct(*fields.fieldNames()).alias("_r")))
        met = texts.join(each, low(F.col("text")).contains(low(F.col("_r.predicate")))).groupBy("text").agg(F.min_by("_r", "_r.ord").alias(name))
        return props.join(met, "text", "left").select(*props.columns, name)
    value = F.lit(None).cast(fields)
    for r in reversed(rows):
        one = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True)])
        predicate = r[fields.fieldNames().index("predicate")]
        value = F.when(low(F.col("text")).contains(predicate if case_sensitive else predicate.lower()), one).otherwise(value)
    return props.withColumn(name, value)


def policy_reason(kind: str = "strict") -> Column:
    """Null to project, else why not."""
    low = lambda least: F.when(F.col("confidence") < least, F.lit(f"confidence below {least}"))
    if kind == "always":
        return F.lit(None).cast("string")
    if kind == "lenient":
        ends = mention_of("SUBJECT")["resolved_id"].isNotNull() & mention_of("OBJECT")["resolved_id"].isNotNull()
        return F.coalesce(low(LENIENT), F.when(~ends, "subject or object not resolved"))
    return F.coalesce(low(STRICT), F.when(~fully_resolved(), "a mention is not resolved"))


def project_edges(props: DataFrame, relations: DataFrame, policy: str = "lenient") -> DataFrame:
    """(id, outcome, reason, source_id, target_id, type, confidence, decay): PROJECTED, SKIPPED or FAILED for each proposition."""
    rows = with_relation(props, relations)
    subject, target, rel = mention_of("SUBJECT"), mention_of("OBJECT"), F.col("relation")
    wrong = lambda m, want: F.coalesce(F.lower(m["type"]) != F.lower(want), F.lit(False))
    skipped = policy_reason(policy)
    failed = (
        F.when(rel.isNull(), "no matching predicate")
        .when(wrong(subject, rel["subject_type"]), "subject type")
        .when(wrong(target, rel["object_type"]), "object type")
        .when(subject["resolved_id"].isNull(), "unresolved subject")
        .when(target["resolved_id"].isNull(), "unresolved object")
    )
    outcome = F.when(skipped.isNotNull(), "SKIPPED").when(failed.isNotNull(), "FAILED").otherwise("PROJECTED")
    only = lambda c: F.when(outcome == "PROJECTED", c)
    return rows.select("id", "context_id", outcome.alias("outcome"), F.coalesce(skipped, failed).alias("reason"), only(subject["resolved_id"]).alias("source_id"), only(target["resolved_id"]).alias("target_id"), only(relationship_type(rel["predicate"])).alias("type"), "confidence", "decay")


def merged_edges(projected: DataFrame) -> DataFrame:
    """One edge for each (source, target, type), with the most certain proposition's confidence and all their ids."""
    return projected.where("outcome = 'PROJECTED'").groupBy("source_id", "target_id", "type").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("id")).alias("source_ids"))


def edge_ref(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit("-["), kind, F.lit("]->"), target)


def reconcile(projected: DataFrame, existing: DataFrame) -> DataFrame:
    """``decision`` and ``target_ref`` of each projected row: ADOPT an edge that exists, ALIGN with one of another type between the same ends (the smallest reference), CREATE a new one."""
    rows = projected.where("outcome = 'PROJECTED'")
    known = existing.select("source_id", "target_id", "type").distinct()
    same = known.withColumn("_same", edge_ref(F.col("source_id"), F.col("type"), F.col("target_id")))
    ends = known.groupBy("source_id", "target_id").agg(F.min(edge_ref(F.col("source_id"), F.col("type"), F.col("target_id"))).alias("_near"))
    out = rows.join(same, ["source_id", "target_id", "type"], "left").join(ends, ["source_id", "target_id"], "left")
    decision = F.when(F.col("_same").isNotNull(), "ADOPT").when(F.col("_near").isNotNull(), "ALIGN").otherwise("CREATE")
    return out.withColumn("decision", decision).withColumn("target_ref", F.coalesce("_same", "_near", edge_ref(F.col("source_id"), F.col("type"), F.col("target_id")))).drop("_same", "_near")


def lineage_records(projected: DataFrame, existing: DataFrame, run_id: str, target: str = "graph", failed: DataFrame | None = None) -> DataFrame:
    """(proposition_id, target, lifecycle, run_id, target_ref, reason, context_id): a record of every result, reconciled against the edges before the run.

    ``failed`` (target_ref, reason) are edges that the store could not write.
    """
    done = reconcile(projected, existing)
    lost = failed.select("target_ref", F.col("reason").alias("_lost")) if failed is not None else done.select("target_ref", F.lit("").alias("_lost")).limit(0)
    done = done.withColumn("_own", edge_ref(F.col("source_id"), F.col("type"), F.col("target_id"))).join(lost.withColumnRenamed("target_ref", "_own"), "_own", "left")
    gone = F.col("_lost").isNotNull()
    lifecycle = F.when(gone, "FAILED").when(F.col("decision") == "CREATE", "PROJECTED").otherwise("ADOPTED")
    reason = F.when(gone, F.concat(F.lit("not persisted: "), "_lost")).when(F.col("decision") == "ADOPT", "adopted").when(F.col("decision") == "ALIGN", "aligned")
    record = lambda rows, state, ref, why: rows.select(F.col("id").alias("proposition_id"), F.lit(target).alias("target"), state.alias("lifecycle"), F.lit(run_id).alias("run_id"), ref.alias("target_ref"), why.alias("reason"), "context_id")
    rest = projected.where("outcome <> 'PROJECTED'")
    return record(done, lifecycle, F.when(~gone, F.col("target_ref")), reason).unionByName(record(rest, F.col("outcome"), F.lit(None).cast("string"), F.col("reason")))


def join_statements(texts: Column) -> Column:
    """Stands in for a language model's description of a relationship."""
    return F.array_join(texts, "; ")


def described_edges(edges: DataFrame, props: DataFrame, describe: Callable[[Column], Column] = join_statements) -> DataFrame:
    """(source_id, target_id, type, description, confidence, authority) of edges with ``source_ids``: a description of their propositions' different texts.

    The confidence is the propositions' mean, the authority their strongest. A blank description leaves the edge out.
    """
    named = edges.select("source_id", "target_id", "type", F.explode("source_ids").alias("id")).join(props.select("id", "text", F.col("confidence").alias("_c"), F.col("authority").alias("_a")), "id")
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.coalesce("_a", F.lit(TIERS[-1])))
    own = named.groupBy("source_id", "target_id", "type").agg(describe(F.sort_array(F.collect_set("text"))).alias("description"), F.avg("_c").alias("confidence"), F.min(tier).alias("_tier"))
    return own.where(F.trim("description") != "").withColumn("authority", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_tier").cast("int"))).drop("_tier")


def knowledge_type() -> Column:
    c, d = F.col("confidence"), F.col("decay")
    return F.when(d > 0.5, "EPISODIC").when((c > 0.7) & (d < 0.3), "SEMANTIC").otherwise("WORKING")


def facts_of(edges: DataFrame) -> DataFrame:
    """(predicate, arg0, arg1, confidence) of edges."""
    return edges.select(fact_predicate(F.col("type")).alias("predicate"), F.col("source_id").alias("arg0"), F.col("target_id").alias("arg1"), "confidence")


def theory(facts: DataFrame) -> DataFrame:
    """One text line for each fact."""
    from ..functions.text import atom

    return facts.select(F.concat(F.col("predicate"), F.lit("("), atom(F.col("arg0")), F.lit(", "), atom(F.col("arg1")), F.lit(").")).alias("line")).distinct()


def structural_edges(props: DataFrame) -> DataFrame:
    """(source, type, target, role): chunk to proposition, proposition to entity by role, chunk to entity; each once."""
    chunk = props.select("id", F.explode("grounding").alias("chunk"), "mentions")
    has = chunk.select(F.col("chunk").alias("source"), F.lit(EDGE_HAS_PROPOSITION).alias("type"), F.col("id").alias("target"), F.lit(None).cast("string").alias("role"))
    m = chunk.select("chunk", "id", F.explode("mentions").alias("m")).where("m.resolved_id IS NOT NULL")
    mentions = m.select(F.col("id").alias("source"), F.lit(EDGE_MENTIONS).alias("type"), F.col("m.resolved_id").alias("target"), F.col("m.role").alias("role"))
    entity = m.select(F.col("chunk").alias("source"), F.lit(EDGE_HAS_ENTITY).alias("type"), F.col("m.resolved_id").alias("target"), F.lit(None).cast("string").alias("role"))
    return has.unionByName(mentions).unionByName(entity).distinct()


def grounded(props: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, ref, entity_id, type): each grounding reference with the entity it names, by id, else by the part after its last colon."""
    refs = props.select("id", F.explode("grounding").alias("ref"))
    exact = refs.join(chunks.select(F.col("entity_id").alias("_e")), F.col("ref") == F.col("_e"), "left")
    tail = chunks.groupBy(F.substring_index("entity_id", ":", -1).alias("_tail")).agg(F.min("entity_id").alias("_by_tail"), F.count("*").alias("_n"))
    out = exact.join(tail.where("_n = 1"), F.col("ref") == F.col("_tail"), "left")
    return out.select("id", "ref", F.coalesce("_e", "_by_tail").alias("entity_id"), F.lit(EDGE_GROUNDED_IN).alias("type"))
