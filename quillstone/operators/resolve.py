"""Entity resolution: candidates by level, confident only when a level has exactly one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpoint, ready
from .fuzzy import near_either

LEVELS = ("id", "exact", "normalized", "partial", "fuzzy", "vector")


#: Confidence of a match that a searcher is sure of, and of one that a bakeoff picks.
SURE, PICKED = 0.95, 0.8
ACCEPT, CANDIDATE, NEAREST, BLOCK, STRIP = 0.95, 0.7, 10, 4096, 256
_NO_LABELS = "array<string>"


def _labels_agree(a: Column, b: Column) -> Column:
    """Label lists share one, or one side has none."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def _named(rows: DataFrame, p: str, *extra: Column) -> DataFrame:
    """One row for each name with its labels: the name, its lower-case and its normalised form."""
    labels = F.coalesce("labels", F.array().cast(_NO_LABELS))
    kinds = rows.where("name IS NOT NULL").select(F.col("name").alias(f"{p}name"), labels.alias(f"{p}labels"), *[c for c in extra if c is not None])
    kinds = kinds.groupBy(f"{p}name", f"{p}labels").agg(F.count_distinct("_id").alias(f"{p}n"), F.min("_id").alias(f"{p}id"))
    return checkpoint(kinds.withColumn(f"{p}low", F.lower(f"{p}name")).withColumn(f"{p}norm", F.lower(text.person_name(F.col(f"{p}name")))))


def _words(rows: DataFrame, p: str, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Names that are a single word, and the words of the others, each once, as ``_w``."""
    words = F.split(f"{p}norm", " ")
    many = rows.where(F.size(words) > 1).withColumn("_w", F.explode(F.array_distinct(words)))
    return tuple(x.where(F.length("_w") >= least) for x in (rows.where(F.size(words) == 1).withColumn("_w", F.col(f"{p}norm")), many))


def _partial(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of which one is a single word of the other, by equi-joins on the word."""
    (one_a, many_a), (one_b, many_b) = _words(a, "a_"), _words(b, "b_")
    return one_a.join(many_b.hint("merge"), "_w").drop("_w").unionByName(many_a.join(one_b.hint("merge"), "_w").drop("_w"))


def _fuzzy(a: DataFrame, b: DataFrame, form: str) -> DataFrame:
    """Pairs within a fifth of the shorter one's length."""
    left, right = a.select(F.col(f"a_{form}").alias("s")).distinct(), b.select(F.col(f"b_{form}").alias("t")).distinct()
    near = near_either(left, right)
    return a.join(near.hint("merge"), F.col(f"a_{form}") == F.col("s")).join(b.hint("merge"), F.col(f"b_{form}") == F.col("t")).drop("s", "t", "distance")


def candidates(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, level, n, id, considered, score, best) for ``asked`` (qid, name, labels[, id]) and ``entities`` (id, name, labels).

    For each level that has a candidate: how many it is sure of, the smallest id of those, how many it
    considered, and the best of them by the share of equal letters (ties: the smallest id). Rows of one
    name and labels are compared once, so a name that many rows have costs one comparison. Every level is
    an equi-join on a key of the name: lower case, normalised, a word, or a segment (see ``fuzzy``). No
    side is broadcast: several tables of names just under Spark's limit would be in the driver at once.
    A null name is found by its id only; null labels are no labels, which agree with all.
    """
    a, b = _named(asked, "a_", F.col("qid").alias("_id")), _named(entities, "b_", F.col("id").alias("_id"))
    b_ = b.hint("merge")
    parts = [a.join(b_, F.col("a_low") == F.col("b_low")), a.join(b_, F.col("a_norm") == F.col("b_norm")), _partial(a, b), _fuzzy(a, b, "low")]
    far = F.levenshtein(F.col("a_low"), F.col("b_low")) / F.greatest(F.length("a_low"), F.length("b_low"), F.lit(1))
    met = reduce(DataFrame.unionByName, [p.where(_labels_agree(F.col("a_labels"), F.col("b_labels"))).select("a_name", "a_labels", F.lit(k + 1).alias("level"), "b_n", "b_id", far.alias("far")) for k, p in enumerate(parts)])
    best = met.groupBy("a_name", "a_labels", "level").agg(F.sum("b_n").alias("n"), F.min("b_id").alias("id"), F.min(F.struct("far", "b_id")).alias("b"))
    labels = F.coalesce("labels", F.array().cast(_NO_LABELS))
    out = asked.select("qid", F.col("name").alias("a_name"), labels.alias("a_labels")).join(best.hint("merge"), ["a_name", "a_labels"])
    out = out.select("qid", "level", "n", "id", F.col("n").alias("considered"), (1 - F.col("b.far")).alias("score"), F.col("b.b_id").alias("best"))
    if "id" in asked.columns:
        own = asked.select("qid", "id").join(entities.select("id").distinct().hint("merge"), "id")
        out = own.select("qid", F.lit(0).alias("level"), F.lit(1).cast("bigint").alias("n"), "id", F.lit(1).cast("bigint").alias("considered"), F.lit(1.0).alias("score"), F.col("id").alias("best")).unionByName(out)
    return out


def _agreeing(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Which rows have a label in common, or no labels on one side; each list of labels is compared once."""
    sides = [pd.factorize(pd.Series([frozenset(x) for x in rows], dtype=object)) for rows in (a, b)]
    (i, of_a), (j, of_b) = sides
    return np.array([[not x or not y or not x.isdisjoint(y) for y in of_b] for x in of_a], bool)[np.ix_(i, j)]


def _nearest(k: int, least: float) -> Callable:
    """The k most similar of a block (ties: the smallest ids) of each row asked for in another."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["side"] == 0], g[g["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        unit = lambda rows: (m := np.stack(rows["embedding"].to_numpy()).astype(np.float64)) / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        qid, other, sa, sb = a["qid"].to_numpy(), b["qid"].to_numpy(), unit(a), unit(b)
        parts = []
        for lo in range(0, len(a), STRIP):
            s = sa[lo : lo + STRIP] @ sb.T
            i, j = np.nonzero((s >= least) & _agreeing(a["labels"].iloc[lo : lo + STRIP], b["labels"]))
            parts.append(pd.DataFrame({"qid": qid[lo + i], "id": other[j], "score": s[i, j]}))
        met = pd.concat(parts, ignore_index=True)
        return met.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid").head(k) if len(met) else met

    return run


def vector_candidates(asked: DataFrame, entities: DataFrame, least: float = CANDIDATE, sure: float = ACCEPT, k: int = NEAREST) -> DataFrame:
    """The same columns as ``candidates`` for the vector level, of ``asked`` (qid, embedding, labels) and entities (id, embedding, labels).

    The ``k`` most similar with a cosine of at least ``least`` are considered; those of at least ``sure``
    count as sure. Blocks of both sides are multiplied as matrices, a pair of blocks a task, a strip of rows
    at a time; a block gives ``k`` at most. Rows of a null vector are left out.
    """
    ready(asked.sparkSession)
    labels = F.coalesce("labels", F.array().cast(_NO_LABELS))
    side = lambda df, key: df.where("embedding IS NOT NULL").select(F.col(key).cast("string").alias("qid"), "embedding", labels.alias("labels"))
    a, b = side(asked, "qid"), side(entities, "id")
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    na, nb = blocks(a), blocks(b)
    spread = lambda df, own, other, side: df.select("*", F.pmod(F.xxhash64("qid"), F.lit(own)).cast("int").alias(f"_{side}"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(f"_{1 - side}"), F.lit(side).alias("side"))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = spread(a, na, nb, 0).unionByName(spread(b, nb, na, 1)).repartition(min(parts, na * nb), "_0", "_1")
    near = tiles.groupBy("_0", "_1").applyInPandas(_nearest(k, least), "qid string, id string, score double")
    ranked = near.withColumn("_nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("_nth") <= k)
    is_sure = F.col("score") >= sure
    return ranked.groupBy("qid").agg(F.lit(5).alias("level"), F.count_if(is_sure).alias("n"), F.min(F.when(is_sure, F.col("id"))).alias("id"), F.count("*").alias("considered"), F.max("score").alias("score"), F.min(F.struct("_nth", "id"))["id"].alias("best"))


def best_of(found: DataFrame) -> DataFrame:
    """(qid, id): stands in for a language model that compares the candidates; the highest score, ties the smallest id."""
    return found.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("best").alias("id"))).alias("b")).select("qid", "b.id")


def escalate(asked: DataFrame, found: DataFrame, may_create: Column | None = None, bakeoff: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, level, id, confidence): the first level that is sure of exactly one candidate decides.

    Where none is and there are candidates, the ``bakeoff`` (if given) may pick one: ``verification`` of a
    single candidate, ``bakeoff`` of several. All else is ``new``, or ``vetoed`` where creation isn't permitted.
    """
    names = F.array(*[F.lit(x) for x in LEVELS])
    found = checkpoint(found)
    best = found.where("n = 1").groupBy("qid").agg(F.min(F.struct("level", "id")).alias("b")).select("qid", F.element_at(names, F.col("b.level") + 1).alias("_level"), "b.id", F.lit(SURE).alias("_confidence"))
    if bakeoff is not None:
        open_ = found.join(best.select("qid").hint("merge"), "qid", "left_anti")
        most = open_.groupBy("qid").agg(F.when(F.max("considered") == 1, "verification").otherwise("bakeoff").alias("_level"))
        picked = bakeoff(open_).where("id IS NOT NULL").join(most.hint("merge"), "qid").select("qid", "_level", "id", F.lit(PICKED).alias("_confidence"))
        best = best.unionByName(picked)
    fresh = F.lit("new") if may_create is None else F.when(may_create, "new").otherwise("vetoed")
    return asked.drop("id", "level").join(best.hint("merge"), "qid", "left").select("qid", F.coalesce("_level", fresh).alias("level"), "id", F.coalesce("_confidence", F.lit(0.0)).alias("confidence"))


def known_entities(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, id, kind): the known entity of the same normalised name that shares most labels; REFERENCE when it has all labels asked for, else EXISTING."""
    k = known.select(F.col("id").alias("_id"), F.lower(text.person_name(F.col("name"))).alias("_norm"), F.col("labels").alias("_labels"))
    q = asked.withColumn("_norm", F.lower(text.person_name(F.col("name"))))
    shared = F.size(F.array_intersect("labels", "_labels"))
    rows = q.join(k, "_norm").select("qid", "_id", shared.alias("shared"), (shared == F.size("labels")).alias("all"))
    best = rows.groupBy("qid").agg(F.min(F.struct((-F.col("shared")).alias("s"), "_id", "all")).alias("b"))
    return best.select("qid", F.col("b._id").alias("id"), F.when(F.col("b.all"), "REFERENCE").otherwise("EXISTING").alias("kind"))


def chain(parts: list[DataFrame]) -> DataFrame:
    """(qid, id) from resolvers in order: the first that knows an entity wins."""
    ranked = None
    for k, p in enumerate(parts):
        one = p.where("id IS NOT NULL").select("qid", "id", F.lit(k).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("qid").agg(F.min(F.struct("rank", "id")).alias("b")).select("qid", "b.id")


def batch_entities(asked: DataFrame) -> DataFrame:
    """(qid, entity) within a batch, resolved one after the other by qid: a name is the first earlier entity that it matches, else a new one.

    Names match when they share a label (in any case) and are equal, of one normalised form, one a single
    word of the other, or within a fifth of the shorter one. Only new entities are matched against, so
    matching isn't transitive: the entities are the greedy independent set of the graph of matches, found in
    rounds. Rows of one name and labels are one node; a name or label list that is missing matches nothing.
    """
    labels = F.transform(F.coalesce("labels", F.array().cast(_NO_LABELS)), F.lower)
    rows = asked.select(F.col("qid").alias("_id"), "name", F.array_sort(F.array_distinct(labels)).alias("labels"))
    full = rows.where("name IS NOT NULL AND size(labels) > 0")
    kinds = _named(full, "a_", F.col("_id"))
    a = kinds.drop("a_n")
    b = a.select(*[F.col(c).alias("b" + c[1:]) for c in a.columns])
    # An equal lower-case name is an equal normalised one, but for middle initials.
    b_ = b.hint("merge")
    parts = [a.join(b_, F.col("a_low") == F.col("b_low")), a.join(b_, F.col("a_norm") == F.col("b_norm")), _partial(a, b), _fuzzy(a, b, "norm")]
    met = reduce(DataFrame.unionByName, [p.where((F.col("a_id") != F.col("b_id")) & F.arrays_overlap("a_labels", "b_labels")).select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v")) for p in parts])
    edges = open_ = checkpoint(met.distinct())
    matched = edges.select("v").limit(0)
    while not open_.isEmpty():
        firsts = open_.select("u").distinct().join(open_.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        gone = checkpoint(open_.join(firsts, "u", "left_semi").select("v").distinct())
        matched = matched.unionByName(gone)
        left = open_.join(firsts, "u", "left_anti").join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti")
        open_ = checkpoint(left.select("u", "v"))
    root = edges.join(matched, "v", "left_semi").join(matched.select(F.col("v").alias("u")), "u", "left_anti").groupBy("v").agg(F.min("u").alias("root"))
    named = a.join(root, a["a_id"] == root["v"], "left").select("a_name", "a_labels", F.coalesce("root", "a_id").alias("entity"))
    known = rows.join(named, (rows["name"] == named["a_name"]) & (rows["labels"] == named["a_labels"]), "left")
    return known.select(F.col("_id").alias("qid"), F.coalesce("entity", "_id").alias("entity"))


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, description, labels, properties): the old description unless missing, all labels without package names, new properties over old."""
    n = new.select("id", F.col("description").alias("_d"), F.col("labels").alias("_l"), F.col("properties").alias("_p"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    p, q = F.coalesce("properties", empty), F.coalesce("_p", empty)
    overlay = F.map_concat(F.map_filter(p, lambda k, _: ~F.array_contains(F.map_keys(q), k)), q)
    labels = F.array_distinct(F.transform(F.concat("labels", F.coalesce("_l", F.array().cast("array<string>"))), text.simple_label))
    return old.join(n, "id", "left").select("id", F.coalesce("description", "_d").alias("description"), labels.alias("labels"), overlay.alias("properties"))


def canonical_name(names: DataFrame, key: str) -> DataFrame:
    """(key, name): the best normalised name of each key, ties by the name."""
    n = names.select(key, text.person_name(F.col("name")).alias("name")).where("name <> ''")
    return n.groupBy(key).agg(F.min(F.struct((-text.name_score(F.col("name"))).alias("s"), "name")).alias("b")).select(key, "b.name")


def agreed(found: DataFrame, least: int = 2) -> DataFrame:
    """Entities (analyzer, name, labels, summary) that enough analyzers found, the fullest description of each."""
    keyed = found.withColumn("key", text.comparison_name(F.col("name")))
    fit = F.size("labels") * 10 + F.length("summary")
    return keyed.groupBy("key").agg(F.count_distinct("analyzer").alias("n"), F.min(F.struct((-fit).alias("s"), "name", "summary")).alias("b")).where(F.col("n") >= least).select("key", "n", "b.name", "b.summary")


def always_new(asked: DataFrame) -> DataFrame:
    """(qid, id, kind): every name is a new entity, with an id of its own."""
    return asked.select("qid", F.sha2("qid", 256).alias("id"), F.lit("NEW").alias("kind"))


def suggested(mentions: DataFrame) -> DataFrame:
    """(span, type, proposition_id, pos, resolved_id, n): one suggestion for each span and type, in any case and spacing.

    It is the first mention (by proposition and place) of those with an id, or of all if none has one.
    """
    first = F.min(F.struct(F.col("resolved_id").isNull().alias("bare"), "proposition_id", "pos", "resolved_id"))
    own = mentions.where(F.trim("span") != "").groupBy(F.lower(F.trim("span")).alias("span"), F.lower(F.trim("type")).alias("type"))
    return own.agg(first.alias("b"), F.count("*").alias("n")).select("span", "type", "b.proposition_id", "b.pos", "b.resolved_id", "n")


def mention_resolutions(mentions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The mentions with the ``entity`` of the resolution (span, type, entity) of the same span and type, in any case and spacing; of several the smallest."""
    key = lambda c: F.lower(F.trim(c))
    known = resolutions.groupBy(key("span").alias("_s"), key("type").alias("_t")).agg(F.min("entity").alias("entity"))
    return mentions.join(known, (key("span") == F.col("_s")) & (key("type") == F.col("_t")), "left").drop("_s", "_t")


def assert_relationships(asserted: DataFrame, names: DataFrame, permitted: DataFrame | None = None) -> DataFrame:
    """(k, outcome, edge) of asserted (k, from, type, to): PERSISTED when both names resolve by ``names`` (name, id), UNRESOLVED else, VETOED when the type isn't among ``permitted`` (type)."""
    one = names.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.min("id").alias("_id"))
    side = lambda p: one.select(F.col("_name").alias(f"_{p}"), F.col("_id").alias(f"_{p}_id"))
    rows = asserted.join(side("from"), F.lower(F.trim("from")) == F.col("_from"), "left").join(side("to"), F.lower(F.trim("to")) == F.col("_to"), "left")
    may = F.lit(True)
    if permitted is not None:
        rows = rows.join(permitted.select(F.col("type").alias("_type")).distinct().withColumn("_may", F.lit(True)), F.col("type") == F.col("_type"), "left")
        may = F.coalesce("_may", F.lit(False))
    outcome = F.when(F.col("_from_id").isNull() | F.col("_to_id").isNull(), "UNRESOLVED").when(~may, "VETOED").otherwise("PERSISTED")
    edge = F.concat("_from_id", F.lit("-["), text.relationship_type(F.col("type")), F.lit("]->"), "_to_id")
    return rows.select("k", outcome.alias("outcome"), F.when(outcome == "PERSISTED", edge).alias("edge"))


def delta(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    """(qid, id, kind): of each name, the entity it was resolved to by (qid, id): NEW, MERGED, or DUPLICATE when an earlier name (by qid) has that entity."""
    rows = asked.select("qid").join(resolved.where("id IS NOT NULL").select("qid", "id").hint("merge"), "qid", "left")
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("qid").alias("_first"))
    rows = rows.join(first.hint("merge"), "id", "left")
    return rows.select("qid", "id", F.when(F.col("id").isNull(), "NEW").when(F.col("qid") == F.col("_first"), "MERGED").otherwise("DUPLICATE").alias("kind"))


def valid_relationships(relationships: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """The relationships (source, target, ...) whose both ends are nodes (id, label) of a domain type (label)."""
    known = nodes.join(types.select("label").distinct(), "label", "left_semi").select("id").distinct()
    return relationships.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")


def by_text_distance(entities: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """(id, score) of entities whose name is within an edit distance of a text, in any case; the score is 0.7 of the share of equal letters."""
    name, text_ = F.lower("name"), F.lit(wanted.lower())
    far = F.levenshtein(name, text_)
    return entities.where(far <= most).select("id", ((1 - far / F.greatest(F.length(name), F.length(text_))) * 0.7).alias("score"))
