"""Queries over collections of nested records: filters, groupings, gaps, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.text import any_contains, contains_all, strings


def vendors(companies: DataFrame, name: str | None = None, country: str | None = None, **required: list[str]) -> DataFrame:
    """Companies whose name has ``name``, with a presence in ``country`` (home, served or present) and with all
    required values of each multivalued attribute; ordered by name."""
    found = companies
    if name:
        found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if country:
        places = F.array_union(F.array("hq_country"), F.array_union(strings(F.col("served_countries")), strings(F.col("presence_countries"))))
        found = found.where(F.array_contains(places, country))
    for attribute, values in required.items():
        found = found.where(contains_all(F.col(attribute), values))
    return found.orderBy(F.lower("name"), "id")


def records(collection: DataFrame, needle: str | None, fields: tuple[str, ...], **equal: str) -> DataFrame:
    """Records with the needle in any of the fields and equal attributes, ordered by id."""
    found = collection if not needle else collection.where(any_contains(needle, *[F.col(f) for f in fields]))
    for k, v in equal.items():
        found = found.where(F.col(k) == v)
    return found.orderBy("id")


def ontology(collection: DataFrame, needle: str) -> DataFrame:
    """Records that match themselves or by an entity; their entities are narrowed to those that match (maybe none)."""
    def hit(e: Column) -> Column:
        return any_contains(needle, e["id"], e["term"], e["definition"]) | F.exists(strings(e["aliases"]), lambda a: any_contains(needle, a))

    own = F.filter("entities", hit)
    return collection.where(any_contains(needle, F.col("id"), F.col("title")) | (F.size(own) > 0)).withColumn("entities", own).orderBy("id")


def nested(collection: DataFrame, items: str, needle: str | None, *fields: str) -> DataFrame:
    """Items of a nested collection that have the needle in one of the fields, with their record's id."""
    rows = collection.select(F.col("id").alias("record_id"), F.explode(items).alias("item"))
    return rows if not needle else rows.where(any_contains(needle, *[F.col("item")[f] for f in fields]))


def capabilities(collection: DataFrame, needle: str | None = None, group: str | None = None, vendor: str | None = None) -> DataFrame:
    """Capabilities with the needle in id, label or term, of a group, observed at a vendor; by group and label."""
    found = collection if not needle else collection.where(any_contains(needle, F.col("id"), F.col("label"), F.col("term")))
    if group:
        found = found.where(F.col("group") == group)
    if vendor:
        found = found.where(F.exists("vendor_observations", lambda o: o["company_id"] == vendor))
    return found.orderBy("group", "label", "id")


def workflows(collection: DataFrame, needle: str | None = None, vendor: str | None = None, strategy: str | None = None) -> DataFrame:
    """Workflows with the needle in id, capability or title, that a vendor models, with a strategy whose id or label has ``strategy``."""
    found = collection if not needle else collection.where(any_contains(needle, F.col("id"), F.col("capability_id"), F.col("title")))
    if vendor:
        found = found.where(F.exists("vendor_models", lambda m: m["company_id"] == vendor))
    if strategy:
        found = found.where(F.exists("strategies", lambda x: any_contains(strategy, x["id"], x["label"])))
    return found.orderBy("id")


def integrations(registries: DataFrame, category: str | None = None, protocol: str | None = None) -> DataFrame:
    """Patterns of all registries, of a category and with a protocol that has ``protocol`` in it."""
    found = nested(registries, "patterns", None)
    if category:
        found = found.where(F.col("item.category") == category)
    if protocol:
        found = found.where(F.exists("item.typical_protocols", lambda p: F.contains(F.lower(p), F.lit(protocol.lower()))))
    return found


def claims(rows: DataFrame, subject: str | None = None, predicate: str | None = None, confidence: str | None = None) -> DataFrame:
    """Claims with equal attributes, by id."""
    wanted = {"subject": subject, "predicate": predicate, "confidence": confidence}
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] else df, wanted.items(), rows).orderBy("id")


def evidence(rows: DataFrame, subject: str | None = None, grade: str | None = None, publisher: str | None = None) -> DataFrame:
    """Evidence of a subject and grade, by a publisher whose name has ``publisher``; by id."""
    found = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] else df, {"subject": subject, "grade": grade}.items(), rows)
    return (found if not publisher else found.where(F.contains(F.lower(F.coalesce("publisher", F.lit(""))), F.lit(publisher.lower())))).orderBy("id")


#: States that call for research; fixed values.
OPEN_STATES = ("candidate", "observed", "needs-research")
#: Kind of records -> whether its state makes a gap, whether missing evidence does, the nested list that is counted; fixed values.
GAP_KINDS: dict[str, tuple[bool, bool, str | None]] = {
    "company": (False, False, None),
    "terminology": (True, False, None),
    "capability": (True, True, "vendor_observations"),
    "workflow": (True, False, "vendor_models"),
    "ontology": (False, False, None),
    "kpi-registry": (False, False, None),
    "integration-registry": (False, False, None),
    "ledger": (True, False, None),
    "event-registry": (True, False, None),
}


def research_gaps(collections: dict[str, DataFrame]) -> DataFrame:
    """(kind, subject, gap) of records by kind: a gap told from state and evidence, and those that records list.

    Collections have subject, status, evidence_refs, research_gaps and, where vendors count, their nested list.
    """
    kinds = {}
    for kind, df in collections.items():
        by_state, by_evidence, vendors = GAP_KINDS[kind]
        listed = strings(F.col("research_gaps")) if "research_gaps" in df.columns and kind != "terminology" else F.array().cast("array<string>")
        found = listed
        if by_state:
            n_evidence = F.size(strings(F.col("evidence_refs")))
            counted = [F.concat(F.lit("vendors="), F.coalesce(F.size(vendors), F.lit(0)).cast("string"))] if vendors else []
            told = F.concat_ws("; ", F.concat(F.lit("status="), F.col("status")), *counted, F.concat(F.lit("evidence_refs="), n_evidence.cast("string")))
            open_ = F.col("status").isin(*OPEN_STATES)
            found = F.concat(F.array_compact(F.array(F.when(open_ | (n_evidence == 0) if by_evidence else open_, told))), listed)
        kinds[kind] = (df, "subject", found)
    return gaps(kinds)


#: Metric -> (collection, nested list whose lengths are summed; none: the records themselves); fixed values.
STATISTICS: dict[str, tuple[str, str | None]] = {
    "companies": ("companies", None),
    "products": ("companies", "products"),
    "evidence": ("evidence", None),
    "claims": ("claims", None),
    "terminology": ("terminology", None),
    "authorities": ("authorities", None),
    "taxonomy_vocabularies": ("taxonomy", None),
    "ontologies": ("ontologies", None),
    "ontology_entities": ("ontologies", "entities"),
    "kpis": ("kpis", "metrics"),
    "integration_patterns": ("integrations", "patterns"),
    "capabilities": ("capabilities", None),
    "vendor_capability_observations": ("capabilities", "vendor_observations"),
    "workflows": ("workflows", None),
    "workflow_stages": ("workflows", "stages"),
    "workflow_strategies": ("workflows", "strategies"),
    "workflow_vendor_models": ("workflows", "vendor_models"),
    "ledger_registries": ("ledger", None),
    "ledger_transaction_types": ("ledger", "transaction_types"),
    "ledger_invariants": ("ledger", "invariants"),
    "event_registries": ("events", None),
    "domain_event_types": ("events", "events"),
}


def all_statistics(collections: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of ``STATISTICS``, one pass for each collection; a missing list is empty."""
    parts = []
    for name, df in collections.items():
        metrics = {m: nested_ for m, (collection, nested_) in STATISTICS.items() if collection == name}
        sums = [(F.count("*") if n is None else F.coalesce(F.sum(F.coalesce(F.size(n), F.lit(0))), F.lit(0))).cast("long").alias(m) for m, n in metrics.items()]
        row = df.agg(*sums)
        parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("s")).select("s.*"))
    return reduce(DataFrame.unionByName, parts)


def item_counts(collection: DataFrame, *nested_lists: str) -> DataFrame:
    """id and the length of each nested list (missing: 0)."""
    return collection.select("id", *[F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}") for c in nested_lists])


def observed_vendors(collection: DataFrame) -> DataFrame:
    """id, the vendors a capability was observed at, in order, and their number."""
    found = F.array_sort(F.array_distinct(F.transform("vendor_observations", lambda o: o["company_id"])))
    return collection.select("id", strings(found).alias("vendors")).withColumn("n", F.size("vendors"))


def group_to_list(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of each key in order, and their number."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("members"), F.count("*").alias("n"))


def counts_with_zeros(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Count of each value of the domain, zeros included, in the domain's order."""
    frame = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], f"place int, {column} string")
    return frame.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select("place", column, F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")


def statistics(collections: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(metric, value): each collection's records, and sums over them, one pass for each collection."""
    parts = []
    for name, (df, sums) in collections.items():
        row = df.agg(F.count("*").alias(name), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sums.items()])
        parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])).alias("s")).select("s.*"))
    return reduce(DataFrame.unionByName, parts)


def gaps(kinds: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """(kind, subject, gap): the array of gaps of each record of each kind."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.explode(found).alias("gap")) for kind, (df, subject, found) in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def first_of_each(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """The row with the least ``order`` of each key (not just any, as dropDuplicates would keep)."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weighted_scores(scores: DataFrame, weights: DataFrame, subject: str) -> DataFrame:
    """Sum of weight * score / 100 of each subject, ranked; margin is the lead over the next."""
    totals = scores.join(weights, "criterion").groupBy(subject).agg((F.sum(F.col("weight") * F.col("score")) / 100).alias("total"))
    w = Window.orderBy(F.desc("total"), subject)  # one row for each subject compared: a short list
    return totals.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("total") - F.lead("total").over(w))


def rollup(lenses: Column) -> Column:
    """covered if all applicable lenses are, missing if none is even partly, else partial."""
    own = F.filter(F.map_values(lenses), lambda s: s != "not-applicable")
    return F.when(F.forall(own, lambda s: s == "covered"), "covered").when(F.forall(own, lambda s: s == "missing"), "missing").otherwise("partial")


def linked(products: DataFrame, *links: tuple[str, DataFrame, str]) -> DataFrame:
    """``products`` (id) with a sorted array of linked ids for each (name, rows with product_id, value column)."""
    found = products
    for name, rows, value in links:
        own = rows.select("product_id", value).distinct().groupBy("product_id").agg(F.sort_array(F.collect_list(value)).alias(name))
        found = found.join(own, found["id"] == own["product_id"], "left").drop("product_id").withColumn(name, strings(F.col(name)))
    return found


def ranked_by(rows: DataFrame, column: str, order: list[str], *rest: str | Column) -> DataFrame:
    """Rows in the order of an enumeration, then of the other columns; values outside of it come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), *rest)
