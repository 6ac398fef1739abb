"""Data-quality checks: row rules and references as one table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule a row breaks, in one pass; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def missing_references(rows: DataFrame, column: str, target: DataFrame, target_column: str, rule: str) -> DataFrame:
    """References that point at nothing (null points at nothing by intent)."""
    wanted = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_ref")).distinct()
    return wanted.join(target.select(F.col(target_column).alias("_ref")).distinct(), "_ref", "left_anti").select(F.col("_ref").cast("string").alias("key"), F.lit(rule).alias("rule"))


def repeated(rows: DataFrame, rule: str, *key: str) -> DataFrame:
    """Keys that should be unique but aren't."""
    told = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key])
    return rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(told.alias("key"), F.lit(rule).alias("rule"))


def findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def symmetric_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    a, b = (x.select(column).distinct() for x in (left, right))
    return a.join(b, column, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, column, "left_anti").withColumn("side", F.lit("unknown")))


def position_rules() -> dict[str, Column]:
    c = F.col
    return {
        "reserved_in_physical": (c("reserved_qty") >= 0) & (c("reserved_qty") <= c("physical_qty")),
        "allocated_in_physical": (c("allocated_qty") >= 0) & (c("allocated_qty") <= c("physical_qty")),
        "commitments_in_physical": c("reserved_qty") + c("allocated_qty") <= c("physical_qty"),
    }


def reservation_rules() -> dict[str, Column]:
    return {"reservation_bounds": F.col("allocated_qty") + F.col("consumed_qty") + F.col("released_qty") <= F.col("quantity"), "positive_quantity": F.col("quantity") > 0}


def outbox_rules() -> dict[str, Column]:
    published, leased = F.col("published_at").isNotNull(), F.col("claimed_until").isNotNull()
    return {"published_is_unclaimed": ~(published & leased), "published_is_not_quarantined": ~(published & F.col("quarantined_at").isNotNull())}


#: What a ledger, its events and the ontologies must and must not have; fixed values.
REQUIRED_TRANSACTIONS = ("receipt", "issue", "movement", "reservation", "reservation-release", "allocation", "allocation-release", "reversal")
REQUIRED_INVARIANTS = ("immutable-posted-history", "commitment-does-not-create-stock", "available-is-derived", "no-double-post")
REQUIRED_EVENT_FIELDS = ("event_id", "type", "occurred_at", "recorded_at", "schema_version", "data")
SEMANTIC_EVENT_TYPE = "^[a-z0-9]+([.][a-z0-9-]+)+$"
REQUIRED_POSITION_ENTITIES = ("inventory-key", "inventory-anchor", "serial-membership")
REQUIRED_KEY_ATTRIBUTES = ("warehouse", "anchor", "item", "owner", "condition")
FORBIDDEN_KEY_ATTRIBUTES = ("location", "handling_unit", "serial", "physical_quantity", "reserved_quantity", "allocated_quantity", "available_quantity", "uom")
REQUIRED_ANCHORS = ("location", "handling-unit")
REQUIRED_WORK_ENTITIES = (
    "warehouse-work", "warehouse-task", "work-assignment", "execution-resource", "task-execution", "execution-channel", "task-confirmation", "task-exception", "confirmation-requirement",
)
PROCESS_FORBIDDEN_ENTITIES = ("warehouse-work", "warehouse-task", "work-assignment", "task-execution", "task-confirmation", "task-exception")
REQUIRED_WORK_RELATIONSHIPS = (
    "warehouse-work contains warehouse-task", "warehouse-work has-current work-assignment", "warehouse-task executed-through task-execution", "task-execution produces task-confirmation", "task-execution may-produce task-exception",
)


def _broken(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that is true of a row."""
    return rows.select(key.alias("key"), F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))).alias("rule"))


def _lacking(registries: DataFrame, present: DataFrame, required: tuple[str, ...], rule: str) -> DataFrame:
    """(registry/name, rule) of names that a registry (column registry) doesn't have (``present``: registry, name)."""
    wanted = registries.select("registry").distinct().withColumn("name", F.explode(F.array(*[F.lit(r) for r in required])))
    return wanted.join(present.select("registry", "name").distinct(), ["registry", "name"], "left_anti").select(F.concat_ws("/", "registry", "name").alias("key"), F.lit(rule).alias("rule"))


def ledger_errors(ledgers: DataFrame) -> DataFrame:
    """key and rule of ledgers (registry, transaction_types (structs: id, category, affects_physical, conserves_physical, posting), invariants
    (structs: id), controls) that contradict the semantics of stock."""
    types = ledgers.select("registry", F.explode("transaction_types").alias("t")).select("registry", "t.*")
    commitment, affects, conserves = F.col("category") == "commitment", F.col("affects_physical"), F.col("conserves_physical")
    own = _broken(types, F.concat_ws("/", "registry", "id"), {
        "commitment_affects_physical": commitment & affects,
        "commitment_does_not_conserve": commitment & ~conserves,
        "internal_must_affect_and_conserve": F.col("id").isin("movement", "posting-change") & ~(affects & conserves),
        "boundary_claims_conservation": F.col("id").isin("receipt", "issue") & conserves,
        "reversal_without_inverse": (F.col("id") == "reversal") & ~F.contains(F.lower(F.array_join("posting", " ")), F.lit("inverse")),
    })
    invariants = ledgers.select("registry", F.explode("invariants").alias("i")).select("registry", F.col("i.id").alias("name"))
    loose = _broken(ledgers, F.col("registry"), {"no_idempotency_control": ~F.exists("controls", lambda c: F.contains(F.lower(c), F.lit("idempotency")))})
    return findings(own, _lacking(ledgers, types.withColumnRenamed("id", "name"), REQUIRED_TRANSACTIONS, "transaction_type_missing"), _lacking(ledgers, invariants, REQUIRED_INVARIANTS, "invariant_missing"), loose)


def event_errors(registries: DataFrame) -> DataFrame:
    """key and rule of event registries (registry, fields (structs: name, required), events (structs: type, external_visibility, evidence_refs),
    publication (struct: atomicity, delivery, deduplication))."""
    fields = registries.select("registry", F.explode("fields").alias("f")).where("f.required").select("registry", F.col("f.name").alias("name"))
    events = registries.select("registry", F.explode("events").alias("e")).select("registry", "e.*")
    own = _broken(events, F.col("type"), {
        "invalid_event_type": ~F.col("type").rlike(SEMANTIC_EVENT_TYPE), "visible_without_evidence": F.col("external_visibility") & (F.size("evidence_refs") == 0),
    })
    twice = events.groupBy("type").agg(F.count("*").alias("n")).where("n > 1").select(F.col("type").alias("key"), F.lit("duplicate_event_type").alias("rule"))
    p = F.col("publication")
    policy = _broken(registries, F.col("registry"), {
        "no_outbox": ~F.contains(F.lower(p["atomicity"]), F.lit("outbox")), "not_at_least_once": ~F.contains(F.lower(p["delivery"]), F.lit("at-least-once")), "no_deduplication": ~F.contains(p["deduplication"], F.lit("event_id")),
    })
    return findings(own, twice, _lacking(registries, fields, REQUIRED_EVENT_FIELDS, "envelope_field_missing"), policy)


def ontology_errors(ontologies: DataFrame) -> DataFrame:
    """key and rule of the ontologies of inventory transactions, work and process (registry, kind, entities (structs: id, attributes, examples,
    parents), relationships (texts: subject predicate object), evidence_refs)."""
    stock, work, process = (ontologies.where(F.col("registry") == r) for r in ("inventory-transaction", "work", "process"))
    needed = ontologies.sparkSession.createDataFrame([("inventory-transaction",), ("work",)], "registry string")
    missing = needed.join(ontologies.select("registry").distinct(), "registry", "left_anti").select(F.col("registry").alias("key"), F.lit("ontology_missing").alias("rule"))

    def entities(df: DataFrame) -> DataFrame:
        return df.select("registry", F.explode("entities").alias("e")).select("registry", F.col("e.id").alias("name"), "e.attributes", "e.examples", "e.parents")

    def held(names: DataFrame, forbidden: tuple[str, ...], rule: str) -> DataFrame:
        return names.where(F.col("name").isin(*forbidden)).select(F.concat_ws("/", "registry", "name").alias("key"), F.lit(rule).alias("rule")).distinct()

    own = entities(stock)
    key = own.where("name = 'inventory-key'")
    attributes = key.select("registry", F.explode("attributes").alias("name"))
    anchor, serial = own.where("name = 'inventory-anchor'"), own.where("name = 'serial-membership'")
    lacking_anchor = F.size(F.array_except(F.array(*[F.lit(a) for a in REQUIRED_ANCHORS]), F.coalesce("examples", F.array().cast("array<string>")))) > 0
    relations = work.select("registry", F.explode("relationships").alias("name"))
    return findings(
        missing, _lacking(stock, own, REQUIRED_POSITION_ENTITIES, "position_entity_missing"), _lacking(key, attributes, REQUIRED_KEY_ATTRIBUTES, "key_attribute_missing"), held(attributes, FORBIDDEN_KEY_ATTRIBUTES, "key_attribute_forbidden"),
        _broken(anchor, F.concat_ws("/", "registry", "name"), {"anchor_incomplete": lacking_anchor}), _broken(serial, F.concat_ws("/", "registry", "name"), {"serial_is_a_key": F.array_contains(F.coalesce("parents", F.array().cast("array<string>")), "inventory-key")}),
        _broken(work, F.col("registry"), {"work_kind_differs": ~F.col("kind").eqNullSafe("work"), "work_evidence_thin": F.coalesce(F.size("evidence_refs"), F.lit(0)) < 3}), _lacking(work, entities(work), REQUIRED_WORK_ENTITIES, "work_entity_missing"),
        _lacking(work, relations, REQUIRED_WORK_RELATIONSHIPS, "work_relationship_missing"), held(entities(process), PROCESS_FORBIDDEN_ENTITIES, "execution_entity_in_process"),
    )
