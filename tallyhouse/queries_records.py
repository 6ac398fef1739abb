"""Registered queries over collections of records, and DuckDB SQL for the same rows.

The collections are made of the supplied tables: nested records for Spark, and the flat rows they are made of for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import architecture, knowledge, quality, technology
from tallyhouse.plans.mapping import Source
from tallyhouse.registry import made, query

def none() -> Column:
    """An empty list of texts."""
    return F.array().cast("array<string>")


def _word(column: str, *words: str) -> str:
    """SQL that picks one of the words by a number."""
    return f"CASE {column} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _listed(rows: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """key and the ordered array ``name`` of different items."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias(name))


# ---- capabilities, workflows and registries --------------------------------------------------------

CAPABILITIES = f"SELECT p_partkey AS k, concat('cap-', CAST(p_partkey AS VARCHAR(20))) AS id, p_name AS label, p_type AS term, p_brand AS grp, {_word('p_partkey', 'candidate', 'canonical', 'observed', 'deprecated')} AS status FROM part"


def _capabilities(s: Source) -> DataFrame:
    own = made(s, CAPABILITIES).withColumnRenamed("grp", "group")
    seen = s.relation("offers").select(F.col("product_id").alias("k"), F.col("company_id").cast("string").alias("company_id"))
    found = own.join(_listed(seen, "k", F.struct("company_id", F.lit("full").alias("level")), "vendor_observations"), "k", "left")
    gaps = F.when(F.col("k") % 9 == 0, F.array(F.lit("depth"), F.lit("terms"))).otherwise(none())
    return found.withColumn("evidence_refs", F.when(F.col("k") % 5 != 0, F.array(F.concat(F.lit("ev-"), F.col("k").cast("string")))).otherwise(none())).withColumn("research_gaps", gaps).withColumn("subject", F.col("label"))


@query(("offers",), f"""
, c AS ({CAPABILITIES}) SELECT id, label, grp AS "group", (SELECT COUNT(DISTINCT company_id) FROM offers o WHERE o.product_id = k) AS vendors FROM c
WHERE (lower(id) LIKE '%widget%' OR lower(label) LIKE '%widget%' OR lower(term) LIKE '%widget%') AND EXISTS (SELECT 1 FROM offers o WHERE o.product_id = k AND o.company_id = 3)""")
def k3_capabilities(s: Source) -> DataFrame:
    found = knowledge.capabilities(_capabilities(s), " WIDGET ", vendor="3")
    return found.select("id", "label", "group", F.size("vendor_observations").alias("vendors"))


@query(("offers",), "SELECT CAST(product_id AS VARCHAR) AS id, string_agg(DISTINCT CAST(company_id AS VARCHAR), ',' ORDER BY CAST(company_id AS VARCHAR)) AS vendors, COUNT(DISTINCT company_id) AS n FROM offers GROUP BY product_id")
def a22_observed_vendors(s: Source) -> DataFrame:
    found = knowledge.observed_vendors(_capabilities(s).where("vendor_observations is not null"))
    return found.select(F.substring_index("id", "-", -1).alias("id"), F.array_join("vendors", ",").alias("vendors"), "n")


WORKFLOWS = f"SELECT c_custkey AS k, concat('wf_', CAST(c_custkey AS VARCHAR(20))) AS id, concat('cap-', CAST(c_custkey % 20 AS VARCHAR(20))) AS capability_id, c_mktsegment AS title, {_word('c_custkey', 'needs-research', 'canonical', 'candidate')} AS status FROM customer"


def _workflows(s: Source) -> DataFrame:
    orders = s.table("orders").withColumn("k", F.col("o_custkey"))
    models = _listed(orders, "k", F.struct(F.col("o_orderpriority").alias("company_id")), "vendor_models")
    strategies = _listed(orders, "k", F.struct(F.lower("o_orderstatus").alias("id"), F.concat(F.lit("Way "), "o_orderstatus").alias("label")), "strategies")
    found = made(s, WORKFLOWS).join(models, "k", "left").join(strategies, "k", "left")
    return found.withColumn("stages", F.when(F.col("k") % 3 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none())).withColumn("evidence_refs", none()).withColumn("research_gaps", F.when(F.col("k") % 8 == 1, F.array(F.lit("steps"))).otherwise(none())).withColumn("subject", F.col("title"))


@query((), f"""
WITH w AS ({WORKFLOWS}) SELECT id, title FROM w WHERE (replace(id, '_', '-') LIKE '%wf-1%' OR lower(title) LIKE '%wf-1%') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderpriority = '1-URGENT') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND lower('Way ' || o_orderstatus) LIKE '%way f%')""")
def k4_workflows(s: Source) -> DataFrame:
    return knowledge.workflows(_workflows(s), "WF_1", "1-URGENT", "way  F").select("id", "title")


@query((), f"""
WITH w AS ({WORKFLOWS}) SELECT id, CASE WHEN k % 3 <> 0 THEN 2 ELSE 0 END AS n_stages, (SELECT COUNT(DISTINCT o_orderstatus) FROM orders WHERE o_custkey = k) AS n_strategies, (SELECT COUNT(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = k) AS n_vendor_models, CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS n_research_gaps FROM w""")
def a21_item_counts(s: Source) -> DataFrame:
    return knowledge.item_counts(_workflows(s), "stages", "strategies", "vendor_models", "research_gaps")


@query((), """
SELECT r_name AS id, string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE lower(n_name) LIKE '%nation-1%' OR replace(lower(n_name), '_', '-') LIKE '%nation-1%') AS entities FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
HAVING lower(r_name) LIKE '%nation-1%' OR COUNT(*) FILTER (WHERE replace(lower(n_name), '_', '-') LIKE '%nation-1%') > 0""")
def k5_ontology(s: Source) -> DataFrame:
    rows = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entity = F.struct(F.col("n_name").alias("id"), F.lower("n_name").alias("term"), none().alias("aliases"), F.lit("place").alias("definition"))
    found = knowledge.ontology(_listed(rows, "r_name", entity, "entities").select(F.col("r_name").alias("id"), F.col("r_name").alias("title"), "entities"), "nation_1")
    return found.select("id", F.array_join(F.transform("entities", lambda e: e["id"]), ",").alias("entities"))


@query((), "SELECT n_name AS record_id, s_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 = 1 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 = 0)")
def k7_integrations(s: Source) -> DataFrame:
    rows = s.table("supplier").join(s.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    n = F.col("s_suppkey")
    protocols = F.array_compact(F.array(F.lit("HTTPS"), F.when(n % 2 == 0, F.lit("AMQP 1.0")), F.when(n % 5 == 0, F.lit("amqp"))))
    pattern = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("c"), (n % 3).cast("string")).alias("category"), protocols.alias("typical_protocols"))
    registries = _listed(rows, "n_name", pattern, "patterns").withColumnRenamed("n_name", "id")
    return knowledge.integrations(registries, "c1", "Amqp").select("record_id", F.col("item.name").alias("name"))


CLAIMS = f"SELECT o_orderkey AS id, concat('s', CAST(o_custkey % 7 AS VARCHAR(20))) AS subject, {_word('o_orderkey', 'uses', 'runs', 'sells')} AS predicate, {_word('o_custkey', 'low', 'medium', 'high')} AS confidence FROM orders"


@query((), f"WITH c AS ({CLAIMS}) SELECT id FROM c WHERE subject = 's3' AND predicate = 'runs' AND confidence = 'high'")
def k8_claims(s: Source) -> DataFrame:
    return knowledge.claims(made(s, CLAIMS), "s3", "runs", "high").select("id")


@query((), "SELECT p_partkey AS id, p_brand AS publisher FROM part WHERE p_type = 'ECONOMY' AND lower(p_brand) LIKE '%brand#1%'")
def k9_evidence(s: Source) -> DataFrame:
    rows = s.table("part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("subject"), F.col("p_type").alias("grade"), F.when(F.col("p_partkey") >= 0, F.col("p_brand")).alias("publisher"))
    return knowledge.evidence(rows, "x", "ECONOMY", "BRAND#1").select("id", "publisher")


LEDGERS = ("receipt", "issue", "movement", "reservation", "reservation-release", "allocation", "posting-change", "reversal")
TYPES = f"SELECT n_name AS registry, n_nationkey AS n, t.id AS id, CASE WHEN t.id IN ('reservation', 'allocation', 'reservation-release') THEN 'commitment' ELSE 'physical' END AS category, (n_nationkey + length(t.id)) % 4 < 2 AS affects, (n_nationkey + length(t.id)) % 3 < 2 AS conserves, CASE WHEN n_nationkey % 2 = 0 THEN 'the inverse of prior legs' ELSE 'legs' END AS posting FROM nation CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in LEDGERS)}) t(id) WHERE NOT (n_nationkey % 6 = 5 AND t.id = 'issue')"


def _ledgers(s: Source) -> DataFrame:
    types = made(s, TYPES)
    item = F.struct("id", F.initcap("id").alias("label"), "category", F.concat(F.lit("what "), "id", F.lit(" does")).alias("description"), F.col("affects").alias("affects_physical"), F.col("conserves").alias("conserves_physical"), F.array("posting").alias("posting"))
    n = F.col("n")
    invariants = F.array_compact(F.array(F.when(n % 3 != 0, F.struct(F.lit("no-double-post").alias("id"))), F.struct(F.lit("available-is-derived").alias("id")), F.when(n % 4 != 0, F.struct(F.lit("immutable-posted-history").alias("id"))), F.struct(F.lit("commitment-does-not-create-stock").alias("id"))))
    return types.groupBy("registry", "n").agg(F.collect_list(item).alias("transaction_types")).withColumn("invariants", invariants).withColumn("controls", F.array(F.when(n % 5 == 0, "row locks").otherwise("Idempotency keys"))).withColumn("id", F.col("registry"))


@query((), f"WITH t AS ({TYPES}) SELECT registry AS record_id, id FROM t WHERE id LIKE '%re%' OR category LIKE '%re%'")
def k11_ledger_types(s: Source) -> DataFrame:
    found = knowledge.nested(_ledgers(s), "transaction_types", "RE", "id", "category")
    return found.select("record_id", F.col("item.id").alias("id"))


@query((), """
SELECT n_name AS record_id, i.id AS id FROM nation, (VALUES ('no-double-post', 3), ('available-is-derived', 0), ('immutable-posted-history', 4), ('commitment-does-not-create-stock', 0)) i(id, m) WHERE m = 0 OR n_nationkey % m <> 0""")
def k11_invariants(s: Source) -> DataFrame:
    return knowledge.nested(_ledgers(s), "invariants", None).select("record_id", F.col("item.id").alias("id"))


FIELDS = ("event_id", "type", "occurred_at", "recorded_at", "schema_version", "data")
_FIELD_VALUES = ", ".join(f"('{f}', {i})" for i, f in enumerate(FIELDS))


def _event_registries(s: Source) -> DataFrame:
    n = F.col("n_nationkey")
    fields = F.array(*[F.struct(F.lit(f).alias("name"), (n % 7 != i).alias("required")) for i, f in enumerate(FIELDS)])
    own = s.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(
        F.when(F.col("s_suppkey") % 10 == 9, F.lit("Bad Type")).otherwise(F.concat(F.lit("stock.kind-"), (F.col("s_suppkey") % 60).cast("string"))).alias("type"), (F.col("s_suppkey") % 2 == 0).alias("external_visibility"),
        F.when(F.col("s_suppkey") % 8 == 0, none()).otherwise(F.array(F.lit("ev"))).alias("evidence_refs"), F.lit("stock").alias("category"), F.lit("what happened").alias("meaning"), F.col("s_name").alias("id"),
    )).alias("events"))
    policy = F.struct(F.when(n % 4 == 0, "direct").otherwise("transactional Outbox").alias("atomicity"), F.when(n % 5 == 0, "at-most-once").otherwise("At-Least-Once").alias("delivery"), F.when(n % 3 == 0, "none").otherwise("by event_id").alias("deduplication"))
    return s.table("nation").join(own, "n_nationkey").select(F.col("n_name").alias("registry"), F.col("n_name").alias("id"), fields.alias("fields"), "events", policy.alias("publication"))


@query((), f"SELECT n_name AS record_id, f.name AS name, n_nationkey % 7 <> f.i AS required FROM nation, (VALUES {_FIELD_VALUES}) f(name, i) WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def k11_envelope_fields(s: Source) -> DataFrame:
    return knowledge.nested(_event_registries(s), "fields", None).select("record_id", F.col("item.name").alias("name"), F.col("item.required").alias("required"))


@query((), "SELECT n_name AS record_id, s_name AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 9 AND 'stock.kind-' || (s_suppkey % 60) LIKE '%kind-1%'")
def k11_event_types(s: Source) -> DataFrame:
    return knowledge.nested(_event_registries(s), "events", "Kind_1", "id", "type", "category", "meaning").select("record_id", F.col("item.id").alias("id"))


@query((), f"""
WITH t AS ({TYPES}), n AS (SELECT n_name, n_nationkey AS k FROM nation)
SELECT registry || '/' || id AS key, 'commitment_affects_physical' AS rule FROM t WHERE category = 'commitment' AND affects UNION ALL SELECT registry || '/' || id, 'commitment_does_not_conserve' FROM t WHERE category = 'commitment' AND NOT conserves
UNION ALL SELECT registry || '/' || id, 'internal_must_affect_and_conserve' FROM t WHERE id IN ('movement', 'posting-change') AND NOT (affects AND conserves) UNION ALL SELECT registry || '/' || id, 'boundary_claims_conservation' FROM t WHERE id IN ('receipt', 'issue') AND conserves
UNION ALL SELECT registry || '/' || id, 'reversal_without_inverse' FROM t WHERE id = 'reversal' AND n % 2 <> 0 UNION ALL SELECT n_name || '/allocation-release', 'transaction_type_missing' FROM n UNION ALL SELECT n_name || '/issue', 'transaction_type_missing' FROM n WHERE k % 6 = 5
UNION ALL SELECT n_name || '/no-double-post', 'invariant_missing' FROM n WHERE k % 3 = 0 UNION ALL SELECT n_name || '/immutable-posted-history', 'invariant_missing' FROM n WHERE k % 4 = 0 UNION ALL SELECT n_name, 'no_idempotency_control' FROM n WHERE k % 5 = 0""")
def dq2_ledger_errors(s: Source) -> DataFrame:
    return quality.ledger_errors(_ledgers(s))


@query((), f"""
WITH e AS (SELECT CASE WHEN s_suppkey % 10 = 9 THEN 'Bad Type' ELSE 'stock.kind-' || (s_suppkey % 60) END AS type, s_suppkey AS k FROM supplier), n AS (SELECT n_name, n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
SELECT type AS key, 'invalid_event_type' AS rule FROM e WHERE type = 'Bad Type' UNION ALL SELECT type, 'visible_without_evidence' FROM e WHERE k % 2 = 0 AND k % 8 = 0 UNION ALL SELECT type, 'duplicate_event_type' FROM e GROUP BY type HAVING COUNT(*) > 1
UNION ALL SELECT n_name || '/' || f.name, 'envelope_field_missing' FROM n, (VALUES {_FIELD_VALUES}) f(name, i) WHERE k % 7 = i
UNION ALL SELECT n_name, 'no_outbox' FROM n WHERE k % 4 = 0 UNION ALL SELECT n_name, 'not_at_least_once' FROM n WHERE k % 5 = 0 UNION ALL SELECT n_name, 'no_deduplication' FROM n WHERE k % 3 = 0""")
def dq2_event_errors(s: Source) -> DataFrame:
    return quality.event_errors(_event_registries(s))


# ---- gaps and statistics ----------------------------------------------------------------------------


def _plain(s: Source, sql: str, gaps: str = "false", evidence: str = "false") -> DataFrame:
    """Records (subject, status, n) of SQL with explicit gaps and evidence where the conditions hold."""
    rows = made(s, sql)
    return rows.withColumn("research_gaps", F.when(F.expr(gaps), F.array(F.lit("more"))).otherwise(none())).withColumn("evidence_refs", F.when(F.expr(evidence), F.array(F.lit("e1"), F.lit("e2"))).otherwise(none()))


TERMS = f"SELECT n_name AS subject, {_word('n_nationkey', 'candidate', 'canonical')} AS status, n_nationkey AS n FROM nation"
REGISTRIES = f"SELECT DISTINCT p_brand AS subject, {_word('length(p_brand)', 'observed', 'canonical')} AS status, length(p_brand) AS n FROM part"


@query(("companies", "offers"), f"""
, t AS ({TERMS}), c AS ({CAPABILITIES}), w AS ({WORKFLOWS}), g AS ({REGISTRIES}), v AS (SELECT product_id, COUNT(DISTINCT company_id) AS n FROM offers GROUP BY product_id), m AS (SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey)
SELECT 'company' AS kind, name AS subject, 'more' AS gap FROM companies WHERE company_id % 2 = 0
UNION ALL SELECT 'terminology', subject, 'status=' || status || '; evidence_refs=' || CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END FROM t WHERE status = 'candidate'
UNION ALL SELECT 'capability', label, 'status=' || status || '; vendors=' || COALESCE(v.n, 0) || '; evidence_refs=' || CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END FROM c LEFT JOIN v ON product_id = k WHERE status IN ('candidate', 'observed') OR k % 5 = 0
UNION ALL SELECT 'capability', label, u.x FROM c, (VALUES ('depth'), ('terms')) u(x) WHERE k % 9 = 0
UNION ALL SELECT 'workflow', title, 'status=' || status || '; vendors=' || COALESCE(m.n, 0) || '; evidence_refs=0' FROM w LEFT JOIN m ON o_custkey = k WHERE status <> 'canonical' UNION ALL SELECT 'workflow', title, 'steps' FROM w WHERE k % 8 = 1
UNION ALL SELECT kind, subject, 'more' FROM g, (VALUES ('ontology'), ('kpi-registry'), ('integration-registry'), ('ledger'), ('event-registry')) k(kind) WHERE n % 2 = 0
UNION ALL SELECT kind, subject, 'status=' || status || '; evidence_refs=0' FROM g, (VALUES ('ledger'), ('event-registry')) k(kind) WHERE status = 'observed'""")
def u3_all_research_gaps(s: Source) -> DataFrame:
    companies = s.relation("companies").select(F.col("name").alias("subject"), F.when(F.col("company_id") % 2 == 0, F.array(F.lit("more"))).otherwise(none()).alias("research_gaps"))
    registries = _plain(s, REGISTRIES, gaps="n % 2 = 0")
    rest = dict.fromkeys(("ontology", "kpi-registry", "integration-registry", "ledger", "event-registry"), registries)
    return knowledge.research_gaps({"company": companies, "terminology": _plain(s, TERMS, gaps="n = 1", evidence="n % 3 = 0"), "capability": _capabilities(s), "workflow": _workflows(s), **rest})


@query(("companies", "offers"), f"""
, t AS ({TYPES}), n AS (SELECT COUNT(*) AS n FROM nation), c AS (SELECT COUNT(*) AS c FROM customer), p AS (SELECT COUNT(*) AS p FROM part), e AS (SELECT COUNT(*) AS e FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
SELECT 'companies' AS metric, COUNT(*) AS value FROM companies UNION ALL SELECT 'products', COUNT(*) FROM (SELECT DISTINCT company_id, product_id FROM offers) UNION ALL SELECT 'evidence', COUNT(*) FROM orders UNION ALL SELECT 'claims', COUNT(*) FROM orders UNION ALL SELECT 'terminology', n FROM n
UNION ALL SELECT 'authorities', COUNT(*) FROM region UNION ALL SELECT 'taxonomy_vocabularies', COUNT(*) FROM region UNION ALL SELECT 'ontologies', COUNT(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'ontology_entities', n FROM n UNION ALL SELECT 'kpis', COUNT(*) FROM supplier UNION ALL SELECT 'integration_patterns', COUNT(*) FROM supplier
UNION ALL SELECT 'capabilities', p FROM p UNION ALL SELECT 'vendor_capability_observations', COUNT(*) FROM (SELECT DISTINCT company_id, product_id FROM offers) UNION ALL SELECT 'workflows', c FROM c UNION ALL SELECT 'workflow_stages', 2 * COUNT(*) FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'workflow_strategies', COUNT(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'workflow_vendor_models', COUNT(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'ledger_registries', n FROM n UNION ALL SELECT 'ledger_transaction_types', COUNT(*) FROM t UNION ALL SELECT 'ledger_invariants', SUM(2 + CASE WHEN n_nationkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 4 <> 0 THEN 1 ELSE 0 END)::BIGINT FROM nation
UNION ALL SELECT 'event_registries', e FROM e UNION ALL SELECT 'domain_event_types', COUNT(*) FROM supplier""")
def a15_all_statistics(s: Source) -> DataFrame:
    offers = s.relation("offers").select("company_id", F.col("product_id")).distinct()
    companies = s.relation("companies").join(_listed(offers, "company_id", F.col("product_id"), "products"), "company_id", "left")
    suppliers = s.table("supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("metrics"), F.collect_list("s_name").alias("patterns"))
    return knowledge.all_statistics({
        "companies": companies, "evidence": s.table("orders"), "claims": s.table("orders"), "terminology": s.table("nation"), "authorities": s.table("region"), "taxonomy": s.table("region"),
        "ontologies": s.table("nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("entities")), "kpis": suppliers, "integrations": suppliers, "capabilities": _capabilities(s), "workflows": _workflows(s),
        "ledger": _ledgers(s), "events": _event_registries(s),
    })


# ---- technology ---------------------------------------------------------------------------------------

STATES = _word("(company_id + product_id)", "verified", "partial", "research-gap")
CONFIDENCE = _word("(company_id + product_id)", "unknown", "low", "medium", "high")
PARTS = f"""SELECT p_partkey AS k, concat('d-', CAST(p_partkey AS VARCHAR(20))) AS id, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'api-contract' WHEN 'PROMO' THEN 'deployment-orchestration' ELSE 'data-store' END AS category, p_brand AS scope, {_word('p_size', 'adopt', 'trial', 'watch', 'reject')} AS disposition,
  {_word('p_partkey', 'low', 'medium', 'high')} AS confidence, p_type AS alternative FROM part"""
NATIONS = f"SELECT n_nationkey AS k, concat('os-', CAST(n_nationkey AS VARCHAR(20))) AS id, n_name AS name, r_name AS organization, {_word('n_nationkey', 'api-governance', 'runtime')} AS category FROM nation JOIN region ON r_regionkey = n_regionkey"


def _technology(s: Source) -> dict[str, DataFrame]:
    offers = s.share("offers").relation("offers").join(s.relation("companies"), "company_id").join(s.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product")), "product_id")
    key = F.concat_ws("/", F.col("company_id").cast("string"), F.col("product_id").cast("string"))
    texts = {"primary_stack": F.array("product"), "databases": F.array("category"), "api_integration": F.array("layer")}
    source = F.concat(F.lit("src-"), "country")
    products = offers.select(
        key.alias("id"), F.struct(F.col("company_id").cast("string").alias("id"), "name").alias("company"), F.struct(F.col("product_id").cast("string").alias("id"), F.col("product").alias("name")).alias("product"),
        F.struct(*[v.alias(k) for k, v in texts.items()]).alias("technology"), F.struct(F.expr(STATES).alias("state"), F.expr(CONFIDENCE).alias("confidence")).alias("verification"),
        F.struct(F.array("market").alias("canonical_deployment_models"), F.lower("country").alias("hosting_topology")).alias("deployment"), F.array(source).alias("source_refs"),
        F.when(F.col("product_id") % 20 == 0, 2).otherwise(1).alias("source_count"), F.when(F.col("product_id") % 5 == 0, F.array(F.lit("size"))).otherwise(none()).alias("research_gaps"), "product_id",
    )
    refs = products.groupBy(F.col("product_id").alias("k")).agg(F.sort_array(F.collect_set("id")).alias("own"))
    k = F.col("k")
    decisions = made(s, PARTS).join(refs, "k", "left").select(
        "id", "name", "category", "scope", "disposition", "confidence", F.array("alternative").alias("alternatives"), F.when(k % 3 == 0, F.array(F.concat(F.lit("docs/"), "scope"))).otherwise(none()).alias("repository_refs"),
        F.concat(text.strings(F.col("own")), F.when(k % 30 == 7, F.array(F.lit("x/0"))).otherwise(none())).alias("product_refs"), F.array(F.concat(F.lit("os-"), (k % 27).cast("string"))).alias("project_refs"),
    )
    projects = made(s, NATIONS).select("id", "name", "organization", "category", F.lit("library").alias("project_kind"), F.concat(F.lit("https://"), F.lower("name"), F.lit(".example")).alias("upstream_url"), F.array("organization").alias("layers"))
    sources = made(s, NATIONS).select(F.concat(F.lit("src-"), "name").alias("id"), F.col("organization").alias("publisher"), F.concat(F.lit("About "), "name").alias("title"))
    return {"products": products.drop("product_id"), "decisions": decisions, "projects": projects, "sources": sources}


_OFFERED = f"SELECT o.company_id, o.product_id, o.company_id || '/' || o.product_id AS id, o.category AS brand, o.layer, c.country, c.name AS company, {STATES.replace('company_id', 'o.company_id')} AS state, {CONFIDENCE.replace('company_id', 'o.company_id')} AS confidence FROM offers o JOIN companies c ON c.company_id = o.company_id"


@query(("offers", "companies"), f"""
, d AS ({PARTS}), n AS ({NATIONS}), o AS ({_OFFERED}), m AS (
SELECT 0 AS place, 'decision' AS kind, id FROM d WHERE lower(name) LIKE '%widget%' AND disposition = 'adopt' AND (EXISTS (SELECT 1 FROM o WHERE o.product_id = d.k AND country LIKE 'NATION_1%') OR (d.k % 27 < 25 AND EXISTS (SELECT 1 FROM n WHERE n.k = d.k % 27 AND name LIKE 'NATION_1%')))
UNION ALL SELECT 1, 'product', o.id FROM o JOIN d ON d.k = o.product_id WHERE lower(d.name) LIKE '%widget%' AND d.disposition = 'adopt' AND country LIKE 'NATION_1%')
SELECT kind, id FROM m ORDER BY place, id LIMIT 60""")
def k12_technology_search(s: Source) -> DataFrame:
    t = _technology(s)
    found = technology.find(**t, decision=("adopt",), technology=("Widget",), source=("nation 1",))
    return technology.page(found, 60).select("kind", "id")


@query(("offers", "companies"), f"""
, d AS ({PARTS}), n AS ({NATIONS}), o AS ({_OFFERED}),
m AS (SELECT 'decision' AS kind FROM d WHERE category = 'api-contract' AND confidence IN ('high', 'medium') UNION ALL SELECT 'product' FROM o WHERE layer = 'ECONOMY' AND confidence IN ('high', 'medium')),
t AS (SELECT COUNT(*) AS n FROM m) SELECT kind, COUNT(*) AS matched, n AS total, LEAST(n, 25) AS returned FROM m, t GROUP BY kind, n""")
def t9_search_summary(s: Source) -> DataFrame:
    found = technology.find(**_technology(s), api=("economy",), confidence=("high", "medium"))
    return technology.summary(found, 25)


@query(("offers", "companies"), f"""
, o AS ({_OFFERED}) SELECT id FROM o WHERE state IN ('research-gap', 'partial') AND product_id % 5 = 0 AND company LIKE '%3' AND country LIKE 'NATION_%2%'""")
def f7_product_filters(s: Source) -> DataFrame:
    found = technology.find(**_technology(s), kinds=("product",), verification=("research-gap", "partial"), research_gaps=True, deployment=("nation", "2"), company=("supplier",))
    return found.where(F.exists("company", lambda c: c.endswith("3"))).select("id")


@query((), "SELECT DISTINCT concat('os-', n_nationkey) AS id FROM nation WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 27 = n_nationkey AND p_size % 4 = 0) AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 27 = n_nationkey AND p_size % 4 = 3)")
def f8_all_dispositions(s: Source) -> DataFrame:
    return technology.find(**_technology(s), kinds=("open-source",), decision=("adopt", "reject")).select("id")


@query(("offers", "companies"), f"""
, o AS ({_OFFERED})
SELECT id AS key, 'deployment_missing' AS rule FROM o WHERE product_id % 50 = 3 UNION ALL SELECT company_id || '/none', 'deployment_of_unknown_product' FROM companies WHERE company_id % 4 = 0 UNION ALL SELECT id, 'source_count_differs' FROM o WHERE product_id % 20 = 0
UNION ALL SELECT id || ' -> src-' || country, 'unknown_source' FROM o WHERE country = 'NATION_3' UNION ALL SELECT 'd-' || p_partkey || ' -> x/0', 'unknown_product' FROM part WHERE p_partkey % 30 = 7 UNION ALL SELECT 'd-' || p_partkey || ' -> os-' || (p_partkey % 27), 'unknown_project' FROM part WHERE p_partkey % 27 >= 25""")
def k12_join_errors(s: Source) -> DataFrame:
    t = _technology(s)
    deployments = t["products"].where(F.substring_index("id", "/", -1).cast("int") % 50 != 3).select("id").unionByName(s.relation("companies").where("company_id % 4 = 0").select(F.concat(F.col("company_id").cast("string"), F.lit("/none")).alias("id")))
    return technology.join_errors(t["products"], deployments, t["decisions"], t["projects"], t["sources"].where("id <> 'src-NATION_3'"))


@query(("offers", "companies"), f"""
, d AS ({PARTS}), o AS ({_OFFERED}), w AS (SELECT * FROM o WHERE state = 'research-gap')
SELECT id AS key, 'adopted_without_repository_evidence' AS rule FROM d WHERE disposition = 'adopt' AND k % 3 <> 0 UNION ALL SELECT id, 'rejected_without_repository_evidence' FROM d WHERE disposition = 'reject' AND k % 3 <> 0 UNION ALL SELECT id, 'firm_with_low_confidence' FROM d WHERE disposition IN ('adopt', 'reject') AND confidence = 'low'
UNION ALL SELECT id || ' -> docs/' || scope, 'missing_file' FROM d WHERE k % 3 = 0 AND scope LIKE '%1%' UNION ALL SELECT id || ' -> os-' || (k % 27), 'unknown_project' FROM d WHERE k % 27 >= 25 UNION ALL SELECT id || ' -> x/0', 'unknown_product' FROM d WHERE k % 30 = 7
UNION ALL SELECT 'd-' || product_id || ' -> ' || w.id, 'unverified_product' FROM w""")
def dq3_decision_errors(s: Source) -> DataFrame:
    t = _technology(s)
    files = s.table("part").where("p_brand not like '%1%'").select(F.concat(F.lit("docs/"), "p_brand").alias("path")).distinct()
    return technology.decision_errors(t["decisions"], t["products"], t["projects"], files)


# ---- architecture -----------------------------------------------------------------------------------------

BOUNDS = "SELECT s_suppkey AS k, concat('b-', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name AS name, r_name AS classification, CASE WHEN s_acctbal < 0 THEN 'unresolved' WHEN s_acctbal < 5000 THEN 'candidate' ELSE 'canonical' END AS status, n_name AS mechanism FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"
LENS_STATES = ("covered", "partial", "missing", "not-required")


def _boundaries(s: Source) -> DataFrame:
    k = F.col("k")
    primary = F.when((F.col("status") != "unresolved") | (k % 7 == 0), F.concat(F.lit("d-"), (k % 150).cast("string")))
    cited = F.concat(F.lit("d-"), (k % 140).cast("string"))
    return made(s, BOUNDS).select(
        "k", "id", "name", "classification", F.struct("status", "mechanism", F.when(k % 11 != 0, primary).alias("technology_decision_ref")).alias("contract"), F.array(F.concat(F.lit("std-"), (k % 7).cast("string"))).alias("standards"),
        F.struct(F.array(cited).alias("technology_decision_refs"), F.array(F.concat(F.lit("os-"), (k % 26).cast("string"))).alias("open_source_project_refs"), F.array(F.concat(F.lit("docs/"), (k % 5).cast("string"))).alias("repository_refs")).alias("evidence"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("gap of "), "mechanism"))).otherwise(none()).alias("research_gaps"), F.when(k % 8 != 3, F.array(F.lit("a"))).otherwise(none()).alias("authoritative"), F.array(F.lit("b")).alias("forbidden"),
        F.when(k % 6 == 5, none()).otherwise(F.array(F.lit("c"))).alias("commands"), none().alias("events"), none().alias("queries"),
    )


@query((), f"WITH b AS ({BOUNDS}) SELECT id, status, mechanism FROM b WHERE status = 'candidate' AND (lower(mechanism) LIKE '%nation_1%' OR 'd-' || (k % 140) LIKE '%nation_1%') AND k % 4 = 0 AND 'std-' || (k % 7) LIKE '%std-%' ORDER BY id LIMIT 30")
def k13_boundaries(s: Source) -> DataFrame:
    found = architecture.boundaries(_boundaries(s), status="candidate", technology="NATION_1", standard="STD-", has_gaps=True, limit=30)
    return found.select("id", "contract.status", "contract.mechanism")


@query((), f"WITH b AS ({BOUNDS}) SELECT id FROM b WHERE id LIKE '%b-1%' AND classification LIKE '%A%' AND k % 4 = 0 AND lower('gap of ' || mechanism) LIKE '%nation_%'")
def f9_boundary_filters(s: Source) -> DataFrame:
    return architecture.boundaries(_boundaries(s), id="B-1", classification="a", gap="Gap of nation_", limit=10_000).select("id")


def _coverage(s: Source) -> DataFrame:
    """One item for each boundary but some; lens i of boundary k has the state (k + i) % 4."""
    k = F.col("k")

    def lens(i: int) -> Column:
        state = F.element_at(F.array(*[F.lit(x) for x in LENS_STATES]), ((k + i) % 4 + 1).cast("int"))
        cited = F.struct(F.element_at(F.array(F.lit("standard"), F.lit("open-source-project"), F.lit("competitor-product"), F.lit("repository")), F.lit(i + 1)).alias("kind"), F.concat(F.lit(("std-", "os-", "p-", "docs/")[i]), (k % 7).cast("string")).alias("ref"))
        gaps = F.when(state.isin("partial", "missing"), F.array(F.concat(F.lit(f"gap {i} of "), "mechanism"))).otherwise(none())
        required = F.when(state == "not-required", F.when(k % 9 == 0, "optional").otherwise("not-required")).otherwise(F.when(k % 13 == 0, "not-required").otherwise("required"))
        evidence = F.when((state == "covered") & (k % 5 != 0), F.array(cited)).otherwise(F.when((state == "missing") & (k % 10 == 1), F.array(cited)).otherwise(F.array().cast("array<struct<kind:string,ref:string>>")))
        return F.struct(required.alias("requirement"), state.alias("status"), evidence.alias("evidence_refs"), gaps.alias("gaps"), F.when(state == "missing", F.array(F.concat(F.lit("target "), "classification"))).otherwise(none()).alias("research_targets"))

    lenses = F.create_map(*[x for i, name in enumerate(architecture.LENSES) for x in (F.lit(name), lens(i))])
    overall = F.element_at(F.array(*[F.lit(x) for x in architecture.OVERALL]), (k % 3 + 1).cast("int"))
    return made(s, BOUNDS).where("k % 10 <> 9").select(F.col("id").alias("boundary_ref"), F.concat(F.lit("P"), (k % 3).cast("string")).alias("priority"), overall.alias("overall"), lenses.alias("lenses"))


_LENS = ", ".join(f"('{n}', {i})" for i, n in enumerate(architecture.LENSES))
COVERED = f"""SELECT b.*, l.name AS lens, l.i, (k + l.i) % 4 AS st, CASE WHEN (k + l.i) % 4 = 3 THEN CASE WHEN k % 9 = 0 THEN 'optional' ELSE 'not-required' END WHEN k % 13 = 0 THEN 'not-required' ELSE 'required' END AS requirement,
  ((k + l.i) % 4 = 0 AND k % 5 <> 0) OR ((k + l.i) % 4 = 2 AND k % 10 = 1) AS cites FROM ({BOUNDS}) b, (VALUES {_LENS}) l(name, i) WHERE k % 10 <> 9"""


@query((), f"""
WITH c AS ({COVERED}), x AS (SELECT id, k, status, mechanism, name, COUNT(*) FILTER (WHERE st IN (1, 2)) AS gap_count, COUNT(*) FILTER (WHERE st = 2) AS target_count, bool_or(lens = 'open_source' AND st = 2) AS hit, bool_or(st = 2 AND classification LIKE 'A%') AS target, bool_or(st IN (1, 2) AND lower('gap ' || i || ' of ' || mechanism) LIKE '%of nation%') AS gap FROM c GROUP BY ALL)
SELECT id AS boundary_ref, name AS boundary_name, status AS contract_status, mechanism AS contract_mechanism, gap_count, target_count FROM x WHERE hit AND target AND gap AND 'P' || (k % 3) = 'P1'""")
def k13_coverage(s: Source) -> DataFrame:
    found = architecture.search_coverage(architecture.coverage(_coverage(s), _boundaries(s)), priority="P1", lens="open_source", lens_status="missing", target="Target a", gap="OF nation")
    return found.select("boundary_ref", "boundary_name", "contract_status", "contract_mechanism", "gap_count", "target_count")


@query((), f"""
WITH c AS ({COVERED}), x AS (SELECT id, k, status, name, bool_or(st = 1) AS hit, bool_or(cites AND ('std-' || (k % 7) = 'std-3' AND i = 0)) AS ev FROM c GROUP BY ALL)
SELECT id AS boundary_ref, 'P' || (k % 3) AS priority, ROW_NUMBER() OVER (ORDER BY k % 3, k % 3, id) AS place FROM x WHERE hit AND ev AND lower(name) LIKE '%supplier%'""")
def f10_coverage_filters(s: Source) -> DataFrame:
    from pyspark.sql import Window

    found = architecture.search_coverage(architecture.coverage(_coverage(s), _boundaries(s)), boundary="SUPPLIER", lens_status="partial", evidence="STD-3")
    rank = F.array_position(F.array(*[F.lit(x) for x in architecture.OVERALL]), F.col("overall"))
    return found.select("boundary_ref", "priority", F.row_number().over(Window.orderBy("priority", rank, "boundary_ref")).alias("place"))


@query((), f"""
WITH b AS ({BOUNDS}), d AS ({PARTS}), j AS (SELECT b.*, CASE WHEN k % 11 <> 0 AND (status <> 'unresolved' OR k % 7 = 0) THEN k % 150 END AS pr FROM b), x AS (SELECT j.*, d.disposition AS disp, d.k AS dk FROM j LEFT JOIN d ON d.k = pr)
SELECT id AS key, 'primary_not_in_evidence' AS rule FROM x WHERE pr IS NOT NULL AND pr <> k % 140 UNION ALL SELECT id, 'unresolved_with_decision' FROM x WHERE status = 'unresolved' AND pr IS NOT NULL UNION ALL SELECT id, 'decision_missing' FROM x WHERE status <> 'unresolved' AND pr IS NULL
UNION ALL SELECT id, 'unknown_primary_decision' FROM x WHERE pr IS NOT NULL AND dk IS NULL UNION ALL SELECT id, 'canonical_not_adopted' FROM x WHERE status = 'canonical' AND disp <> 'adopt' UNION ALL SELECT id, 'candidate_not_tried' FROM x WHERE status = 'candidate' AND disp NOT IN ('trial', 'adopt')
UNION ALL SELECT id, 'ownership_incomplete' FROM x WHERE k % 8 = 3 UNION ALL SELECT id, 'no_flow' FROM x WHERE k % 6 = 5 UNION ALL SELECT id || ' -> d-' || (k % 140), 'unknown_decision' FROM x WHERE k % 140 NOT IN (SELECT k FROM d)
UNION ALL SELECT x.id || ' -> ' || d.id, 'rejected_decision_cited' FROM x JOIN d ON d.k = x.k % 140 WHERE d.disposition = 'reject' UNION ALL SELECT id || ' -> os-' || (k % 26), 'unknown_project' FROM x WHERE k % 26 = 25 UNION ALL SELECT id || ' -> docs/' || (k % 5), 'missing_file' FROM x WHERE k % 5 = 4""")
def dq3_boundary_errors(s: Source) -> DataFrame:
    files = s.spark.range(4).select(F.concat(F.lit("docs/"), F.col("id").cast("string")).alias("path"))
    return architecture.boundary_errors(_boundaries(s), made(s, PARTS).select("id", "disposition"), made(s, NATIONS).select("id"), files)


@query((), f"""
WITH c AS ({COVERED}), b AS ({BOUNDS}), o AS (SELECT id, k, CASE WHEN COUNT(*) FILTER (WHERE requirement = 'required') > 0 AND COUNT(*) FILTER (WHERE requirement = 'required' AND st <> 0) = 0 THEN 'covered' WHEN bool_or(requirement <> 'not-required' AND cites) THEN 'partial' ELSE 'missing' END AS want FROM c GROUP BY id, k)
SELECT id AS key, 'coverage_missing' AS rule FROM b WHERE k % 10 = 9 UNION ALL SELECT id, 'overall_differs' FROM o WHERE want <> CASE k % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'covered' END
UNION ALL SELECT id || '.' || lens, 'left_out_with_status' FROM c WHERE requirement = 'not-required' AND st <> 3 UNION ALL SELECT id || '.' || lens, 'left_out_not_empty' FROM c WHERE requirement = 'not-required' AND (cites OR st IN (1, 2))
UNION ALL SELECT id || '.' || lens, 'status_needs_requirement' FROM c WHERE requirement <> 'not-required' AND st = 3 UNION ALL SELECT id || '.' || lens, 'covered_without_evidence' FROM c WHERE st = 0 AND NOT cites UNION ALL SELECT id || '.' || lens, 'missing_with_evidence' FROM c WHERE st = 2 AND cites
UNION ALL SELECT id || '.' || lens || ' -> p-' || (k % 7), 'unknown_product' FROM c WHERE cites AND i = 2 AND k % 7 = 6 UNION ALL SELECT id || '.' || lens || ' -> p-' || (k % 7), 'unverified_product' FROM c WHERE cites AND i = 2 AND k % 7 IN (1, 2)
UNION ALL SELECT id || '.' || lens || ' -> docs/' || (k % 7), 'missing_file' FROM c WHERE cites AND i = 3 AND k % 7 >= 4""")
def dq3_coverage_errors(s: Source) -> DataFrame:
    n = F.col("id")
    products = s.spark.range(6).select(F.concat(F.lit("p-"), n.cast("string")).alias("id"), F.struct(F.when(n == 1, "research-gap").otherwise("verified").alias("state")).alias("verification"), F.when(n == 2, 0).otherwise(3).alias("source_count"))
    files = s.spark.range(4).select(F.concat(F.lit("docs/"), n.cast("string")).alias("path"))
    return architecture.coverage_errors(_coverage(s), _boundaries(s), made(s, NATIONS).select("id"), products, files)


@query((), "SELECT s_suppkey, trim(regexp_replace(lower(s_name || ' ' || s_nationkey || ' ' || 'A_b' || ' ' || s_suppkey % 3), '[^a-z0-9]+', ' ', 'g')) AS key FROM supplier")
def f5_nested_search_keys(s: Source) -> DataFrame:
    nested = F.struct(F.col("s_name").alias("name"), F.array(F.struct(F.col("s_nationkey").alias("n"), F.lit("A_b").alias("t"))).alias("items"), F.create_map(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")).alias("more"))
    rows = s.table("supplier").select("s_suppkey", nested.alias("record"))
    return rows.select("s_suppkey", text.search_key(text.flat(F.col("record"), rows.schema["record"].dataType)).alias("key"))


@query((), "SELECT p_partkey FROM part WHERE (lower(p_name) LIKE '%widget%' OR lower(p_type) LIKE '%widget%') AND (regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') LIKE '%brand 1%' OR lower(p_name) LIKE '%brand 1%')")
def f6_all_terms(s: Source) -> DataFrame:
    return s.table("part").where(text.matches_terms(F.array("p_name", "p_type", "p_brand"), ["Widget", "BRAND#1"])).select("p_partkey")
