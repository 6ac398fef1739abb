"""Architecture boundaries, and how well references cover them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import strings
from tallyhouse.operators.knowledge import ranked_by

#: Orders and names; fixed values.
PRIORITIES = ("P0", "P1", "P2")
OVERALL = ("missing", "partial", "covered")
LENSES = ("standards", "open_source", "commercial", "executable")


def _has(value: Column, needle: str) -> Column:
    return F.contains(F.lower(value), F.lit(needle.lower()))


def _any_has(values: Column, needle: str) -> Column:
    return F.exists(strings(values), lambda v: F.coalesce(_has(v, needle), F.lit(False)))


def boundaries(
    rows: DataFrame, id: str | None = None, classification: str | None = None, status: str | None = None, technology: str | None = None, standard: str | None = None, gap: str | None = None, has_gaps: bool = False, limit: int = 100
) -> DataFrame:
    """Boundaries that meet all filters, by id; ``technology`` is sought in mechanism and references, as JSON text.

    ``rows``: id, name, classification, contract (struct: status, mechanism, ...), standards, evidence (struct: technology_decision_refs,
    open_source_project_refs, ...), research_gaps.
    """
    searched = F.to_json(F.struct(F.col("contract.mechanism").alias("mechanism"), *[F.col(f"evidence.{c}").alias(c) for c in ("open_source_project_refs", "technology_decision_refs")]))
    wanted = [
        (id, lambda: _has(F.col("id"), id)), (classification, lambda: _has(F.col("classification"), classification)), (status, lambda: F.col("contract.status") == status), (technology, lambda: _has(searched, technology)),
        (standard, lambda: _has(F.to_json("standards"), standard)), (gap, lambda: _has(F.to_json("research_gaps"), gap)), (has_gaps, lambda: F.size(strings(F.col("research_gaps"))) > 0),
    ]
    found = reduce(lambda df, w: df.where(w[1]()) if w[0] else df, wanted, rows)
    return found.orderBy("id").limit(max(limit, 0))


def _over_lenses(field: str) -> Column:
    """All values of an array field of all lenses."""
    return F.flatten(F.transform(F.map_values("lenses"), lambda lens: lens[field]))


def coverage(items: DataFrame, known: DataFrame) -> DataFrame:
    """Coverage items with their boundary's name, classification and contract, and how many gaps and targets their lenses have.

    ``items``: boundary_ref, priority, overall, lenses (map of name to struct: requirement, status, evidence_refs (structs: kind, ref),
    gaps, research_targets); ``known``: as for ``boundaries``.
    """
    named = known.select(F.col("id").alias("boundary_ref"), F.col("name").alias("boundary_name"), "classification", F.col("contract.status").alias("contract_status"), F.col("contract.mechanism").alias("contract_mechanism"))
    return items.join(named, "boundary_ref").withColumns({"gap_count": F.size(_over_lenses("gaps")), "target_count": F.size(_over_lenses("research_targets"))})


def search_coverage(
    found: DataFrame, boundary: str | None = None, priority: str | None = None, overall: str | None = None, contract_status: str | None = None, classification: str | None = None, lens: str | None = None,
    lens_status: str | None = None, target: str | None = None, gap: str | None = None, evidence: str | None = None,
) -> DataFrame:
    """Of ``coverage`` the items that meet all filters, by priority, overall state and boundary; a lens status without a lens means any lens."""
    if lens and lens not in LENSES:
        raise ValueError(f"unknown lens: {lens}")
    has_status = F.col("lenses")[lens]["status"] == lens_status if lens else F.exists(F.map_values("lenses"), lambda x: x["status"] == lens_status)
    refs = _over_lenses("evidence_refs")
    wanted = [
        (boundary, lambda: _any_has(F.array("boundary_ref", "boundary_name"), boundary)), (priority, lambda: F.col("priority") == priority), (overall, lambda: F.col("overall") == overall),
        (contract_status, lambda: F.col("contract_status") == contract_status), (classification, lambda: _has(F.col("classification"), classification)), (lens_status, lambda: has_status),
        (target, lambda: _any_has(_over_lenses("research_targets"), target)), (gap, lambda: _any_has(_over_lenses("gaps"), gap)),
        (evidence, lambda: _any_has(F.transform(refs, lambda r: r["kind"]), evidence) | _any_has(F.transform(refs, lambda r: r["ref"]), evidence)),
    ]
    out = reduce(lambda df, w: df.where(w[1]()) if w[0] else df, wanted, found)
    place = F.array_position(F.array(*[F.lit(v) for v in OVERALL]), F.col("overall"))
    return ranked_by(out, "priority", list(PRIORITIES), place, "boundary_ref")


def expected_overall(lenses: Column) -> Column:
    """covered if all required lenses are (and there is one), partial if any that is not left out has evidence, else missing."""
    own = F.map_values(lenses)
    required = F.filter(own, lambda x: x["requirement"] == "required")
    seen = F.exists(own, lambda x: (x["requirement"] != "not-required") & (F.size(x["evidence_refs"]) > 0))
    return F.when((F.size(required) > 0) & F.forall(required, lambda x: x["status"] == "covered"), "covered").when(seen, "partial").otherwise("missing")


def _told(rules: dict[str, Column]) -> Column:
    """The names of the rules that are broken."""
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def _dangling(refs: DataFrame, known: DataFrame, rule: str) -> DataFrame:
    """Of (key, ref) those whose ref is not a ``ref`` of ``known``."""
    return refs.join(known.select("ref").distinct(), "ref", "left_anti").select(F.concat_ws(" -> ", "key", "ref").alias("key"), F.lit(rule).alias("rule"))


def boundary_errors(rows: DataFrame, decisions: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """key and rule of boundaries that break the rules on contracts, evidence, ownership and flow.

    ``rows``: as for ``boundaries``, with contract.technology_decision_ref, evidence.repository_refs, authoritative, forbidden,
    commands, events, queries; ``decisions``: id, disposition; ``projects``: id; ``files``: path.
    """
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("key"), F.lit("duplicate_id").alias("rule"))
    primary, status = F.col("contract.technology_decision_ref"), F.col("contract.status")
    judged = rows.join(decisions.select(F.col("id").alias("_primary"), F.col("disposition").alias("_disposition")).distinct(), primary == F.col("_primary"), "left")
    empty = {c: F.size(strings(F.col(c))) == 0 for c in ("authoritative", "forbidden", "commands", "events", "queries")}
    rules = {
        "primary_not_in_evidence": primary.isNotNull() & ~F.array_contains(strings(F.col("evidence.technology_decision_refs")), primary),
        "unresolved_with_decision": (status == "unresolved") & primary.isNotNull(),
        "decision_missing": status.isin("canonical", "candidate") & primary.isNull(),
        "unknown_primary_decision": primary.isNotNull() & F.col("_primary").isNull(),
        "canonical_not_adopted": (status == "canonical") & (F.col("_disposition") != "adopt"),
        "candidate_not_tried": (status == "candidate") & ~F.col("_disposition").isin("trial", "adopt"),
        "ownership_incomplete": empty["authoritative"] | empty["forbidden"],
        "no_flow": empty["commands"] & empty["events"] & empty["queries"],
    }
    own = judged.select(F.col("id").alias("key"), F.explode(_told(rules)).alias("rule"))

    def refs(column: str) -> DataFrame:
        return rows.select(F.col("id").alias("key"), F.explode(f"evidence.{column}").alias("ref"))

    rejected = decisions.where("disposition = 'reject'").select(F.col("id").alias("ref")).distinct()
    cited = refs("technology_decision_refs").join(rejected, "ref").select(F.concat_ws(" -> ", "key", "ref").alias("key"), F.lit("rejected_decision_cited").alias("rule"))
    parts = [
        repeated, own, _dangling(refs("technology_decision_refs"), decisions.select(F.col("id").alias("ref")), "unknown_decision"), cited,
        _dangling(refs("open_source_project_refs"), projects.select(F.col("id").alias("ref")), "unknown_project"), _dangling(refs("repository_refs"), files.select(F.col("path").alias("ref")), "missing_file"),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage_errors(items: DataFrame, known: DataFrame, projects: DataFrame, products: DataFrame, files: DataFrame) -> DataFrame:
    """key and rule of coverage items that break the rules; ``products``: id, verification (struct: state), source_count."""
    repeated = items.groupBy("boundary_ref").agg(F.count("*").alias("n")).where("n > 1").select(F.col("boundary_ref").alias("key"), F.lit("duplicate_boundary").alias("rule"))
    ids = known.select(F.col("id").alias("boundary_ref"), "standards").dropDuplicates(["boundary_ref"])
    unknown = items.select("boundary_ref").distinct().join(ids, "boundary_ref", "left_anti").select(F.col("boundary_ref").alias("key"), F.lit("unknown_boundary").alias("rule"))
    missing = ids.join(items.select("boundary_ref"), "boundary_ref", "left_anti").select(F.col("boundary_ref").alias("key"), F.lit("coverage_missing").alias("rule"))
    fitting = items.join(ids, "boundary_ref")
    wrong = fitting.where(F.col("overall") != expected_overall(F.col("lenses"))).select(F.col("boundary_ref").alias("key"), F.lit("overall_differs").alias("rule"))
    lens = fitting.select("boundary_ref", "standards", F.explode("lenses").alias("name", "lens")).withColumn("key", F.concat_ws(".", "boundary_ref", "name"))
    x, left_out = F.col("lens"), F.col("lens.requirement") == "not-required"
    used = F.size(x["evidence_refs"]) > 0
    rules = {
        "left_out_with_status": left_out & (x["status"] != "not-required"),
        "left_out_not_empty": left_out & (used | (F.size(x["research_targets"]) > 0) | (F.size(x["gaps"]) > 0)),
        "status_needs_requirement": ~left_out & (x["status"] == "not-required"),
        "covered_without_evidence": (x["status"] == "covered") & ~used,
        "missing_with_evidence": (x["status"] == "missing") & used,
    }
    own = lens.select("key", F.explode(_told(rules)).alias("rule"))
    cited = lens.select("key", "standards", F.explode("lens.evidence_refs").alias("e")).select("key", "standards", "e.kind", "e.ref")

    def of(kind: str) -> DataFrame:
        return cited.where(F.col("kind") == kind).select("key", "ref")

    undeclared = cited.where((F.col("kind") == "standard") & ~F.array_contains(strings(F.col("standards")), F.col("ref"))).select(F.concat_ws(" -> ", "key", "ref").alias("key"), F.lit("undeclared_standard").alias("rule"))
    weak = products.where((F.col("verification.state") == "research-gap") | (F.coalesce("source_count", F.lit(0)) < 1)).select(F.col("id").alias("ref")).distinct()
    unverified = of("competitor-product").join(weak, "ref").select(F.concat_ws(" -> ", "key", "ref").alias("key"), F.lit("unverified_product").alias("rule"))
    parts = [
        repeated, unknown, missing, wrong, own, undeclared, _dangling(of("open-source-project"), projects.select(F.col("id").alias("ref")), "unknown_project"),
        _dangling(of("competitor-product"), products.select(F.col("id").alias("ref")), "unknown_product"), unverified, _dangling(of("repository"), files.select(F.col("path").alias("ref")), "missing_file"),
    ]
    return reduce(DataFrame.unionByName, parts)
