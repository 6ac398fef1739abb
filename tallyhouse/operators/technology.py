"""Products, technology decisions and open-source projects as one collection that can be searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import contains_all, each_flat, flat, matches_terms, strings
from tallyhouse.operators.quality import findings

#: Kinds of records, in their order; fixed values.
KINDS = ("decision", "product", "open-source")
#: What a search may look for; fixed values.
FILTERS = ("company", "product", "database", "api", "deployment", "technology", "source")
#: Categories whose records answer to a filter on interfaces or deployment; fixed values.
API_DECISION, DEPLOYMENT_DECISION, API_PROJECT = "api-contract", "deployment-orchestration", "api-governance"


def _texts(df: DataFrame, *columns: str) -> Column:
    """One text for each of the columns."""
    return F.array(*[flat(F.col(c), df.schema[c].dataType) for c in columns])


def _linked(rows: DataFrame, refs: str, target: DataFrame, name: str) -> DataFrame:
    """``rows`` (id) with an array ``name`` of the rows of ``target`` (id) that the array ``refs`` names; unknown ones are left out."""
    wanted = rows.select(F.col("id").alias("_owner"), F.explode_outer(refs).alias("id")).where("id is not null")
    own = wanted.join(target, "id").groupBy("_owner").agg(F.sort_array(F.collect_set(F.struct(*target.columns))).alias(name))
    return rows.join(own, rows["id"] == own["_owner"], "left").drop("_owner")


def _dispositions(rows: DataFrame, decisions: DataFrame, refs: str) -> DataFrame:
    """``rows`` (id) with the dispositions of the decisions that refer to them."""
    own = decisions.select("disposition", F.explode(refs).alias("_ref")).groupBy("_ref").agg(F.collect_set("disposition").alias("dispositions"))
    return rows.join(own, rows["id"] == own["_ref"], "left").drop("_ref").withColumn("dispositions", strings(F.col("dispositions")))


Texts = dict[str, Column]


def _none() -> Column:
    return F.array().cast("array<string>")


def _parts(df: DataFrame, column: str) -> list[Column]:
    """One text for each field of a struct."""
    return [flat(F.col(column)[f.name], f.dataType) for f in df.schema[column].dataType.fields]


def _of_product(df: DataFrame) -> Texts:
    """What filters look at in a product's own columns; ``_of_decision`` and ``_of_project`` likewise."""
    return {
        "company": _texts(df, "company"), "product": _texts(df, "product"), "database": strings(F.col("technology.databases")), "api": strings(F.col("technology.api_integration")),
        "deployment": F.array(*_parts(df, "deployment")), "technology": F.array(*_parts(df, "technology")),
    }


def _of_decision(df: DataFrame) -> Texts:
    named = _texts(df, "name", "scope", "alternatives")
    return {
        "api": F.when(F.col("category") == API_DECISION, named).otherwise(_none()), "deployment": F.when(F.col("category") == DEPLOYMENT_DECISION, named).otherwise(_none()), "technology": _texts(df, "name", "category", "scope", "alternatives"),
    }


def _of_project(df: DataFrame) -> Texts:
    api = F.when(F.col("category") == API_PROJECT, _texts(df, "name", "layers")).otherwise(_none())
    return {"api": api, "technology": _texts(df, "name", "organization", "category", "project_kind", "layers"), "source": _texts(df, "upstream_url")}


def records(products: DataFrame, decisions: DataFrame, projects: DataFrame, sources: DataFrame, market: DataFrame | None = None, referring: DataFrame | None = None) -> DataFrame:
    """kind, id, what each filter looks at (arrays of texts), dispositions, verification, confidence, n_gaps.

    ``products``: id, company, product, technology (struct with databases and api_integration), deployment (struct),
    verification (struct: state, confidence), source_refs, research_gaps.  ``decisions``: id, name, category, scope, disposition,
    confidence, alternatives, repository_refs, product_refs, project_refs.  ``projects``: id, name, organization, category,
    project_kind, upstream_url, layers.  ``sources``: id and what describes them.
    Where ``products`` or ``decisions`` are but a part, ``market`` and ``referring`` are all of them, which links lead to.
    """
    market, referring = products if market is None else market, decisions if referring is None else referring

    def shaped(df: DataFrame, kind: str, texts: Texts, dispositions: Column, verification: Column, confidence: Column, gaps: Column) -> DataFrame:
        found = [texts.get(name, _none()).alias(name) for name in FILTERS]
        return df.select(F.lit(kind).alias("kind"), "id", *found, dispositions.alias("dispositions"), verification.alias("verification"), confidence.alias("confidence"), gaps.cast("int").alias("n_gaps"))

    sold = _dispositions(_linked(products, "source_refs", sources, "sources"), referring, "product_refs")
    product = shaped(
        sold, "product", _of_product(sold) | {"source": each_flat(F.col("sources"), sold.schema["sources"].dataType)},
        F.col("dispositions"), F.col("verification.state"), F.col("verification.confidence"), F.size(strings(F.col("research_gaps"))),
    )
    rivals = market.select("id", F.col("company.name").alias("company"), F.col("product.name").alias("product"), "verification", "source_refs")
    made = _linked(_linked(decisions, "product_refs", rivals, "competitor_products"), "project_refs", projects.select("id", "name", "organization", "category", "project_kind", "upstream_url"), "open_source_projects")
    cited = made.select("id", F.array_distinct(F.flatten(F.transform(F.coalesce("competitor_products", F.array().cast(made.schema["competitor_products"].dataType)), lambda p: p["source_refs"]))).alias("refs"))
    made = made.join(_linked(cited, "refs", sources, "market_sources").select("id", "market_sources"), "id")
    competitors = each_flat(F.col("competitor_products"), made.schema["competitor_products"].dataType)
    decision = shaped(
        made, "decision", _of_decision(made) | {"company": competitors, "product": competitors, "source": _texts(made, "repository_refs", "market_sources", "open_source_projects")},
        F.array("disposition"), F.lit(None).cast("string"), F.col("confidence"), F.lit(0),
    )
    known = _dispositions(projects, referring, "project_refs")
    project = shaped(known, "open-source", _of_project(known), F.col("dispositions"), F.lit(None).cast("string"), F.lit(""), F.lit(0))
    return decision.unionByName(product).unionByName(project)


def find(
    products: DataFrame, decisions: DataFrame, projects: DataFrame, sources: DataFrame, kinds: tuple[str, ...] = (), decision: tuple[str, ...] = (), verification: tuple[str, ...] = (), confidence: tuple[str, ...] = (), research_gaps: bool = False, **terms: tuple[str, ...]
) -> DataFrame:
    """``search`` in the ``records`` of these tables: filters on a row's own columns come first, so only rows that meet them are linked."""

    def own(df: DataFrame, kind: str, texts: Texts, sure: Column, gaps: bool = False) -> DataFrame:
        if (kinds and kind not in kinds) or ((verification or research_gaps) and not gaps):
            return df.where(F.lit(False))
        for name in terms.keys() & texts.keys():
            df = df.where(matches_terms(texts[name], list(terms[name])))
        return df.where(sure.isin(*confidence)) if confidence else df

    some = own(products, "product", _of_product(products), F.col("verification.confidence"), True)
    if verification:
        some = some.where(F.col("verification.state").isin(*verification))
    if research_gaps:
        some = some.where(F.size(strings(F.col("research_gaps"))) > 0)
    few = own(decisions, "decision", _of_decision(decisions), F.col("confidence"))
    if decision:
        few = few.where(contains_all(F.array("disposition"), list(decision)))
    found = records(some, few, projects, sources, market=products, referring=decisions)
    return search(found, kinds, decision, verification, confidence, research_gaps, **terms)


def search(
    found: DataFrame, kinds: tuple[str, ...] = (), decision: tuple[str, ...] = (), verification: tuple[str, ...] = (), confidence: tuple[str, ...] = (), research_gaps: bool = False, **terms: tuple[str, ...]
) -> DataFrame:
    """Of ``records`` those that meet all filters: each term of a filter is in one of its texts; all of ``decision`` are among the dispositions."""
    if unknown := set(terms) - set(FILTERS):
        raise ValueError(f"unknown filter: {sorted(unknown)[0]}")
    out = found.where(F.col("kind").isin(*kinds)) if kinds else found
    for name, wanted in terms.items():
        out = out.where(matches_terms(F.col(name), list(wanted)))
    if decision:
        out = out.where(contains_all(F.col("dispositions"), list(decision)))
    if verification:
        out = out.where((F.col("kind") == "product") & F.col("verification").isin(*verification))
    if confidence:
        out = out.where(F.col("confidence").isin(*confidence))
    return out.where((F.col("kind") == "product") & (F.col("n_gaps") > 0)) if research_gaps else out


def page(matched: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` records by kind and id."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return matched.orderBy(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), "id").limit(limit)


def summary(matched: DataFrame, limit: int = 100) -> DataFrame:
    """kind and matched for each kind found, and how many of all are returned: counted before the limit."""
    by_kind = matched.groupBy("kind").agg(F.count("*").alias("matched"))
    total = by_kind.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("total"))
    return by_kind.crossJoin(F.broadcast(total)).select("kind", "matched", "total", F.least(F.col("total"), F.lit(limit)).cast("long").alias("returned"))


def join_errors(products: DataFrame, deployments: DataFrame, decisions: DataFrame, projects: DataFrame, sources: DataFrame) -> DataFrame:
    """key and rule of everything that doesn't join: products and deployments, declared counts, sources, and what decisions refer to.
    Only what is left over is made distinct, and ids that several rules look at are shuffled in the same form."""

    def unmatched(left: DataFrame, right: DataFrame, rule: str) -> DataFrame:
        return left.select("id").join(right.select("id"), "id", "left_anti").distinct().select(F.col("id").alias("key"), F.lit(rule).alias("rule"))

    def dangling(rows: DataFrame, refs: str, target: DataFrame, rule: str) -> DataFrame:
        wanted = rows.select(F.col("id").alias("_owner"), F.explode(refs).alias("id"))
        return wanted.join(target.select("id"), "id", "left_anti").distinct().select(F.concat_ws(" -> ", "_owner", "id").alias("key"), F.lit(rule).alias("rule"))

    miscounted = products.where(F.coalesce("source_count", F.lit(0)) != F.size(strings(F.col("source_refs")))).select(F.col("id").alias("key"), F.lit("source_count_differs").alias("rule"))
    return findings(
        unmatched(products, deployments, "deployment_missing"), unmatched(deployments, products, "deployment_of_unknown_product"), miscounted, dangling(products, "source_refs", sources, "unknown_source"),
        dangling(decisions, "product_refs", products, "unknown_product"), dangling(decisions, "project_refs", projects, "unknown_project"),
    )


def decision_errors(decisions: DataFrame, products: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """key and rule of decisions that break the rules on evidence, dispositions and references; ``files``: path of the repository's files."""
    repeated = decisions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("key"), F.lit("duplicate_id").alias("rule"))
    repository, project, product = (F.size(strings(F.col(c))) for c in ("repository_refs", "project_refs", "product_refs"))
    firm = F.col("disposition").isin("adopt", "reject")
    rules = {
        "no_evidence": repository + project + product == 0,
        "adopted_without_repository_evidence": (F.col("disposition") == "adopt") & (repository == 0),
        "firm_with_low_confidence": firm & (F.col("confidence") == "low"),
        "rejected_without_repository_evidence": (F.col("disposition") == "reject") & (repository == 0),
    }
    own = decisions.select(F.col("id").alias("key"), F.explode(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))).alias("rule"))

    def refs(column: str, target: DataFrame, known: str, rule: str) -> DataFrame:
        wanted = decisions.select(F.col("id").alias("_owner"), F.explode(column).alias("_ref"))
        return wanted.join(target.select(F.col(known).alias("_ref")).distinct(), "_ref", "left_anti").select(F.concat_ws(" -> ", "_owner", "_ref").alias("key"), F.lit(rule).alias("rule"))

    weak = products.where((F.col("verification.state") == "research-gap") | (F.coalesce("source_count", F.lit(0)) < 1)).select(F.col("id").alias("_ref")).distinct()
    cited = decisions.select(F.col("id").alias("_owner"), F.explode("product_refs").alias("_ref")).join(weak, "_ref").select(F.concat_ws(" -> ", "_owner", "_ref").alias("key"), F.lit("unverified_product").alias("rule"))
    return reduce(DataFrame.unionByName, [repeated, own, refs("repository_refs", files, "path", "missing_file"), refs("project_refs", projects, "id", "unknown_project"), refs("product_refs", products, "id", "unknown_product"), cited])
