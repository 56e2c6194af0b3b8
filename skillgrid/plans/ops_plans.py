"""Query plans for run bookkeeping, audits and student analytics (Q23-Q35)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.text import name_based_id
from skillgrid.operators import dedup, demand, ingest, ops, publish, quality, resolve, student
from skillgrid.plans import demand_plans, publish_plans
from skillgrid.sources import dimensions as D
from skillgrid.sources.materialize import PlanContext
from skillgrid.sources.tables import document_postings, table

OUTBOX_NOW = dt.datetime(2024, 1, 10)
LEDGER_CUTOFF = dt.datetime(2024, 1, 15)


# ---------------------------------------------------------------- ledger / outbox

def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    action = (F.when(F.col("event_type") == "signup", F.lit("create"))
              .when(F.col("event_type").isin("view", "click"), F.lit("running"))
              .when(F.col("event_type") == "purchase", F.lit("complete"))
              .otherwise(F.lit("failed")))
    return e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), action.alias("action"),
                    (F.floor("value").cast("bigint") * 3).alias("processed_rows"),
                    (F.floor("value").cast("bigint") % 2).alias("rejected_rows"),
                    (F.floor("value").cast("int") + 1).alias("output_version"),
                    F.col("props").alias("message"))


def run_ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q23: final ledger row per job from the event log (user = job)."""
    return ops.ledger_state(_event_log(spark, sf_dir))


def ledger_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger row-state rules (D5), one row of counts."""
    return ops.ledger_rule_violations(run_ledger_status(spark, sf_dir))


def ledger_refused_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ledger call that is refused, with the status it met."""
    return ops.refused_calls(_event_log(spark, sf_dir))


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return ops.outbox_first(e, aggregate_id="user_id", event_type="event_type", ts="ts", seq="event_id",
                            payload="props")


def outbox_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24: one outbox row per (user, event type), the first one."""
    return _outbox(spark, sf_dir)


def outbox_pickup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending outbox rows due at a fixed 'now'."""
    return ops.outbox_pickup(_outbox(spark, sf_dir), OUTBOX_NOW)


# ---------------------------------------------------------------- document run

def _document_run(spark: SparkSession, sf_dir: str):
    raw = document_postings(spark, sf_dir)
    validated = ingest.validate_postings(raw)
    valid, rejected = ingest.split_valid(validated)
    norm = ingest.normalize_postings(ingest.to_raw_posting(valid))
    survivors = dedup.dedup_postings(norm)
    hints = resolve.role_hints(raw)
    with_hint = survivors.join(hints, "external_id", "left").withColumn(
        "role_hint", F.coalesce(F.when(F.col("source_role_hint") != "", F.col("source_role_hint")),
                                F.col("normalized_role_hint")))
    resolved = resolve.resolve_roles(with_hint, D.role_aliases_df(spark))
    matched = resolved.where(F.col("role_id").isNotNull())
    hits, _ = resolve.map_skills(matched, D.skills_df(spark), D.skill_aliases_df(spark),
                                 posting="external_id", text="description")
    return validated, rejected, resolved, hits


def run_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q25: run report over documents taken through validate/dedup/resolve/map."""
    validated, _, resolved, hits = _document_run(spark, sf_dir)
    counters = (ops.stage_counter(validated, "read", F.col("reason").isNull())
                .unionByName(ops.stage_counter(resolved, "deduplicated", F.col("role_id").isNotNull()))
                .unionByName(ops.stage_counter(hits, "skill_match")))
    return ops.run_report(counters)


def top_rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most common rejection reasons (ties by first row)."""
    _, rejected, _, _ = _document_run(spark, sf_dir)
    return ops.top_reasons(rejected)


def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q26: per job (document source): rows read / rejected / valid, skill hits, status."""
    d = table(spark, sf_dir, "documents", F.col("doc_id"), F.col("source").alias("job_id"))
    validated, _, _, _ = _document_run(spark, sf_dir)
    v = validated.select(F.col("source_row_number"), F.col("reason"))
    per_row = d.join(v, F.col("doc_id") + 1 == F.col("source_row_number"))
    skills = _document_skill_hits(spark, sf_dir)
    hits = d.join(skills, "doc_id").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("skill_hits"), F.countDistinct("skill_id").alias("evidence_skills"))
    s = per_row.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"),
        F.count_if(F.col("reason").isNull()).alias("rows_valid"))
    out = s.join(hits, "job_id", "left")
    return out.select("job_id", "rows_read", "rows_rejected", "rows_valid",
                      F.coalesce("skill_hits", F.lit(0)).alias("skill_hits"),
                      F.coalesce("evidence_skills", F.lit(0)).alias("evidence_skills"),
                      ops.terminal_status("rows_rejected").alias("status"))


def _document_skill_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First skill hits of valid documents (keyed by doc_id)."""
    raw = document_postings(spark, sf_dir)
    valid, _ = ingest.split_valid(ingest.validate_postings(raw))
    docs = valid.select((F.col("source_row_number") - 1).alias("doc_id"), "description")
    hits, _ = resolve.map_skills(docs, D.skills_df(spark), D.skill_aliases_df(spark),
                                 posting="doc_id", text="description")
    return hits


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job and reason, rejected-row counts."""
    d = table(spark, sf_dir, "documents", "doc_id", F.col("source").alias("job_id"))
    _, rejected, _, _ = _document_run(spark, sf_dir)
    j = d.join(rejected.select("source_row_number", "reason"), F.col("doc_id") + 1 == F.col("source_row_number"))
    return j.groupBy("job_id", "reason").agg(F.count(F.lit(1)).alias("rows"))


def below_threshold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows still below the publish threshold."""
    return demand_plans.cumulative_evidence(spark, sf_dir).where(~F.col("threshold_met"))


# ---------------------------------------------------------------- audits

def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q27: constraint-style rules over the shared tables and published frames."""
    t = lambda n: table(spark, sf_dir, n)
    ctx = PlanContext(spark, sf_dir)
    parts = [
        quality.table_rules(t("lineitem"), "lineitem", {
            "quantity_range": quality.in_range("l_quantity", 1.0, 50.0),
            "discount_range": quality.in_range("l_discount", 0.0, 1.0),
            "returnflag_enum": F.col("l_returnflag").isin("A", "N", "R"),
        }),
        quality.table_rules(t("orders"), "orders", {
            "orderstatus_enum": F.col("o_orderstatus").isin("F", "O", "P"),
            "totalprice_positive": F.col("o_totalprice") > 0,
        }),
        quality.table_rules(t("documents"), "documents", {
            **quality.non_blank_rules(["text", "source", "lang"]),
            "n_chars_positive": F.col("n_chars") > 0,
        }),
        quality.table_rules(t("labels"), "labels", {
            "quality_flag": F.col("quality").isin(0, 1),
            "toxic_flag": F.col("toxic").isin(0, 1),
        }),
        quality.duplicate_rule(t("orders"), ["o_orderkey"], "orders"),
        quality.duplicate_rule(t("part"), ["p_partkey"], "part"),
        quality.duplicate_rule(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"),
        quality.orphan_rule(t("lineitem"), ["l_orderkey"], t("orders"), ["o_orderkey"], "lineitem", "fk_orders"),
        quality.orphan_rule(t("lineitem"), ["l_partkey"], t("part"), ["p_partkey"], "lineitem", "fk_part"),
        quality.orphan_rule(t("orders"), ["o_custkey"], t("customer"), ["c_custkey"], "orders", "fk_customer"),
        quality.orphan_rule(t("customer"), ["c_nationkey"], t("nation"), ["n_nationkey"], "customer", "fk_nation"),
        quality.orphan_rule(t("labels"), ["doc_id"], t("documents"), ["doc_id"], "labels", "fk_documents"),
        quality.publish_rules(demand_plans.requirements_of(ctx), "role_skill_requirements"),
        quality.publish_rules(demand.compute_demand_index(
            demand.inputs_from_evidence(demand_plans.evidence(ctx), demand_plans.pairs_of(ctx)),
            demand_plans.SNAPSHOT_DATE), "sdi_snapshots"),
        quality.publish_rules(publish_plans.published_requirements_of(ctx), "published_requirements"),
        quality.publish_rules(publish_plans.published_signals_of(ctx), "skill_decay_signals"),
        quality.one_current_per_month(publish_plans.manifest_of(ctx)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dimension_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rules: alias keys, duplicates, orphans, inactive targets,
    allowed course weights (D7, D8, J12) over the dimensions, the part-derived
    role hints and part-derived course weights ((p_size % 5) x 0.25)."""
    skills, aliases = D.skills_df(spark), D.skill_aliases_df(spark)
    ra = D.role_aliases_df(spark)
    hints = table(spark, sf_dir, "part", F.col("p_name").alias("alias"))
    inactive = aliases.join(skills.where(~F.col("is_active")).select("skill_id"), "skill_id")
    parts = [
        quality.alias_key_rule(aliases, "skill_aliases"),
        quality.alias_key_rule(ra.where(F.col("role_id").isNotNull()), "role_aliases"),
        quality.duplicate_rule(aliases, ["normalized_alias"], "skill_aliases"),
        quality.duplicate_rule(ra, ["normalized_alias"], "role_aliases"),
        quality.orphan_rule(aliases, ["skill_id"], skills, ["skill_id"], "skill_aliases", "fk_skills"),
        quality.orphan_rule(ra.where(F.col("role_id").isNotNull()), ["role_id"], D.roles_df(spark), ["role_id"],
                            "role_aliases", "fk_roles"),
        inactive.agg(F.count(F.lit(1)).cast("bigint").alias("violations")).select(
            F.lit("alias_of_inactive_skill").alias("rule_name"), F.lit("skill_aliases").alias("table_name"),
            "violations"),
        quality.allowed_values_rule(
            table(spark, sf_dir, "part", (F.col("p_size") % 5 * F.lit(0.25)).alias("weight")),
            "weight", quality.ALLOWED_COURSE_WEIGHTS, "course_skills", "course_weight_allowed"),
        hints.join(ra.select("normalized_alias"),
                   resolve.normalize_key("alias") == F.col("normalized_alias"), "left_anti")
        .agg(F.countDistinct("alias").cast("bigint").alias("violations")).select(
            F.lit("hint_without_alias").alias("rule_name"), F.lit("part").alias("table_name"), "violations"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q28: (order, part) pairs that occur on more than one line."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    return dedup.duplicate_keys(li, ["l_orderkey", "l_partkey"])


def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child keys missing from their parent, plus parts never ordered."""
    t = lambda n: table(spark, sf_dir, n)
    rel = [
        quality.orphan_keys(t("lineitem").select(F.col("l_suppkey").alias("key")), ["key"],
                            t("supplier").select(F.col("s_suppkey").alias("key")), ["key"], "lineitem.l_suppkey"),
        quality.orphan_keys(t("orders").select(F.col("o_custkey").alias("key")), ["key"],
                            t("customer").select(F.col("c_custkey").alias("key")), ["key"], "orders.o_custkey"),
        quality.orphan_keys(t("embeddings").select(F.col("vec_id").alias("key")), ["key"],
                            t("labels").select(F.col("doc_id").alias("key")), ["key"], "embeddings.unlabelled"),
        quality.orphan_keys(t("labels").select(F.col("doc_id").alias("key")), ["key"],
                            t("documents").select(F.col("doc_id").alias("key")), ["key"], "labels.doc_id"),
        dedup.missing_from(t("part").select(F.col("p_partkey").alias("key")),
                           t("lineitem").select(F.col("l_partkey").alias("key")), ["key"])
        .select(F.lit("part.unused").alias("relation"), "key"),
    ]
    out = rel[0]
    for r in rel[1:]:
        out = out.unionByName(r)
    return out


def alias_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q29: every distinct part-name hint as an alias candidate with its review
    state; candidates in the alias table carry its reviewed flag (P15)."""
    cand = table(spark, sf_dir, "part", resolve.normalize_key("p_name").alias("normalized_alias")).distinct()
    ra = D.role_aliases_df(spark).select("normalized_alias", "role_id", "reviewed")
    j = cand.join(ra, "normalized_alias", "left")
    state = quality.review_state("reviewed", "role_id")
    action = F.when(state == "approved", F.lit("approve")).when(state == "dismissed", F.lit("dismiss"))
    return j.select("normalized_alias", "role_id", F.coalesce("reviewed", F.lit(False)).alias("reviewed"),
                    state.alias("review_state"),
                    F.when(action.isNotNull(), quality.review_action_valid(action, "role_id")).alias("action_valid"))


def name_based_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q30: deterministic ids of (part, brand) pairs."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return p.select("p_partkey", "p_brand",
                    name_based_id(F.lit("part"), "p_partkey", "p_brand").alias("part_skill_id"))


# ---------------------------------------------------------------- students

def _purchases(ctx: PlanContext) -> DataFrame:
    """One row per (student, part) bought, with the part's brand (skill) and
    quantity sums; built once per query and shared by profile and completed items."""
    def build():
        li = table(ctx.spark, ctx.sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
        o = table(ctx.spark, ctx.sf_dir, "orders", "o_orderkey", "o_custkey")
        p = table(ctx.spark, ctx.sf_dir, "part", "p_partkey", "p_brand")
        return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
                .groupBy(F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("item_id"),
                         F.col("p_brand").alias("skill_id"))
                .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines")))
    return ctx.table("student-purchases", build)


def _student_inputs(ctx: PlanContext):
    bought = _purchases(ctx)
    profile = bought.groupBy("student_id", "skill_id").agg(
        F.least(F.sum("qty") / (F.lit(50.0) * F.sum("lines")), F.lit(1.0)).alias("depth"))
    c = table(ctx.spark, ctx.sf_dir, "customer", "c_custkey", "c_nationkey")
    second = ((F.col("c_nationkey") + 7) % 25).cast(c.schema["c_nationkey"].dataType)  # some students aim at two roles
    targets = c.select(F.col("c_custkey").alias("student_id"), F.explode(F.when(
        F.col("c_custkey") % 8 == 0, F.array("c_nationkey", second)).otherwise(F.array("c_nationkey"))).alias("role_id"))
    completed = bought.select("student_id", "item_id")
    o = table(ctx.spark, ctx.sf_dir, "orders", "o_custkey", "o_orderdate")
    versions = o.groupBy(F.col("o_custkey").alias("student_id")).agg(
        F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("profile_version"))
    return targets, profile, completed, versions


def _gaps(ctx: PlanContext) -> DataFrame:
    targets, profile, _, _ = _student_inputs(ctx)
    return student.skill_gaps(targets, demand_plans.requirements_of(ctx), profile)


def skill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q32: per student (customer) and required skill of the target role: gap and priority."""
    return student.prioritized(_gaps(PlanContext(spark, sf_dir)))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness per student with the reuse key of the result."""
    ctx = PlanContext(spark, sf_dir)
    _, _, _, versions = _student_inputs(ctx)
    r = student.readiness(_gaps(ctx)).join(versions, "student_id", "left")
    return r.withColumn("result_key", student.result_key("student_id", "role_id", "profile_version",
                                                         F.lit("1")))


def roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q33: top-3 gaps -> the active catalog items (parts of the brand, active
    when p_size <= 45) the student has not bought yet (X5)."""
    ctx = PlanContext(spark, sf_dir)
    _, _, completed, _ = _student_inputs(ctx)
    pri = student.prioritized(_gaps(ctx))
    catalog = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select(
        F.col("p_brand").alias("skill_id"), F.col("p_partkey").alias("item_id"),
        F.col("p_size").alias("difficulty"), (F.col("p_size") <= 45).alias("is_active"))
    return student.roadmap(pri, catalog, completed)


def role_search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q34: part-name queries (three spellings) against role titles and aliases; some parts ask for a
    role title, a title with its last letter lost, or a word that no role has."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    k, odd = F.col("p_partkey") % 3, F.col("p_partkey") % 37
    titles = F.array(*[F.lit(t) for _, t in D.TEST_ROLES])
    title = F.element_at(titles, (F.col("p_partkey") % len(D.TEST_ROLES) + 1).cast("int"))
    q = p.select((F.when(odd == 5, title).when(odd == 6, title.substr(F.lit(1), F.length(title) - 1))
                  .when(odd == 7, F.lit("zzqx"))
                  .when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("  "), "p_name", F.lit("!")))
                  .otherwise(F.regexp_replace("p_name", " ", "-"))).alias("query"))
    roles, aliases = D.roles_df(spark), D.role_aliases_df(spark)
    return student.role_search(q, student.search_targets(roles, aliases),
                               top_roles=student.top_active_roles(roles, aliases))


def retention_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q35: versions kept online: the newest with its previous three, and the monthly currents."""
    return publish.retention_plan(publish_plans.version_manifest(spark, sf_dir)).select(
        "version", "period_month", "is_current", "keep_online")


def reingest_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the cutoff on as ingest requests against earlier events as the ledger."""
    e = table(spark, sf_dir, "events", 
        F.col("user_id").alias("dataset_id"), F.col("event_type").alias("job_type"),
        F.sha2("props", 256).alias("file_hash"), F.col("event_id").alias("seq"), "ts")
    ledger = e.where(F.col("ts") < F.lit(LEDGER_CUTOFF))
    req = e.where(F.col("ts") >= F.lit(LEDGER_CUTOFF))
    return ops.reingest_guard(req, ledger).select("dataset_id", "job_type", "file_hash", "seq", "runs")


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest order per customer, as the latest-profile read."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return student.latest_by(o.withColumn("_ord", F.struct("o_orderdate", "o_orderkey")), ["o_custkey"], "_ord") \
        .drop("_ord")
