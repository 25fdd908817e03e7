"""Artifacts, jobs, files and catalogue roll-ups."""

from __future__ import annotations

import hashlib

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Ledger, is_empty, settle
from .ordering import global_running_sum, grouped_rank
from .skew import packed, salted_join

#: Least number of classes of one kernel in a piece, each standing for many operations or requests; and the pieces aimed at.
CLASS_ROWS, PIECES = 64, 256


# -- store ------------------------------------------------------------------------------------
def dedup_by_content(files: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(blobs, links): one blob per SHA-256 kept under its smallest id; every file keeps a link."""
    hashed = files.select(key, F.sha2(F.col(content).cast("string"), 256).alias("sha256"), F.octet_length(content).alias("size"))
    blobs = hashed.groupBy("sha256").agg(F.min(key).alias("first_id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("uses"))
    return blobs, hashed.select(key, "sha256")


def inspect_artifacts(artifacts: DataFrame, blobs: DataFrame, provenance: DataFrame) -> DataFrame:
    """Artifact with its blob's size and path and one row per provenance entry, numbered in order;
    position 0 stands for an artifact without provenance."""
    numbered = grouped_rank(provenance, "artifact_id", [F.col("created"), F.col("job_id")])
    return artifacts.join(blobs.withColumnRenamed("sha256", "blob_sha256"), "blob_sha256").join(
        numbered.select("artifact_id", "job_id", "position"), "artifact_id", "left").withColumn("position", F.coalesce("position", F.lit(0)))


def orphan_blobs(blobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    return blobs.join(artifacts.select(F.col("blob_sha256").alias("sha256")), "sha256", "left_anti")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, problem``: missing, extra, changed-size and changed-hash files."""
    both = files.select("path", F.col("size").alias("s1"), F.col("sha256").alias("h1")).join(
        manifest.select("path", F.col("size").alias("s2"), F.col("sha256").alias("h2")), "path", "full_outer")
    problem = F.when(F.col("h1").isNull(), "missing").when(F.col("h2").isNull(), "extra") \
        .when(F.col("s1") != F.col("s2"), "changed_size").when(F.col("h1") != F.col("h2"), "changed_hash")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def reuse_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def reuse_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """hit, miss, stale (other worker) or tampered (stored bytes do not match) per request."""
    found = requests.join(cache.select("key", F.col("worker").alias("cached_worker"), "stored_sha256", "actual_sha256"), "key", "left")
    outcome = F.when(F.col("cached_worker").isNull(), "miss").when(F.col("cached_worker") != F.col("worker"), "stale") \
        .when(F.col("stored_sha256") != F.col("actual_sha256"), "tampered").otherwise("hit")
    return found.withColumn("outcome", outcome).drop("cached_worker", "stored_sha256", "actual_sha256")


def tree_hash(files: DataFrame, by: str) -> DataFrame:
    """Order-independent digest of each file set: SHA-256 over ``path NUL hash LF`` in path order.

    One definition for sets of every size: the rows of a set stream through the digest in order, and
    nothing but its state is held.
    """
    kind = files.schema[by].dataType.simpleString()
    ordered = files.select(F.col(by).alias("_set"), F.encode(F.concat("path", F.lit("\0"), "sha256", F.lit("\n")), "UTF-8").alias("_entry"), "path") \
        .repartition("_set").sortWithinPartitions("_set", "path", "_entry").select("_set", "_entry")
    def run(batches):
        current, digest, n, started = None, None, 0, False
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current], column.type), pa.array([n]), pa.array([digest.hexdigest()])], names=["_set", "files", "digest"])
        for batch in batches:
            column = batch.column(0)
            for owner, entry in zip(column.to_pylist(), batch.column(1)):
                if not started or owner != current:
                    if started:
                        yield row()
                    current, digest, n, started = owner, hashlib.sha256(), 0, True
                digest.update(entry.as_buffer() if entry.is_valid else b"")
                n += 1
        if started:
            yield row()
    return ordered.mapInArrow(run, f"_set {kind}, files bigint, digest string").withColumnRenamed("_set", by)


def retain_lru(entries: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """Newest entries within a count and a byte budget (oldest leave first until both hold)."""
    order = [F.col("used").desc(), F.col("entry_id")]
    summed = global_running_sum(entries, order, F.struct(F.lit(1)).isNotNull().cast("bigint"), "_rank")
    summed = global_running_sum(summed, order, F.col("size").cast("bigint"), "_bytes")
    return summed.filter((F.col("_rank") <= max_entries) & (F.col("_bytes") <= max_bytes)).drop("_rank", "_bytes")


# -- jobs -------------------------------------------------------------------------------------
def store_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def job_funnel(jobs: DataFrame) -> DataFrame:
    return jobs.cube("state", "validation_status").agg(F.count(F.lit(1)).alias("jobs"))


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs become failed; ``recovered`` tells which."""
    hit = F.col("state").isin("queued", "running")
    return jobs.withColumn("recovered", hit).withColumns({
        "execution_status": F.when(hit, "interrupted").otherwise(F.col("execution_status")),
        "validation_status": F.when(hit, "not_run").otherwise(F.col("validation_status")),
        "state": F.when(hit, "failed").otherwise(F.col("state"))})


# Raw error class, its failure class, whether a retry may help.
TAXONOMY = [
    ("INVALID_INPUT", "invalid_input", False), ("PRECONDITION_FAILED", "unmet_precondition", False),
    ("UNMET_PRECONDITION", "unmet_precondition", False), ("UNSUPPORTED_ADAPTER", "unsupported_adapter", False),
    ("NUMERIC_FAILURE", "numeric_failure", True), ("TIMEOUT", "timeout", True), ("WORKER_CRASH", "worker_crash", True),
    ("RESOURCE_LIMIT", "resource_limit", True), ("VALIDATION_FAILED", "validation_failure", True),
    ("PROTOCOL_ERROR", "worker_protocol", True), ("IO_FAILURE", "worker_io", True),
]


def failure_taxonomy(jobs: DataFrame, raw: str) -> DataFrame:
    classes = F.create_map(*[F.lit(x) for r, c, _ in TAXONOMY for x in (r, c)])
    retry = F.create_map(*[F.lit(x) for r, _, ok in TAXONOMY for x in (r, ok)])
    return jobs.groupBy(F.coalesce(classes[F.upper(raw)], F.lit("internal")).alias("failure_class"),
                        F.coalesce(retry[F.upper(raw)], F.lit(False)).alias("recoverable")).agg(F.count(F.lit(1)).alias("jobs"))


# Failure classes after which the next plan may be tried.
RETRYABLE = ["validation_failure", "unmet_precondition", "worker_error", "resource_limit", "invalid_input"]


def first_success_chain(attempts: DataFrame) -> DataFrame:
    """Ordered fallbacks per job: which index served, how many attempts ran, and why it ended.

    An attempt runs if every earlier one failed with a retryable class, so the first attempt that
    succeeds or fails for good ends the chain; everything is one aggregation with partial results.
    """
    ends = (F.col("state") == "succeeded") | ~F.coalesce(F.col("error_class"), F.lit("")).isin(*RETRYABLE)
    last = F.struct(F.col("attempt"), F.col("state"), F.col("error_class"))
    out = attempts.groupBy("job_id").agg(F.min(F.when(ends, last)).alias("stop"), F.max(last).alias("tail"), F.count(F.lit(1)).alias("declared"))
    end = F.coalesce("stop", "tail")
    return out.select("job_id", "declared", (end["attempt"] + 1).alias("ran"),
                      F.when(end["state"] == "succeeded", end["attempt"]).alias("served_by_index"), end["error_class"].alias("last_error"))


def expectation_gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``failed_rules`` (names in rule order) and ``published``; a null test counts as failed."""
    failed = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, test in rules.items()]),
                      lambda n: n.isNotNull())
    return df.withColumn("failed_rules", failed).withColumn("published", F.size("failed_rules") == 0)


def split_publish(df: DataFrame, rules: Mapping[str, Column], good: str, rejected: str) -> None:
    """Write passing rows to ``good`` and the rest, with their reasons, to ``rejected``."""
    gated = expectation_gate(df, rules)
    gated.filter("published").drop("failed_rules", "published").write.mode("append").parquet(good)
    gated.filter(~F.col("published")).drop("published").write.mode("append").parquet(rejected)


# -- lineage ----------------------------------------------------------------------------------
def lineage_closure(edges: DataFrame) -> DataFrame:
    """``output, input, depth`` of all upstream inputs, from one-hop ``output, input`` rows.

    Path doubling: with all pairs up to k hops known, those of more, up to 2k, go over a pair of exactly k
    hops, so a chain of n hops takes log n rounds, and a pair is met once per middle of its shortest paths.
    Pairs already known are dropped, so cycles end too.  ``depth`` is the smallest number of hops.
    """
    known, hops = Ledger(edges.sparkSession), 1
    known.add(edges.select("output", "input").distinct().withColumn("depth", F.lit(1)))
    while True:
        exact = known.read().filter(F.col("depth") == hops).select("output", F.col("input").alias("middle"))
        onward = known.read().select(F.col("output").alias("middle"), "input", (F.col("depth") + hops).alias("depth"))
        reached = exact.join(onward, "middle").groupBy("output", "input").agg(F.min("depth").alias("depth"))
        fresh = settle(reached.join(known.read().select("output", "input"), ["output", "input"], "left_anti"))
        if is_empty(fresh):
            return known.read()
        known.add(fresh)
        hops *= 2


def _jumped(single: DataFrame) -> DataFrame:
    """``v, d, w, b`` with every ``d`` moved on along single steps as far as they go; what runs into a cycle
    is left out.  A step means level(v) = max(b, level(d) + w), and so does a chain of steps."""
    jump, heads = single, single.select(F.col("v").alias("d"))
    for _ in range(single.count().bit_length() + 1):
        ahead = jump.select(F.col("v").alias("d"), F.col("d").alias("d2"), F.col("w").alias("w2"), F.col("b").alias("b2"))
        moved = jump.join(ahead, "d", "left")
        more = F.col("d2").isNotNull()
        jump = settle(moved.select("v", F.coalesce("d2", "d").alias("d"), F.when(more, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"),
                                   F.when(more, F.greatest("b", F.col("b2") + F.col("w"))).otherwise(F.col("b")).alias("b")))
        if is_empty(jump.join(heads, "d", "left_semi")):
            return jump
    return settle(jump.join(heads, "d", "left_anti"))


def dag_levels(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``plan_id, step_id, level, problem`` for steps (``plan_id, step_id``) and their
    ``plan_id, step_id, depends_on`` rows.  Problems: duplicate_id, dangling, cycle.

    A step with one open dependency is a function of it, and chains of such functions are folded by
    pointer doubling; the steps with several dependencies then depend on each other directly, and those
    whose dependencies have come to be one are folded in the next round.  So a chain takes rounds
    logarithmic in its length, not one per level.  Steps without a known dependency have level 0 and take
    no part in the rounds.
    """
    spark, keys = steps.sparkSession, ["plan_id", "step_id"]
    counted = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = counted.select("plan_id", F.col("step_id").alias("depends_on"))
    told = settle(edges.distinct().join(known.withColumn("_known", F.lit(True)), ["plan_id", "depends_on"], "left").select(*keys, "depends_on", F.coalesce("_known", F.lit(False)).alias("_known")))
    node = F.struct(*keys).alias("v")
    links = told.filter("_known").select(node, F.struct("plan_id", F.col("depends_on").alias("step_id")).alias("d"), F.lit(1).alias("w"))
    linked = settle(links.select("v").distinct())
    resolved = Ledger(spark)
    # A dependency that has none itself adds its one level at once.
    there = linked.withColumnsRenamed({"v": "d"}).withColumn("_open", F.lit(True))
    sorted_out = settle(links.join(there, "d", "left"))
    ready = sorted_out.filter("_open IS NULL").groupBy("v").agg(F.max("w").alias("b"))
    base = settle(linked.join(ready, "v", "left").select("v", F.coalesce("b", F.lit(0)).alias("b")))
    links = sorted_out.filter("_open").select("v", "d", "w")
    fresh = settle(base.limit(0).select("v", F.col("b").alias("level")))
    hanging: list[DataFrame] = []
    while True:
        # What depends on steps whose level is known now has a level of at least that much more.
        got = links.join(fresh.withColumnRenamed("v", "d"), "d").groupBy("v").agg(F.max(F.col("level") + F.col("w")).alias("got"))
        links = settle(links.join(fresh.select(F.col("v").alias("d")), "d", "left_anti"))
        open_ = links.groupBy("v").agg(F.count(F.lit(1)).alias("open"), F.max(F.struct("d", "w")).alias("only"))
        state = settle(base.join(got, "v", "left").join(open_, "v", "left").select("v", F.greatest("b", F.coalesce("got", F.lit(0))).alias("b"), F.coalesce("open", F.lit(0)).alias("open"), "only"))
        fresh = settle(state.filter("open = 0").select("v", F.col("b").alias("level")))
        resolved.add(fresh)
        single = settle(state.filter("open = 1").select("v", "only.d", "only.w", "b"))
        moved = _jumped(single)
        hanging.append(moved)
        several = state.filter("open > 1").select("v", "b")
        own = links.join(several.select("v"), "v", "left_semi")
        over = own.join(moved.select(F.col("v").alias("d"), F.col("d").alias("d2"), F.col("w").alias("w2"), F.col("b").alias("b2")), "d", "left")
        over = settle(over.select("v", F.coalesce("d2", "d").alias("d"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("b2") + F.col("w")).alias("least")))
        links = settle(over.groupBy("v", "d").agg(F.max("w").alias("w")))
        raised = over.groupBy("v").agg(F.max("least").alias("least"))
        base = settle(several.join(raised, "v", "left").select("v", F.greatest("b", F.coalesce("least", F.lit(0))).alias("b")))
        if is_empty(fresh) and is_empty(moved):
            break
    for part in reversed(hanging):
        resolved.add(part.join(resolved.read().withColumnRenamed("v", "d"), "d").select("v", F.greatest("b", F.col("level") + F.col("w")).alias("level")))
    marks = steps.select(*keys, F.lit(1).alias("n"), F.lit(False).alias("dangling"), F.lit(False).alias("linked")).unionByName(
        told.select(*keys, F.lit(0).alias("n"), (~F.col("_known")).alias("dangling"), F.col("_known").alias("linked")))
    every = marks.groupBy(*keys).agg(F.sum("n").alias("n"), F.bool_or("dangling").alias("dangling"), F.bool_or("linked").alias("linked")).filter("n > 0")
    out = every.join(resolved.read().select("v.*", "level"), keys, "left").withColumn("level", F.when(F.col("linked"), F.col("level")).otherwise(0))
    problem = F.when(F.col("n") > 1, "duplicate_id").when(F.col("dangling"), "dangling").when(F.col("level").isNull(), "cycle")
    return out.select(*keys, "level", problem.alias("problem"))


# -- catalogue -----------------------------------------------------------------------------------
BENIGN = ["BSL-1.0", "MIT", "CC0-1.0"]  # fixed values
SPDX = "SPDX-License-Identifier:\\s*([^\\r\\n*]+)"  # fixed value


def header_expression(text: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), F.trim)))
    return F.when(F.size(found) > 0, F.array_join(found, " ; ")).otherwise("(none)")


def license_resolution(files: DataFrame, designation: DataFrame) -> DataFrame:
    """Status per package from the licence line of every file and the official designation.

    ``files``: ``package, path, expression``; ``designation``: ``package, license_class`` (null when
    no official source names one).
    """
    per = files.groupBy("package", "expression").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    named = designation.select("package", "license_class", F.concat("license_class", F.lit("-3.0-or-later OR LicenseRef-Commercial")).alias("designated"))
    rows = named.join(per, "package", "left")
    e, d = F.col("expression"), F.col("designated")
    dual = F.expr("startswith(expression, concat('( ', designated, ' ) AND '))") & F.substring_index(e, " AND ", -1).isin(*BENIGN)
    benign = dual | e.isin(*BENIGN) | (d.startswith("GPL") & (e == F.regexp_replace(d, "^GPL", "LGPL")))
    n = F.coalesce(F.col("n"), F.lit(0))
    out = rows.groupBy("package", "license_class", "designated").agg(
        F.sum(n).alias("files"), F.sum(F.when(e == d, n).otherwise(0)).alias("agreeing"),
        F.max(F.struct(F.col("n"), F.col("expression"))).alias("top"),
        F.sum(F.when(benign & (e != d), n).otherwise(0)).alias("benign_exceptions"),
        F.sum(F.when(~benign & (e != d), n).otherwise(0)).alias("other_exceptions"))
    status = (
        F.when(F.col("license_class").isNull(), F.when(F.col("files") == 0, "UNRESOLVABLE").otherwise("UNRESOLVED"))
        .when((F.col("files") == 0) | (F.col("agreeing") == 0) | (F.col("other_exceptions") > 0), "NEEDS_HUMAN_REVIEW")
        .when(F.col("benign_exceptions") > 0, "MIXED").otherwise("RESOLVED"))
    provisional = F.when(F.col("agreeing") > 0, F.col("designated")).otherwise(F.col("top.expression"))
    return out.select("package", "files", F.col("top.expression").alias("dominant"), "benign_exceptions", "other_exceptions", status.alias("status"),
                      F.when(status.isin("MIXED", "RESOLVED"), F.col("designated")).alias("resolved_expression"),
                      F.when(status == "NEEDS_HUMAN_REVIEW", provisional).alias("provisional_expression"))


def coverage_rollup(packages: DataFrame, operations: DataFrame, policy: DataFrame) -> DataFrame:
    """Validated, implemented and total operations per package, uses by other packages, status."""
    primary = operations.groupBy(F.col("package")).agg(
        F.count(F.lit(1)).alias("total"), F.sum((F.col("status") == "VALIDATED").cast("bigint")).alias("validated"),
        F.sum((F.col("status") == "IMPLEMENTED").cast("bigint")).alias("implemented"))
    uses = operations.select("operation_id", F.col("package").alias("owner"), F.explode("constituents").alias("package")) \
        .filter(F.col("owner") != F.col("package")).groupBy("package").agg(F.countDistinct("operation_id").alias("dependency_use"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = packages.select("package").join(primary, "package", "left").join(uses, "package", "left").join(policy, "package", "left")
    status = F.when(F.col("validated") > 0, "VALIDATED").otherwise(F.coalesce("policy_status", F.lit("CATALOGED")))
    reason = F.when(F.col("validated") > 0, "has_validated_operations").otherwise(F.coalesce("policy_reason", F.lit("unclassified_in_policy")))
    return joined.select("package", zero("total"), zero("validated"), zero("implemented"), zero("dependency_use"),
                         status.alias("status"), reason.alias("reason_code"))


def restrictive_expression(operations: DataFrame, packages: DataFrame) -> DataFrame:
    """The licence of an operation: the first GPL expression among its constituents, else the first;
    null when a constituent is unknown.  Constituents that await review are counted."""
    parts = operations.select("operation_id", F.posexplode("constituents").alias("pos", "package")).join(packages, "package", "left")
    rank = F.struct((~F.col("expression").startswith("GPL")).alias("r"), "pos", "expression")
    out = parts.groupBy("operation_id").agg(
        F.max(F.col("license_status").isNull()).alias("unknown"), F.min(F.when(F.col("expression").isNotNull(), rank)).alias("best"),
        F.sum((F.col("license_status") == "NEEDS_HUMAN_REVIEW").cast("bigint")).alias("review"))
    return out.select("operation_id", F.when(~F.col("unknown"), F.col("best.expression")).alias("expression"), F.coalesce("review", F.lit(0)).alias("review"))


SMALL_BOUND, MEDIUM_BOUND = 1000, 50000  # fixed values


def plan_cost(steps: DataFrame, registry: DataFrame) -> DataFrame:
    """Per plan: total cost units, steps, validators, mutating steps, highest tier and risk."""
    joined = steps.join(registry, "operation_id")
    bound = F.col("maximum_faces")
    tier = F.when(bound.isNull(), 3).when(bound <= SMALL_BOUND, 0).when(bound <= MEDIUM_BOUND, 1).otherwise(2)
    mutating = (F.col("role") != "validator") & F.col("mutates")
    names = F.array(*[F.lit(x) for x in ("small", "medium", "large", "unbounded")])
    out = joined.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("step_count"), F.sum(F.lit(1) + F.col("worker_checks")).alias("total_cost_units"),
        F.sum((F.col("role") == "validator").cast("bigint")).alias("validator_steps"), F.sum(mutating.cast("bigint")).alias("mutating_steps"),
        F.max(tier).alias("_tier"))
    return out.withColumn("highest_tier", F.element_at(names, F.col("_tier") + 1)).withColumn(
        "highest_risk", F.when(F.col("mutating_steps") > 0, "mutating_validated").otherwise("read_only")).drop("_tier")


def set_difference_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    missing = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def corroboration_gaps(packages: DataFrame, docs: DataFrame, examples: DataFrame, headers: DataFrame) -> DataFrame:
    """Evidence kinds that a package lacks, in fixed order, from three tables keyed by ``package``."""
    out = packages.select("package")
    for name, table in (("docs_entry_missing", docs), ("examples_not_found", examples), ("headers_not_found", headers)):
        out = out.join(table.groupBy("package").agg(F.count(F.lit(1)).alias(name)), "package", "left")
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("docs_entry_missing", "examples_not_found", "headers_not_found")]),
                    lambda c: c.isNotNull())
    return out.select("package", gaps.alias("gaps"))


# -- gates ------------------------------------------------------------------------------------
def gate_candidates(operations: DataFrame, constraints: DataFrame) -> DataFrame:
    """``request_id, operation_id`` pairs that pass every hard gate of a request.

    Both tables carry ``kernel``, so the gate that is an equality is the join key and the others are
    filters; a null constraint means the gate is open.  Operations that no gate can tell apart are one class,
    and so are such requests: the gates are tried once per pair of classes, then their members are listed.
    """
    wants = ["statuses", "input_type", "dependencies", "licenses"]
    gates = ["status", "accepted_types", "dependencies", "license"]
    ops = packed(operations.filter("kernel IS NOT NULL"), ["kernel", *gates], "operation_id")
    asked = packed(constraints.filter("kernel IS NOT NULL").select("request_id", *[F.col(n).alias(f"want_{n}") for n in wants], "kernel"), ["kernel", *[f"want_{n}" for n in wants]], "request_id")
    open_ = lambda name, test: F.col(f"want_{name}").isNull() | test
    passed = (
        open_("statuses", F.array_contains("want_statuses", F.col("status")))
        & open_("input_type", F.array_contains("accepted_types", F.col("want_input_type")))
        & open_("dependencies", F.size(F.array_except("dependencies", "want_dependencies")) == 0)
        & open_("licenses", F.array_contains("want_licenses", F.col("license"))))
    ops, asked = settle(ops), settle(asked)
    # Kernels may be few, so their classes are cut into pieces, about as many for tables of any size.
    rows = max(CLASS_ROWS, max(ops.count(), asked.count()) // PIECES)
    pairs = salted_join(ops, asked, ["kernel"], "request_id", rows).filter(passed).select("request_id", "operation_id")
    return pairs.withColumn("request_id", F.explode("request_id")).withColumn("operation_id", F.explode("operation_id"))


def match_input_types(offers: DataFrame, slots: DataFrame) -> DataFrame:
    """Is there a one-to-one assignment of offers to slots?  Hall's condition: the counts agree and
    every subset of slots is accepted by at least as many offers.

    ``offers``: ``request_id, kind``; ``slots``: ``request_id, slot`` (from 0) and ``types``.  All subsets
    of a request's slots are tried, so the work doubles with each slot.
    """
    # A kind's mask says which slots take it; the distinct masks with counts replace the offers.
    n_slots = slots.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_slots"))
    n_offers = offers.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_offers"))
    wide = slots.select("request_id", F.explode("types").alias("kind"), F.expr("shiftleft(1L, CAST(slot AS INT))").alias("bit")).distinct()
    masks = offers.groupBy("request_id", "kind").agg(F.count(F.lit(1)).alias("n")).join(
        wide.groupBy("request_id", "kind").agg(F.sum("bit").alias("mask")), ["request_id", "kind"], "left")
    width = F.expr("shiftleft(1L, CAST(n_slots AS INT)) - 1")
    subsets = masks.join(n_slots, "request_id").select("request_id", "n", F.coalesce("mask", F.lit(0)).alias("mask"), F.explode(F.sequence(F.lit(1).cast("bigint"), width)).alias("subset"))
    reach = subsets.groupBy("request_id", "subset").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("subset")) > 0, F.col("n")).otherwise(0)).alias("reach"))
    checked = n_slots.join(n_offers, "request_id", "left").join(reach, "request_id", "left")
    inside = F.col("subset").isNotNull()
    ok = F.coalesce(F.col("reach"), F.lit(0)) >= F.bit_count("subset")
    return checked.groupBy("request_id").agg(
        ((F.first("n_slots") == F.coalesce(F.first("n_offers"), F.lit(0))) & F.coalesce(F.min(F.when(inside, ok)), F.lit(False))).alias("compatible"))


def select_policy(rows: DataFrame, policies: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Match every row's parameters to policies (``policy_id, policy_group, field, test, value``);
    a row needs exactly one policy in every required group.

    ``rows``: ``row_id`` and a map ``parameters``.  Matching is an equi-join on the field name.
    """
    fields = rows.select("row_id", F.explode("parameters").alias("field", "actual"))
    hit = (
        ((F.col("test") == "equals") & (F.col("actual") == F.col("value"))) | (F.col("test") == "present")
        | ((F.col("test") == "nonempty") & (F.length("actual") > 0)))
    chosen = fields.join(policies, "field").filter(hit).groupBy("row_id", "policy_group").agg(
        F.countDistinct("policy_id").alias("n"), F.min("policy_id").alias("policy_id"))
    per = chosen.groupBy("row_id").agg(*[F.max(F.when((F.col("policy_group") == g) & (F.col("n") == 1), F.col("policy_id"))).alias(g) for g in groups])
    out = rows.select("row_id").join(per, "row_id", "left")
    accepted = F.lit(True)
    for g in groups:
        accepted = accepted & F.col(g).isNotNull()
    return out.withColumn("accepted", accepted)
