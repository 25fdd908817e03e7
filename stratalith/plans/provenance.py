"""Queries over artifacts, jobs, files and catalogue tables, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as pv
from . import inputs as i
from .registry import query


def _t(spark, sf, name):
    return i.table(spark, sf, name)


@query("p1_dedup_by_content", """SELECT sha256(text) AS sha256, min(doc_id) AS first_id, octet_length(encode(any_value(text))) AS size, count(*) AS uses
  FROM documents GROUP BY sha256(text)""")
def p1_dedup_by_content(spark, sf):
    return pv.dedup_by_content(_t(spark, sf, "documents"), "doc_id", "text")[0].withColumn("size", F.col("size").cast("bigint"))


_BLOBS = "bl AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, CAST(floor(o_totalprice) AS BIGINT) AS size, 'blob/' || o_orderkey AS path FROM orders)"
_ARTS = "ar AS (SELECT 'a' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS artifact_id, sha256(CAST(l_orderkey AS VARCHAR)) AS blob_sha256 FROM lineitem WHERE l_returnflag = 'R')"


def _blobs(spark, sf):
    return _t(spark, sf, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
                                          F.floor("o_totalprice").cast("bigint").alias("size"), F.concat(F.lit("blob/"), "o_orderkey").alias("path"))


def _artifacts(spark, sf):
    return _t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("a"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_linenumber").alias("artifact_id"),
        F.sha2(F.col("l_orderkey").cast("string"), 256).alias("blob_sha256"))


@query("c14_inspect_artifacts", """WITH ar AS (SELECT c_custkey AS artifact_id, sha256(CAST(c_nationkey AS VARCHAR)) AS blob_sha256 FROM customer),
  bl AS (SELECT sha256(CAST(n_nationkey AS VARCHAR)) AS sha256, n_regionkey AS size, n_name AS path FROM nation),
  pr AS (SELECT o_custkey AS artifact_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
  SELECT ar.artifact_id, blob_sha256, size, path, job_id, coalesce(position, 0) AS position FROM ar JOIN bl ON sha256 = blob_sha256 LEFT JOIN pr USING (artifact_id)""")
def c14_inspect_artifacts(spark, sf):
    artifacts = _t(spark, sf, "customer").select(F.col("c_custkey").alias("artifact_id"), F.sha2(F.col("c_nationkey").cast("string"), 256).alias("blob_sha256"))
    blobs = _t(spark, sf, "nation").select(F.sha2(F.col("n_nationkey").cast("string"), 256).alias("sha256"), F.col("n_regionkey").alias("size"), F.col("n_name").alias("path"))
    provenance = _t(spark, sf, "orders").select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"))
    return pv.inspect_artifacts(artifacts, blobs, provenance).select("artifact_id", "blob_sha256", "size", "path", "job_id", "position")


@query("c15_orphan_blobs", f"WITH {_BLOBS}, {_ARTS} SELECT sha256, size, path FROM bl WHERE sha256 NOT IN (SELECT blob_sha256 FROM ar)")
def c15_orphan_blobs(spark, sf):
    return pv.orphan_blobs(_blobs(spark, sf), _artifacts(spark, sf))


@query("s1_union_sources", """SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS status FROM orders
  UNION ALL SELECT 'event', event_id, event_type FROM events""")
def s1_union_sources(spark, sf):
    one = _t(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return one.unionByName(_t(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("status")))


@query("s2_multiset_difference", """SELECT l_quantity, l_discount, l_returnflag FROM lineitem WHERE l_linestatus = 'O'
  EXCEPT ALL SELECT l_quantity, l_discount, l_returnflag FROM lineitem WHERE l_linestatus = 'F'""")
def s2_multiset_difference(spark, sf):
    line = _t(spark, sf, "lineitem")
    pick = lambda s: line.filter(F.col("l_linestatus") == s).select("l_quantity", "l_discount", "l_returnflag")
    return pick("O").exceptAll(pick("F"))


@query("s3_set_difference_report", """WITH e AS (SELECT DISTINCT o_orderkey AS id FROM orders), a AS (SELECT DISTINCT l_orderkey + 3 AS id FROM lineitem)
  SELECT id, 'missing' AS problem FROM e WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'unexpected' FROM a WHERE id NOT IN (SELECT id FROM e)""")
def s3_set_difference_report(spark, sf):
    return pv.set_difference_report(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
                                    _t(spark, sf, "lineitem").select((F.col("l_orderkey") + 3).alias("id")), "id")


@query("p2_verify_manifest", """WITH f AS (SELECT source || '/' || doc_id AS path, n_chars AS size, sha256(text) AS h FROM documents WHERE doc_id % 17 <> 3),
  m AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 13 = 5 THEN n_chars + 1 ELSE n_chars END AS size,
    CASE WHEN doc_id % 11 = 7 THEN sha256('x' || text) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 19 <> 4)
  SELECT * FROM (SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'extra' WHEN f.size <> m.size THEN 'changed_size'
    WHEN f.h <> m.h THEN 'changed_hash' END AS problem FROM f FULL JOIN m ON f.path = m.path) WHERE problem IS NOT NULL""")
def p2_verify_manifest(spark, sf):
    docs = _t(spark, sf, "documents")
    path, key = F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("doc_id")
    files = docs.filter(key % 17 != 3).select(path, F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"))
    manifest = docs.filter(key % 19 != 4).select(
        path, F.when(key % 13 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"),
        F.sha2(F.when(key % 11 == 7, F.concat(F.lit("x"), "text")).otherwise(F.col("text")), 256).alias("sha256"))
    return pv.verify_manifest(files, manifest)


@query("p3_reuse_plan", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, sha256(concat_ws('|', l_partkey, l_returnflag)) AS key, 'w' || (l_suppkey % 3) AS worker FROM lineitem),
  c AS (SELECT key, min(worker) AS cached_worker, min(l_partkey) % 5 = 0 AS bad FROM (SELECT sha256(concat_ws('|', l_partkey, l_returnflag)) AS key, 'w' || (l_suppkey % 3) AS worker, l_partkey
    FROM lineitem WHERE l_linestatus = 'F') GROUP BY key)
  SELECT l_orderkey, l_linenumber, l_partkey, key, r.worker, CASE WHEN cached_worker IS NULL THEN 'miss' WHEN cached_worker <> r.worker THEN 'stale' WHEN bad THEN 'tampered' ELSE 'hit' END AS outcome
  FROM r LEFT JOIN c USING (key)""")
def p3_reuse_plan(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus",
                                            pv.reuse_key(F.col("l_partkey"), F.col("l_returnflag")).alias("key"), F.concat(F.lit("w"), F.col("l_suppkey") % 3).alias("worker"))
    cache = rows.filter("l_linestatus = 'F'").groupBy("key").agg(F.min("worker").alias("worker"), F.min("l_partkey").alias("p"))
    cache = cache.withColumn("stored_sha256", F.sha2("key", 256)).withColumn("actual_sha256", F.when(F.col("p") % 5 == 0, "bad").otherwise(F.sha2("key", 256)))
    return pv.reuse_plan(rows.drop("l_linestatus"), cache)


@query("p4_expectation_gate", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice >= 5000 THEN 'minimum_price' END,
    CASE WHEN o_orderstatus = 'P' THEN 'final_status' END, CASE WHEN o_orderpriority IS NULL OR o_orderpriority LIKE '4%' THEN 'priority_given' END], lambda x: x IS NOT NULL), ',') AS failed_rules,
    o_totalprice >= 5000 AND o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '4%' AS published FROM orders""")
def p4_expectation_gate(spark, sf):
    rules = {"minimum_price": F.col("o_totalprice") >= 5000, "final_status": F.col("o_orderstatus") != "P", "priority_given": ~F.col("o_orderpriority").startswith("4")}
    return pv.expectation_gate(_t(spark, sf, "orders"), rules).select("o_orderkey", F.array_join("failed_rules", ",").alias("failed_rules"), "published")


_JOBS = """jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS state,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'finished' END AS execution_status,
  CASE WHEN value < 10 THEN 'passed' WHEN value < 20 THEN 'failed' ELSE 'not_run' END AS validation_status FROM events)"""


def _jobs(spark, sf):
    e = F.col("event_type")
    return _t(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.when(e == "view", "queued").when(e == "click", "running").when(e == "error", "failed").otherwise("succeeded").alias("state"),
        F.when(e == "error", "failed").when(e == "view", "pending").otherwise("finished").alias("execution_status"),
        F.when(F.col("value") < 10, "passed").when(F.col("value") < 20, "failed").otherwise("not_run").alias("validation_status"))


@query("p6_recover_interrupted", f"""WITH {_JOBS} SELECT job_id, state IN ('queued', 'running') AS recovered, CASE WHEN state IN ('queued', 'running') THEN 'failed' ELSE state END AS state,
  CASE WHEN state IN ('queued', 'running') THEN 'interrupted' ELSE execution_status END AS execution_status,
  CASE WHEN state IN ('queued', 'running') THEN 'not_run' ELSE validation_status END AS validation_status FROM jobs""")
def p6_recover_interrupted(spark, sf):
    return pv.recover_interrupted(_jobs(spark, sf))


_RAW = [r for r, _, _ in pv.TAXONOMY] + ["UNHEARD_OF"]


@query("p7_failure_taxonomy", f"""WITH m(raw, failure_class, recoverable) AS (VALUES {', '.join(f"('{r}', '{c}', {str(ok).lower()})" for r, c, ok in pv.TAXONOMY)}),
  e AS (SELECT [{', '.join(f"'{r}'" for r in _RAW)}][user_id % {len(_RAW)} + 1] AS raw FROM events WHERE event_type = 'error')
  SELECT coalesce(failure_class, 'internal') AS failure_class, coalesce(recoverable, false) AS recoverable, count(*) AS jobs FROM e LEFT JOIN m USING (raw) GROUP BY ALL""")
def p7_failure_taxonomy(spark, sf):
    raw = F.element_at(F.array(*[F.lit(r) for r in _RAW]), (F.col("user_id") % len(_RAW) + 1).cast("int"))
    return pv.failure_taxonomy(_t(spark, sf, "events").filter("event_type = 'error'").select(raw.alias("raw")), "raw")


@query("p8_corroboration_gaps", """WITH p AS (SELECT p_brand AS package FROM part GROUP BY p_brand UNION SELECT 'Brand#none'),
  d AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_size > 48), e AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_partkey % 97 = 0), h AS (SELECT DISTINCT p_brand AS package FROM part)
  SELECT package, array_to_string(list_filter([CASE WHEN package NOT IN (SELECT package FROM d) THEN 'docs_entry_missing' END, CASE WHEN package NOT IN (SELECT package FROM e) THEN 'examples_not_found' END,
    CASE WHEN package NOT IN (SELECT package FROM h) THEN 'headers_not_found' END], lambda x: x IS NOT NULL), ',') AS gaps FROM p""")
def p8_corroboration_gaps(spark, sf):
    part = _t(spark, sf, "part").withColumn("package", F.col("p_brand"))
    packages = part.select("package").distinct().unionByName(part.select(F.lit("Brand#none").alias("package")).distinct())
    return pv.corroboration_gaps(packages, part.filter("p_size > 48"), part.filter("p_partkey % 97 = 0"), part).withColumn("gaps", F.array_join("gaps", ","))


@query("d15_store_counts", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def d15_store_counts(spark, sf):
    return pv.store_counts({n: _t(spark, sf, n) for n in ("orders", "lineitem", "events")})


@query("d15_job_funnel", f"WITH {_JOBS} SELECT state, validation_status, count(*) AS jobs FROM jobs GROUP BY CUBE (state, validation_status)")
def d15_job_funnel(spark, sf):
    return pv.job_funnel(_jobs(spark, sf))


_CLASS = "CASE WHEN CAST(substring(source, 4) AS INT) % 7 = 6 THEN NULL WHEN CAST(substring(source, 4) AS INT) % 2 = 0 THEN 'GPL' ELSE 'LGPL' END"
_EXPR = f"""CASE WHEN text LIKE '%MIT License%' THEN 'MIT' WHEN text LIKE '%Apache License%' THEN 'Apache-2.0' WHEN text LIKE '%General Public License%' THEN 'LGPL-3.0-or-later OR LicenseRef-Commercial'
  ELSE coalesce({_CLASS}, 'GPL') || '-3.0-or-later OR LicenseRef-Commercial' END"""


@query("d16_license_resolution", f"""WITH f AS (SELECT source || '/' || (doc_id % 5) AS package, {_EXPR} AS expression FROM documents), g AS (SELECT DISTINCT source || '/' || (doc_id % 5) AS package, {_CLASS} AS license_class FROM documents),
  n AS (SELECT *, license_class || '-3.0-or-later OR LicenseRef-Commercial' AS designated FROM g),
  h AS (SELECT package, expression, count(*) AS n FROM f GROUP BY ALL),
  a AS (SELECT package, license_class, designated, sum(n) AS files, sum(CASE WHEN expression = designated THEN n ELSE 0 END) AS agreeing, max({{'n': n, 'e': expression}}).e AS dominant,
    sum(CASE WHEN expression <> designated AND (expression IN ('BSL-1.0', 'MIT', 'CC0-1.0') OR (designated LIKE 'GPL%' AND expression = 'L' || designated)) THEN n ELSE 0 END) AS benign_exceptions,
    sum(CASE WHEN expression <> designated AND NOT (expression IN ('BSL-1.0', 'MIT', 'CC0-1.0') OR (designated LIKE 'GPL%' AND expression = 'L' || designated)) THEN n ELSE 0 END) AS other_exceptions
    FROM n LEFT JOIN h USING (package) GROUP BY ALL),
  s AS (SELECT *, CASE WHEN license_class IS NULL THEN CASE WHEN files = 0 THEN 'UNRESOLVABLE' ELSE 'UNRESOLVED' END WHEN files = 0 OR agreeing = 0 OR other_exceptions > 0 THEN 'NEEDS_HUMAN_REVIEW'
    WHEN benign_exceptions > 0 THEN 'MIXED' ELSE 'RESOLVED' END AS status FROM a)
  SELECT package, CAST(files AS BIGINT) AS files, dominant, CAST(benign_exceptions AS BIGINT) AS benign_exceptions, CAST(other_exceptions AS BIGINT) AS other_exceptions, status,
    CASE WHEN status IN ('MIXED', 'RESOLVED') THEN designated END AS resolved_expression,
    CASE WHEN status = 'NEEDS_HUMAN_REVIEW' THEN CASE WHEN agreeing > 0 THEN designated ELSE dominant END END AS provisional_expression FROM s""")
def d16_license_resolution(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("package", F.concat("source", F.lit("/"), F.col("doc_id") % 5))
    rows = docs.select("package", F.col("doc_id").cast("string").alias("path"), F.expr(_EXPR).alias("expression"))
    return pv.license_resolution(rows, docs.select("package", F.expr(_CLASS).alias("license_class")).distinct())


_OPS = """ops AS (SELECT p_partkey AS operation_id, p_brand AS package, CASE WHEN p_size < 10 THEN 'VALIDATED' WHEN p_size < 20 THEN 'IMPLEMENTED' ELSE 'CATALOGED' END AS status,
  [p_brand, 'Brand#' || (p_partkey % 26 + 1)] AS constituents FROM part)"""


def _ops(spark, sf):
    size = F.col("p_size")
    return _t(spark, sf, "part").select(
        F.col("p_partkey").alias("operation_id"), F.col("p_brand").alias("package"), F.when(size < 10, "VALIDATED").when(size < 20, "IMPLEMENTED").otherwise("CATALOGED").alias("status"),
        F.array("p_brand", F.concat(F.lit("Brand#"), F.col("p_partkey") % 26 + 1)).alias("constituents"))


@query("d17_coverage_rollup", f"""WITH {_OPS}, pk AS (SELECT DISTINCT p_brand AS package FROM part UNION SELECT 'Brand#26'),
  pr AS (SELECT package, count(*) AS total, count(*) FILTER (status = 'VALIDATED') AS validated, count(*) FILTER (status = 'IMPLEMENTED') AS implemented FROM ops GROUP BY package),
  us AS (SELECT c AS package, count(DISTINCT operation_id) AS dependency_use FROM (SELECT operation_id, package AS owner, unnest(constituents) AS c FROM ops) WHERE c <> owner GROUP BY c)
  SELECT package, coalesce(total, 0) AS total, coalesce(validated, 0) AS validated, coalesce(implemented, 0) AS implemented, coalesce(dependency_use, 0) AS dependency_use,
    CASE WHEN validated > 0 THEN 'VALIDATED' WHEN package = 'Brand#26' THEN 'EXCLUDED' ELSE 'CATALOGED' END AS status,
    CASE WHEN validated > 0 THEN 'has_validated_operations' WHEN package = 'Brand#26' THEN 'out_of_scope' ELSE 'unclassified_in_policy' END AS reason_code
  FROM pk LEFT JOIN pr USING (package) LEFT JOIN us USING (package)""")
def d17_coverage_rollup(spark, sf):
    ops = _ops(spark, sf)
    last = ops.select(F.lit("Brand#26").alias("package")).distinct()
    policy = last.select("package", F.lit("EXCLUDED").alias("policy_status"), F.lit("out_of_scope").alias("policy_reason"))
    return pv.coverage_rollup(ops.select("package").distinct().unionByName(last).distinct(), ops, policy)


_PKL = """pkl AS (SELECT DISTINCT p_brand AS package, CASE WHEN CAST(substring(p_brand, 7) AS INT) % 3 = 0 THEN 'GPL-3.0' WHEN CAST(substring(p_brand, 7) AS INT) % 5 = 0 THEN NULL ELSE 'LGPL-3.0' END AS expression,
  CASE WHEN CAST(substring(p_brand, 7) AS INT) % 4 = 0 THEN 'NEEDS_HUMAN_REVIEW' ELSE 'RESOLVED' END AS license_status FROM part)"""


@query("d18_restrictive_expression", f"""WITH {_OPS}, {_PKL}, x AS (SELECT operation_id, constituents[i] AS package, i FROM ops, (VALUES (1), (2)) v(i)),
  j AS (SELECT * FROM x LEFT JOIN pkl USING (package)),
  g AS (SELECT operation_id, bool_or(license_status IS NULL) AS unknown, count(*) FILTER (license_status = 'NEEDS_HUMAN_REVIEW') AS review,
    arg_min(expression, (CASE WHEN expression LIKE 'GPL%' THEN 0 ELSE 10 END) + i) FILTER (expression IS NOT NULL) AS best FROM j GROUP BY operation_id)
  SELECT operation_id, CASE WHEN NOT unknown THEN best END AS expression, review FROM g""")
def d18_restrictive_expression(spark, sf):
    n = F.substring("p_brand", 7, 10).cast("int")
    packages = _t(spark, sf, "part").select(
        F.col("p_brand").alias("package"), F.when(n % 3 == 0, "GPL-3.0").when(n % 5 == 0, F.lit(None)).otherwise("LGPL-3.0").alias("expression"),
        F.when(n % 4 == 0, "NEEDS_HUMAN_REVIEW").otherwise("RESOLVED").alias("license_status")).distinct()
    return pv.restrictive_expression(_ops(spark, sf), packages)


@query("d19_plan_cost", """WITH r AS (SELECT p_partkey AS operation_id, CASE WHEN p_size = 1 THEN NULL ELSE p_size * p_size * p_size END AS maximum_faces, p_size % 3 AS worker_checks, p_size % 2 = 0 AS mutates FROM part),
  s AS (SELECT l_orderkey AS plan_id, l_partkey AS operation_id, CASE WHEN l_returnflag = 'N' THEN 'validator' ELSE 'transform' END AS role FROM lineitem)
  SELECT plan_id, count(*) AS step_count, CAST(sum(1 + worker_checks) AS BIGINT) AS total_cost_units, count(*) FILTER (role = 'validator') AS validator_steps,
    count(*) FILTER (role <> 'validator' AND mutates) AS mutating_steps,
    ['small', 'medium', 'large', 'unbounded'][max(CASE WHEN maximum_faces IS NULL THEN 3 WHEN maximum_faces <= 1000 THEN 0 WHEN maximum_faces <= 50000 THEN 1 ELSE 2 END) + 1] AS highest_tier,
    CASE WHEN count(*) FILTER (role <> 'validator' AND mutates) > 0 THEN 'mutating_validated' ELSE 'read_only' END AS highest_risk FROM s JOIN r USING (operation_id) GROUP BY plan_id""")
def d19_plan_cost(spark, sf):
    size = F.col("p_size")
    registry = _t(spark, sf, "part").select(F.col("p_partkey").alias("operation_id"), F.when(size != 1, size * size * size).alias("maximum_faces"),
                                            (size % 3).alias("worker_checks"), (size % 2 == 0).alias("mutates"))
    steps = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_partkey").alias("operation_id"),
                                             F.when(F.col("l_returnflag") == "N", "validator").otherwise("transform").alias("role"))
    return pv.plan_cost(steps, registry)


@query("d20_tree_hash", r"""WITH f AS (SELECT lang, source || '/' || doc_id AS path, sha256(text) AS h FROM documents)
  SELECT lang, count(*) AS files, sha256(string_agg(path || chr(0) || h || chr(10), '' ORDER BY path)) AS digest FROM f GROUP BY lang""")
def d20_tree_hash(spark, sf):
    files = _t(spark, sf, "documents").select("lang", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return pv.tree_hash(files, "lang")


@query("e7_retain_lru", """WITH e AS (SELECT o_orderkey AS entry_id, o_orderdate AS used, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders),
  r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (ORDER BY used DESC, entry_id ROWS UNBOUNDED PRECEDING) AS b FROM e WINDOW w AS (ORDER BY used DESC, entry_id))
  SELECT entry_id, used, size FROM r WHERE n <= 9000 AND b <= 900000000""")
def e7_retain_lru(spark, sf):
    entries = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("used"), F.round("o_totalprice").cast("bigint").alias("size"))
    return pv.retain_lru(entries, 9000, 900_000_000)


_CHAIN = """at AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt,
    CASE WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END AS state,
    CASE event_type WHEN 'purchase' THEN NULL WHEN 'signup' THEN 'timeout' WHEN 'error' THEN 'resource_limit' ELSE 'validation_failure' END AS error_class FROM events)"""


@query("e9_first_success_chain", f"""WITH {_CHAIN.replace('at AS', 'att AS')}, e AS (SELECT *, state = 'succeeded' OR coalesce(error_class, '') NOT IN ('validation_failure', 'unmet_precondition', 'worker_error', 'resource_limit', 'invalid_input') AS ends FROM att),
  f AS (SELECT job_id, coalesce(min(attempt) FILTER (ends), max(attempt)) AS a, count(*) AS declared FROM e GROUP BY job_id)
  SELECT f.job_id, declared, a + 1 AS ran, CASE WHEN state = 'succeeded' THEN a END AS served_by_index, error_class AS last_error FROM f JOIN e ON e.job_id = f.job_id AND e.attempt = a""")
def e9_first_success_chain(spark, sf):
    from ..operators.ordering import grouped_rank
    e = F.col("event_type")
    ranked = grouped_rank(_t(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")])
    return pv.first_success_chain(ranked.select(
        F.col("user_id").alias("job_id"), (F.col("position") - 1).alias("attempt"), F.when(e == "purchase", "succeeded").otherwise("failed").alias("state"),
        F.when(e == "signup", "timeout").when(e == "error", "resource_limit").when(e != "purchase", "validation_failure").alias("error_class")))


_EDGES = "ed AS (SELECT p_partkey AS output, p_partkey // 3 AS input FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 7 FROM part WHERE p_partkey > 0)"


def _edges(spark, sf):
    part = _t(spark, sf, "part").filter("p_partkey > 0")
    return part.select(F.col("p_partkey").alias("output"), F.explode(F.array(F.floor(F.col("p_partkey") / 3), F.floor(F.col("p_partkey") / 7))).alias("input")).distinct()


@query("f15_lineage_closure", f"""WITH RECURSIVE {_EDGES}, cl AS (SELECT output, input, 1 AS depth FROM ed UNION SELECT cl.output, ed.input, depth + 1 FROM cl JOIN ed ON ed.output = cl.input)
  SELECT output, input, min(depth) AS depth FROM cl GROUP BY ALL""")
def f15_lineage_closure(spark, sf):
    return pv.lineage_closure(_edges(spark, sf))


@query("f16_dag_levels", """WITH RECURSIVE s AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_id, count(*) AS n FROM lineitem GROUP BY ALL),
  e AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS step_id, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN l_linenumber - 1 WHEN l_returnflag = 'A' AND l_orderkey % 5 = 0 THEN l_linenumber + 1 END AS d FROM lineitem),
  d AS (SELECT * FROM e WHERE d IS NOT NULL), k AS (SELECT d.* FROM d JOIN s ON s.plan_id = d.plan_id AND s.step_id = d.d),
  bad AS (SELECT DISTINCT plan_id, step_id FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.plan_id = d.plan_id AND s.step_id = d.d)),
  -- nodes that reach a cycle: reachable from themselves, or depending on such a node
  r AS (SELECT plan_id, step_id, d FROM k UNION SELECT r.plan_id, r.step_id, k.d FROM r JOIN k ON k.plan_id = r.plan_id AND k.step_id = r.d),
  cyc AS (SELECT DISTINCT plan_id, step_id FROM r WHERE step_id = d), stuck AS (SELECT plan_id, step_id FROM cyc UNION SELECT r.plan_id, r.step_id FROM r JOIN cyc ON cyc.plan_id = r.plan_id AND cyc.step_id = r.d),
  lv AS (SELECT plan_id, step_id, 0 AS level FROM s UNION SELECT k.plan_id, k.step_id, level + 1 FROM lv JOIN k ON k.plan_id = lv.plan_id AND k.d = lv.step_id WHERE level < 10),
  m AS (SELECT plan_id, step_id, max(level) AS level FROM lv GROUP BY ALL)
  SELECT s.plan_id, s.step_id, CASE WHEN stuck.step_id IS NULL THEN m.level END AS level,
    CASE WHEN n > 1 THEN 'duplicate_id' WHEN bad.step_id IS NOT NULL THEN 'dangling' WHEN stuck.step_id IS NOT NULL THEN 'cycle' END AS problem
  FROM s JOIN m USING (plan_id, step_id) LEFT JOIN bad USING (plan_id, step_id) LEFT JOIN stuck USING (plan_id, step_id)""")
def f16_dag_levels(spark, sf):
    line = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_id"), "l_returnflag")
    up = F.when((F.col("l_returnflag") == "R") & (F.col("step_id") > 1), F.col("step_id") - 1).when(
        (F.col("l_returnflag") == "A") & (F.col("plan_id") % 5 == 0), F.col("step_id") + 1)
    edges = line.withColumn("depends_on", up).filter("depends_on IS NOT NULL").select("plan_id", "step_id", "depends_on")
    return pv.dag_levels(line.select("plan_id", "step_id"), edges)


@query("b9_gate_candidates", """WITH o AS (SELECT p_partkey AS operation_id, p_type AS kernel, CASE WHEN p_size < 25 THEN 'VALIDATED' ELSE 'BLOCKED' END AS status, [p_brand, p_name] AS accepted, [p_brand] AS deps, p_name AS license FROM part),
  c AS (SELECT s_suppkey AS request_id, ['ECONOMY', 'STANDARD', 'PROMO'][s_suppkey % 3 + 1] AS kernel, CASE WHEN s_suppkey % 2 = 0 THEN ['VALIDATED'] END AS st, CASE WHEN s_suppkey % 5 = 0 THEN 'Brand#' || (s_nationkey + 1) END AS it,
    CASE WHEN s_suppkey % 7 < 6 THEN ['Brand#' || (s_nationkey + 1), 'Brand#3'] END AS dp FROM supplier)
  SELECT request_id, operation_id FROM o JOIN c USING (kernel) WHERE (st IS NULL OR list_contains(st, status)) AND (it IS NULL OR list_contains(accepted, it)) AND (dp IS NULL OR list_has_all(dp, deps))""")
def b9_gate_candidates(spark, sf):
    ops = _t(spark, sf, "part").select(
        F.col("p_partkey").alias("operation_id"), F.col("p_type").alias("kernel"), F.when(F.col("p_size") < 25, "VALIDATED").otherwise("BLOCKED").alias("status"),
        F.array("p_brand", "p_name").alias("accepted_types"), F.array("p_brand").alias("dependencies"), F.col("p_name").alias("license"))
    k, brand = F.col("s_suppkey"), F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1)
    asked = _t(spark, sf, "supplier").select(
        k.alias("request_id"), F.element_at(F.array(F.lit("ECONOMY"), F.lit("STANDARD"), F.lit("PROMO")), (k % 3 + 1).cast("int")).alias("kernel"),
        F.when(k % 2 == 0, F.array(F.lit("VALIDATED"))).alias("statuses"), F.when(k % 5 == 0, brand).alias("input_type"),
        F.when(k % 7 < 6, F.array(brand, F.lit("Brand#3"))).alias("dependencies"), F.lit(None).cast("array<string>").alias("licenses"))
    return pv.gate_candidates(ops, asked)


@query("b10_match_input_types", """WITH sl AS (SELECT s_suppkey AS request_id, slot, CASE slot WHEN 0 THEN ['A', 'N'] WHEN 1 THEN ['R'] ELSE ['A', 'R'] END AS types FROM supplier, (VALUES (0), (1), (2)) v(slot) WHERE slot <= s_suppkey % 3),
  f AS (SELECT s_suppkey AS request_id, k, ['A', 'N', 'R'][(s_suppkey * (k + 3) + k + s_nationkey) % 3 + 1] AS kind FROM supplier, (VALUES (0), (1), (2)) v(k) WHERE k <= s_nationkey % 3),
  p AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) v(a, b, c)),
  w AS (SELECT s_suppkey AS request_id, s_suppkey % 3 + 1 AS ns, s_nationkey % 3 + 1 AS no FROM supplier),
  t AS (SELECT w.request_id, a, b, c, count(*) FILTER (list_contains(types, kind)) AS good FROM w, p JOIN sl ON true JOIN f ON f.request_id = sl.request_id AND f.k = [a, b, c][sl.slot + 1] WHERE sl.request_id = w.request_id GROUP BY ALL)
  SELECT w.request_id, ns = no AND coalesce(max(good) = ns, false) AS compatible FROM w LEFT JOIN t USING (request_id) GROUP BY w.request_id, ns, no""")
def b10_match_input_types(spark, sf):
    sup = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_nationkey").alias("nation"))
    r, n = F.col("request_id"), F.col("nation")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    slots = sup.withColumn("slot", F.explode(F.sequence(F.lit(0), (r % 3).cast("int")))).select(
        "request_id", "slot", F.when(F.col("slot") == 0, lit("A", "N")).when(F.col("slot") == 1, lit("R")).otherwise(lit("A", "R")).alias("types"))
    offers = sup.withColumn("k", F.explode(F.sequence(F.lit(0), (n % 3).cast("int")))).select(
        "request_id", F.element_at(lit("A", "N", "R"), ((r * (F.col("k") + 3) + F.col("k") + n) % 3 + 1).cast("int")).alias("kind"))
    return pv.match_input_types(offers, slots)


@query("b11_select_policy", """WITH p(policy_id, policy_group, field, test, value) AS (VALUES ('p1', 'status', 'status', 'equals', 'F'), ('p2', 'status', 'status', 'equals', 'O'), ('p3', 'rank', 'priority', 'nonempty', NULL),
    ('p4', 'rank', 'rush', 'present', NULL)),
  f AS (SELECT o_orderkey AS row_id, 'status' AS field, o_orderstatus AS actual FROM orders UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderpriority END FROM orders
    UNION ALL SELECT o_orderkey, 'rush', 'yes' FROM orders WHERE o_custkey % 4 = 0),
  c AS (SELECT row_id, policy_group, count(DISTINCT policy_id) AS n, min(policy_id) AS policy_id FROM f JOIN p USING (field)
    WHERE (test = 'equals' AND actual = value) OR test = 'present' OR (test = 'nonempty' AND length(actual) > 0) GROUP BY ALL),
  g AS (SELECT o_orderkey AS row_id, max(policy_id) FILTER (policy_group = 'status' AND n = 1) AS status, max(policy_id) FILTER (policy_group = 'rank' AND n = 1) AS rank FROM orders LEFT JOIN c ON row_id = o_orderkey GROUP BY o_orderkey)
  SELECT row_id, status, rank, status IS NOT NULL AND rank IS NOT NULL AS accepted FROM g""")
def b11_select_policy(spark, sf):
    priority = F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.col("o_orderpriority"))
    base = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), priority)
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(
        F.col("o_custkey") % 4 == 0, F.map_concat(base, F.create_map(F.lit("rush"), F.lit("yes")))).otherwise(base).alias("parameters"))
    policies = spark.createDataFrame([("p1", "status", "status", "equals", "F"), ("p2", "status", "status", "equals", "O"),
                                      ("p3", "rank", "priority", "nonempty", None), ("p4", "rank", "rush", "present", None)],
                                     "policy_id string, policy_group string, field string, test string, value string")
    return pv.select_policy(rows, policies, ["status", "rank"])
