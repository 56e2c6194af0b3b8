import datetime as dt

from pyspark.sql import functions as F

from skillgrid.operators import ops, quality, student


def _log(spark, rows):
    t0 = dt.datetime(2026, 5, 1)
    data = [(job, t0 + dt.timedelta(minutes=i), i, action, 10 * i, rej, 7, msg)
            for i, (job, action, rej, msg) in enumerate(rows)]
    return spark.createDataFrame(data, "job_id string, ts timestamp, seq int, action string, processed_rows int, rejected_rows int, "
                                       "output_version int, message string")


def test_ledger_transitions(spark):
    log = _log(spark, [
        ("a", "create", 0, None), ("a", "running", 0, None), ("a", "complete", 0, None), ("a", "failed", 0, "x"),
        ("b", "create", 0, None), ("b", "complete", 0, None), ("b", "running", 0, None), ("b", "complete", 2, None),
        ("c", "create", 0, None), ("c", "failed", 0, "  boom  "), ("c", "running", 0, None),
        ("d", "create", 0, None), ("d", "running", 0, None),
        ("e", "create", 0, None),
        ("f", "running", 0, None),
    ])
    got = {r["job_id"]: r for r in ops.ledger_state(log).collect()}
    assert got["a"]["status"] == "complete" and got["a"]["output_version"] == 7
    assert got["b"]["status"] == "partial" and got["b"]["rejected_rows"] == 2 and got["b"]["processed_rows"] == 70
    assert got["c"]["status"] == "failed" and got["c"]["error_message"] == "boom" and got["c"]["started_at"] is None
    assert got["d"]["status"] == "running" and got["d"]["finished_at"] is None
    assert got["e"]["status"] == "pending"
    assert "f" not in got
    refused = sorted((r["seq"], r["action"], r["from_status"]) for r in ops.refused_calls(log).collect())
    assert refused == [(3, "failed", "complete"), (5, "complete", "pending"), (10, "running", "failed"),
                       (14, "running", None)]
    v = ops.ledger_rule_violations(ops.ledger_state(log)).first().asDict()
    assert all(x == 0 for x in v.values())


def _plain_ledger(rows):
    """Call by call, as the rules state them."""
    jobs, refused = {}, []
    for job, ts, seq, action, processed, rejected, version, message in sorted(rows, key=lambda r: (r[1], r[2])):
        j = jobs.get(job)
        if action == "create":
            jobs.setdefault(job, {"status": "pending", "started": None, "ended": None, "processed": 0, "error": None})
        elif j is None:
            refused.append((seq, None))
        elif action == "running" and j["status"] in ("pending", "running"):
            j["started"] = j["started"] or ts
            j["status"] = "running"
        elif action == "complete" and j["status"] == "running":
            j.update(status="partial" if rejected else "complete", ended=ts, processed=processed)
        elif action == "failed" and j["status"] in ("pending", "running"):
            j.update(status="failed", ended=ts, error=message)
        elif not (action == "complete" and j["status"] in ("complete", "partial")
                  or action == "failed" and j["status"] == "failed"):
            refused.append((seq, j["status"]))
    return jobs, sorted(refused, key=str)


def test_ledger_equals_a_plain_fold_in_any_segments(spark):
    import random
    rng = random.Random(4)
    t0 = dt.datetime(2026, 5, 1)
    rows = []
    for seq in range(900):
        job = rng.choice([*"abcdefghijklmnopqrstuvwxyz", "hot"] * 2 + ["hot"] * 10)
        action = rng.choice(["create", "running", "complete", "failed"] + (["running"] * 9 if job == "hot" else []))
        ts = t0 + dt.timedelta(hours=rng.randrange(200))
        rows.append((job, ts, seq, action, rng.randrange(99), rng.randrange(2), 1, f"m{seq}"))
    log = spark.createDataFrame(rows, "job_id string, ts timestamp, seq int, action string, processed_rows int, "
                                      "rejected_rows int, output_version int, message string")
    jobs, refused = _plain_ledger(rows)
    for segment in ("hour", "day", "year"):
        got = {r["job_id"]: {"status": r["status"], "started": r["started_at"], "ended": r["finished_at"],
                             "processed": r["processed_rows"], "error": r["error_message"]}
               for r in ops.ledger_state(log, segment=segment).collect()}
        assert got == jobs
        assert sorted(((r["seq"], r["from_status"]) for r in ops.refused_calls(log, segment=segment).collect()),
                      key=str) == refused
    assert ops.ledger_state(log.limit(0)).count() == 0 == ops.refused_calls(log.limit(0)).count()


def test_outbox_first_wins(spark):
    t = dt.datetime(2026, 5, 1)
    ev = spark.createDataFrame([("j", "done", t + dt.timedelta(1), 2, "b"), ("j", "done", t, 1, "a"),
                                ("j", "failed", t, 3, "c")],
                               "agg string, type string, ts timestamp, seq int, payload string")
    got = {r["event_type"]: r for r in ops.outbox_first(ev, aggregate_id="agg", event_type="type", ts="ts", seq="seq",
                                                        payload="payload").collect()}
    assert got["done"]["payload"] == "a" and got["done"]["attempts"] == 2 and got["failed"]["payload"] == "c"


def test_run_report_formula(spark):
    def tagged(stage, flags):
        return spark.createDataFrame([(f,) for f in flags], "f boolean").select(
            F.lit(stage).alias("stage"), F.col("f").alias("flag"))
    counters = (tagged("read", [True] * 10 + [False] * 2).unionByName(tagged("deduplicated", [True] * 10))
                .unionByName(tagged("skill_match", [True] * 10)))
    r = ops.run_report(counters).first()
    assert r["validation_pass_rate"] == 0.8333 and r["role_match_rate"] == 1.0 and r["skill_match_rate"] == 1.0
    assert r["confidence_score"] == 0.9417 and not r["manual_review_recommended"]
    empty = ops.run_report(tagged("read", [])).first()
    assert empty["validation_pass_rate"] == 0.0 and empty["manual_review_recommended"]


def test_quality_rules(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.05), (float("nan"), 0.2)], "required_depth double, demand_weight double")
    got = {r["rule_name"]: r["violations"] for r in quality.publish_rules(df, "t").collect()}
    assert got == {"required_depth_range": 2, "demand_weight_range": 1}
    try:
        quality.assert_rules(quality.publish_rules(df, "t"))
        raise AssertionError("expected a rule failure")
    except ValueError:
        pass


def test_review_state(spark):
    df = spark.createDataFrame([(False, "R"), (True, "R"), (True, None), (None, None)], "reviewed boolean, role string")
    assert [r[0] for r in df.select(quality.review_state("reviewed", "role")).collect()] == \
        ["pending", "approved", "dismissed", "pending"]


def test_gap_readiness_priority(spark):
    targets = spark.createDataFrame([("u", "r")], "student_id string, role_id string")
    req = spark.createDataFrame([("r", "a", 0.8, 1.0), ("r", "b", 0.5, 0.5), ("r", "c", 0.4, 0.2)],
                                "role_id string, skill_id string, required_depth double, demand_weight double")
    prof = spark.createDataFrame([("u", "a", 0.4), ("u", "c", 0.6)], "student_id string, skill_id string, depth double")
    gaps = student.skill_gaps(targets, req, prof)
    pri = {r["skill_id"]: (r["raw_gap"], r["gap_score"], r["priority"]) for r in student.prioritized(gaps).collect()}
    assert pri == {"a": (0.4, 0.4, 1), "b": (0.5, 0.25, 2), "c": (0.0, 0.0, 3)}
    rd = student.readiness(gaps).first()
    # (0.5 * 1.0 + 0 * 0.5 + 1 * 0.2) / 1.7
    assert rd["readiness_score"] == round(0.7 / 1.7, 4)


def test_role_search(spark):
    roles = spark.createDataFrame([("R1", "Data Analyst"), ("R2", "Backend Engineer")], "role_id string, title string")
    aliases = spark.createDataFrame([("BI Analyst", "R1")], "alias string, role_id string")
    q = spark.createDataFrame([("data analyst",), ("bi analyst",), ("analyst",), ("backend enginer",), ("zzz",)],
                              "query string")
    got = {(r["query_key"], r["role_id"]): (r["tier"], r["score"])
           for r in student.role_search(q, student.search_targets(roles, aliases)).collect()}
    assert got[("data analyst", "R1")] == ("exact_title", 1.0)
    assert got[("bi analyst", "R1")] == ("exact_alias", 0.95)
    assert got[("analyst", "R1")] == ("keyword", 0.8)
    assert got[("backend enginer", "R2")][0] in ("keyword", "fuzzy")
    assert not any(k[0] == "zzz" for k in got)


def test_allowed_course_weights(spark):
    df = spark.createDataFrame([(0.25,), (0.5,), (0.6,), (0.0,)], "weight double")
    got = quality.allowed_values_rule(df, "weight", quality.ALLOWED_COURSE_WEIGHTS, "course_skills",
                                      "course_weight_allowed").first()
    assert got["violations"] == 2


def test_roadmap_skips_completed_and_reaches_deeper_ranks(spark):
    pri = spark.createDataFrame([("u", "r", "a", 1, 0.4), ("u", "r", "b", 2, 0.2), ("u", "r", "c", 3, 0.0)],
                                "student_id string, role_id string, skill_id string, priority int, gap_score double")
    catalog = spark.createDataFrame(
        [("a", "a1", 1, True), ("a", "a2", 2, True), ("a", "a3", 3, True), ("a", "a4", 4, True),
         ("a", "a0", 0, False), ("b", "b1", 1, True), ("c", "c1", 1, True)],
        "skill_id string, item_id string, difficulty int, is_active boolean")
    done = spark.createDataFrame([("u", "a1"), ("u", "a3")], "student_id string, item_id string")
    got = [r["item_id"] for r in
           student.roadmap(pri, catalog, done).orderBy("priority", "difficulty", "item_id").collect()]
    assert got == ["a2", "a4", "b1"]


def test_roadmap_of_two_roles_has_all_items_for_each(spark):
    pri = spark.createDataFrame([("u", "r1", "a", 1, 0.4), ("u", "r2", "a", 1, 0.3)],
                                "student_id string, role_id string, skill_id string, priority int, gap_score double")
    catalog = spark.createDataFrame([("a", f"i{n}", n, True) for n in range(6)],
                                    "skill_id string, item_id string, difficulty int, is_active boolean")
    none = spark.createDataFrame([], "student_id string, item_id string")
    got = student.roadmap(pri, catalog, none).groupBy("role_id").count().collect()
    assert sorted(tuple(r) for r in got) == [("r1", 6), ("r2", 6)]


def test_ratio_is_rounded_once(spark):
    from skillgrid.functions.scores import ratio4, safe_rate
    df = spark.createDataFrame([(9157, 12507), (1, 8), (0, 3), (1, 3)], "n long, d long")
    assert [r[0] for r in df.select(ratio4("n", "d")).collect()] == [0.7321, 0.125, 0.0, 0.3333]
    assert df.select(safe_rate("n", "d")).first()[0] == 0.7321


def test_ledger_tie_on_time_is_decided_by_sequence(spark):
    import datetime as dt
    t = [dt.datetime(2024, 1, 1, 0, m) for m in range(3)]
    log = spark.createDataFrame(
        [("j", t[0], 1, "create", 0, 0, None, None), ("j", t[1], 2, "running", 0, 0, None, None),
         ("j", t[2], 3, "failed", 0, 0, None, "boom"), ("j", t[2], 4, "complete", 5, 0, 7, None)],
        "job_id string, ts timestamp, seq long, action string, processed_rows long, rejected_rows long, "
        "output_version int, message string")
    row = ops.ledger_state(log).first()
    assert row["status"] == "failed" and row["error_message"] == "boom"


def test_roadmap_query_lists_every_unbought_part_of_a_brand(spark, scratch):
    """Two parts of one brand and size are two items: buying one leaves the other to do (F1)."""
    import duckdb

    from skillgrid.plans import oracle_ops, ops_plans
    day = dt.datetime(1996, 1, 1)

    def write(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{scratch}/{name}.parquet")

    write("customer", [(1, 3), (2, 3)], "c_custkey long, c_nationkey int")
    write("orders", [(k, 1 if k == 10 else 2, "F", day, "1-URGENT") for k in range(10, 17)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string")
    write("lineitem", [(10, 1, 5.0, "R")] + [(k, 3, 40.0, "R") for k in range(11, 17)],
          "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string")
    write("part", [(1, "B1", 7), (2, "B1", 7), (3, "B1", 9), (4, "B1", 46)], "p_partkey long, p_brand string, p_size int")
    got = ops_plans.roadmap(spark, scratch)
    items = sorted(r["item_id"] for r in got.where("student_id = 1").collect())
    assert items == [2, 3]
    sql = oracle_ops.ROADMAP
    for name in ("customer", "orders", "lineitem", "part"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{scratch}/{name}.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_roadmap_in_blocks_is_the_plain_join(spark, monkeypatch):
    """Several blocks a skill, repeated and null keys, all or none completed: as joined row by row (F1)."""
    monkeypatch.setattr(student, "BLOCK_ITEMS", 4)
    pri = [("u", "r1", "a", 1, 0.4), ("u", "r2", "a", 2, 0.3), ("u", "r1", "b", 3, 0.2), ("u", "r1", "c", 4, 0.1),
           ("v", "r1", "a", 1, 0.4), ("v", "r1", "a", 1, 0.4), ("v", "r1", "b", 2, 0.0), (None, "r1", "a", 1, 0.5),
           ("w", "r1", "d", 1, 0.5), ("w", "r1", None, 1, 0.5), ("x", "r1", "b", 1, 0.5)]
    cat = [("a", i, i % 5, True) for i in range(30)] + [("b", i, i % 3, i != 33) for i in range(25, 40)] + \
          [("a", 7, 7 % 5, True), ("a", 8, 9, True), ("a", None, 1, True), ("b", 39, None, True), ("a", 50, 1, None),
           ("c", 60, 1, True), (None, 61, 1, True)]
    done = [("u", i) for i in (0, 1, 2, 7, 8, 8, 26, 39, 29, 99)] + [("x", i) for i in range(25, 40)] + \
           [(None, 3), ("v", None), ("w", 5)]
    want = [(s, r, k, p, g, i, d, "todo") for s, r, k, p, g in pri for k2, i, d, a in cat
            if p <= 3 and g > 0 and k is not None and k == k2 and a
            and not any(s is not None and i is not None and (s, i) == c for c in done)]
    got = student.roadmap(
        spark.createDataFrame(pri, "student_id string, role_id string, skill_id string, priority int, gap_score double"),
        spark.createDataFrame(cat, "skill_id string, item_id long, difficulty int, is_active boolean"),
        spark.createDataFrame(done, "student_id string, item_id long"))
    key = lambda row: [(v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_roadmap_shuffles_no_row_of_its_result(spark):
    """100 students x 300 items: what is shuffled are gaps, items and completed items, not their product (F1)."""
    pri = spark.range(100).selectExpr("id AS student_id", "1 AS role_id", "'a' AS skill_id", "1 AS priority", "0.5D AS gap_score")
    catalog = spark.range(300).selectExpr("'a' AS skill_id", "id AS item_id", "int(id % 9) AS difficulty", "true AS is_active")
    done = spark.range(100).selectExpr("id AS student_id", "id * 2 AS item_id")
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = student.roadmap(pri, catalog, done)
        assert len(got.collect()) == 100 * 299
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)

    def sent(node):
        name = node.nodeName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else \
            [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(map(sent, below))

    assert 0 < sent(got._jdf.queryExecution().executedPlan()) < 100 * 299 / 10
