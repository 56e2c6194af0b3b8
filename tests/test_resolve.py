from pyspark.sql import functions as F

from skillgrid.operators import resolve


def _dims(spark):
    skills = spark.createDataFrame(
        [("K1", "JavaScript", True), ("K2", "Go", True), ("K3", "Django", True), ("K4", "MongoDB", True),
         ("K5", "Algorithms", True), ("K6", "Old", False), ("K7", "SQL", True)],
        "skill_id string, name string, is_active boolean")
    aliases = spark.createDataFrame(
        [("js", "K1"), ("javascript es6", "K1"), ("Go", "K2"), ("django", "K3"), ("mongodb", "K4"),
         ("algorithms", "K5"), ("legacy", "K6"), ("sql queries", "K7")], "alias string, skill_id string"
    ).withColumn("normalized_alias", F.lower(F.trim("alias")))
    return skills, aliases


def _map(spark, text):
    skills, aliases = _dims(spark)
    docs = spark.createDataFrame([(1, text)], "posting_id int, description string")
    hits, unresolved = resolve.map_skills(docs, skills, aliases, posting="posting_id", text="description")
    return ({(r["skill_id"], r["match_type"]) for r in hits.collect()},
            sorted(r["signal_text"] for r in unresolved.collect()))


def test_tiers(spark):
    hits, unresolved = _map(spark, "JavaScript, js; Writing SQL queries daily\nbasket weaving")
    assert hits == {("K1", "exact"), ("K7", "alias")}
    assert unresolved == ["basket weaving"]


def test_go_guard(spark):
    hits, _ = _map(spark, "django and mongodb")
    assert ("K2", "alias") not in hits and ("K3", "alias") in hits and ("K4", "alias") in hits
    hits, _ = _map(spark, "experience with go and rust")
    assert ("K2", "alias") in hits


def test_guard_boundaries(spark):
    hits, _ = _map(spark, "go-lang")
    assert ("K2", "alias") in hits
    hits, _ = _map(spark, "go.")
    assert ("K2", "alias") not in hits
    hits, _ = _map(spark, "js+")
    assert ("K1", "alias") not in hits


def test_inactive_skill_alias_ignored(spark):
    hits, unresolved = _map(spark, "legacy systems")
    assert hits == set() and unresolved == ["legacy systems"]


def test_first_hit_per_skill(spark):
    skills, aliases = _dims(spark)
    docs = spark.createDataFrame([(1, "js, JavaScript, algorithms")], "posting_id int, description string")
    hits, _ = resolve.map_skills(docs, skills, aliases, posting="posting_id", text="description")
    got = {r["skill_id"]: (r["signal_pos"], r["match_type"]) for r in hits.collect()}
    assert got == {"K1": (0, "alias"), "K5": (2, "exact")}


def test_duplicate_alias_raises(spark):
    skills, aliases = _dims(spark)
    dup = aliases.unionByName(aliases.limit(1))
    try:
        resolve.skill_alias_lookup(dup, skills)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_skill_name_clash_last_name_wins(spark):
    skills = spark.createDataFrame([("A", "python", True), ("B", "Python", True)], "skill_id string, name string, is_active boolean")
    got = resolve.skill_name_lookup(skills).collect()
    assert [(r["name_key"], r["skill_id"]) for r in got] == [("python", "A")]


def test_role_resolution_and_examples(spark):
    ra = spark.createDataFrame([("Data Analyst", "R1")], "alias string, role_id string").withColumn(
        "normalized_alias", F.lit(None).cast("string"))
    post = spark.createDataFrame([(1, "  data   ANALYST"), (2, "chef"), (3, "chef "), (4, " "), (5, "baker")],
                                 "source_row_number int, role_hint string")
    r = resolve.resolve_roles(post, ra)
    assert {x["source_row_number"]: x["role_id"] for x in r.collect()} == {1: "R1", 2: None, 3: None, 4: None, 5: None}
    ex = [x["example"] for x in resolve.unmatched_examples(r).collect()]
    assert ex == ["chef", "baker"]


def test_role_hint_candidates(spark):
    rows = spark.createDataFrame([(1, "e1", "", "Analyst", "t1"), (2, "e1", "Chef", "", "t2"), (3, "e2", "", "", "T3")],
                                 "source_row_number int, external_id string, role_normalized string, role string, title string")
    got = {r["external_id"]: r["source_role_hint"] for r in resolve.role_hints(rows).collect()}
    assert got == {"e1": "Chef", "e2": "T3"}


def test_contained_alias_candidates_are_complete(spark):
    """The index finds what a check of every pair finds."""
    import itertools
    import random
    rng = random.Random(6)
    parts = ["x", "go", "c++", "java", "script", "-", " ", ".", "node.js", "é", "react", "ab"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(1, n))).strip()
    names = sorted({a for a in (" ".join(make(4).split()) for _ in range(60)) if a})
    skills = spark.createDataFrame([(f"k{i}", f"skill {i}", True) for i in range(len(names))],
                                   "skill_id string, name string, is_active boolean")
    aliases = spark.createDataFrame([(a, f"k{i}", a) for i, a in enumerate(names)],
                                    "alias string, skill_id string, normalized_alias string")
    lookup = resolve.skill_alias_lookup(aliases, skills)
    keys = spark.createDataFrame([(k,) for k in sorted({" ".join(make(8).split()) for _ in range(200)})], "signal_key string")
    got = {(r.signal_key, r.t3.normalized_alias) for r in resolve.contained_aliases(keys, lookup).collect() if r.t3}
    want = set()
    import re
    for k, a in itertools.product([r[0] for r in keys.collect()], lookup.collect()):
        if a.normalized_alias in k and re.search(f"[{resolve.TOKEN_CHARS}]", a.normalized_alias) and (
                not a.requires_boundary or re.search(a.pattern, k)):
            want.add((k, a.normalized_alias))
    assert got == want and len(want) > 50


def test_short_alias_table_is_checked_without_a_shuffle(spark, monkeypatch):
    """Signals meet a short alias table in their own row; the index, for longer ones, finds the same."""
    import random
    rng = random.Random(9)
    skills = spark.createDataFrame([("K1", "K One", True), ("K2", "K Two", True), ("K3", "Off", False)],
                                   "skill_id string, name string, is_active boolean")
    aliases = spark.createDataFrame(
        [(a, k) for a, k in (("a", "K1"), ("an", "K1"), ("c++", "K2"), ("c#", "K1"), (".net", "K2"), ("tion", "K1"),
                             ("stone", "K2"), ("version 2.0", "K1"), ("node.js", "K2"), ("r&d", "K1"), ("--", "K2"),
                             ("ab-cdef", "K1"), ("gone", "K3"))], "alias string, skill_id string") \
        .withColumn("normalized_alias", F.col("alias"))
    lookup = resolve.skill_alias_lookup(aliases, skills)
    pieces = ["a", "an", "c++", "c#", ".net", "tion", "stone", "version", "2.0", "node.js", "r&d", "--", "ab-cdef", "x",
              "stones", "c", "+", "(", ")", "gone", "version 2.0"]
    texts = {"".join(rng.choice(pieces) + rng.choice(["", " ", "-"]) for _ in range(5)).strip() for _ in range(300)}
    signals = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts) * 2)] + [(-1, None)],
                                    "n int, signal_key string").repartition(3)
    among = F.col("n") % 5 != 0

    def found(df):
        return sorted((r.n, r.signal_key or "", r.t3.normalized_alias if r.t3 else "") for r in df.collect())

    paired = resolve.contained_aliases(signals, lookup, among=among)
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key_id" not in plan and "Generate" not in plan
    got = found(paired)
    monkeypatch.setattr(resolve, "PAIRED_ALIASES", 0)
    assert "Aggregate [key_id" in resolve.contained_aliases(signals, lookup, among=among)._jdf.queryExecution().optimizedPlan().toString()
    assert got == found(resolve.contained_aliases(signals, lookup, among=among))
    monkeypatch.setattr(resolve, "BROADCAST_ALIASES", 0)
    assert got == found(resolve.contained_aliases(signals, lookup, among=among))
    assert {a for _, _, a in got} == {"", "a", "an", "c++", "c#", ".net", "tion", "stone", "version 2.0", "node.js", "r&d", "ab-cdef"}


def test_contained_alias_candidates_of_the_index_are_complete(spark, monkeypatch):
    """The index, which a longer alias table takes, finds what a check of every pair finds."""
    monkeypatch.setattr(resolve, "PAIRED_ALIASES", 0)
    test_contained_alias_candidates_are_complete(spark)
