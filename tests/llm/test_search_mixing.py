"""Benchmark search and mixing on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import decontamination, mixing
from tests.conftest import SF


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontamination.common_subsequence(masks, (1 << len(a)) - 1, b) == row[-1]


def test_finds_every_verbatim_item_of_the_corpus(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.id, r["item"]) for r in decontamination.contaminated(docs, items).collect()}
    texts, bench = docs.select("doc_id", "text").collect(), items.collect()
    verbatim = {(d.doc_id, b.item_id) for d in texts for b in bench if b.text in d.text}
    assert verbatim and verbatim <= got
    loose = {(d.doc_id, b.item_id) for d in texts for b in bench if b.text.lower() in d.text.lower()}
    assert len(got - loose) <= 1 + len(loose) // 20


def test_near_pairs_are_all_that_cosine_and_missing_words_leave():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        cosine = rng.random((n, 5), np.float32)
        missing, wanted = (rng.integers(0, 1 << 63, (k, decontamination.SIGNS), np.uint64) for k in (n, 5))
        wanted[0], limit = 0, np.array([0, 90, 120, 128.5, 300])
        at, item = decontamination._near(cosine, 0.4, missing, wanted, limit)
        lacks = np.array([[sum((int(m) & int(w)).bit_count() for m, w in zip(a, b)) for b in wanted] for a in missing])
        assert sorted(zip(at.tolist(), item.tolist())) == list(map(tuple, np.argwhere((cosine >= 0.4) & (lacks <= limit)).tolist()))


def test_sums_by_column_and_by_word_place_equal_the_plain_ones():
    rng = np.random.default_rng(6)
    ids, first = decontamination._hashed(decontamination.WordHasher(), [
        " ".join(map(str, rng.integers(0, 900, n))) for n in (0, 3, 8, 700, 0, 65, 1)] + [None, "last"])
    plain = decontamination.WordHasher()(["a"])[0], [0, 0, 3, 11, 711, 711, 776, 777, 777, 778]
    assert first.tolist() == plain[1] and len(ids) == 778 and (ids != plain[0]).all()
    f = decontamination._features(ids)
    starts, omega = decontamination._passages(first, decontamination.PASSAGE), decontamination._test_matrix()
    z, y = np.zeros(omega.T.shape), np.zeros((decontamination.DIMS, omega.shape[1]))
    decontamination._add_sketch(z, np.ascontiguousarray(omega.T), f, starts)
    for a, b in zip(starts, [*starts[1:], len(f)]):
        np.add.at(y, f[a:b], omega[f[a:b]].sum(axis=0))
    assert np.allclose(z.T, y, atol=1e-3)
    strides = decontamination._passages(first, decontamination.STRIDE)
    assert np.array_equal(decontamination._stride_sums(omega, f, strides), np.add.reduceat(omega[f], strides, axis=0))


def _texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(20 + i))) for i in range(12)]
    docs = [(i, " ".join(sentence(rng.randrange(30, 400))), "e") for i in range(120)]
    return rng, items, docs, sentence


def test_copies_paraphrases_and_clean_texts(spark):
    rng, items, docs, sentence = _texts()
    planted = {}
    for i, text in items:
        words = text.split()
        edits = {0: words, 1: [w.upper() + "," for w in words], 2: [w for j, w in enumerate(words) if j % 9],
                 3: [w if j % 4 or j > 3 * len(words) // 4 else sentence(1)[0] for j, w in enumerate(words)]}[i % 4]
        planted[500 + i] = i
        docs.append((500 + i, " ".join([*sentence(rng.randrange(40)), *edits, *sentence(50)]), "e"))
    docs += [(900, None, "e"), (901, "", "e"), (902, items[0][1][: len(items[0][1]) // 3], "e"), (None, items[1][1], "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string").repartition(3)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "...")], "item_id long, text string")
    got = {(r.id, r["item"]) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {*planted.items(), (None, 1)}
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - set(planted) - {None}
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.contaminated(df.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    _, items, docs, _ = _texts()
    docs += [(500 + i, docs[i][1] + " " + t, "e") for i, t in items]
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string, s string"), bench).collect()
    assert {(r.id, r["item"]) for r in got} == {(500 + i, i) for i, _ in items}


def test_mixing_meets_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    domains = mixing.domains_of(docs)
    targets = {d: 1.0 + i % 3 for i, d in enumerate(domains)}
    model = mixing.fit_domains(docs, labels, domains)
    members = mixing.memberships(docs, model).cache()
    rows = members.collect()
    assert len(rows) == docs.count() and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
    rates, reached = mixing.fit_rates(members, domains, targets, budget=2.0 * sum(r.rows * r.tokens for r in rows))
    rate = {bytes(r.rk): r.rate for r in rates.collect()}
    assert min(rate.values()) >= 0
    want = [sum(r.rows * r.tokens * rate[bytes(r.rk)] * r.p[i] for r in rows) for i in range(len(domains))]
    assert want == pytest.approx(reached, rel=1e-9)
    goal = 2.0 * sum(r.rows * r.tokens for r in rows)
    # nearer the targets than the natural totals, each error relative to its domain
    natural = [sum(r.rows * r.tokens * r.p[i] for r in rows) for i in range(len(domains))]
    aim = [goal * targets[d] / sum(targets.values()) for d in domains]
    loss = lambda total: sum((e - t) ** 2 / n for e, t, n in zip(total, aim, natural))
    assert loss(want) < 0.5 * loss(natural)
    members.unpersist()


def test_rates_reach_feasible_targets_and_stay_nonnegative(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        p = [0.05, 0.05, 0.05]
        p[0 if i < 200 else 1 + i % 2] = 0.9
        rows.append((bytes([i % 256, i // 256]), 1 + (i % 50 == 0), rng.randrange(0, 400), p))
    members = spark.createDataFrame(rows, "rk binary, rows long, tokens long, p array<double>")
    for targets in ({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 1.0, "b": 3.0, "c": 2.0}):
        _, reached = mixing.fit_rates(members, ["a", "b", "c"], targets)
        total = sum(reached)
        assert [x / total for x in reached] == pytest.approx([targets[d] / sum(targets.values()) for d in "abc"], rel=1e-3)
    # a domain of weight 0 cannot be left out wholly, as every document is a little of each
    rates, reached = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.0, "b": 1.0, "c": 1.0})
    assert min(r.rate for r in rates.collect()) == 0.0 and reached[0] < 0.2 * reached[1]


def test_mixing_edge_rows(spark):
    rows = [(i, "alpha beta " * (i + 1), "s1" if i % 4 else "s2", "en", "z") for i in range(24)]
    rows += [(90, None, "s1", "en", "z"), (91, "", None, None, "z"), (None, "alpha", "s2", "en", "z"), (5, rows[5][1], "s1", "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 24, 2)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and r.copies >= (r.rate > 0) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (90, 91)} == {0}
    assert len({r.rate for r in got if r.doc_id == 5 and r.text == rows[5][1]}) == 1
    assert mixing.mix(docs.limit(0), labels).count() == 0
    alone = docs.withColumn("source", docs.source.substr(9, 9)).selectExpr("doc_id", "text", "cast(null as string) source", "lang")
    assert {r.rate for r in mixing.mix(alone, labels).collect()} == {1.0}


def test_memberships_follow_the_words_not_the_stated_source(spark):
    rng = random.Random(4)
    words = {d: [f"{d}{i}" for i in range(60)] for d in "ab"}
    common = [f"c{i}" for i in range(60)]
    text = lambda d: " ".join(rng.choice(words[d] if rng.random() < 0.3 else common) for _ in range(80))
    # the words that tell come after any number of others
    rows = [(i, " ".join(rng.choices(common, k=200)) + " " + text("ab"[i % 2]), "ab"[i % 2], "en") for i in range(200)]
    rows += [(300 + i, text("ab"[i % 2]), "ba"[i % 2], "en") for i in range(20)]  # stated source contradicts the words
    rows += [(400 + i, text("ab"[i % 2]), None, "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    model = mixing.fit_domains(docs, labels, ["a", "b"])
    p = {bytes(r.rk): r.p for r in mixing.memberships(docs, model).collect()}
    keys = docs.select("doc_id", mixing.row_key("doc_id", "text").alias("rk")).collect()
    for r in keys:
        assert p[bytes(r.rk)][r.doc_id % 2] > 0.9


def test_words_that_tell_nothing_move_no_membership(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(150)), "ab"[rng.randrange(2)], "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = mixing.fit_domains(docs, docs.select("doc_id"), ["a", "b"])
    assert all(0.3 < x < 0.7 for r in mixing.memberships(docs, model).collect() for x in r.p)


def test_recall_of_edited_items_against_the_word_rule(spark):
    """Items with words replaced, planted in documents; those the rule on words accepts are found."""
    sf, rng, rules = SF.replace("sf0.001", "sf0.1"), random.Random(5), decontamination.Rules()
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    texts = [r.text or "" for r in base.orderBy("doc_id").limit(1500).collect()]
    pool = [w for t in texts[:300] for w in t.split()[:200]]
    hosts = [t.split() for t in texts if 60 <= len(t.split()) <= 300]
    hasher, rows, want = decontamination.WordHasher(drop=decontamination.PUNCTUATION), [], {20: set(), 35: set()}
    for r in bench.collect():
        w = r.text.split()
        item = hasher([r.text])[0]
        answer = item[len(item) - max(1, round(len(item) * rules.answer_part)):]
        for edits in want:
            last = len(w) if edits == 20 else len(w) - max(1, round(len(w) * rules.answer_part))
            put = set(rng.sample(range(last), min(last, round(len(w) * edits / 100))))
            x = [rng.choice(pool) if i in put else v for i, v in enumerate(w)]
            host = rng.choice(hosts)
            at = rng.randrange(len(host))
            i = 10**7 + len(rows)
            rows.append((i, " ".join(host[:at] + x + host[at:])))
            region = hasher([" ".join(x)])[0].tolist()
            share, part = (decontamination.common_subsequence(*decontamination._masks(y), region) / len(y) for y in (item, answer))
            if share >= rules.copy_share or share >= rules.paraphrase_share and part >= rules.answer_share:
                want[edits].add((i, r.item_id))
    df = base.union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    got = {(r.id, r["item"]) for r in decontamination.contaminated(df, bench).select("id", "item").collect()}
    for edits, pairs in want.items():
        assert len(pairs & got) >= 0.93 * len(pairs), edits


def _plain_memberships(rows, taught, domains, *, alpha=0.5):
    """Tempered naive Bayes by numpy, from (id, text, source, lang) rows and the bucket of each word and field."""
    def counts(some):
        c, n = np.zeros((len(domains), mixing.BUCKETS)), np.zeros(len(domains))
        for r in some:
            n[domains.index(r["source"])] += 1
            np.add.at(c[domains.index(r["source"])], r["f"], 1)
        return n, c

    def model(n, c, w=1.0):
        every = alpha + c.sum(0)
        share, mass = every / every.sum(), alpha * mixing.BUCKETS
        return (np.log((n + alpha) / (n.sum() + alpha * len(n))),
                w * (np.log((c + mass * share) / (c.sum(1, keepdims=True) + mass)) - np.log(share)))

    def posterior(m, r):
        z = m[0] + m[1][:, r["f"]].sum(1)
        e = np.exp(z - z.max())
        return e / e.sum()

    learn = [r for r in rows if r["doc_id"] in taught and r["source"] in domains]
    seen, held = counts([r for r in learn if not r["held"]]), [r for r in learn if r["held"]]
    fit = lambda w: sum(np.log(posterior(model(*seen, w), r)[domains.index(r["source"])]) for r in held)
    best = max(mixing.WEIGHTS, key=fit)
    whole = model(*counts(learn), best)
    return {r["doc_id"]: posterior(whole, r) for r in rows}


def test_memberships_equal_plain_naive_bayes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    domains = mixing.domains_of(docs)
    words = F.regexp_extract_all(mixing.text_of("text"), F.lit(f"({mixing.WORD})"), 1)
    rows = docs.select("doc_id", "source", (F.pmod(F.xxhash64(F.lit("side"), mixing.text_of("text")), F.lit(5)) == 0).alias("held"),
                       F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(mixing.BUCKETS))),
                                F.array(F.pmod(F.xxhash64(F.lit("lang="), F.coalesce("lang", F.lit(""))), F.lit(mixing.BUCKETS)))
                                ).alias("f")).collect()
    want = _plain_memberships(rows, {r.doc_id for r in labels.collect()}, domains)
    got = mixing.memberships(docs, mixing.fit_domains(docs, labels, domains))
    keys = {bytes(r.rk): r.doc_id for r in docs.select("doc_id", mixing.row_key("doc_id", "text").alias("rk")).collect()}
    for r in got.collect():
        assert r.p == pytest.approx(want[keys[bytes(r.rk)]], abs=1e-9)


def test_rates_are_the_plain_optimum(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([.5, .4, .3, .6], 200)
    m = rng.integers(0, 300, 200)
    members = spark.createDataFrame([(bytes([i]), 1, int(m[i]), p[i].tolist()) for i in range(200)],
                                    "rk binary, rows long, tokens long, p array<double>")
    natural = m @ p
    for targets, ridge in (([1, 1, 1, 1], 1e-5), ([0, 1, 5, 1], 1e-5), ([1, 1, 2, 40], 1e-5), ([3, 1, 1, 1], 1e-2)):
        share = np.array(targets) / sum(targets)
        goal = share * max(n / s for n, s in zip(natural, share) if s)
        rates, reached = mixing.fit_rates(members, list("abcd"), dict(zip("abcd", targets)), ridge=ridge)
        r = np.zeros(200)
        for row in rates.collect():
            r[row.rk[0]] = row.rate
        loss = lambda r: (((m * r) @ p - goal) ** 2 / natural).sum() + ridge * (m * (r - 1) ** 2).sum()
        assert reached == pytest.approx(((m * r) @ p).tolist(), rel=1e-6, abs=1e-6)
        # the conditions of the optimum: no slope where the rate is positive, none below 0 where it is 0
        slope = p @ (2 * (np.array(reached) - goal) / natural) + 2 * ridge * (r - 1)
        on = m > 0
        assert np.abs(slope[on & (r > 0)]).max() < 1e-3 * ridge + 1e-6 and slope[on & (r == 0)].min(initial=0) > -1e-6
        best = loss(r)
        for _ in range(200):  # and no small change does better
            assert loss(np.maximum(0, r + rng.normal(0, .01, 200) * (rng.random(200) < .2))) >= best - 1e-9 * best
        if targets == [1, 1, 1, 1]:
            assert reached == pytest.approx(goal.tolist(), rel=1e-3)


def test_mixing_rows_that_share_id_and_text_and_clashing_names(spark):
    rows = [(1, "alpha beta", "s1", "en"), (1, "alpha beta", "s2", "de"), (2, "gamma", "s2", "de"), (3, "gamma", "s1", None),
            (4, "x", "s1", "")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").select(
        "*", *[F.lit("x").alias(c) for c in ("t_id", "d_id", "r_key", "rk", "meta", "rows", "tokens", "b", "m0", "at", "word")])
    labels = docs.select("doc_id")
    got = mixing.mix(docs, labels)
    assert got.columns == [*docs.columns, "n_tokens", "rate", "copies"] and got.count() == len(rows)
    members = mixing.memberships(docs, mixing.fit_domains(docs, labels, ["s1", "s2"]))
    assert {(r.meta, r.rows) for r in members.collect()} == {('["en"]', 3), ('["de"]', 3), ('[null]', 3), ('[""]', 3)}


def test_more_domains_than_a_literal_could_hold(spark):
    rows = [(i, f"w{i % 300} common", f"s{i % 300:03}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    domains = mixing.domains_of(docs)
    p = mixing.memberships(docs, mixing.fit_domains(docs, docs.select("doc_id"), domains)).collect()
    assert len(domains) == 300 and all(len(r.p) == 300 and abs(sum(r.p) - 1) < 1e-9 for r in p)
