"""Archives, pseudonyms and the classifier on small fixtures."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import factorisation, pseudonyms, warc
from skillgrid.llm.common import read
from tests.conftest import SF


def _pages():
    big, other = "<p>é" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n</p>", "y" * 1000
    rows = [(1, "http://www.a.example/p?q=1", big), (7, "https://a.example:443/p", big), (3, "http://b.example/ x", big),
            (4, "http://b.example/z", other), (9, "http://b.example/z", other), (5, "http://c.example", "short"),
            (6, "http://c.example", "short"), (8, None, None), (10, "bad\r\nurl", ""), (9, "http://b.example/z", other),
            (11, "http://[broken", "w" * 999), (12, "", "w" * 999), (None, "http://n.example/", other)]
    return rows + [(100 + i, "http://hot.example/", "z" * 1000) for i in range(60)]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_RANGE", 9)
    monkeypatch.setattr(warc, "PIECE", 4)
    rows = _pages()
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, keeper string").repartition(4)
    got = warc.archive_and_index(pages, time=F.timestamp_seconds(F.col("page_id") % 5), records_per_file=7).collect()
    assert len(got) == len(rows) and len({r.archive for r in got}) > 4 and len({r["range"] for r in got}) > 3
    keeper: dict = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000 and p is not None:
            keeper[h] = max(keeper.get(h, p), p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        k = keeper.get(h)
        again = k is not None and p is not None and p < k
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", k if again else None))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(
        want, key=key)
    order = [(r.url_key, r.timestamp) for r in sorted(got, key=lambda r: (r["range"], r.place))]
    assert order == sorted(order)
    assert warc.archive_and_index(pages.limit(0), time=F.current_timestamp()).count() == 0


def test_url_key():
    assert warc.url_key("http://www.A.Example:80/p?q=1#f") == warc.url_key("https://a.example:443/p?q=1") == "example,a)/p?q=1"
    assert warc.url_key("http://a.example:8080") == "example,a:8080)/"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(bytes([rng.randrange(97, 100)]) * rng.randrange(1, 4) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def _luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        v = int(x) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(189 * 7).select(pseudonyms.feistel(
        F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(189), F.lit(7), "k", "t", F.lit(3)).alias("p"))
    got = {(r.p.x, r.p.y) for r in pairs.collect()}
    assert got == {(x, y) for x in range(189) for y in range(7)}
    digits = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "d").alias("p"))
    assert sorted(r.p for r in digits.collect()) == [f"{i:03d}" for i in range(1000)]


def test_values_keep_their_form(spark):
    good = "4845168114407329"
    texts = [f"card {good}, again {good} {good[:4]}-{good[4:8]}-{good[8:12]}-{good[12:]}", f"other {good[:-1]}{(int(good[-1]) + 1) % 10}",
             "call +1 (017) 555-7713", "ip 97.51.17.173. and 1.2.3.400 v1.2.3", "ssn 123-45-6789 not 000-12-3456 666-12-3456",
             "on 1999-12-31 or 12/31/1999 or 31.12.1999; 2001-02-30 no", "mail a.b@x.example.com", None, "", "no digits", "é" * 9000 + good]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, key="k").collect()}
    a = got[0].text.replace(",", "").split()
    assert a[1] == a[3] == a[4].replace("-", "") != good and _luhn(a[1]) and got[0].n_values == 3
    assert got[10].text == "é" * 9000 + good or got[10].text.endswith(a[1])
    assert got[1].text == texts[1] and got[1].n_values == 0
    assert got[2].text.startswith("call +1 (") and got[2].text != texts[2]
    assert "97.51.17.173" not in got[3].text and got[3].text.endswith("and 1.2.3.400 v1.2.3")
    assert "123-45-6789" not in got[4].text and got[4].text.endswith("not 000-12-3456 666-12-3456")
    d = got[5].text.replace(";", "").split()
    day = dt.date.fromisoformat(d[1])
    assert d[3] == day.strftime("%m/%d/%Y") and d[5] == day.strftime("%d.%m.%Y") and day != dt.date(1999, 12, 31)
    assert d[6] == "2001-02-30"
    assert "x.example.com" not in got[6].text and "@" in got[6].text
    assert got[7].text == "" and got[8].text == "" and got[9].text == "no digits" and got[9].row == "n"
    other = pseudonyms.pseudonymise(df, key="another").where("doc_id = 0").first()
    assert other.text != got[0].text
    assert pseudonyms.pseudonymise(df.limit(0), key="k").count() == 0


def test_pairwise_part_is_exact():
    rng = np.random.default_rng(3)
    fm = factorisation.FactorisationMachine(0.3, rng.normal(size=factorisation.DIMS), rng.normal(size=(factorisation.DIMS, 4)))
    at, x = rng.choice(factorisation.DIMS, 12, replace=False), rng.normal(size=12)
    want = 0.3 + (fm.weights[at] * x).sum() + sum(
        (fm.factors[at[i]] @ fm.factors[at[j]]) * x[i] * x[j] for i in range(12) for j in range(i))
    assert fm.logits(at, x, np.array([0]))[0] == pytest.approx(want)


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    from skillgrid.llm import queries
    rows = queries.op10_quality_fm(spark, sf).join(read(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert sum(r.predicted for r in held if r.quality == 1) / sum(r.quality for r in held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "s"), (2, "", 0, "s"), (3, "a b c\n" * 3000, 5, "s"), (3, "a", 1, "s"), (None, "b", 1, "s")],
                                 "doc_id long, text string, n_chars long, score string")
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id long, quality int")
    model = factorisation.train(docs, one)
    got = factorisation.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert factorisation.score(docs.limit(0), model).count() == 0
    assert factorisation.train(docs, one.limit(0)).bias == 0.0
