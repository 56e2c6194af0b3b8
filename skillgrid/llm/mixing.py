"""Mixing a corpus to target domain weights, in DataFrame functions only.

A classifier, fitted on the documents of the label table, gives each document
a soft membership in the domains, from the hashed words of its whole text and
its metadata; the stated domain is what it is taught, never what it is shown.
The model is a table of one row for each bucket, with a weight for each domain;
words meet it in a join, and a document's sums leave the task as one row.

Document rates r >= 0 are then fitted by projected gradient steps, so that the
expected domain totals ``E_d = sum_i r_i tokens_i p_id`` meet the targets
``T_d`` in least squares, each domain's error taken relative to its size.
``RIDGE`` times the squared distance from rate 1 is added, so that of the many
rates that meet the targets the fit takes those nearest to 1.  A step needs, for
each domain, the total and its products with the others: one aggregation over
the corpus, with a row of one number per domain in reply.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm.common import WORD, materialize, row_key, text_of

BUCKETS = 8192  # hashed words and metadata values
MAX_TRAIN = 20_000
HELD_OUT = 5  # every so many training documents only tell the weight of the words
WEIGHTS = (*(2.0 ** -i for i in range(13)), 0.0)  # tried for the words; 1 is plain naive Bayes
RIDGE = 1e-5
BROADCAST_MODEL = 64 << 20  # bytes of the model up to which it is broadcast, else both sides are shuffled


def _bucket(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(BUCKETS)).cast("int")


def _shown(docs: DataFrame, meta_cols: tuple[str, ...], domain_col: str) -> list[str]:
    return [c for c in meta_cols if c in docs.columns and c != domain_col]


def _meta(cols: list[str]) -> Column:
    """The shown metadata as one value; a missing one differs from an empty one."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in cols])) if cols else F.lit("")


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(text_of(text_col), F.lit(f"({WORD})"), 1)


def _fields(cols: list[str]) -> Column:
    """The bucket of each shown metadata value; a missing value is a value of its own."""
    return F.array(*[_bucket(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in cols]).cast("array<int>")


def _exploded(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(keys, b, is_row, is_word): the features of ``rows`` (keys, fields, w); each row has a line more, without bucket."""
    null = F.lit(None).cast("string")
    marks = rows.select(*keys, F.size("fields").alias("n"), "fields",
                        F.posexplode(F.concat(F.array(null), F.transform("fields", lambda _: null), "w")).alias("at", "word"))
    bucket = F.when(F.col("at") > F.col("n"), _bucket(F.col("word"))).otherwise(F.get("fields", F.col("at") - 1))
    return marks.select(*keys, bucket.alias("b"), (F.col("at") == 0).cast("long").alias("is_row"),
                        (F.col("at") > F.col("n")).cast("long").alias("is_word"))


def _model_table(spark: SparkSession, model: np.ndarray) -> DataFrame:
    """(m_b, m0, m1, ...): the weights of each bucket for each domain."""
    cols = ", ".join(f"m{i} double" for i in range(len(model)))
    rows = [(b, *w) for b, w in enumerate(model[:, 1:].T.tolist())]
    return materialize(spark, spark.createDataFrame(rows, f"m_b int, {cols}"), "mixing_model")


def _logits(rows: DataFrame, keys: list[str], model: np.ndarray) -> DataFrame:
    """(keys, rows, tokens, z): sums of the weights of all features of equal keys, for one row, and its prior."""
    k = len(model)
    table = _model_table(rows.sparkSession, model)
    table = F.broadcast(table) if 8 * model.size <= BROADCAST_MODEL else table.hint("shuffle_hash")
    found = _exploded(rows, keys).join(table, F.col("b") == F.col("m_b"), "left")
    sums = found.groupBy(*keys).agg(F.sum("is_row").alias("rows"), F.sum("is_word").alias("words"),
                                    *[F.sum(f"m{i}").alias(f"z{i}") for i in range(k)])
    z = [F.lit(float(model[i, 0])) + F.coalesce(F.col(f"z{i}"), F.lit(0.0)) / F.col("rows") for i in range(k)]
    return sums.select(*keys, "rows", F.expr("words div rows").alias("tokens"), F.array(*z).alias("z"))


def domains_of(docs: DataFrame, domain_col: str = "source") -> list[str]:
    """The stated domains, in order.  Each is a column of the plans that follow, so hundreds will do."""
    return sorted(r[0] for r in docs.select(F.col(f"`{domain_col}`").cast("string")).where(
        F.col(f"`{domain_col}`").isNotNull()).distinct().collect())


def _model(docs_in: np.ndarray, counts: np.ndarray, alpha: float, weight: float = 1.0) -> np.ndarray:
    """Per domain the log prior, then ``weight`` times the log ratio of each bucket to all domains together.

    A domain's multinomial is smoothed towards that of all, so what it has not been seen with says little.
    """
    k, mass = len(docs_in), alpha * BUCKETS
    every = alpha + counts.sum(axis=0)
    share = every / every.sum()
    ratio = np.log((counts + mass * share) / (counts.sum(axis=1, keepdims=True) + mass)) - np.log(share)
    prior = np.log((docs_in + alpha) / (docs_in.sum() + alpha * k))
    return np.concatenate([prior[:, None], weight * ratio], axis=1)


def _word_weight(domain: np.ndarray, logits: np.ndarray, priors: np.ndarray) -> float:
    """That of ``WEIGHTS`` under which the held-out documents are likeliest; without any, the first."""
    def fit(weight: float) -> float:
        x = priors + weight * (logits - priors)
        top = x.max(axis=1, keepdims=True)
        return float((x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[np.arange(len(domain)), domain].sum())

    return max(WEIGHTS, key=fit) if len(domain) else WEIGHTS[0]


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], *, max_train: int = MAX_TRAIN, alpha: float = 0.5,
                id_col: str = "doc_id", text_col: str = "text", domain_col: str = "source",
                meta_cols: tuple[str, ...] = ("lang",)) -> np.ndarray:
    """Naive Bayes model: per domain the log prior, then a weight for each bucket of words and metadata.

    Learned from the documents of the label table with a stated domain, one
    for each id and at most ``max_train`` of them (a documented bound; the ids
    of smallest hash, of rows with equal ids the least).
    Words of one text are not independent, so their sum is tempered by one
    factor, the one that makes documents held out of the counts likeliest: 0
    if the words do not tell the domains apart.  The counts (domains x buckets)
    and the logits of the held-out documents come to the driver.
    """
    spark, k = docs.sparkSession, len(domains)
    if not k:
        return np.zeros((0, 1 + BUCKETS))
    ids = (labels.select(F.col(f"`{id_col}`").alias("t_id")).where(F.col("t_id").isNotNull()).distinct()
           .orderBy(F.xxhash64("t_id"), "t_id").limit(max_train))
    shown = _shown(docs, meta_cols, domain_col)
    place = spark.createDataFrame([(d, i) for i, d in enumerate(domains)], "d_name string, domain int")
    # equal texts are on one side, else the held-out ones would be known
    side = F.pmod(F.xxhash64(F.lit("side"), text_of(text_col)), F.lit(HELD_OUT)) == 0
    mine = docs.select(F.col(f"`{id_col}`").alias("d_id"), F.col(f"`{domain_col}`").cast("string").alias("name"),
                       side.alias("held"), _fields(shown).alias("fields"), text_of(text_col).alias("body"))
    mine = mine.join(F.broadcast(ids), F.col("d_id") == F.col("t_id"), "left_semi").join(
        F.broadcast(place), F.col("name") == F.col("d_name"))
    one = mine.groupBy("d_id").agg(F.min(F.struct("domain", "held", "fields", "body")).alias("r")).select("d_id", "r.*")
    rows = materialize(spark, one.select("d_id", "domain", "held", "fields", _words("body").alias("w")), "domain_features")
    docs_in, counts = np.zeros((2, k)), np.zeros((2, k, BUCKETS))
    for held, domain, n in rows.groupBy("held", "domain").count().collect():
        docs_in[int(held), domain] = n
    seen = _exploded(rows, ["held", "domain"]).where(F.col("b").isNotNull()).groupBy("held", "domain", "b").agg(
        F.count(F.lit(1)).alias("n"))
    lists = seen.groupBy("held", "domain").agg(F.collect_list(F.struct("b", "n")).alias("l")).select(
        "held", "domain", F.col("l.b").alias("b"), F.col("l.n").alias("n"))
    for held, domain, b, n in lists.toLocalIterator():
        counts[int(held), domain, b] = n
    model = _model(docs_in[0], counts[0], alpha)
    held_rows = [(r.domain, r.z) for r in _logits(rows.where("held"), ["d_id", "domain"], model).collect()]
    weight = _word_weight(np.array([d for d, _ in held_rows], int), np.array([z for _, z in held_rows]).reshape(-1, k),
                          model[:, 0])
    return _model(docs_in.sum(axis=0), counts.sum(axis=0), alpha, weight)


def memberships(docs: DataFrame, model: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text",
                domain_col: str = "source", meta_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(rk, meta, rows, tokens, p): membership of each distinct document row, ``p`` an array in domain order.

    ``rk`` stands for id and text, ``meta`` for the shown metadata.  ``rows`` is
    how often the row occurs, ``tokens`` the words of one copy.
    Every word of the text counts; the stated domain in ``domain_col`` does not.
    """
    shown = _shown(docs, meta_cols, domain_col)
    rows = docs.select(row_key(id_col, text_col).alias("rk"), _meta(shown).alias("meta"), _fields(shown).alias("fields"),
                       _words(text_col).alias("w"))
    z = _logits(rows, ["rk", "meta"], np.asarray(model))
    e = z.select("rk", "meta", "rows", "tokens", "z", F.array_max("z").alias("top")).select(
        "rk", "meta", "rows", "tokens", F.transform("z", lambda x: F.exp(x - F.col("top"))).alias("e"))
    norm = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return e.select("rk", "meta", "rows", "tokens", "e", norm.alias("n")).select(
        "rk", "meta", "rows", "tokens", F.transform("e", lambda x: x / F.col("n")).alias("p"))


def _rate(prices: np.ndarray) -> Column:
    """Rate of a document at given domain prices: 1 and the mean price of its domains, not below 0."""
    price = F.array(*[F.lit(float(x)) for x in prices])
    return F.greatest(F.lit(0.0), F.lit(1.0) + F.aggregate(
        F.zip_with("p", price, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x))


def _answer(members: DataFrame, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(domain totals, their products among documents of positive rate, sum of mass x rate squared)."""
    k = len(prices)
    rows = members.select((F.col("rows") * F.col("tokens")).cast("double").alias("m"), "p", _rate(prices).alias("r"))
    each = rows.where("m > 0").select("m", "p", "r", F.posexplode("p").alias("i", "pi"))
    on = F.when(F.col("r") > 0, F.col("m") * F.col("pi")).otherwise(0.0)
    sums = each.select("i", "p", "m", "r", (F.col("m") * F.col("r") * F.col("pi")).alias("t"), on.alias("on")).groupBy("i").agg(
        F.sum("t").alias("t"), F.sum(F.when(F.col("i") == 0, F.col("m") * F.col("r") * F.col("r"))).alias("s"),
        *[F.sum(F.col("on") * F.col("p")[j]).alias(f"j{j}") for j in range(k)]).collect()
    total, products, square = np.zeros(k), np.zeros((k, k)), 0.0
    for r in sums:
        total[r.i], products[r.i] = r.t, [r[f"j{j}"] for j in range(k)]
        square += r.s or 0.0
    return total, products, square


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], *, budget: float | None = None,
              ridge: float = RIDGE, tolerance: float = 1e-5) -> tuple[DataFrame, list[float]]:
    """(members with ``rate``, expected totals reached).

    ``targets`` are domain weights (missing: 0).  Without ``budget`` (tokens of
    the whole mix), it is the smallest at which no domain has to shrink.  The
    rates minimise ``sum_d (E_d - T_d)^2 / S_d + ridge * sum_i tokens_i (r_i - 1)^2``
    over r >= 0, with the natural totals S.  There the rates are the
    projection ``max(0, 1 + sum_d p_id x_d)`` of a move along domain prices x.
    Each step moves the prices against the gradient ``E - T + ridge S x``, scaled
    by the k x k products of the memberships of the documents of positive rate,
    and is halved until it lowers the objective.  Steps go on until the gradient
    is within ``tolerance`` of each domain's size, or no step lowers the objective
    any more; their number is not limited.
    """
    k = len(domains)
    weight = sum(max(0.0, targets.get(d, 0.0)) for d in domains)
    if not k or weight <= 0:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * k
    share = np.array([max(0.0, targets.get(d, 0.0)) / weight for d in domains])
    x = np.zeros(k)
    total, products, square = _answer(members, x)
    natural = total.copy()
    scale = budget if budget is not None else max((n / s for n, s in zip(natural, share) if s > 0), default=0.0)
    goal = scale * share
    size = np.maximum(natural, 1e-9 * max(natural.sum(), 1.0))

    def objective(x: np.ndarray, square: float) -> float:  # the dual one, to be lowered
        return square / 2 + ridge * float((size * x * x).sum()) / 2 - float(x @ goal)

    now = objective(x, square)
    while natural.sum() > 0:
        gradient = total - goal + ridge * size * x
        if np.abs(gradient / size).max() <= tolerance:
            break
        move = -np.linalg.solve(products + ridge * np.diag(size), gradient)
        slope, length = float(gradient @ move), 1.0
        while True:
            tried = x + length * move
            total2, products2, square2 = _answer(members, tried)
            after = objective(tried, square2)
            if after <= now + 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        if not after < now - 1e-12 * abs(now):
            break  # no step lowers it: as near as the numbers allow
        x, total, products, now = tried, total2, products2, after
    return members.withColumn("rate", _rate(x)).select(
        *[c for c in ("rk", "meta") if c in members.columns], "rows", "tokens", "rate"), total.tolist()


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] | None = None, budget: float | None = None,
        ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "source",
        keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) with ``n_tokens``, ``rate`` and ``copies``.

    ``targets`` default to equal weights of the stated domains.  A greater
    ``ridge`` keeps more documents and misses targets that only few documents
    could meet.  ``copies`` is
    the rate rounded up or down by a hash of the row, at least 1 where the rate
    is positive; documents of rate 0 stay in the result with 0 copies.  A
    document without domain is placed by its words and other metadata; one
    without words has 0 tokens and moves no total.  Repeated rows have equal
    rates.  Without any domain every rate is 1.
    """
    spark = docs.sparkSession
    domains = domains_of(docs, domain_col)
    if targets is not None:
        domains = sorted(set(domains) | set(targets))
    names = dict(id_col=id_col, text_col=text_col, domain_col=domain_col)
    model = fit_domains(docs, labels, domains, **names)
    if not domains:
        model = np.zeros((1, 1 + BUCKETS))
    members = materialize(spark, memberships(docs, model, **names), "memberships")
    rates, _ = fit_rates(members, domains, targets or {d: 1.0 for d in domains}, budget=budget,
                         ridge=ridge)
    u = F.pmod(F.xxhash64("rk"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.when(F.col("rate") > 0, F.greatest(F.lit(1), F.floor(F.col("rate") + u))).otherwise(0).cast("long")
    rates = materialize(spark, rates.select(F.col("rk").alias("r_key"), F.col("meta").alias("r_meta"), "tokens", "rate",
                                            copies.alias("copies")), "copies")
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_tokens", "rate", "copies")]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), row_key(id_col, text_col).alias("rk"),
                       _meta(_shown(docs, ("lang",), domain_col)).alias("meta"))
    return left.join(rates.hint("shuffle_hash"), (F.col("rk") == F.col("r_key")) & (F.col("meta") == F.col("r_meta"))).select(
        *[F.col("row")[c].alias(c) for c in cols], F.col("tokens").alias("n_tokens"), "rate", "copies")
