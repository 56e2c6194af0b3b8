"""Role and skill resolution.

Skill signals are classified in a single pass: tier 1 (exact skill name) and
tier 2 (exact alias) are equi-joins on the key; tier 3 (alias occurring inside
the signal) checks each signal against a short alias table as it goes by.  A
longer table is met by an index of one term per alias: the signal's tokens and
four-character pieces are looked up, carrying only ids, and the aliases met are
checked on the signal itself.  Hits and unresolved signals come out of the same
rows.

Alias guard (tier 3): an alias needs a whole-token match when one of its
tokens has at most 3 characters or it is a collision word; otherwise a plain
substring match is enough.  Token characters are letters, digits and ``+ # .``.
A guarded alias made only of token characters matches exactly when it equals
one of the signal's maximal token runs, which stand between single spaces in a
text made once per signal (no regex per alias); other guarded aliases use a
look-around regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.text import SIGNAL_DELIMITERS, normalize_key, strip_ws
from skillgrid.operators.dedup import assert_unique

# --- fixed values -----------------------------------------------------------
COLLISION_WORDS = ("a", "an", "as", "at", "be", "by", "do", "go", "in", "it", "of", "on", "or", "to", "up", "us", "we")
SHORT_ALIAS_TOKEN_LENGTH = 3
TOKEN_CHARS = "A-Za-z0-9+#."
# --- end of fixed values ----------------------------------------------------

NON_TOKEN_RUN = f"[^{TOKEN_CHARS}]+"
_REGEX_SPECIAL = set("\\.^$|?*+()[]{}")


def escape_regex(text: str) -> str:
    """Escape regex metacharacters (valid for Java regex and RE2)."""
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in text)


def boundary_pattern(alias: str) -> str:
    """Java pattern: alias not preceded or followed by a token character."""
    return f"(?<![{TOKEN_CHARS}]){escape_regex(alias)}(?![{TOKEN_CHARS}])"


# ---------------------------------------------------------------- dimensions

def skill_alias_lookup(aliases: DataFrame, skills: DataFrame, check_unique: bool = True) -> DataFrame:
    """Aliases of active skills with their matching rule.

    Columns: normalized_alias, skill_id, skill_name, requires_boundary,
    single_run, pattern.
    """
    lookup = (
        aliases.select(normalize_key(F.coalesce("normalized_alias", "alias")).alias("normalized_alias"), "skill_id")
        .join(skills.where(F.col("is_active")).select("skill_id", F.col("name").alias("skill_name")), "skill_id")
        .where(F.col("normalized_alias") != F.lit(""))
    )
    if check_unique:
        assert_unique(lookup, ["normalized_alias"], "skill alias lookup")
    tokens = F.split(F.col("normalized_alias"), " ")
    guarded = (F.exists(tokens, lambda t: (F.length(t) > 0) & (F.length(t) <= SHORT_ALIAS_TOKEN_LENGTH))
               | F.col("normalized_alias").isin(*COLLISION_WORDS))
    return lookup.select(
        "normalized_alias", "skill_id", "skill_name",
        guarded.alias("requires_boundary"),
        F.col("normalized_alias").rlike(f"^[{TOKEN_CHARS}]+$").alias("single_run"),
        F.concat(F.lit(f"(?<![{TOKEN_CHARS}])"),
                 F.regexp_replace("normalized_alias", r"([\\.^$|?*+()\[\]{}])", r"\\$1"),
                 F.lit(f"(?![{TOKEN_CHARS}])")).alias("pattern"),
    )


def skill_name_lookup(skills: DataFrame) -> DataFrame:
    """Active skills keyed by normalised name; on a key clash the name that sorts
    last wins (S6)."""
    return (
        skills.where(F.col("is_active"))
        .select(normalize_key("name").alias("name_key"), "skill_id", F.col("name").alias("skill_name"))
        .groupBy("name_key")
        .agg(F.max_by(F.struct("skill_id", "skill_name"), F.col("skill_name")).alias("s"))
        .select("name_key", "s.skill_id", "s.skill_name")
    )


def role_alias_lookup(role_aliases: DataFrame) -> DataFrame:
    """normalised alias -> role id (S5); ``reviewed`` is not consulted."""
    return role_aliases.where(F.col("role_id").isNotNull()).select(
        normalize_key(F.coalesce("normalized_alias", "alias")).alias("role_key"), "role_id")


# ---------------------------------------------------------------- roles

def role_hints(rows: DataFrame, *, external_id: str = "external_id", order: str = "source_row_number",
               candidates: tuple[str, ...] = ("role_normalized", "role", "title")) -> DataFrame:
    """Source role hint per external id: first non-empty candidate column; for a
    repeated external id the last row wins (J1)."""
    present = [c for c in candidates if c in rows.columns]
    hint = F.coalesce(*[F.when(F.col(c) != F.lit(""), F.col(c)) for c in present], F.lit(""))
    return rows.groupBy(external_id).agg(F.max_by(hint, F.col(order)).alias("source_role_hint"))


def resolve_roles(postings: DataFrame, role_aliases: DataFrame, *, hint: str = "role_hint") -> DataFrame:
    """Add ``role_key`` and ``role_id`` (null when no alias matches)."""
    lookup = role_alias_lookup(role_aliases)
    return (postings.withColumn("role_key", normalize_key(hint))
            .join(lookup, "role_key", "left"))


def unmatched_examples(resolved: DataFrame, *, hint: str = "role_hint", order: str = "source_row_number",
                       n: int = 5) -> DataFrame:
    """First ``n`` distinct non-blank hints without a role, in input order."""
    ex = strip_ws(F.col(hint))
    return (
        resolved.where(F.col("role_id").isNull() & (ex != F.lit("")))
        .groupBy(ex.alias("example")).agg(F.min(order).alias("first_row"))
        .orderBy("first_row").limit(n)
    )


# ---------------------------------------------------------------- skills

def extract_signals(postings: DataFrame, *, posting: str, text: str) -> DataFrame:
    """Split the raw text on ``[,;\\n]+``; strip; drop blanks.

    Columns: posting, signal_pos (0-based split index), signal_text, signal_key.
    """
    parts = postings.select(posting, F.posexplode(F.split(F.col(text), SIGNAL_DELIMITERS)).alias("signal_pos", "_raw"))
    sig = strip_ws("_raw")
    return (parts.select(posting, "signal_pos", sig.alias("signal_text"))
            .where(F.col("signal_text") != F.lit(""))
            .withColumn("signal_key", normalize_key("signal_text")))


GRAM = 4
# each alias is one more search of every signal, so a longer table goes by the index (where that pays was not measured)
PAIRED_ALIASES = 200
BROADCAST_ALIASES = 50_000  # rows of a few short strings each, some 10 MB
ALIAS_FIELDS = ("normalized_alias", "skill_id", "skill_name", "requires_boundary", "single_run", "pattern")
#: every four characters of a text, overlapping; a look-ahead finds them in one pass over it
_EVERY_GRAM = f"(?s)(?=(.{{{GRAM}}}))"


def _alias_candidates(keys: DataFrame, aliases: DataFrame, small: bool) -> DataFrame:
    """(key_id, found): the aliases that may occur in a key, by an index of one term per alias.

    A guarded alias starts at a token bound, so its term is its first token.
    All words of any other alias have more than three characters, so its term
    is four characters of it, from its longest token on where they fit.  A
    key's terms are its tokens and its runs of four characters; only ids and
    terms leave the key's row.  A ``small`` index is sent to the terms.
    """
    parts = F.filter(F.split("normalized_alias", NON_TOKEN_RUN), lambda t: t != "")
    longest = F.get(F.array_sort(F.transform(parts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), F.lit(0))["t"]
    start = F.least(F.instr("normalized_alias", longest), F.length("normalized_alias") - (GRAM - 1))
    index = aliases.select(
        F.when(F.col("requires_boundary"), F.get(parts, F.lit(0)))
        .otherwise(F.substring("normalized_alias", start, F.lit(GRAM))).alias("_term"),
        F.struct(*ALIAS_FIELDS).alias("_alias"))
    terms = keys.select("key_id", F.explode(F.concat(
        F.split("signal_key", NON_TOKEN_RUN),
        F.regexp_extract_all("signal_key", F.lit(_EVERY_GRAM), F.lit(1)))).alias("_term"))
    # Spark's estimate of the terms is that of the text before it is exploded, so it would broadcast them
    # rather than the index; an index counted to be small is sent, a larger one meets the terms by a shuffle
    index = F.broadcast(index) if small else index.hint("merge")
    return terms.join(index, "_term").groupBy("key_id").agg(F.collect_set("_alias").alias("found"))


def _token_runs(key: Column) -> Column:
    """The key's maximal token runs, each between single spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(key, NON_TOKEN_RUN, " "), F.lit(" "))


def _contained(key: Column, runs: Column, alias: Column) -> Column:
    """The alias occurs in the key, at token bounds if its guard asks for that."""
    name = alias["normalized_alias"]
    whole = alias["requires_boundary"] & alias["single_run"]
    return F.when(whole, F.contains(runs, F.concat(F.lit(" "), name, F.lit(" ")))).otherwise(
        F.contains(key, name) & (~alias["requires_boundary"] | F.regexp_like(key, alias["pattern"])))


def contained_aliases(signals: DataFrame, aliases: DataFrame, *, among: Column | None = None) -> DataFrame:
    """``signals`` with a row for each alias contained in its key (J4), as the struct ``t3``; null without any.

    Only signals that meet the condition ``among`` are looked at.  An alias
    without any token character matches nothing.
    """
    in_words = aliases.where(F.regexp_like("normalized_alias", F.lit(f"[{TOKEN_CHARS}]")))
    n = in_words.limit(BROADCAST_ALIASES + 1).count()
    if n <= PAIRED_ALIASES:
        return _contained_in_pairs(signals, in_words, among)
    return _contained_by_index(signals, in_words, among, small=n <= BROADCAST_ALIASES)


def _contained_in_pairs(signals: DataFrame, aliases: DataFrame, among: Column | None) -> DataFrame:
    """Every signal checked against every alias of a short table, in the signal's own row: no shuffle."""
    looked_at = F.lit(True) if among is None else among
    with_runs = signals.withColumn("_runs", F.when(looked_at, _token_runs(F.col("signal_key"))))
    table = aliases.select(F.struct(*ALIAS_FIELDS).alias("t3")).distinct()
    found = F.col("_runs").isNotNull() & _contained(F.col("signal_key"), F.col("_runs"), F.col("t3"))
    return with_runs.join(F.broadcast(table), found, "left").drop("_runs")


def _contained_by_index(signals: DataFrame, aliases: DataFrame, among: Column | None, small: bool) -> DataFrame:
    """Candidates meet the signals by a 64-bit id of the key and are checked on
    the key itself, so keys that share an id do no harm."""
    key, key_id = F.col("signal_key"), F.xxhash64("signal_key")
    with_id = signals.withColumn("key_id", key_id if among is None else F.when(among, key_id))
    found = _alias_candidates(with_id.where(F.col("key_id").isNotNull()).select("key_id", "signal_key"), aliases, small)
    # the runs are the one element of an array, so they are made once for a signal and not for each alias
    checked = F.flatten(F.transform(F.array(_token_runs(key)), lambda runs: F.filter(
        F.col("found"), lambda a: _contained(key, runs, a))))
    return (with_id.join(found, "key_id", "left")
            .withColumn("t3", F.explode_outer(F.when(F.col("found").isNotNull(), checked)))
            .drop("key_id", "found"))


def classify_signals(signals: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tiered match of every signal.

    One output row per hit; a signal without any hit keeps one row with null
    ``skill_id`` and ``match_type``.  ``match_key`` is the name or alias that
    matched (tier-3 hits are ordered by it).
    """
    t1 = names.select(F.col("name_key").alias("signal_key"),
                      F.col("skill_id").alias("t1_skill"), F.col("skill_name").alias("t1_name"))
    t2 = aliases.select(F.col("normalized_alias").alias("signal_key"),
                        F.col("skill_id").alias("t2_skill"), F.col("skill_name").alias("t2_name"))
    staged = signals.join(t1, "signal_key", "left").join(t2, "signal_key", "left")
    joined = contained_aliases(staged, aliases, among=F.col("t1_skill").isNull() & F.col("t2_skill").isNull())
    keep = [c for c in signals.columns]
    return joined.select(
        *keep,
        F.coalesce("t1_skill", "t2_skill", "t3.skill_id").alias("skill_id"),
        F.coalesce("t1_name", "t2_name", "t3.skill_name").alias("skill_name"),
        F.when(F.col("t1_skill").isNotNull(), F.lit("exact"))
        .when(F.col("t2_skill").isNotNull() | F.col("t3").isNotNull(), F.lit("alias")).alias("match_type"),
        F.when(F.col("t1_skill").isNotNull(), F.col("signal_key"))
        .when(F.col("t2_skill").isNotNull(), F.col("signal_key"))
        .otherwise(F.col("t3.normalized_alias")).alias("match_key"),
    )


def skill_hits(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("match_type").isNotNull())


def unresolved_signals(classified: DataFrame) -> DataFrame:
    """Signals no tier matched."""
    return classified.where(F.col("match_type").isNull()).drop("skill_id", "skill_name", "match_type", "match_key")


def first_hit_per_skill(hits: DataFrame, *, posting: str) -> DataFrame:
    """Keep the first hit of each skill within a posting, by (signal position,
    matched key) (W2).  An aggregate, so a huge posting is combined map-side."""
    s = F.min_by(F.struct("signal_pos", "match_key", "match_type", "signal_text", "skill_name"),
                 F.struct("signal_pos", "match_key"))
    return (hits.groupBy(posting, "skill_id").agg(s.alias("_f"))
            .select(posting, "skill_id", "_f.skill_name", "_f.signal_pos", "_f.signal_text",
                    "_f.match_key", "_f.match_type"))


def map_skills(postings: DataFrame, skills: DataFrame, aliases: DataFrame, *, posting: str,
               text: str) -> tuple[DataFrame, DataFrame]:
    """(hits kept once per posting and skill, unresolved signals) for postings."""
    names = skill_name_lookup(skills)
    lookup = skill_alias_lookup(aliases, skills)
    classified = classify_signals(extract_signals(postings, posting=posting, text=text), names, lookup)
    return first_hit_per_skill(skill_hits(classified), posting=posting), unresolved_signals(classified)


def hits_in_row_order(first_hits: DataFrame, *, posting: str) -> DataFrame:
    """Order hits as the reference lists them; ordering happens only at the
    reporting edge, never inside an operator (W8)."""
    return first_hits.orderBy(posting, "signal_pos", "match_key")
