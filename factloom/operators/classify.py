"""Rules over texts: tags with context, votes, signals, rhetoric, negation, references, terms.

Rules are parameters. A text is put in lower case once; whatever many patterns
look for is looked for in that column. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scores import calibrated
from factloom.operators.relational import top_per


def lowered(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, ..., t): the text in lower case with a space at either end."""
    return docs.withColumn("t", F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")))


def pattern_found(p: str, t: str = "t") -> Column:
    """A phrase, a word with digits or one of five letters or more anywhere; one of two letters as a word, of up to four at a word's beginning."""
    if " " in p or any(c.isdigit() for c in p) or len(p) > 4:
        return F.contains(t, F.lit(p))
    return F.col(t).rlike(rf"[^\p{{L}}\p{{N}}_]{p}" + (r"[^\p{L}\p{N}_]" if len(p) <= 2 else ""))


def pattern_sql(p: str) -> str:
    """The same for DuckDB."""
    if " " in p or any(c.isdigit() for c in p) or len(p) > 4:
        return f"contains(t, '{p}')"
    return f"regexp_matches(t, '[^\\p{{L}}\\p{{N}}_]{p}" + (r"[^\p{L}\p{N}_]" if len(p) <= 2 else "") + "')"


Rules = Sequence[tuple[str, Sequence[tuple[str, float]], float]]


def _points(patterns: Sequence[tuple[str, float]]) -> Column:
    return sum((F.when(pattern_found(p), x).otherwise(0.0) for p, x in patterns), F.lit(0.0))


def context_scores(docs: DataFrame, rules: Rules, context: Sequence[str], boosts: Sequence[tuple[str, Sequence[str], float, bool]]) -> DataFrame:
    """(id, tag, score): rule scores that reach their threshold, raised by boosts after it.

    A boost (tag, patterns, points, needs context) adds its points for each
    pattern found, where needed only if one of ``context`` is found too; it may
    make a tag that no rule made.
    """
    d = lowered(docs)
    has = F.lit(False)
    for c in context:
        has = has | pattern_found(c)
    base = [F.struct(F.lit(t).alias("tag"), F.when(_points(p) >= least, _points(p)).otherwise(0.0).alias("score")) for t, p, least in rules]
    more = [F.struct(F.lit(t).alias("tag"), (F.when(has, 1.0).otherwise(0.0) * _points([(p, x) for p in ps]) if needs else _points([(p, x) for p in ps])).alias("score")) for t, ps, x, needs in boosts]
    s = d.select("id", F.inline(F.array(*base, *more))).filter("score > 0")
    return s.groupBy("id", "tag").agg(F.sum("score").alias("score"))


def granular_tags(docs: DataFrame, registry: Sequence[tuple[str, str, Sequence[str]]], most: dict[str, int]) -> DataFrame:
    """(id, kind, tag): tags (kind, tag, patterns) found, in the registry's order, of each kind so many as ``most`` says."""
    found = F.array_compact(F.array(*[F.when(_any(ps), F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag"))) for kind, tag, ps in registry]))

    def first(kind: str, n: int) -> Column:
        return F.slice(F.filter("f", lambda x: x["kind"] == kind), 1, n)

    kinds = [first(k, n) for k, n in most.items()]
    return lowered(docs).select("id", found.alias("f")).select("id", F.inline(F.flatten(F.array(*kinds))))


def _any(patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | pattern_found(p)
    return out


def guarded_votes(votes: DataFrame, strict: Sequence[str], generic: Sequence[str]) -> DataFrame:
    """Adds ``vote`` to (id, tag, kind, confidence, has_context): a generic tag on an item of a strict kind without context abstains."""
    guard = F.col("tag").isin(*generic) & F.coalesce(F.col("kind").isin(*strict), F.lit(False)) & ~F.col("has_context")
    return votes.withColumn("vote", F.when(guard, "abstain").otherwise("support"))


def final_tags(votes: DataFrame) -> DataFrame:
    """(id, tag, confidence, votes): the mean confidence of the votes in support, calibrated by their number."""
    g = votes.filter("vote = 'support'").groupBy("id", "tag").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("votes"))
    return g.select("id", "tag", calibrated(F.col("c"), F.col("votes")).alias("confidence"), "votes")


def without_generic(tags: DataFrame, items: DataFrame, strict: Sequence[str], generic: Sequence[str]) -> DataFrame:
    """Tags without generic ones on items of strict kinds."""
    bad = items.filter(F.col("content_type").isin(*strict)).select("id")
    return tags.join(bad.withColumn("_bad", F.lit(True)), "id", "left").filter(~(F.coalesce("_bad", F.lit(False)) & F.col("tag").isin(*generic))).drop("_bad")


def signals(docs: DataFrame, rules: Sequence[tuple[str, Sequence[tuple[str, float]]]], least: float = 3.5) -> DataFrame:
    """(id, total, categories): the points of all categories, and those of ``least`` points or more by name."""
    scored = [F.struct(F.lit(name).alias("name"), _points(ps).alias("score")) for name, ps in rules]
    d = lowered(docs).select("id", F.array(*scored).alias("s"))
    total = F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"]), 2)
    names = F.transform(F.filter("s", lambda x: x["score"] >= least), lambda x: x["name"])
    return d.select("id", total.alias("total"), F.array_join(F.array_sort(names), ",").alias("categories"))


def profile(signalled: DataFrame, threshold: Column) -> DataFrame:
    """Adds ``flagged``: the total reaches the source's threshold and some category stands."""
    return signalled.withColumn("flagged", (F.col("total") >= threshold) & (F.col("categories") != ""))


def informative(claims: DataFrame, context: str, needs_context: Sequence[str], low: str) -> DataFrame:
    """Claims (id, claim_text, claim_type) that tell something: 18 characters and three words or more, no low signal, and context where their type needs it."""
    t = F.trim(F.regexp_replace(F.coalesce("claim_text", F.lit("")), r"\s+", " "))
    d = claims.withColumn("_t", t).withColumn("_w", F.size(F.regexp_extract_all("_t", F.lit(r"([\p{L}\p{N}_-]+)"), 1)))
    has = F.col("_t").rlike(context)
    ok = (F.length("_t") >= 18) & (F.col("_w") >= 3) & ~F.lower("_t").rlike(low) & (~F.col("claim_type").isin(*needs_context) | has)
    return d.filter(ok).drop("_t", "_w")


def rhetoric_classes(docs: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, class): classes whose pattern the text in lower case has."""
    found = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(name)) for name, p in patterns]))
    return lowered(docs).select("id", F.explode(found).alias("class"))


def negations(docs: DataFrame, keyword: str, negators: Sequence[str], window: int = 40, gap: int = 8) -> DataFrame:
    """(id, hits, negated): how often the keyword (a pattern) stands in the text, and how often a negator stands at most ``gap`` characters before it.

    Every place counts, not the first alone; a negator is looked for in the ``window`` characters before.
    """
    any_of = "|".join(negators)
    d = lowered(docs)
    hits = F.size(F.regexp_extract_all("t", F.lit(f"({keyword})"), 1))
    near = F.size(F.regexp_extract_all("t", F.lit(rf"(?s)({any_of}).{{0,{min(gap, window)}}}?(?:{keyword})"), 1))
    return d.select("id", hits.alias("hits"), near.alias("negated"))


def negated_claims(claims: DataFrame, texts: DataFrame, negators: dict[str, str], rebuttals: str) -> DataFrame:
    """(id, outcome, status, risk): claims whose item's text negates their type (pattern by type) or rebuts.

    A negated open claim becomes likely_false with .3 more risk; a rebuttal alone adds .2.
    """
    x = claims.join(lowered(texts).select(F.col("id").alias("content_item_id"), "t"), "content_item_id")
    neg = F.lit(False)
    for kind, p in negators.items():
        neg = F.when(F.col("claim_type") == kind, F.col("t").rlike(p)).otherwise(neg)
    outcome = F.when(neg, "negated").when(F.col("t").rlike(rebuttals), "rebutted")
    d = x.select("id", "status", outcome.alias("outcome")).filter("outcome is not null")
    status = F.when((F.col("outcome") == "negated") & F.col("status").isin("unverified", "likely_false"), "likely_false").otherwise(F.col("status"))
    return d.select("id", "outcome", status.alias("status"), F.when(F.col("outcome") == "negated", 0.3).otherwise(0.2).alias("risk"))


def references(docs: DataFrame, patterns: Sequence[tuple[str, str]], before: int = 60, after: int = 40) -> DataFrame:
    """(id, kind, number, context): what each pattern's group finds, each number once a kind and text, with the characters around its first place."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    d = docs.select("id", t.alias("t"))

    def found(kind: str, p: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(p), 1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("number")))

    x = d.select("id", "t", F.inline(F.flatten(F.array(*[found(k, p) for k, p in patterns]))))
    at = F.instr("t", F.col("number"))
    start = F.greatest(F.lit(1), at - before)
    return x.select("id", "kind", "number", F.substr("t", start, at - start + F.length("number") + after).alias("context"))


def search_terms(docs: DataFrame, patterns: Sequence[str], stop: Sequence[str] = (), most: int = 8, least: int = 4) -> DataFrame:
    """(id, terms): what the patterns' groups find, in their order, without repeats by case, short ones and stop words; the first ``most`` joined by a bar."""
    t = F.coalesce("text", F.lit(""))
    all_ = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 1) for p in patterns]))
    clean = F.filter(F.transform(all_, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= least)
    if stop:
        clean = F.filter(clean, lambda x: ~F.lower(x).isin(*stop))
    d = docs.select("id", clean.alias("c"))
    first = F.filter("c", lambda x, i: F.array_position(F.transform("c", lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return d.select("id", F.array_join(F.slice(first, 1, most), "|").alias("terms"))


def roles_stated(docs: DataFrame, patterns: Sequence[tuple[str, str]], entities: DataFrame) -> DataFrame:
    """(id, role, name, entity_id): people that a text names with a role (pattern with one group), and the entity whose name begins so, where one alone does.

    ``entities`` (id, name). An equality join on the first two words of the name.
    """
    t = F.coalesce("text", F.lit(""))

    def named(role: str, p: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(p), 1)), lambda v: F.struct(F.lit(role).alias("role"), v.alias("name")))

    found = F.flatten(F.array(*[named(r, p) for r, p in patterns]))
    x = docs.select("id", F.inline(found))
    two = lambda c: F.array_join(F.array_sort(F.slice(F.split(F.lower(c), r"\s+"), 1, 2)), " ")
    e = entities.groupBy(two(F.col("name")).alias("k")).agg(F.min("id").alias("entity_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return x.withColumn("k", two(F.col("name"))).join(e, "k", "left").select("id", "role", "name", "entity_id")


def structured(docs: DataFrame, kinds: Sequence[tuple[str, str]], name: str, limit: int = 220) -> DataFrame:
    """(id, kind, summary, names): a text's first kind whose pattern it has (else other), its first sentence, and the distinct names in it by order."""
    d = docs.select("id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("t"))
    kind = F.lit("other")
    for k, p in reversed(list(kinds)):
        kind = F.when(F.lower("t").rlike(p), k).otherwise(kind)
    s = F.regexp_extract("t", r"^(.*?[.!?])(?:\s|$)", 1)
    s = F.when(s == "", F.col("t")).otherwise(s)
    short = F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))).otherwise(s)
    return d.select("id", kind.alias("kind"), short.alias("summary"), F.array_join(F.array_distinct(F.regexp_extract_all("t", F.lit(name), 1)), "|").alias("names"))


def template_groups(members: DataFrame, texts: DataFrame, phrases: Sequence[str], least: int = 3) -> DataFrame:
    """(canonical_id, group_size, reason): groups of ``least`` members or more whose first member's text has one of the phrases."""
    g = members.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") >= least)
    x = g.join(lowered(texts).select(F.col("id").alias("canonical_id"), "t"), "canonical_id")
    return x.filter(_any(phrases)).select("canonical_id", "group_size", F.lit("repeated template").alias("reason"))


def top_tags(scored: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` best tags of each text by score, then name."""
    return top_per(scored, ["id"], [F.col("score").desc(), F.col("tag")], k).drop("rank")


def distribution(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of a column's values."""
    g = rows.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return g.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
