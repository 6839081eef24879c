"""Variant spellings of names typed by people (problem 5).

Distinct spellings are linked to entities in four steps:

1. Spellings are cut into tokens: titles and bracketed notes go, legal forms
   and set abbreviations take one form, single letters are initials.
2. Set-similarity join of tokens on padded bigrams: bigrams are ordered rare
   first, and only the prefix that any pair of the wanted similarity must share
   is joined; pairs are verified by their edit distance.
3. Entities are proposed by the rare tokens of a spelling alone: tokens are
   ordered by weight, and those behind the point from which the rest could not
   reach the threshold propose nothing (a prefix filter on weights).
4. A pair's score is the soft weighted similarity of tokens: each token of the
   spelling counts with the inverse document frequency of what it matches.
   Another number, legal form or initial rules a pair out. Among the best, a
   hint (faction, INN) tells namesakes apart; what stays ambiguous is left out.

Every step is an equi-join on tokens or grams of distinct spellings; repeated
spellings cost one row before any of it.
"""

from __future__ import annotations

import functools
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

# How Cyrillic letters are written in Latin ones.
LATIN = dict(zip("абвгдезийклмнопрстуфцыэ", "abvgdeziyklmnoprstuf*ye", strict=True)) | {
    "ц": "ts", "ж": "zh", "х": "kh", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya",
}
# Legal forms and their full names.
FORMS = {
    "ооо": "общество с ограниченной ответственностью",
    "зао": "закрытое акционерное общество",
    "пао": "публичное акционерное общество",
    "оао": "открытое акционерное общество",
    "ао": "акционерное общество",
    "муп": "муниципальное унитарное предприятие",
    "гуп": "государственное унитарное предприятие",
    "мбоу": "муниципальное бюджетное общеобразовательное учреждение",
    "мку": "муниципальное казенное учреждение",
    "мбу": "муниципальное бюджетное учреждение",
    "гбу": "государственное бюджетное учреждение",
    "гку": "государственное казенное учреждение",
    "ип": "индивидуальный предприниматель",
}
# Abbreviations written in names of bodies.
SHORT = {
    "укс": "управление капитального строительства", "адм": "администрация", "деп-т": "департамент", "обл": "области", "р-на": "района", "р-н": "район",
    "упр": "управление", "мин-во": "министерство", "ком-т": "комитет", "собр": "собрание",
}
# Titles that stand before names of persons.
TITLES = {"деп", "депутат", "депутаты", "гс", "гд", "сф", "член", "комитета", "сенатор", "госдумы", "председатель", "зам", "тов", "г-н", "г-жа", "dep", "deputat"}
# Short forms of given names.
NICKNAMES = {
    "александр": "саша шура саня алекс", "алена": "аленка", "анатолий": "толя", "артем": "тема артемий", "вера": "верочка", "виктор": "витя", "владимир": "вова володя",
    "глеб": "глебушка", "григорий": "гриша", "дмитрий": "дима митя", "евгений": "женя", "евгения": "женя", "екатерина": "катя катерина", "ирина": "ира", "константин": "костя",
    "леонид": "леня", "людмила": "люда люся мила", "мария": "маша маруся", "михаил": "миша", "наталья": "наташа наталия", "николай": "коля", "ольга": "оля", "павел": "паша",
    "петр": "петя", "роман": "рома", "светлана": "света", "сергей": "сережа серега", "софья": "соня софия", "татьяна": "таня", "тимур": "тима", "федор": "федя",
    "юрий": "юра", "алексей": "леша алеша", "анна": "аня нюра", "елена": "лена", "иван": "ваня", "юлия": "юля", "александра": "саша шура", "борис": "боря", "василий": "вася",
    "надежда": "надя", "любовь": "люба", "илья": "илюша", "андрей": "андрюша", "максим": "макс", "валентина": "валя", "галина": "галя", "алла": "аллочка", "лариса": "лара",
}


class Lexicon(NamedTuple):
    """Lists that the reading of names uses; each may be replaced for another corpus."""

    forms: dict[str, str] = FORMS
    short: dict[str, str] = SHORT
    titles: frozenset[str] = frozenset(TITLES)
    nicknames: dict[str, str] = NICKNAMES


LEXICON = Lexicon()
THRESHOLD = 0.8
#: Shared bigrams of two tokens against all of them, at least.
GRAMS = 0.4


def fold(text: str) -> str:
    return text.lower().replace("ё", "е")


def latin(token: str) -> str:
    return "".join(LATIN.get(c, c) for c in token)


@functools.lru_cache(maxsize=8)
def _forms(forms: tuple[tuple[str, str], ...]) -> list[tuple[re.Pattern, str]]:
    out = []
    for short, full in sorted(forms, key=lambda x: -len(x[1])):
        dotted = r"\.\s?".join(short) + r"\.?"
        for spelling in (re.escape(full), dotted, re.escape(latin(short)), re.escape(latin(full))):
            out.append((re.compile(rf"(?<![\w]){spelling}(?![\w])"), f" {short} "))
    return out


_TOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*\.?")


def tokens(name: str | None, person: bool, lexicon: Lexicon = LEXICON) -> list[str]:
    """The tokens of a spelling; one that ends in a full stop is an abbreviation, one of a single letter an initial."""
    text = " ".join(fold(name or "").split())
    if person:
        text = re.sub(r"\s*[-–—‐‑]\s*", "-", re.sub(r"\([^)]*\)", " ", text))
    else:
        text = re.sub(r"[«»“”„\"'()]", " ", text)
        for pattern, short in _forms(tuple(lexicon.forms.items())):
            text = pattern.sub(short, text)
    out = []
    for t in _TOKEN.findall(text):
        bare = t.rstrip(".")
        if person and bare in lexicon.titles:
            continue
        if not person and bare in lexicon.short:
            out.extend(lexicon.short[bare].split())
        else:
            out.append(t if t.endswith(".") and 1 < len(bare) <= 5 else bare)
    return out


def edit_distance(a: str, b: str) -> int:
    """Edits, exchanged neighbours being one."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


def same_token(a: str, b: str) -> float:
    """Similarity of a typed token to an entity's: 1 if equal, 0 if they differ by more than a slip."""
    if a == b:
        return 1.0
    if a[-1:].isdigit() or b[-1:].isdigit() or min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return 0.0
    longer, shorter = max(a, b, key=len), min(a, b, key=len)
    if len(b) >= 6 and (longer == shorter + "a" or longer == shorter + "а"):
        return 0.0  # the other gender's form of a surname
    d = edit_distance(a, b)
    return 1 - d / (len(b) + 1) if d <= (1 if len(b) < 10 else 2) else 0.0


def against(token: str, other: str, lexicon: Lexicon = LEXICON) -> float:
    """Similarity of one typed token (word, abbreviation, initial, short name) to an entity's token."""
    foreign = bool(re.search("[a-z]", token))
    target = latin(other) if foreign else other
    bare = token.rstrip(".")
    if len(bare) == 1:
        return 0.95 if target.startswith(bare) else 0.0
    if token.endswith("."):
        return 0.95 if target.startswith(bare) else 0.0
    if "-" in bare and len(bare) <= 6 and "-" not in target:  # a contraction: beginning and end
        begin, _, end = bare.partition("-")
        return 0.9 if target.startswith(begin) and target.endswith(end) else 0.0
    sim = same_token(bare, target)
    if not sim:
        for short in lexicon.nicknames.get(other, "").split():
            if bare == (latin(short) if foreign else short):
                return 0.9
    return sim


class Matcher:
    """``against`` under a lexicon, remembering what it was asked: the same tokens meet in many pairs."""

    def __init__(self, lexicon: Lexicon = LEXICON, most: int = 500_000):
        self.lexicon, self.most, self.known = lexicon, most, {}

    def __call__(self, token: str, other: str) -> float:
        s = self.known.get((token, other))
        if s is None:
            if len(self.known) >= self.most:
                self.known.clear()
            s = self.known[token, other] = against(token, other, self.lexicon)
        return s


def _surname(typed: list[str], own: str, against) -> tuple[list[int], float]:
    """Which tokens are the surname, and how similar: whole, its two parts apart, or one part of two."""
    found: list[tuple[float, list[int]]] = []
    parts = own.split("-")
    for i, t in enumerate(typed):
        if len(t.rstrip(".")) < 2 or t.endswith("."):
            continue
        found.append((against(t, own), [i]))
        if len(parts) == 2:
            found.append((0.9 * max(against(t, p) for p in parts), [i]))
            if i + 1 < len(typed) and (s := min(against(t, parts[0]), against(typed[i + 1], parts[1]))) and len(typed[i + 1].rstrip(".")) > 1:
                found.append((0.99 * s, [i, i + 1]))
    best = max(found, default=(0.0, []), key=lambda x: x[0])
    return best[1], best[0]


def score(typed: list[str], own: list[str], weights: list[float], person: bool, against: Matcher | None = None) -> float:
    """Soft weighted similarity of a spelling to an entity, from 0 to 1; 0 where something rules it out."""
    against = against or Matcher()
    if not typed or not own:
        return 0.0
    known = against.lexicon.forms
    forms = [t for t in own if t in known]
    given = [t for t in typed if t in known]
    if not person and given and given[:1] != forms[:1]:
        return 0.0
    if sorted(t for t in typed if t.isdigit()) != sorted(t for t in own if t.isdigit()):
        return 0.0
    if person:
        at, s = _surname(typed, own[0], against)
        rest = [t for i, t in enumerate(typed) if i not in at]
        if not s or len(rest) >= len(own):
            return 0.0
        pairs = [(0, s)] + [(i, against(t, own[i])) for i, t in enumerate(rest, 1)]
        if any(s == 0 for _, s in pairs):
            return 0.0
        return sum(weights[i] * s for i, s in pairs) / sum(weights[i] for i, _ in pairs)
    free, hit, total, covered = set(range(len(own))), 0.0, 0.0, 0.0
    for t in sorted(typed, key=len, reverse=True):
        best = max(free, key=lambda i: against(t, own[i]), default=None)
        s = against(t, own[best]) if best is not None else 0.0
        w = weights[best] if s else max(weights)
        total += w
        if s:
            free.discard(best)
            hit += w * s
            covered += weights[best]
    whole = sum(w for t, w in zip(own, weights, strict=True) if t not in known or t in typed)
    return min(hit / total, covered / whole if whole else 0.0)


def hint_key(text: str | None, person: bool) -> str:
    """A faction in one form, or an INN's digits without leading zeros."""
    if not text:
        return ""
    if person:
        m = re.search("«([^»]+)»", text)
        return " ".join(re.findall(r"[^\W_]+", fold(m[1] if m else text)))
    return re.sub(r"\D", "", re.sub(r"\.0+\s*$", "", text)).lstrip("0")


def _parse(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(key, person, tokens, hint) of rows (key, person, name, hint)."""

    def each(batches):
        for b in batches:
            person = b.column("person").to_pylist()
            toks = [tokens(n, p, lexicon) for n, p in zip(b.column("name").to_pylist(), person, strict=True)]
            hints = [hint_key(h, p) for h, p in zip(b.column("hint").to_pylist(), person, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("person"), pa.array(toks, pa.list_(pa.string())), pa.array(hints)], names=["key", "person", "tokens", "hint"])

    return df.select("key", "person", "name", "hint").mapInArrow(each, "key long, person boolean, tokens array<string>, hint string")


def similar_tokens(typed: DataFrame, own: DataFrame) -> DataFrame:
    """(typed, own) of tokens of enough common bigrams that are a slip apart at most; equal ones included.

    ``own`` has (token, form): an entity's token and a way it may be written.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, F.lit(2))))
    a = typed.select("token", grams(F.col("token")).alias("grams"))
    b = own.select(F.col("form").alias("token"), grams(F.col("form")).alias("grams")).dropDuplicates(["token"])
    both = a.unionByName(b).select(F.explode("grams").alias("gram"))
    rank = cut(both.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))

    def prefix(x: DataFrame) -> DataFrame:
        each = x.select("token", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(rank, "gram")
        ordered = each.groupBy("token", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
        some = ordered.select("token", "n", F.slice("g", F.lit(1), F.col("n") - F.ceil(F.col("n") * GRAMS).cast("int") + 1).alias("g"))
        return some.select("token", "n", F.explode("g.gram").alias("gram"))

    p, q = prefix(a).toDF("typed", "n", "gram"), prefix(b).toDF("form", "m", "gram")
    met = p.join(q, "gram").filter(f"least(n, m) >= {GRAMS} * greatest(n, m) and abs(length(typed) - length(form)) <= 2").select("typed", "form").distinct()

    def close(batches):
        for t in batches:
            s = [same_token(x, y) for x, y in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)]
            yield t.filter(pa.array([x > 0 for x in s], pa.bool_()))

    near = met.mapInArrow(close, "typed string, form string")
    return near.join(own, "form").select("typed", F.col("token").alias("own")).distinct()


def link(names: DataFrame, entities: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """(person, name, hint, entity_id) for every distinct spelling that denotes one entity.

    ``names`` has (person boolean, name, hint), ``entities`` (id, person, name,
    hint). Null, empty and unreadable names, and names of more than one best
    entity, are left out. Repeated rows count once; extra columns are ignored.
    """
    names = names.select("person", "name", "hint").filter("person is not null and name is not null").distinct()
    names = cut(names.withColumn("key", F.xxhash64("person", "name", F.coalesce("hint", F.lit("\u0000")))))
    n = cut(_parse(names, lexicon).filter("size(tokens) > 0"))
    e = cut(_parse(entities.select(F.col("id").alias("key"), "person", "name", "hint").filter("key is not null and name is not null and person is not null").dropDuplicates(["key"]), lexicon).filter("size(tokens) > 0"))
    apart = F.flatten(F.transform(F.filter("tokens", lambda t: t.contains("-")), lambda t: F.split(t, "-")))
    e = e.withColumn("index", F.array_distinct(F.when(F.col("person"), F.concat("tokens", apart)).otherwise(F.col("tokens"))))
    count = e.groupBy("person").agg(F.count(F.lit(1)).alias("all"))
    df = e.select("person", F.explode("index").alias("token")).groupBy("person", "token").agg(F.count(F.lit(1)).alias("df"))
    weight = cut(df.join(count, "person").select("person", "token", F.log1p(F.col("all") / F.col("df")).alias("w")))

    def written(batches):
        for b in batches:
            t = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([*t, *t]), pa.array([*t, *map(latin, t)])], names=["token", "form"])

    own = cut(weight.select("token").distinct().mapInArrow(written, "token string, form string").filter("length(form) > 1").distinct())
    typed = n.select(F.explode("tokens").alias("token")).filter("length(token) > 2 and token not like '%.'").distinct()
    pair = cut(similar_tokens(typed, own))
    # what each token of a spelling can match, and how much it weighs at most
    most = math.log1p(1.0)
    words = n.select("key", "person", F.explode(F.array_distinct("tokens")).alias("typed")).filter("length(typed) > 2 and typed not like '%.'")
    matched = words.join(pair, "typed").join(weight.withColumnRenamed("token", "own"), ["person", "own"])
    best = matched.groupBy("key", "typed").agg(F.max("w").alias("w"))
    rows = F.collect_list(F.struct(F.col("w").alias("w"), F.col("typed").alias("typed")))
    ranked = best.groupBy("key").agg(F.sort_array(rows, asc=False).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x["w"])
    ahead = lambda i: F.aggregate(F.slice("t", F.lit(1), i), F.lit(0.0), lambda s, x: s + x["w"])
    # a token may be left out only if those behind it, all met, stay below the threshold
    needed = F.filter("t", lambda x, i: (total - ahead(i)) >= F.lit(THRESHOLD * 0.75) * total)
    probe = ranked.select("key", F.explode(needed).alias("t")).select("key", F.col("t.typed").alias("typed"))
    tokens_of = e.select(F.col("key").alias("id"), "person", F.explode("index").alias("own"))
    asked = probe.join(n.select("key", "person"), "key").join(pair, "typed").join(tokens_of, ["person", "own"]).select("key", "id").distinct()
    weights = e.select("key", "person", F.posexplode("tokens").alias("i", "token")).join(weight, ["person", "token"], "left")
    weights = weights.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("w", F.lit(most)).alias("w")))), lambda x: x["w"]).alias("weights"))
    known = e.join(weights, "key").select(F.col("key").alias("id"), F.col("tokens").alias("own"), "weights", F.col("hint").alias("own_hint"))
    full = asked.join(n, "key").join(known, "id").select("key", "id", "person", "tokens", "hint", "own", "weights", "own_hint")

    def judge(batches):
        match = Matcher(lexicon)
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in b.schema.names}
            s, agree = [], []
            for typed_, own_, w, person, h, g in zip(c["tokens"], c["own"], c["weights"], c["person"], c["hint"], c["own_hint"], strict=True):
                s.append(score(typed_, own_, w, person, match))
                agree.append(0 if not h or not g else 1 if h == g else -1)
            keep = pa.array([x >= THRESHOLD for x in s], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(s, pa.float64()), pa.array(agree, pa.int32())], names=["key", "id", "score", "agree"])
            yield out.filter(keep)

    scored = cut(full.mapInArrow(judge, "key long, id long, score double, agree int").filter("agree >= 0"))
    order = F.struct("agree", F.round("score", 2).alias("score"))
    top = scored.groupBy("key").agg(F.max(order).alias("top"))
    first = scored.join(top, "key").filter(order == F.col("top")).groupBy("key").agg(F.min("id").alias("entity_id"), F.max("id").alias("_other"))
    return first.filter("entity_id = _other").join(names, "key").select("person", "name", "hint", "entity_id")
