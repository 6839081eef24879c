"""Noise in text from scanned pages (problem 6).

A text's lines are page furniture (running headers and footers, page numbers),
blank, or text. Page numbers are found by their forms and by bare numbers that
count up from page to page. What reads like a running line is learned from the
whole corpus: a short line's patterns (the line itself, its first words, its
make-up) stand at page edges in most of the documents that have them, or they
do not. Within a document, furniture is what such patterns name, and what comes
back at the edge of every page, give or take misread letters.

Words cut at line ends are put together with the next line of text, unless the
sign belongs to the word. Misread words are looked up in a vocabulary of all
words of the corpus: a Levenshtein automaton of each distinct word is
intersected with the vocabulary's trie, in as many shards as the vocabulary
needs, which yields every word within the distance. The confusions of letters
are learned from these neighbours, with a fixed list as prior; candidates are
ranked by them, by their frequency and by how often they stand beside the
neighbouring words. All that is asked and answered is a table of distinct
strings, so nothing of the corpus's size is broadcast, and no entry is left out
for being rare.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.sieve import Sieve
from factloom.session import cut

#: A word must have been read so often to be a candidate, and so many times as often as the word it replaces.
MIN_COUNT, MORE = 4, 4.0
#: A letter is misread at most so often; a count is too high for a misreading if chance gives it less often than TAIL.
RATE, TAIL = 0.015, 1e-3
#: A confusion is learned if this share of the letter is read so, in three different words or more.
LEAST_RATE, LEAST_WORDS = 2e-4, 3
#: A pattern of lines counts if so many documents have it; it names furniture if the one share of it or more stands at page edges, text if the other or less.
LEAST_DOCUMENTS, AT_EDGES, INSIDE = 5, 0.6, 0.3
#: Words in a shard of the trie, and words looked up by one task.
SHARD, ASKED = 100_000, 2_000

# Signs of hyphenation at a line's end.
HYPHENS = "-­¬‐‑"
# Letters that scanners read for digits, and the digits.
DIGITS = str.maketrans("оoзlб", "00316")
# What stands beside a page number.
PAGE_WORDS = ("стр", "страница", "лист")
# Letters and what scanners read for them (the letter, the misreading); a prior, to which the corpus adds.
MISREAD = (("и", "н"), ("н", "п"), ("л", "п"), ("п", "л"), ("д", "л"), ("ш", "щ"), ("е", "с"), ("о", "с"), ("в", "б"), ("з", "э"), ("н", "и"), ("ц", "п"))
# Signs of other alphabets that are read for letters.
FOREIGN = (
    ("rn", "м"), ("»к", "ж"), ("ьi", "ы"), ("bi", "ы"), ("0", "о"), ("o", "о"), ("a", "а"), ("p", "р"), ("m", "т"), ("8", "в"), ("6", "б"), ("r", "г"), ("y", "у"),
    ("3", "з"), ("4", "ч"), ("e", "е"), ("x", "х"), ("k", "к"), ("u", "и"), ("b", "ь"), ("h", "н"), ("t", "т"), ("i", "і"),
)

_RUN = re.compile(r"(?:[^\W_]|(?<=[^\W\d_])»(?=к[а-яё]))+")
_OWN = re.compile("[а-яё]+")
_HYPHENATED = re.compile(r"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+)+(?![\w-])")
_NUM = r"[\dоoзlб]{1,4}"
_PAGE = re.compile(rf"^([^\d\W]*)\.?\s*({_NUM})(?:\s*[а-я]{{2}}\s*{_NUM})?$")
_FRAMED = re.compile(rf"^(?:\[\s*{_NUM}\s*\]|[-—–]\s*{_NUM}\s*[-—–]|{_NUM}\s*/\s*{_NUM})$")


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


# ---- page furniture ---------------------------------------------------------
def _key(line: str) -> str:
    return re.sub(r"\d+", "0", " ".join(line.lower().split()))


def _alike(a: str, b: str) -> bool:
    most = max(1, len(a) // 8)
    return a == b or edit_distance(a, b, most) <= most


def _page_number(line: str) -> bool:
    s = line.strip().lower()
    if len(s) > 24 or not re.search(r"\d", s):
        return False
    if _FRAMED.match(s):
        return True
    m = _PAGE.match(s)
    return bool(m and m[1] and any(edit_distance(undone(m[1]), w, 2) <= (len(w) > 3) + (len(w) > 5) for w in PAGE_WORDS))


def _plain_number(line: str) -> str | None:
    """The digits of a line that is a number of up to four, some perhaps misread."""
    s = line.strip().lower()
    return s.translate(DIGITS) if re.fullmatch(_NUM, s) and re.search(r"\d|l", s) else None


def _numbered_lines(lines: list[str], shown: list[int]) -> set[int]:
    """Lines that come back three times or more with a last number that counts up, as far apart as pages are; sections seldom are."""
    alike: dict[str, list[tuple[int, int]]] = {}
    for i in shown:
        m = re.search(r"\D(\d{1,4})\s*$", lines[i])
        if m and len(lines[i]) <= 70:
            alike.setdefault(_key(lines[i]), []).append((i, int(m[1])))
    found: set[int] = set()
    for at in alike.values():
        gaps = [b[0] - a[0] for a, b in zip(at, at[1:])]  # noqa: B905
        if len(at) > 2 and all(b[1] == a[1] + 1 for a, b in zip(at, at[1:])) and min(gaps) >= 8 and max(gaps) <= 1.3 * min(gaps):  # noqa: B905
            found |= {i for i, _ in at}
    return found


def page_marks(lines: list[str]) -> tuple[list[int], set[int], set[int]]:
    """The lines that are not blank, page numbers among them, and form feeds."""
    shown = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0c") or "\x0c" in x]
    feed = {i for i in shown if not lines[i].strip()}
    numbers = {i for i in shown if _page_number(lines[i])} | _numbered_lines(lines, shown)
    plain = {i: int(x) for i in shown if (x := _plain_number(lines[i])) is not None and int(x) < 1000}
    chains: list[list[int]] = []
    for i, value in plain.items():
        for c in chains:
            if plain[c[-1]] + 1 == value and (i - c[-1] >= 8 or i == shown[-1]):
                c.append(i)
                break
        else:
            chains.append([i])
    # bare numbers are pages if they count up across the text, or stand alone at its edge
    long = max(chains, key=len, default=[])
    if len(numbers) < 2 and len(long) > 1:
        numbers |= set(long)
    elif not numbers:
        numbers |= {i for i in plain if i in (shown[0], shown[-1])}
    return shown, numbers, feed


def _short(line: str, ends: str = ".,;:!?" + HYPHENS) -> bool:
    """Whether a line may be a running one by its form: short, and not of a sentence."""
    s = line.strip()
    return 4 <= len(s) <= 70 and not s[0].islower() and s[-1] not in ends and bool(re.search(r"[^\W\d_]{2}", s))


def _make_up(token: str) -> str:
    if token.isdigit():
        return "0"
    if not re.search(r"[^\W\d_]", token):
        return token
    return "U" if token.isupper() and len(token) > 1 else "T" if token[:1].isupper() else "l"


def line_patterns(line: str) -> list[str]:
    """A line's patterns, the most specific first: itself, its first two words and make-up, its first word and make-up, its make-up if that is not of small words alone."""
    words, kinds = _key(line).split(), " ".join(map(_make_up, line.split()))
    two = f"2 {words[0]} {words[1]} {kinds}" if len(words) > 2 else None
    made = [f"s {kinds}"] if "l" not in kinds or re.search("[^Tl ]", kinds) else []  # small words alone are made up like any sentence
    return [f"w {' '.join(words)} {kinds[:1]}", *([two] if two else []), f"1 {words[0]} {kinds}", *made]


def pattern_rows(text: str) -> dict[tuple[str, str], tuple[int, int, int, list[int]]]:
    """For every pattern of a text's short lines, and every line that has it: how specific it is, how often it stands at page edges, how often at all, and where.

    Where a text has no page marks, nobody knows its edges, so nothing is counted.
    """
    lines = text.split("\n")
    shown, numbers, feed = page_marks(lines)
    edge, out = numbers | feed, {}
    for n, i in enumerate(shown):
        if i not in edge and _short(lines[i], ".,;!?" + HYPHENS):  # with headings that end in a colon
            at = n in (0, len(shown) - 1) or shown[n - 1] in edge or shown[n + 1] in edge
            own = line_patterns(lines[i])
            for level, p in enumerate(own):
                _, e, a, where = out.get((p, own[0]), (level, 0, 0, []))
                out[p, own[0]] = (level, e + (at and bool(edge)), a + bool(edge), [*where, i])
            # a page number may follow the running line: then the line without it is known
            if m := re.fullmatch(r"\s*(\S.*\S)\s+\d{1,4}\s*", lines[i]):
                for level, p in enumerate(line_patterns(m[1]), 4):
                    _, _, _, where = out.get((p, ""), (level, 0, 0, []))
                    out[p, ""] = (level, 0, 0, [*where, i])
    return out


def furniture(lines: list[str], known: dict[int, bool]) -> set[int]:
    """Numbers (from 0) of the lines that are running headers, footers or page numbers; ``known`` says what the corpus tells of some."""
    shown, numbers, feed = page_marks(lines)
    edge, order = numbers | feed, {i: n for n, i in enumerate(shown)}
    if len(shown) < 3 or all(lines[i].isupper() for i in shown if lines[i].strip()):
        return numbers
    keys = {i: _key(lines[i]) for i in shown}
    again = Counter(keys.values())
    close = {shown[n + k] for n in (order[i] for i in edge) for k in (-2, -1, 1, 2) if 0 <= n + k < len(shown)} | {*shown[:2], *shown[-2:]}
    might = [i for i in shown if i not in edge and (i in close or again[keys[i]] > 1) and known.get(i) is not False and _short(lines[i])]
    groups: list[list[int]] = []
    for i in might:
        for g in groups:
            if _alike(keys[g[0]], keys[i]):
                g.append(i)
                break
        else:
            groups.append([i])
    found: set[int] = set()
    for _ in range(2):
        near = {i for i in might if order[i] in (0, len(shown) - 1) or shown[order[i] - 1] in edge | found or shown[order[i] + 1] in edge | found}
        for g in groups:
            at = sum(i in near for i in g)
            form = any(known.get(i) for i in g)
            if (form and (at or len(g) > 1)) or (len(g) > 2 and at == len(g)):
                found |= set(g)
    return found | numbers


# ---- words ------------------------------------------------------------------
def undone(word: str) -> str:
    """The word with signs of other alphabets as the letters they were read for."""
    for sign, letter in FOREIGN:
        word = word.replace(sign, letter)
    return word.replace("c", "с")


def _ending(line: str) -> tuple[str, str] | None:
    """The run of letters before a sign of hyphenation at the line's end, and the sign."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS:
        return None
    m = re.search(r"[^\W_»]*(?:»к[^\W_]*)?$", s[:-1])
    return (m[0].lower(), s[-1]) if m and m[0] else None


def _beginning(line: str) -> str:
    m = _RUN.match(line.strip().lower())
    return m[0] if m else ""


class Trie:
    """A vocabulary's words."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, most: int) -> list[str]:
        """All words at most ``most`` edits away: the automaton's states (bits) go down the trie."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, out = 1 << len(word), []
        stack = [(self.root, [(1 << (k + 1)) - 1 for k in range(most + 1)])]
        while stack:
            node, states = stack.pop()
            if "" in node and states[most] & end:
                out.append(node[""])
            for c, below in node.items():
                if not c:
                    continue
                m, new = masks.get(c, 0), []
                for k in range(most + 1):
                    r = (states[k] & m) << 1
                    if k:
                        r |= states[k - 1] | states[k - 1] << 1 | new[k - 1] << 1
                    new.append(r & (2 * end - 1))
                if new[most]:
                    stack.append((below, new))
        return out


def too_many(a: int, mean: float) -> bool:
    """Whether chance with this mean gives ``a`` or more in less than TAIL of the cases (Poisson)."""
    if a <= mean:
        return False
    if mean > 500:
        return a > mean + 3.1 * math.sqrt(mean)
    term = total = math.exp(-mean)
    for i in range(1, a):
        term *= mean / i
        total += term
    return 1 - total < TAIL


def differences(right: str, word: str) -> list[tuple[str, str]] | None:
    """The letters that differ, if the words are of one length."""
    return [(a, b) for a, b in zip(right, word, strict=True) if a != b] if len(right) == len(word) else None


def misread_from(right: str, word: str, confusions, most: int = 2) -> int:
    """How many known confusions make ``word`` of ``right``; 0 if they do not, or not with ``most``."""
    d = differences(right, word)
    return len(d) if d and len(d) <= most and all(x in confusions for x in d) else 0


def likely(n: int, n_right: int, misread: int) -> bool:
    """Whether a word read ``n`` times is so rare against one read ``n_right`` times that it must be a misreading of it."""
    return n_right >= max(MIN_COUNT, MORE * max(n, 0.5)) and not too_many(n, n_right * RATE**misread)


def _plain_rule(word: str) -> str | None:
    """What a run of signs was, where its make-up tells; '' if it is none of these cases."""
    if not word or word.isdigit() or re.fullmatch(r"\d+[абвгдк]", word):
        return None
    if re.fullmatch(r"[0-9l]+", word):
        return word.replace("l", "1")
    return ""


def _foreign(word: str) -> bool:
    """Letters of another alphabet alone, so few that they may be look-alikes throughout."""
    return len(word) <= 4 and not re.search("[0-9а-яё]", word)


def _mixed(word: str) -> bool:
    """Cyrillic letters and other signs in one word: misread by its make-up."""
    return not _OWN.fullmatch(word) and bool(re.search("[а-яё]", word))


def variants(word: str) -> list[str]:
    """What a mixed word may have been: its signs undone, a c also for a letter e."""
    plain = undone(word)
    return list(dict.fromkeys([plain, plain.replace("с", "е"), *(plain[:i] + "е" + plain[i + 1 :] for i, x in enumerate(word[: len(plain)]) if x == "c")]))


def compound(left: str, right: str, n: list[int], near: list[str], near_apart: list[str], confusions) -> bool:
    """Whether the sign between two fragments belongs to the word; ``n``: counts of left + right, left-right, and both with signs undone."""
    if n[0] or n[1]:
        return n[1] > n[0]
    if n[2] or n[3]:
        return n[3] > n[2]
    left, right = undone(left), undone(right)
    if any(misread_from(c, left + right, confusions, 1) for c in near):
        return False
    parts = (c.split("-") for c in near_apart)
    return any(len(p) == 2 and edit_distance(p[0], left, 1) <= 1 and edit_distance(p[1], right, 1) <= 1 for p in parts)


def runs_of(lines: list[str], gone: set[int]) -> dict[int, list[str]]:
    """The runs of signs that make words, in lower case, of every line of text."""
    return {i: _RUN.findall(x.lower()) for i, x in enumerate(lines) if i not in gone and x.strip()}


def walk(lines: list[str], runs_in: dict[int, list[str]]):
    """Everything a text asks, as tuples (line, kind, word, left, right, begin, end, before, after), lines from 0.

    ``word``: a run to be looked up. ``break``: left and right are cut by a sign
    that may belong to the word. ``part``: if they are one word, the run from
    begin to end of it; ``half``: if they are not, a run of its own.
    """
    shown, ends = list(runs_in), {i: _ending(lines[i]) for i in runs_in}
    signs = Counter(e[1] for e in ends.values() if e)
    style = signs.most_common(1)[0][0] if signs else "-"
    carried = None
    for n, i in enumerate(shown):
        runs, end, broken = runs_in[i], ends[i], None
        if end and n + 1 < len(shown):
            right, opens = _beginning(lines[shown[n + 1]]), lines[shown[n + 1]].strip()[:1]
            if right and (opens.islower() or not opens.isalpha() or lines[i].isupper()) and (end[1] == style or end[1] != "-"):
                broken = (end[0], right)
                yield i, "break", None, *broken, 0, 0, "", ""
        last = len(runs) - 1
        for k, word in enumerate(runs):
            before, after = runs[k - 1] if k else "", runs[k + 1] if k < last else ""
            if k == 0 and carried:
                yield i, "part", carried[0] + word, *carried, len(carried[0]), len(carried[0]) + len(word), before, after
                yield i, "half", word, *carried, 0, 0, before, after
            if k == last and broken:
                if not (k == 0 and carried):
                    yield i, "part", broken[0] + broken[1], *broken, 0, len(broken[0]), before, after
                yield i, "half", word, *broken, 0, 0, before, after
            elif not (k == 0 and carried):
                yield i, "word", word, None, None, 0, 0, before, after
        carried = broken


def bad_by_make_up(kind: str, word: str, begin: int, end: int) -> bool:
    """Whether a run, or a part of a cut word, is misread by its signs alone."""
    if kind == "part":
        part = word[begin:end]
        return bool(re.search("[а-яё]", word) and re.search("[^а-яё]", part) and not part.isdigit())
    rule = _plain_rule(word)
    return bool(rule) or (rule == "" and _mixed(word))


def reflowed(text: str, gone: set[int], heads: set[int], joins: set[int], right: dict[str, str]) -> str:
    """Running text: no furniture, cut words whole, misread words repaired, a line for each paragraph; headings begin one."""
    lines = text.split("\n")
    shown = [i for i, x in enumerate(lines) if i not in gone and x.strip()]
    paragraphs: list[str] = []
    glue, last = "", None
    for i in shown:
        line = lines[i]
        gap = last is not None and any(not lines[j].strip() and j not in gone for j in range(last + 1, i))
        starts = line.startswith("    ") or i in heads or (gap and not glue and paragraphs[-1][-1:] in ".:!?»")
        piece = line.strip()
        if i in joins:
            piece = piece[:-1]
        if not paragraphs or (starts and not glue):
            paragraphs.append(piece)
        else:
            paragraphs[-1] += ("" if glue else " ") + piece
        glue, last = "cut" if i in joins else "own" if _ending(line) else "", i
    return "\n".join(_RUN.sub(lambda m: _cased(m[0], right), p) for p in paragraphs)


def _cased(word: str, rights: dict[str, str]) -> str:
    low = word.lower()
    right = rights.get(low) or _plain_rule(low)
    if not right:
        return word
    return right.upper() if word.isupper() and len(word) > 1 else right.capitalize() if word[:1].isupper() else right


# ---- tables -----------------------------------------------------------------
def _documents(attachments: DataFrame, key: str, text: str, beside: bool) -> DataFrame:
    """(kind, k, text, gone, heads, entry, n): kind -1 the texts with their furniture and headings; 0 words, 1 neighbours, 2 breaks with their counts in a batch; neighbours if ``beside`` says so."""
    rows = attachments.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k is not null and t != ''")

    def patterns(batches):
        for b in batches:
            out = []
            for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(k, *p, *x) for p, x in pattern_rows(t).items()]
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["k", "p", "line", "level", "edge", "n", "lines"])

    p = cut(rows.mapInArrow(patterns, "k long, p string, line string, level int, edge int, n int, lines array<int>"))
    # every different line has one voice in what its make-up tells
    told = p.filter("n > 0").groupBy("p", "line").agg((F.sum("edge") / F.sum("n")).alias("e"), F.count_distinct("k").alias("d"))
    told = told.groupBy("p").agg(F.avg("e").alias("e"), F.sum("d").alias("d")).filter(F.col("d") >= LEAST_DOCUMENTS)
    told = told.select("p", F.when(F.col("e") >= AT_EDGES, True).when(F.col("e") <= INSIDE, False).alias("at")).filter("at is not null")
    known = p.join(told, "p").groupBy("k").agg(F.collect_set(F.struct("level", "at", "lines")).alias("known"))

    def each(batches):
        for b in batches:
            docs, words, pairs, breaks = [], Counter(), Counter(), Counter()
            for k, t, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                said: dict[int, bool] = {}
                for x in sorted(known or [], key=lambda x: -x["level"]):
                    for i in x["lines"]:
                        if x["at"] or x["level"] == 0:
                            said[i] = x["at"]
                        else:
                            said.pop(i, None)
                lines = t.split("\n")
                gone = furniture(lines, said)
                docs.append((k, t, sorted(gone), [i for i, at in said.items() if not at]))
                runs, cut_before = runs_of(lines, gone), False
                for i, run in runs.items():
                    end = _ending(lines[i])
                    inner = run[1 if cut_before else 0 : len(run) - 1 if end else len(run)]
                    words.update(inner)
                    if "-" in lines[i]:
                        words.update(_HYPHENATED.findall(lines[i].lower()))
                    if beside:
                        pairs.update(map(" ".join, zip(inner, inner[1:])))  # noqa: B905
                    cut_before = bool(end)
                for x in walk(lines, runs):
                    if x[1] == "break":
                        breaks[f"{x[3]}\n{x[4]}"] += 1
                    elif x[1] == "word" and x[2] not in words:
                        words[x[2]] = 0  # asked, though not counted where a line end may have cut it
            counted = [(n, e, c) for n, counts in enumerate((words, pairs, breaks)) for e, c in counts.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] * len(docs) + [x[0] for x in counted], pa.int32()), pa.array([x[0] for x in docs] + [None] * len(counted), pa.int64()),
                    pa.array([x[1] for x in docs] + [None] * len(counted), pa.string()), *[pa.array([x[j] for x in docs] + [None] * len(counted), pa.list_(pa.int32())) for j in (2, 3)],
                    pa.array([None] * len(docs) + [x[1] for x in counted], pa.string()), pa.array([None] * len(docs) + [x[2] for x in counted], pa.int64()),
                ],
                names=["kind", "k", "text", "gone", "heads", "entry", "n"],
            )

    d = rows.dropDuplicates(["k"]).join(known, "k", "left").select("k", "t", "known")
    return cut(d.mapInArrow(each, "kind int, k long, text string, gone array<int>, heads array<int>, entry string, n long"))


def neighbours(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(s, n, c, n_c): for every asked string (s, n) all words of (entry, n) within two edits (one, if it is short), other than itself.

    The trie is parted into shards of about ``SHARD`` words, the strings into
    blocks of ``ASKED``; a task intersects one block with one shard.
    """
    shards, blocks = max(1, -(-words.count() // SHARD)), max(1, -(-asked.count() // ASKED))
    w = words.select(F.pmod(F.xxhash64("entry"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "entry", "n", F.lit(True).alias("word"))
    q = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("s"), F.lit(blocks)).alias("block"), F.col("s").alias("entry"), "n", F.lit(False).alias("word"))

    def each(batches):
        known, asked = {}, []
        for b in batches:
            for entry, n, word in zip(*(b.column(c).to_pylist() for c in ("entry", "n", "word")), strict=True):
                if word:
                    known[entry] = n
                else:
                    asked.append((entry, n))
        trie = Trie(known)
        for lo in range(0, len(asked), 1000):
            out = [(s, n, c, known[c]) for s, n in asked[lo : lo + 1000] for c in trie.within(s, 1 if len(s) < 6 else 2) if c != s]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["s", "n", "c", "n_c"])

    cells = w.unionByName(q).withColumn("cell", (F.col("shard") * blocks + F.col("block")).cast("int"))
    return cells.repartitionById(shards * blocks, "cell").select("entry", "n", "word").mapInArrow(each, "s string, n long, c string, n_c long")


def learned_confusions(near: DataFrame, words: DataFrame) -> frozenset:
    """(letter, what it is read for): pairs that turn frequent words into rare ones often and in several words, and the prior."""

    def pairs(batches):
        for b in batches:
            found = []
            for s, n, c, n_c in zip(*(b.column(x).to_pylist() for x in ("s", "n", "c", "n_c")), strict=True):
                d = differences(c, s)
                if n and len(s) > 3 and d and len(d) == 1 and n_c >= max(20, 50 * n) and _OWN.fullmatch(c):
                    found.append((*d[0], n))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["a", "b", "n"])

    letters = words.select(F.explode(F.split(F.regexp_replace("entry", "[^а-яё]", ""), "")).alias("a"), "n").filter("a != ''").groupBy("a").agg(F.sum("n").alias("total"))
    found = near.filter(F.col("s").rlike("^[а-яё]+$")).mapInArrow(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    rows = found.join(letters, "a").filter((F.col("n") >= LEAST_RATE * F.col("total")) & (F.col("words") >= LEAST_WORDS)).collect()  # at most the alphabet squared
    return frozenset({(r.a, r.b) for r in rows} | set(MISREAD))


def _tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the corpus tells: (word, right, n_right) of misread words, (left, right, compound) of breaks, (entry, n) of neighbours."""
    counts = cut(documents.filter("kind >= 0").groupBy("kind", "entry").agg(F.sum("n").alias("n")))
    words, breaks = counts.filter("kind = 0").select("entry", "n"), counts.filter("kind = 2").select("entry")

    def strings(batches):  # every string whose count or neighbours somebody asks
        for b in batches:
            out = set()
            for kind, e in zip(b.column("kind").to_pylist(), b.column("entry").to_pylist(), strict=True):
                if kind == 2:
                    left, right = e.split("\n")
                    x, y = undone(left), undone(right)
                    out |= {left, right, left + right, f"{left}-{right}", x + y, f"{x}-{y}", *(variants(left + right) if _mixed(left + right) else ())}
                elif _OWN.fullmatch(e):
                    out.add(e)
                elif _plain_rule(e) == "":
                    out |= {e, undone(e)} if _foreign(e) else set(variants(e)) if _mixed(e) else set()
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], names=["s"])

    asked = counts.filter("kind != 1").select("kind", "entry").mapInArrow(strings, "s string").distinct()
    asked = cut(asked.join(words.withColumnRenamed("entry", "s"), "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n")))
    most = words.agg(F.max("n").alias("n")).first().n or 0
    sure = next(a for a in range(1, 10**9) if too_many(a, most * RATE)) if most * RATE < 500 else int(most * RATE + 3.1 * math.sqrt(most * RATE)) + 1
    trie = words.filter((F.col("n") >= MIN_COUNT) & F.col("entry").rlike(r"^[\p{L}]+$") | F.col("entry").contains("-"))
    near = cut(neighbours(asked.filter((F.col("n") < sure) & (F.length("s") > 1)), trie))
    confusions = learned_confusions(near, words)

    def judged(batches):
        for b in batches:
            out = [(s, c, n_c) for s, n, c, n_c in zip(*(b.column(x).to_pylist() for x in ("s", "n", "c", "n_c")), strict=True) if (k := misread_from(c, s, confusions)) and likely(n, n_c, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "right", "n_right"])

    own = near.filter(F.col("s").rlike("^[а-яё]+$")).mapInArrow(judged, "word string, right string, n_right long")

    def other(batches):  # what a word of other signs may have been, the better kinds of answer last
        for b in batches:
            out = []
            for kind, e in zip(b.column("kind").to_pylist(), b.column("entry").to_pylist(), strict=True):
                e = e.replace("\n", "") if kind == 2 else e
                if _plain_rule(e) != "" or _OWN.fullmatch(e):
                    continue
                if _mixed(e):
                    out += [(e, v, False) for v in variants(e)]
                elif _foreign(e):
                    out += [(e, undone(e), True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["word", "s", "foreign"])

    o = cut(counts.filter("kind != 1").select("kind", "entry").mapInArrow(other, "word string, s string, foreign boolean").distinct())
    read = words.select(F.col("entry").alias("word"), F.col("n").alias("n_word"))
    o = o.join(asked, "s", "left").join(read, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    foreign = o.filter(F.col("foreign") & (F.col("n") >= 20 * F.greatest(F.lit(1), F.coalesce("n_word", F.lit(0))))).select("word", F.col("s").alias("right"), F.col("n").alias("n_right"))
    mixed = o.filter("not foreign").withColumn("rank", F.when(F.col("n") > 0, 2).otherwise(0)).select("word", F.col("s").alias("right"), F.col("n").alias("n_right"), "rank")
    one = near.filter(F.col("n_c") >= MIN_COUNT).filter(F.levenshtein("s", "c", 1) == 1).select("s", F.col("c").alias("right"), F.col("n_c").alias("n_right"))
    mixed = mixed.unionByName(o.filter("not foreign and n = 0").select("word", "s").join(one, "s").select("word", "right", "n_right", F.lit(1).alias("rank")))
    best = F.max("rank").over(Window.partitionBy("word"))
    mixed = mixed.withColumn("best", best).filter("rank = best").select("word", "right", "n_right").distinct()
    rights = cut(own.unionByName(foreign).unionByName(mixed).distinct())

    def roles(batches):
        for b in batches:
            out = []
            for e in b.column("entry").to_pylist():
                left, right = e.split("\n")
                x, y = undone(left), undone(right)
                out += [(left, right, i, s) for i, s in enumerate((left + right, f"{left}-{right}", x + y, f"{x}-{y}"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["left", "right", "role", "s"])

    r = breaks.mapInArrow(roles, "left string, right string, role int, s string")
    around = near.groupBy("s").agg(F.collect_list("c").alias("near"))
    r = r.join(asked, "s").join(around, "s", "left").groupBy("left", "right")
    r = r.agg(*[F.max(F.when(F.col("role") == i, F.col("n"))).alias(f"n{i}") for i in range(4)], *[F.max_by("near", F.when(F.col("role") == i, 1)).alias(f"c{i}") for i in (2, 3)])

    def verdicts(batches):
        for b in batches:
            left, right, n0, n1, n2, n3, c2, c3 = (b.column(x).to_pylist() for x in ("left", "right", "n0", "n1", "n2", "n3", "c2", "c3"))
            v = [compound(*x[:2], x[2:6], x[6] or [], x[7] or [], confusions) for x in zip(left, right, n0, n1, n2, n3, c2, c3, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("left"), b.column("right"), pa.array(v, pa.bool_())], names=["left", "right", "compound"])

    return rights, cut(r.mapInArrow(verdicts, "left string, right string, compound boolean")), counts.filter("kind = 1").select("entry", "n")


_ASKED = "k long, line int, kind string, word string, left string, right string, begin int, end int, before string, after string, bad boolean"


def _answers(documents: DataFrame, rights: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(k, line, kind, word, ...): what the texts ask and the corpus answers: joins, and misread words with what they may be (null: by make-up)."""
    sieve = Sieve(rights.select(F.xxhash64("word").alias("h")).distinct(), "h")

    def each(batches):
        known: dict[str, tuple[bool, bool]] = {}
        for b in batches:
            out = []
            for k, text, gone in zip(*(b.column(c).to_pylist() for c in ("k", "text", "gone")), strict=True):
                lines = text.split("\n")
                for line, kind, word, left, right, begin, end, before, after in walk(lines, runs_of(lines, set(gone))):
                    bad = False
                    if kind == "part":
                        bad = bad_by_make_up(kind, word, begin, end)
                    if kind != "break":
                        if word not in known:  # may be found misread, is misread by its make-up
                            if len(known) > 200_000:
                                known.clear()
                            known[word] = (sieve.hit(xxhash.xxh64_intdigest(word.encode(), 42)), bad_by_make_up("word", word, 0, 0))
                        bad = bad or (kind != "part" and known[word][1])
                        if not bad and not known[word][0]:
                            continue
                    out.append((k, line, kind, word, left, right, begin, end, before, after, bad))
            types = (pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _ASKED.split(", ")])

    rows = documents.filter("kind = -1").select("k", "text", "gone").mapInArrow(each, _ASKED)
    rows = rows.join(verdicts, ["left", "right"], "left").filter("kind = 'word' or compound = (kind = 'half')")
    best = rights.groupBy("word").agg(F.max_by("right", F.struct("n_right", "right")).alias("best"))
    rows = rows.join(best, "word", "left")
    part = F.substring(F.col("best"), F.col("begin") + 1, F.col("end") - F.col("begin")) != F.substring(F.col("word"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    told = F.when(F.col("kind") == "part", F.col("word").rlike("^[а-яё]+$") & (F.length("best") == F.length("word")) & part).otherwise(F.col("best").isNotNull())
    return rows.withColumn("misread", (F.col("kind") != "break") & (F.col("bad") | F.coalesce(told, F.lit(False))))


def scan_noise(attachments: DataFrame, key: str = "id", text: str = "ocr_text") -> DataFrame:
    """(attachment_id, line_no, kind) of every line to drop, to join with the next one, or with a misread character.

    Null and empty texts give nothing; a repeated key counts once.
    """
    documents = _documents(attachments, key, text, False)
    rights, verdicts, _ = _tables(documents)
    x = _answers(documents, rights, verdicts)
    out = x.select("k", "line", F.when(F.col("kind") == "break", "join").when(F.col("misread"), "char").alias("kind")).filter("kind is not null").distinct()
    drop = documents.filter("kind = -1").select("k", F.explode("gone").alias("line"), F.lit("drop").alias("kind"))
    return drop.unionByName(out).select(F.col("k").alias("attachment_id"), (F.col("line") + 1).cast("long").alias("line_no"), "kind")


def running_text(attachments: DataFrame, key: str = "id", text: str = "ocr_text") -> DataFrame:
    """(attachment_id, text): every text that is not empty, repaired and reflowed.

    Where a misread word may be several, the one that stands most often beside its neighbours is taken, then the most frequent.
    """
    documents = _documents(attachments, key, text, True)
    rights, verdicts, pairs = _tables(documents)
    x = cut(_answers(documents, rights, verdicts))
    joins = x.filter("kind = 'break'").groupBy("k").agg(F.collect_set("line").alias("joins"))
    may = x.filter("kind != 'break'").select("k", "word", "before", "after").join(rights, "word")
    for name, a, b in (("n_before", "before", "right"), ("n_after", "right", "after")):
        p = pairs.select(F.col("entry").alias("_entry"), F.col("n").alias(name))
        may = may.join(p, F.concat_ws(" ", a, b) == F.col("_entry"), "left").drop("_entry")
    may = may.groupBy("k", "word", "right", "n_right").agg(F.sum(F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))).alias("beside"))
    chosen = may.groupBy("k", "word").agg(F.max_by("right", F.struct("beside", "n_right", "right")).alias("right"))
    chosen = chosen.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("rights"))

    def each(batches):
        for b in batches:
            k, t, gone, heads, joins, rights = (b.column(c).to_pylist() for c in ("k", "text", "gone", "heads", "joins", "rights"))
            done = [reflowed(x, set(g), set(h), set(j or ()), dict(r or ())) for x, g, h, j, r in zip(t, gone, heads, joins, rights, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(done, pa.string())], names=["attachment_id", "text"])

    d = documents.filter("kind = -1").select("k", "text", "gone", "heads").join(joins, "k", "left").join(chosen, "k", "left")
    return d.mapInArrow(each, "attachment_id long, text string")
