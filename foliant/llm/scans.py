"""Problem 5: repair of text read from scanned pages.

Method: an averaged perceptron edits words character by character (keep, replace, delete, insert) and decides at line ends
(join, join with the hyphen, leave apart). It is trained here: words that no clean book has are aligned with their only
near neighbour in the clean vocabulary, which gives the confusions of these scans; clean words and numbers spoiled with
them, and clean words divided anywhere, are the training data. Every unknown word is counted and every clean word is in a
lesson; where these are too many for one perceptron, parts of the words train one each and the weights are averaged. Decoding ranks the edits of a word by the weights of their
operations in context; those without weight in their favour are out, and the first that gives a word of the vocabulary
(numbers: digits throughout) is made. Without weights nothing is mended and nothing is joined.

Running heads, feet and page numbers are found by their place on the page and by how many of the book's pages
repeat them, digits and confusable characters aside. The heads of a chapter count like those of the whole book.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import cut_lineage, latest, read_table

VOCABULARY = 200_000  # most frequent words that are sent to every task; pages get their own share of the others by a join
PART = 6_000  # words from which one perceptron is trained; of more words each part trains one
LESSONS = 6_000  # spoiled words, and as many divided ones, drawn for a perceptron, besides one of each word not drawn
KNOWN, SURE = 2, 5  # occurrences from which a word of clean text counts as right, and from which others may be taken for it
OWN = 0.02  # share of a word's count from which an unknown word like it counts as a word of its own
REPEATED, NUMBERED = 3, 2  # chunks of a book that have a running line, whatever the book's length; one with a page number
SCANNED = 0.2  # share of a book's chunks that bear signs of a scan
HYPHENS = "-­‐‑¬"
_PAGE = re.compile(r"^[\s\-–—\[(|.•*]*(?:(?:page|pagc|poge|p\.?|seite)\s*)?([0-9lIoOsSbBzZgq]{1,5})[\s\-–—\])|.•*]*$", re.I)
_EDGE_NUMBER = re.compile(r"^\s*[0-9lioszbgq]{1,5}(?=\s)|(?<=\s)[0-9lioszbgq]{1,5}\s*$")
_BREAK = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}]\s*$")
_SUSPENDED = frozenset("and or to und oder et ou y o bis".split())
_TAIL = frozenset("the a an of to in and or is are was were by for at on with that as it its from their this no not when which than then if each some most neither nor what under there such because only".split())
_CORE = re.compile(r"[^\W_](?:[\w\-‐­'’]*[^\W_])?")
#: Characters that scans take for one another, to one representative (fixed values).
_FOLD = str.maketrans({"0": "o", "c": "o", "e": "o", "a": "o", "1": "l", "i": "l", "t": "l", "f": "l", "j": "l", "!": "l", "5": "s", "6": "b", "h": "b", "8": "b", "u": "n", "v": "y", "9": "g", "q": "g", "2": "z"})
#: Letters that scans put in the place of digits (fixed values); numbers spoiled with them are training data.
_LETTERS = {"o": "0", "l": "1", "i": "1", "s": "5", "b": "6", "z": "2", "g": "9", "q": "9", "t": "7"}


def fold(line: str) -> str:
    s = _EDGE_NUMBER.sub(" ", _EDGE_NUMBER.sub(" ", line.lower()))
    s = re.sub(r"[^\w ]+", " ", s).replace("rn", "m").translate(_FOLD)
    return re.sub(r"[\W\d_]+", "", s)


def is_page_number(line: str) -> bool:
    m = _PAGE.match(line)
    return bool(m) and (any(map(str.isdigit, m.group(1))) or line.strip().lower()[:3] in ("pag", "pog")) and len(line.strip()) <= 16


def may_run(line: str) -> bool:
    """Whether a line could be a running head or foot: short, not the start or the end of a sentence."""
    s = line.strip()
    if not 3 <= len(s) <= 90 or s.startswith("#") or s[-1] in ".?!,;:" + HYPHENS or s[0].islower():
        return False
    last = re.sub(r"\W", "", s.split()[-1].lower())
    return last not in _TAIL and not is_page_number(s) and any(map(str.isalpha, s))


def folds(line: str) -> set[str]:
    """The fold of a line that could run, and those of its parts around a bar."""
    parts = line.split("|") if line.count("|") == 1 else []
    return {f for f in (fold(line), *map(fold, parts)) if len(f) >= 5}


def has_edge_number(line: str) -> bool:
    """Whether a page number stands apart at the start or the end of the line."""
    return bool(re.match(r"\s*[0-9lIoOsSbB]{1,5}\s{2,}\S", line) and re.match(r"\s*\S*\d", line) or re.search(r"\S\s{2,}[lIoOsSbB]?\d[0-9lIoOsSbB]{0,4}\s*$", line))


def is_numbered(line: str) -> bool:
    """Whether a line may be a head with its page number: a number apart, or at the edge of two words or more."""
    m = _EDGE_NUMBER.search(line.lower())
    return has_edge_number(line) or bool(m) and any(map(str.isdigit, m.group())) and len(line.split()) >= 3


def near(a: str, b: str, most: int = 2) -> bool:
    """Whether two strings are within ``most`` edits."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def furniture(lines: list[str], heads: list[str]) -> set[int]:
    """Numbers of the lines that are running heads, feet or page numbers.

    Page position counts: a page number stands alone in its line at an edge of the page, which is an edge of the chunk,
    a blank line or another such line. A line like a known head is one anywhere; one that only resembles it, at an edge.
    A head that ends in ``#`` is known with a page number only.
    """
    solid = [i for i, x in enumerate(lines) if x.strip()]
    known, numbered = {h for h in heads if h[-1:] != "#"}, {h[:-1] for h in heads if h[-1:] == "#"}
    out = {i for i in solid if known and may_run(lines[i]) and not known.isdisjoint(folds(lines[i]))}
    out |= {i for i in solid if numbered and may_run(lines[i]) and is_numbered(lines[i]) and not numbered.isdisjoint(folds(lines[i]))}
    edge = {*solid[:2], *solid[-2:]}
    out |= {i for i in edge if may_run(lines[i]) and (has_edge_number(lines[i]) or lines[i].isupper() and len(lines[i].split()) >= 2)}
    out |= {i for i in edge & set(solid) if i not in out and known and may_run(lines[i]) and any(len(h) > 8 and near(f, h) for f in folds(lines[i]) for h in known)}
    for _ in range(2):
        for i in solid:
            if i not in out and (is_page_number(lines[i]) or (i - 1 in out or i + 1 in out) and may_run(lines[i]) and (has_edge_number(lines[i]) or lines[i].isupper() and len(lines[i].split()) >= 2)):
                before, after = lines[i - 1].strip() if i else "", lines[i + 1].strip() if i + 1 < len(lines) else ""
                alone = any(not x.isalnum() for x in lines[i].strip()) or _BREAK.search(before)  # marked as a page number, or within a word
                if alone or i in edge or not before or not after or i - 1 in out or i + 1 in out:
                    out.add(i)
    return out


def _words(line: str) -> Iterator[str]:
    for m in _CORE.finditer(line):
        yield m.group().lower().replace("­", "").replace("‐", "-").replace("’", "'")


class Perceptron:
    """Averaged weights by (feature, operation)."""

    def __init__(self):
        self.weights, self._sum, self._at, self._t = {}, defaultdict(float), defaultdict(int), 0

    def score(self, features: list[str], op: str) -> float:
        get = self.weights.get
        return sum([get((f, op), 0.0) for f in features])

    def update(self, features: list[str], op: str, by: float) -> None:
        for f in features:
            k = (f, op)
            w = self.weights.get(k, 0.0)
            self._sum[k] += (self._t - self._at[k]) * w
            self._at[k] = self._t
            self.weights[k] = w + by

    def average(self) -> None:
        self.weights = {k: (self._sum[k] + (self._t - self._at[k]) * w) / max(self._t, 1) for k, w in self.weights.items()}
        self._sum.clear()
        self._at.clear()


class Editor:
    """The character editor. Operations are ``r:x`` and ``s:xy`` (replace by one or two characters), ``d`` (delete),
    ``i:x`` (keep and insert) and ``=`` (keep); at line ends ``join``, ``hyphen`` and ``apart``."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.confusions, self.model, self.line_ends, self.cache = vocabulary, {}, Perceptron(), Perceptron(), {}
        self.inventory: dict[str, list[tuple[str, str, list[str]]]] = {}

    @staticmethod
    def features(w: str, i: int) -> list[str]:
        p, c, n = w[i - 1] if i else "^", w[i], w[i + 1] if i + 1 < len(w) else "$"
        odd = c.isdigit() and (p.isalpha() or n.isalpha())
        among = not c.isdigit() and (p.isdigit() or n.isdigit())
        return [f"c{c}", f"p{p}{c}", f"n{c}{n}", f"t{p}{c}{n}", f"d{odd}{among}{c}"]

    def edits(self, w: str) -> list[tuple[float, int, str, str]]:
        """(score, place, what is seen, what is meant) of the edits that the weights speak for, best first."""
        out = []
        for i, c in enumerate(w):
            for seen, meant, ops in self.inventory.get(c, ()):
                if w.startswith(seen, i):
                    s = self.edit_score(w, i, ops)
                    if s > 0:
                        out.append((s, i, seen, meant))
        out.sort(key=lambda e: (-e[0], e[1:]))
        return out

    def edit_score(self, w: str, i: int, ops: list[str]) -> float:
        return sum(self.model.score(self.features(w, i + j), op) for j, op in enumerate(ops) if op != "=")

    @staticmethod
    def operations(seen: str, meant: str) -> list[str] | None:
        """Operations a character of ``seen`` that give ``meant`` with at most one insertion a character; None if there are none."""
        n, m = len(seen), len(meant)
        cost = np.full((n + 1, m + 1), 99)
        cost[0, 0] = 0
        back = {}
        for i in range(n):
            for j in range(m + 1):
                if cost[i, j] >= 99:
                    continue
                for op, dj, c in (("d", 0, 1), ("r", 1, 1), ("i", 2, 1), ("s", 2, 2)):
                    if j + dj > m or op == "i" and seen[i] != meant[j] or op == "s" and seen[i] == meant[j]:
                        continue
                    c = 0 if op == "r" and seen[i] == meant[j] else c
                    if op == "i" and seen[i] == meant[j]:
                        c = 1
                    if cost[i, j] + c < cost[i + 1, j + dj]:
                        cost[i + 1, j + dj] = cost[i, j] + c
                        back[i + 1, j + dj] = (j, {"d": "d", "r": "=" if j < m and seen[i] == meant[j] else f"r:{meant[j : j + 1]}", "i": f"i:{meant[j + 1 : j + 2]}", "s": f"s:{meant[j : j + 2]}"}[op])
        if cost[n, m] >= 99:
            return None
        out, j = [], m
        for i in range(n, 0, -1):
            j, op = back[i, j]
            out.append(op)
        return out[::-1]

    def neighbours(self, w: str) -> dict[str, tuple[str, str]]:
        """Vocabulary words one confusion away: (what is seen, what is meant)."""
        if not self.confusions:
            return {x: p for x, p in self.spellings(w).items() if self.vocabulary.get(x, 0) >= SURE}
        pairs = []
        for seen, meant in self.confusions:
            at = w.find(seen)
            while at >= 0:
                pairs.append((w[:at] + meant + w[at + len(seen) :], (seen, meant)))
                at = w.find(seen, at + 1)
        return {x: p for x, p in pairs if self.vocabulary.get(x, 0) >= SURE and x != w}

    @staticmethod
    def spellings(w: str) -> dict[str, tuple[str, str]]:
        """What may be meant by a word with one misreading of any kind."""
        pairs = [(w[:i] + x + w[i + 1 :], (w[i], x)) for i in range(len(w)) for x in "abcdefghijklmnopqrstuvwxyz"]
        pairs += [(w[:i] + x + w[i + 2 :], (w[i : i + 2], x)) for i in range(len(w) - 1) for x in "abcdefghijklmnopqrstuvwxyz"]
        pairs += [(w[:i] + x + w[i + 1 :], (w[i], x)) for i in range(len(w)) for x in ("rn", "cl", "vv", "ii", "ri", "li", "in", "nn", "fi", "fl", "")]
        return {x: p for x, p in pairs if x != w}

    def learn(self, unknown: list[tuple[str, int]], rounds: int = 4, seed: int = 5) -> None:
        """Confusions from unknown words with counts, then weights from clean words spoiled with them."""
        seen = self.count_confusions(unknown)
        self.settle(seen, sum(seen.values()))
        self.learn_edits(self.vocabulary, rounds, seed)
        self.learn_line_ends(self.vocabulary, rounds, seed)

    def count_confusions(self, unknown: Iterable[tuple[str, int]]) -> Counter:
        """(what is seen, what is meant) of the words with only one near neighbour."""
        seen: Counter = Counter()
        for w, n in unknown:
            if len(w) >= 4:
                found = self.neighbours(w)
                if len(found) == 1:
                    seen[next(iter(found.values()))] += min(n, 5)
        return seen

    def settle(self, seen: dict[tuple[str, str], int], total: int) -> None:
        """The confusions, of those seen (at least twice) and their ``total``."""
        seen = dict(sorted(seen.items(), key=lambda e: (-e[1], e[0])))
        least = max(2, 0.005 * total)
        # a confusion that these scans make one way may be rare the other way
        usual = {p for p, n in seen.items() if n >= least}
        self.confusions = {p: n for p, n in seen.items() if p[0] and (p in usual or n >= 2 and (p[::-1] in usual or not p[0].isascii()))}
        self.inventory = {}
        for x, y in self.confusions:
            ops = self.operations(x, y)
            if ops:
                self.inventory.setdefault(x[0], []).append((x, y, ops))

    @staticmethod
    def _plain(counts: dict[str, int]) -> list[str]:
        return [w for w in sorted(counts, key=lambda w: (-counts[w], w)) if w.isalpha() and len(w) > 2]

    def learn_edits(self, counts: dict[str, int], rounds: int = 4, seed: int = 5) -> None:
        rng, words = np.random.default_rng(seed), self._plain(counts)
        lessons = []  # (what is seen, right edits, other edits)
        pairs = [p for p in self.confusions if p[1]]
        chance = np.sqrt([self.confusions[p] for p in pairs])  # rare confusions are learned too
        chance = chance / (2 * chance.sum() or 1) + 0.5 / max(1, len(pairs))
        having = {m: own for m in {m for _, m in pairs} if (own := [w for w in words if m in w])}
        drawn = []  # (what is seen, what is meant, the word)
        for _ in range(min(LESSONS, 40 * len(pairs) + 3 * len(words)) if pairs else 0):
            s, m = pairs[rng.choice(len(pairs), p=chance)]
            if m in having:
                drawn.append((s, m, having[m][rng.integers(len(having[m]))]))
        for w in sorted(set(words) - {w for *_, w in drawn}):  # each word is in a lesson, if it can be spoiled
            fit = [p for p in pairs if p[1] in w]
            if fit:
                drawn.append((*fit[rng.integers(len(fit))], w))
        for s, m, w in drawn:
            at = [i for i in range(len(w)) if w.startswith(m, i)]
            i = at[rng.integers(len(at))]
            seen = w[:i] + s + w[i + len(m) :]
            every = [(j, ops, seen[:j] + y + seen[j + len(x) :]) for j, c in enumerate(seen) for x, y, ops in self.inventory.get(c, ()) if seen.startswith(x, j)]
            lessons.append((seen, [(j, ops) for j, ops, r in every if r == w], [(j, ops) for j, ops, r in every if r != w]))
        for _ in range(LESSONS // 8):  # numbers: every letter among digits stands for one
            w = [str(d) for d in rng.integers(0, 10, rng.integers(2, 6))]
            at = int(rng.integers(len(w)))
            letters = [a for a, d in _LETTERS.items() if d == w[at]]
            if letters:
                digit, w[at] = w[at], letters[rng.integers(len(letters))]
                lessons.append(("".join(w), [(at, [f"r:{digit}"])], [(at, [f"r:{d}"]) for d in sorted(set(_LETTERS.values())) if d != digit]))
        model = self.model
        for _ in range(rounds):
            for k in rng.permutation(len(lessons)):
                w, right, wrong = lessons[k]
                if not right:
                    continue
                model._t += 1
                j, ops = max(right, key=lambda e: self.edit_score(w, *e))
                own = self.edit_score(w, j, ops)
                worse = max(wrong, key=lambda e: self.edit_score(w, *e), default=None)
                if own < 1 or worse is not None and self.edit_score(w, *worse) >= own:
                    for d, op in enumerate(ops):
                        if op != "=":
                            model.update(self.features(w, j + d), op, 1.0)
                    if worse is not None and self.edit_score(w, *worse) >= max(own, 1e-9):
                        for d, op in enumerate(worse[1]):
                            if op != "=":
                                model.update(self.features(w, worse[0] + d), op, -1.0)
        model.average()

    def _line_end(self, left: str, right: str, hidden: str = "") -> list[str]:
        """Features of a line end; ``hidden`` is taken for unknown."""
        known = lambda w: w != hidden and w in self.vocabulary
        whole, parted, stem = known(left + right), known(f"{left}-{right}"), left.rpartition("-")
        tail = right.partition("-")
        part = bool(stem[0] and known(stem[2] + right) or tail[2] and known(left + tail[0]))
        more = whole and parted and self.vocabulary[f"{left}-{right}"] > self.vocabulary[left + right]
        state = f"{whole:d}{parted:d}{part:d}{more:d}"
        sides = f"{known(left):d}{known(right):d}"
        mended = "" if whole or parted or part else f"{self.fix(left + right) is not None:d}{self.fix(f'{left}-{right}') is not None:d}"
        return [f"s{state}", f"m{state}{mended}", f"k{state}{sides}{mended}", f"r{right in _SUSPENDED}", f"a{right[:1].isalpha()}"]

    def learn_line_ends(self, counts: dict[str, int], rounds: int = 4, seed: int = 5) -> None:
        rng, words = np.random.default_rng(seed + 1), self._plain(counts)
        parted = [w for w in sorted(counts) if w.count("-") == 1 and all(map(str.isalpha, w.split("-")))]
        long = [w for w in words if len(w) >= 5]
        lessons, halves = [], [w.split("-") for w in parted]
        drawn = [long[rng.integers(len(long))] for _ in range(min(LESSONS, 3 * len(long)))]
        for w in [*drawn, *sorted(set(long) - set(drawn))]:
            i = int(rng.integers(2, len(w) - 1))
            lessons.append((w[:i], w[i:], w if rng.random() < 0.2 else "", "join"))
            if rng.random() < 0.3:  # the whole has a misread character besides
                some = [(j, x, y) for x, y in self.confusions if y for j in range(len(w)) if w.startswith(y, j)]
                if some:
                    j, x, y = some[rng.integers(len(some))]
                    bad = w[:j] + x + w[j + len(y) :]
                    if bad not in self.vocabulary and len(bad) > 4:
                        lessons.append((bad[:3], bad[3:], "", "join"))
            if rng.random() < 0.3:
                a, b = halves[rng.integers(len(halves))] if halves and rng.random() < 0.7 else (words[rng.integers(len(words))], words[rng.integers(len(words))])
                lessons.append((a, b, f"{a}-{b}" if rng.random() < 0.3 else "", "hyphen"))
                lessons.append((a, sorted(_SUSPENDED)[rng.integers(len(_SUSPENDED))], "", "apart"))
        model = self.line_ends
        cases = [(self._line_end(a, b, h), op) for a, b, h, op in lessons]
        for _ in range(rounds):
            for k in rng.permutation(len(cases)):
                f, op = cases[k]
                model._t += 1
                got = max(("apart", "join", "hyphen"), key=lambda c: model.score(f, c))
                if got != op:
                    model.update(f, op, 1.0)
                    model.update(f, got, -1.0)
        model.average()

    def fix(self, w: str) -> str | None:
        """What was printed, or None if the word seems right or can't be told."""
        if w in self.cache:
            return self.cache[w]
        if len(self.cache) > 300_000:
            self.cache.clear()
        self.cache[w] = out = self._fix(w)
        return out

    def _fix(self, w: str) -> str | None:
        if w.isdigit() or len(w) < 2 or w in self.vocabulary:
            return None
        if "-" in w:
            parts = w.split("-")
            if all(p in self.vocabulary or p.isdigit() or not p for p in parts):
                return None
            fixed = [p if p in self.vocabulary or p.isdigit() or not p else self.fix(p) for p in parts]
            return None if None in fixed else "-".join(fixed)
        if w.endswith("'s"):
            base = self.fix(w[:-2])
            return base and base + "'s"
        edits = self.edits(w)
        found = next((x for _, i, s, m in edits if self.vocabulary.get(x := w[:i] + m + w[i + len(s) :], 0) >= SURE), None)
        digits = sum(map(str.isdigit, w))
        if found is None and (digits or len(w) >= 6):
            two = sorted(((s1 + s2, i, x, y, j, u, v) for k, (s1, i, x, y) in enumerate(edits) for s2, j, u, v in edits[k + 1 :] if i + len(x) <= j or j + len(u) <= i), key=lambda e: -e[0])
            for _, *e in two:
                (i, x, y), (j, u, v) = sorted((e[:3], e[3:]))
                whole = w[:i] + y + w[i + len(x) : j] + v + w[j + len(u) :]
                if self.vocabulary.get(whole, 0) >= SURE:
                    found = whole
                    break
        if digits and (digits * 2 >= len(w) or found is None):
            number = self._number(w)
            if number:
                return number
        return found

    def _number(self, w: str) -> str | None:
        """The token in digits throughout, if every other character has an edit to a digit that the weights speak for."""
        out = ""
        for i, c in enumerate(w):
            if not c.isdigit():
                f = self.features(w, i)
                s, c = max((self.model.score(f, f"r:{d}"), d) for d in "0123456789")
                if s <= 0:
                    return None
            out += c
        return out

    def join(self, left: str, right: str) -> str | None:
        """The whole of a word that a line end divides, or None if the two are words of their own."""
        left, right = left.lower(), right.lower()
        if not right:
            return None
        f = self._line_end(left, right)
        op = max(("apart", "join", "hyphen"), key=lambda c: self.line_ends.score(f, c))
        if op == "apart":
            return None
        whole = left + right if op == "join" else f"{left}-{right}"
        return whole if whole in self.vocabulary else self.fix(whole) or whole


def _first_word(lines: list[str], skip: set[int], start: int = 0) -> str | None:
    for i in range(start, len(lines)):
        if i not in skip and lines[i].strip():
            m = re.match(r"[^\w]*([^\W_][\w\-‐'’]*)", lines[i])
            return m.group(1).rstrip("-‐'’").replace("‐", "-") if m else None
    return None


def faults(content: str, heads: list[str], following: str | None, carried: bool, editor: Editor, known: frozenset[str] = frozenset()) -> list[tuple[int, str, str]]:
    """(line_no, kind, fixed) of a chunk; ``following`` is the first word of the next one, ``carried`` whether the
    chunk before ends inside a word, ``known`` are right words beyond the editor's."""
    lines = content.split("\n")
    gone = furniture(lines, heads)
    out = [(i, "furniture", "") for i in sorted(gone)]
    for i, line in enumerate(lines):
        if i in gone or not line.strip():
            continue
        cores = list(_CORE.finditer(line))
        tokens = [m.group().lower().replace("­", "").replace("‐", "-").replace("’", "'") for m in cores]
        cut = _BREAK.search(line.rstrip()) and not line.rstrip().endswith("--")
        last = len(tokens)
        if cut and tokens:
            nxt = _first_word(lines, gone, i + 1) or following
            whole = editor.join(tokens[-1], nxt) if nxt else None
            last -= 1
            if whole:
                out.append((i, "hyphen", whole))
        for k in range(1 if carried else 0, last):
            fixed = None if tokens[k] in known else editor.fix(tokens[k])
            if fixed:
                out.append((i, "misread", fixed))
        carried = bool(cut and tokens and whole)
    return out


def repaired(content: str, heads: list[str], following: str | None, editor: Editor, known: frozenset[str] = frozenset()) -> str:
    """Continuous paragraphs: furniture gone, lines joined, words mended. The rest of a word that goes on in the next
    chunk is completed here, and stays there too, since a chunk is repaired on its own."""
    lines = content.split("\n")
    gone = furniture(lines, heads)
    out, par, half = [], "", ""
    for i, line in enumerate([*lines, ""]):
        s = line.strip()
        if i in gone:
            continue
        if not s or s.startswith("#"):
            inside = par and not re.search(r"[.!?:][\"'”’)]*$", par) and (i < len(lines)) and not s
            if inside:
                continue  # a page break within a sentence
            if i == len(lines) and half and following:
                half = editor.join(half.rstrip(HYPHENS), following) or half
            if par or half:
                out.append(par + half)
            par, half = "", ""
            if s:
                out.append(s)
            continue
        def mend(m: re.Match) -> str:
            w = m.group().replace("­", "")
            fixed = None if w.lower() in known else editor.fix(w.lower())
            return w if not fixed else fixed.upper() if w.isupper() else fixed.capitalize() if w[0].isupper() else fixed
        m = re.match(r"\S+", s)
        if half and m:
            whole = editor.join(half.rstrip(HYPHENS), _first_word([s], set()) or "")
            rest = m.group()
            mark = re.search(r"[^\w\-‐'’]*$", rest).group()
            par += (whole if whole and half[:1].islower() else (whole or half + " " + rest).capitalize() if half[:1].isupper() and whole else half + " " + rest) + (mark if whole else "")
            s, half = s[m.end() :].strip(), ""
            if not s:
                continue
        if _BREAK.search(s) and not s.endswith("--"):
            cut = s.rsplit(None, 1)
            half = cut[-1]
            s = cut[0] if len(cut) > 1 else ""
        s = _CORE.sub(mend, s)
        par = f"{par} {s}".strip() + (" " if half else "")
    return "\n\n".join(out)


def _signs(chunks: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, content, level, next_id, ingested_at) without the text, but with its hash, whether it bears
    signs of a scan, and its lines that could run, folded."""

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sign, found = [], []
            for text in pdf["content"]:
                lines = text.split("\n") if isinstance(text, str) else []
                sign.append(any(is_page_number(x) for x in lines if x.strip()) or any(bool(_BREAK.search(x)) for x in lines))
                found.append(sorted({f for x in lines if may_run(x) for f in folds(x)}))
            yield pdf.drop(columns="content").assign(sign=sign, folds=found)

    row = F.xxhash64("content", "level", "next_id").alias("row")
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    thin = chunks.select("chunk_id", "ingested_at", "level", "next_id", row, F.col("content").isNotNull().alias("filled"), "content")
    return thin.mapInPandas(signs, f"chunk_id string, ingested_at {types['ingested_at']}, level {types['level']}, next_id string, row long, filled boolean, sign boolean, folds array<string>")


def _profiles(rows: DataFrame) -> DataFrame:
    """(book, heads) of the books that bear signs of a scan, from (book, sign, folds)."""
    books = rows.groupBy("book").agg(F.count("*").alias("chunks"), F.sum(F.col("sign").cast("long")).alias("signs"))
    counts = rows.select("book", F.explode("folds").alias("fold")).groupBy("book", "fold").agg(F.count("*").alias("n")).where(F.col("n") >= NUMBERED)
    # every line that recurs, so a book's list grows with its chapters
    head = F.when(F.col("n") >= REPEATED, F.col("fold")).otherwise(F.concat("fold", F.lit("#")))
    heads = counts.groupBy("book").agg(F.sort_array(F.collect_list(head)).alias("heads"))
    return books.where(F.col("signs") >= SCANNED * F.col("chunks")).join(heads, "book", "left").select("book", F.coalesce("heads", F.array().cast("array<string>")).alias("heads"))


def scanned_pages(chunks: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages (chunk_id, content, heads, following, carried), clean text (content)) of the latest rows of leaf chunks.

    A chunk without metadata belongs to the book that its chunk_id names before ``_l2_``. Which rows count, and which
    books are scans, is settled without the texts; these are then joined once and kept.
    """
    chunks = chunks.select("chunk_id", "content", "level", "next_id", "ingested_at")
    c = latest(_signs(chunks), ["chunk_id"], "ingested_at", [F.col("row")]).where("level = 2 AND filled")
    m = latest(metadata.select("chunk_id", "document_id", "ingested_at"), ["chunk_id"], "ingested_at", [F.col("document_id").asc_nulls_last()]).select("chunk_id", "document_id")
    named = F.nullif(F.regexp_extract("chunk_id", r"^(.*)_l\d+_\d+$", 1), F.lit(""))
    rows = cut_lineage(c.join(m, "chunk_id", "left").select("chunk_id", "ingested_at", "row", "next_id", "sign", "folds", F.coalesce("document_id", named, F.lit("")).alias("book")))
    scanned = cut_lineage(_profiles(rows))
    kept = rows.select("chunk_id", F.col("ingested_at").alias("at"), "row", "book").join(scanned, "book", "left").drop("book")
    texts = chunks.select("chunk_id", "content", "next_id", "ingested_at", F.xxhash64("content", "level", "next_id").alias("row"))
    same = F.col("at").eqNullSafe(F.col("ingested_at"))
    texts = cut_lineage(texts.join(kept, ["chunk_id", "row"]).where(same).dropDuplicates(["chunk_id", "row"]).select("chunk_id", "content", "next_id", "heads"))
    pages, clean = texts.where("heads IS NOT NULL"), texts.where("heads IS NULL").select("content")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first, cut = [], []
            for text, heads in pdf[["content", "heads"]].itertuples(index=False):
                lines = text.split("\n")
                gone = furniture(lines, list(heads))
                first.append(_first_word(lines, gone))
                rest = [x.rstrip() for i, x in enumerate(lines) if i not in gone and x.strip()]
                cut.append(bool(rest and _BREAK.search(rest[-1]) and not rest[-1].endswith("--")))
            yield pd.DataFrame({"id": pdf["chunk_id"], "next": pdf["next_id"], "following": first, "cut": cut})

    ends = cut_lineage(pages.select("chunk_id", "next_id", "content", "heads").mapInPandas(starts, "id string, next string, following string, cut boolean"))
    after = ends.select(F.col("id").alias("next"), F.col("following").alias("then"))
    before = ends.where("cut AND next IS NOT NULL").select(F.col("next").alias("id"), F.lit(True).alias("carried")).distinct()
    # keys are joined first, so that the texts are joined once
    keys = ends.select("id", "next").join(after, "next", "left").join(before, "id", "left").select(F.col("id").alias("chunk_id"), F.col("then").alias("following"), F.coalesce("carried", F.lit(False)).alias("carried"))
    pages = pages.drop("next_id").join(cut_lineage(keys), "chunk_id")
    return pages.select("chunk_id", "content", "heads", "following", "carried"), clean


def _count_words(df: DataFrame) -> DataFrame:
    """(word, n) over the column ``content``; the parts of a word with a hyphen count too."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for t in pdf["content"]:
                for w in _words(t):
                    n[w] += 1
                    if "-" in w:
                        n.update(w.split("-"))
            yield pd.DataFrame({"word": list(n), "n": list(n.values())}, columns=["word", "n"])

    return df.select("content").mapInPandas(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _confusions(editor: Editor, words: DataFrame, strange: DataFrame, more: bool) -> DataFrame:
    """(seen, meant, n) over all unknown words; ``more`` says that the editor hasn't all ``words``, which are then joined."""
    bare = strange.sparkSession.sparkContext.broadcast(editor)
    unknown = strange.where(F.length("word") >= 4)
    if not more:

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                seen = bare.value.count_confusions(pdf[["word", "n"]].itertuples(index=False))
                yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["seen", "meant", "n"])

        found = unknown.mapInPandas(count, "seen string, meant string, n long")
    else:

        def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for some in (pdf.iloc[a : a + 200] for a in range(0, len(pdf), 200)):
                    yield pd.DataFrame([(w, n, x, a, b) for w, n in some[["word", "n"]].itertuples(index=False) for x, (a, b) in Editor.spellings(w).items()], columns=["of", "n", "word", "seen", "meant"])

        sure = words.where(F.col("n") >= SURE).select("word").where("word NOT RLIKE '[0-9]' AND length(word) > 1 OR word IN ('a', 'i')")
        near = unknown.mapInPandas(spell, "of string, n long, word string, seen string, meant string").join(sure, "word")
        found = near.groupBy("of").agg(F.count("*").alias("words"), F.first("seen").alias("seen"), F.first("meant").alias("meant"), F.least(F.first("n"), F.lit(5)).alias("n")).where("words = 1")
    return found.groupBy("seen", "meant").agg(F.sum("n").alias("n"))


def _lesson(step: str, shared) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Trains a perceptron on a part (word, n, part) of the words: (feature, op, weight times updates), and the updates."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, own = shared.value, {w: int(n) for w, n in pdf[["word", "n"]].itertuples(index=False)}
        e = Editor(whole.vocabulary | own)
        e.confusions, e.inventory = whole.confusions, whole.inventory
        e.model.weights = dict(whole.model.weights)
        getattr(e, step)(own, seed=5 + int(pdf["part"].iloc[0]))
        got = e.model if step == "learn_edits" else e.line_ends
        return pd.DataFrame([*((f, op, w * got._t) for (f, op), w in got.weights.items()), ("", "", float(got._t))], columns=["feature", "op", "weight"])

    return learn


def _learn_from_all(editor: Editor, words: DataFrame, strange: DataFrame, more: bool) -> None:
    """Confusions from all ``strange`` words, weights from all ``words``: parts of PART words train a perceptron each,
    and the weights are averaged."""
    seen = cut_lineage(_confusions(editor, words, strange, more))
    total = seen.agg(F.sum("n")).first()[0] or 0
    editor.settle({(a, b): int(n) for a, b, n in seen.where("n >= 2").collect()}, total)  # as many as scans have pairs of characters
    parts = -(-words.count() // PART)
    if parts <= 1 and not more:
        editor.learn_edits(editor.vocabulary)
        editor.learn_line_ends(editor.vocabulary)
        return
    divided = words.where("word NOT RLIKE '[0-9]'").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    for step, model in (("learn_edits", editor.model), ("learn_line_ends", editor.line_ends)):
        shared = strange.sparkSession.sparkContext.broadcast(editor)

        mixed = divided.groupBy("part").applyInPandas(_lesson(step, shared), "feature string, op string, weight double").groupBy("feature", "op").agg(F.sum("weight").alias("weight")).collect()
        whole = next((r.weight for r in mixed if not r.op), 0.0)
        model.weights = {(r.feature, r.op): r.weight / whole for r in mixed if r.op and whole}


def train(pages: DataFrame, clean: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Editor, DataFrame | None]:
    """(an editor for these pages, right words that it doesn't know). Words of clean text are the vocabulary, all of the
    pages' other words teach confusions, all words of clean text edits and line ends. The ``vocabulary`` most frequent words go into the editor, which is sent to all tasks;
    None means that these are all."""
    words = cut_lineage(_count_words(clean).where(F.col("n") >= KNOWN))
    top = words.orderBy(F.desc("n"), "word").limit(vocabulary + 1).toPandas()
    more, top = len(top) > vocabulary, top.iloc[:vocabulary]
    editor = Editor({w: int(n) for w, n in top.itertuples(index=False) if len(w) > 1 and not any(map(str.isdigit, w)) or w in ("a", "i")})
    strange = cut_lineage(_count_words(pages).join(words, "word", "left_anti"))
    _learn_from_all(editor, words, strange, more)
    shared = pages.sparkSession.sparkContext.broadcast(editor)

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A word that is frequent against those it would be taken for is a word of its own."""
        for pdf in batches:
            e = shared.value
            yield pdf[[not any(map(str.isdigit, w)) and all(n >= OWN * e.vocabulary[x] for x in e.neighbours(w)) for w, n in pdf.itertuples(index=False)]]

    own = cut_lineage(strange.where("n >= 8").mapInPandas(own_words, "word string, n long"))
    kept = own.orderBy(F.desc("n"), "word").limit(vocabulary + 1).toPandas()
    more |= len(kept) > vocabulary
    editor.vocabulary |= {w: int(n) for w, n in kept.iloc[:vocabulary].itertuples(index=False)}
    editor.cache.clear()
    return editor, words.select("word").unionByName(own.select("word")) if more else None


def with_rare_words(pages: DataFrame, right: DataFrame | None, editor) -> DataFrame:
    """``pages`` with ``known``: those of their words that ``right`` has and the (broadcast) editor hasn't."""
    if right is None:
        return pages.withColumn("known", F.array().cast("array<string>"))

    def missing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, w) for c, t in pdf.itertuples(index=False) for w in {x for w in _words(t) for x in (w, *w.split("-"))} if w and w not in editor.value.vocabulary and not w.isdigit()]
            yield pd.DataFrame(out, columns=["chunk_id", "word"])

    rare = pages.select("chunk_id", "content").mapInPandas(missing, "chunk_id string, word string").join(right, "word").groupBy("chunk_id").agg(F.collect_set("word").alias("known"))
    return pages.join(rare, "chunk_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def _prepared(spark: SparkSession, sf_dir: str):
    pages, clean = scanned_pages(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "chunk_metadata"))
    editor, right = train(pages, clean)
    shared = spark.sparkContext.broadcast(editor)
    return with_rare_words(pages, right, shared), shared


def page_faults(pages: DataFrame, editor) -> DataFrame:
    """(chunk_id, line_no, kind, fixed), each once; ``editor`` is a broadcast Editor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = pdf[["chunk_id", "content", "heads", "following", "carried", "known"]].itertuples(index=False)
            out = [(c, *x) for c, t, h, f, k, r in some for x in dict.fromkeys(faults(t, list(h), f if isinstance(f, str) else None, bool(k), editor.value, frozenset(r)))]
            yield pd.DataFrame(out, columns=["chunk_id", "line_no", "kind", "fixed"])

    return pages.mapInPandas(run, "chunk_id string, line_no int, kind string, fixed string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_faults(*_prepared(spark, sf_dir))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, editor = _prepared(spark, sf_dir)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [repaired(t, list(h), f if isinstance(f, str) else None, editor.value, frozenset(r)) for t, h, f, r in pdf[["content", "heads", "following", "known"]].itertuples(index=False)]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "repaired": text})

    return pages.select("chunk_id", "content", "heads", "following", "known").mapInPandas(run, "chunk_id string, repaired string")
