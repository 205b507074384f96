"""Toxicity scores: a lexicon trie met by Levenshtein automata, and context windows around what it finds.

Learning (``learn``): from a bounded sample of the labelled rows given, terms - whole words and word
stems - that mark label 1 go into a lexicon with their log odds; then a logistic model is fitted on
what the scan below counts in each text.

Scoring (``score``): the distinct words of a block of texts are looked up at once.  The trie is walked
together with the Levenshtein automata of all of them, which yields exact terms, words that begin with a stem term, terms one edit
away (two for long ones), and words with a beginning as near to a stem, with common letter disguises
(``1`` for ``i`` and so on) undone at no cost.  Stems and terms of four letters get as many edits as
the texts of label 0 bear (``_bearable``), other words at most theirs; terms of three letters get none.

A find counts as quoted between quotation marks (straight ones of one sentence, opening and closing
ones of one paragraph) or within ``WINDOW`` words of a word of report or denial; else as aimed where a
word of address is as near.  The score is the model's probability over these counts.

Null and empty texts count nothing.  A text in which nothing is found gets the model's base score, at most
1/2; so does every text where the sample holds one label alone, or none.  Repeated rows score alike.
Other columns pass through.  Labels, language, source and id are no input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from . import common

#: Labelled rows that a fit reads at most, by hash order of their ids: label 1 and label 0 each.
SAMPLE_ROWS = 6000
#: A text of label 1 speaks for further terms until so many of those chosen are in it.
COVER = 6
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: Least evidence for a term: the log likelihood ratio of its texts' labels against the sample's shares.
EVIDENCE = 9.0
#: Least ratio between the shares of texts of label 1 and of label 0 that hold a term.
RATIO = 5.0
#: Words on each side of a find that make its context.
WINDOW = 4

# Letters that commonly stand for others in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Words of report, denial or mention, and of address.
QUOTING = frozenset("said says wrote quote quoted quotes called word words term phrase slur never not allegedly reported".split())
AIMING = frozenset("you your youre ur u du dein deine tu te toi vous eres tú usted".split())

_WORD = r"[^\W_]+(?:[@$!][^\W_]+)*"
_WORDS = re.compile(_WORD, re.UNICODE)
_MARKS = re.compile("[“”\"«»„]")
_PLAINER = str.maketrans(DISGUISE)
#: Counts of terms that a task holds before it hands them on.
HELD_TERMS = 100_000
#: Characters of text whose words are looked up at once.
BLOCK = 1_000_000

FEATURES = ("exact", "stem", "fuzzy", "quoted", "aimed", "rate", "kinds", "weight")


Terms = dict[tuple[str, bool], float]
#: How a word matches - ``exact``, ``stem`` or ``fuzzy`` - what it would be without edits, the term, and its weight.
Hit = tuple[str, str, str, float]


def _edits(term: str) -> int:
    return 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0


class Trie:
    """Terms by letter; a node is ``[children, term at its end or None, stem that ends there or None, most edits of the terms below]``.

    ``edits`` says how far from a term a word, or from a stem a word's beginning, may be; else their lengths do.
    The terms that bear edits also have a trie of their own.
    """

    def __init__(self, terms: Terms, edits: dict[tuple[str, bool], int] | None = None):
        self.bound = {t: _edits(t[0]) if edits is None else edits[t] for t in terms}
        self.root: list = [{}, None, None, 0]
        self.loose: list = [{}, None, None, 0]
        for (term, stem), weight in terms.items():
            bound = self.bound[term, stem]
            for node in (self.root, self.loose) if bound else (self.root,):
                node[3] = max(node[3], bound)
                for ch in term:
                    node = node[0].setdefault(ch, [{}, None, None, 0])
                    node[3] = max(node[3], bound)
                node[2 if stem else 1] = (term, weight)
        #: Letters of a word that its distances may depend on.
        self.width = max((len(t) + e for (t, _), e in self.bound.items() if e), default=0)
        self.begun = {t[:2] for t, _ in terms}

    def _exact(self, word: str) -> tuple[str, str, float] | None:
        node, stem = self.root, None
        for ch in word:
            node = node[0].get(ch)
            if node is None:
                return stem
            if node[2]:
                stem = ("stem", *node[2])
        return ("exact", *node[1]) if node[1] else stem

    def look_up(self, words: Collection[str]) -> dict[str, Hit]:
        """The best match of each lower-case word that has one."""
        found, rest = {}, []
        for word in words:
            hit = self._exact(word) if word[:2] in self.begun else None
            plain = word if word.isalpha() else word.translate(_PLAINER)
            if hit:
                found[word] = (hit[0], *hit)
            elif plain != word and plain[:2] in self.begun and (hit := self._exact(plain)):
                found[word] = ("fuzzy", *hit)
            else:
                rest.append((word, plain))
        for at, near in self.near([p for _, p in rest]).items():
            best = min(near)
            found[rest[at][0]] = ("fuzzy", "stem" if best[2] else "exact", best[1], best[3])
        return found

    def near(self, words: list[str]) -> dict[int, list[tuple[int, str, bool, float]]]:
        """``(distance, term, stem, weight)`` of all terms within their edits, by the place of the word.

        Walks the trie with the states of all words' Levenshtein automata: a row of distances for each word and node,
        the distances of the letters so far from the word's beginnings.  Where no distance is within the edits of a
        term below, the word's automaton has died and the word goes no further.
        """
        found: dict[int, list[tuple[int, str, bool, float]]] = {}
        if not words or not self.width:
            return found
        width = self.width
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # a word that is longer is no nearer to a whole term than its first letters and one more
        letters = np.zeros((width + 1, len(words)), np.uint32)
        inside = at <= width
        letters[at[inside], np.repeat(np.arange(len(words)), sizes)[inside]] = flat[inside]
        sizes = np.minimum(sizes, width + 1)
        first = np.repeat(np.arange(width + 2, dtype=np.uint8 if width < 200 else np.int32)[:, None], len(words), axis=1)
        stack = [(self.loose, np.arange(len(words)), first)]
        while stack:
            node, alive, rows = stack.pop()
            for ends, stem in ((node[1], False), (node[2], True)):
                if ends:
                    d = rows.min(axis=0) if stem else rows[sizes[alive], np.arange(len(alive))]
                    for i in np.flatnonzero((d > 0) & (d <= self.bound[ends[0], stem])).tolist():
                        found.setdefault(int(alive[i]), []).append((int(d[i]), ends[0], stem, ends[1]))
            here = letters[:, alive] if node[0] else letters
            for ch, child in node[0].items():
                new = np.empty_like(rows)
                new[0] = rows[0] + 1
                np.minimum(rows[:-1] + (here != ord(ch)), rows[1:] + 1, out=new[1:])
                for j in range(1, width + 2):
                    np.minimum(new[j], new[j - 1] + 1, out=new[j])
                keep = new.min(axis=0) <= child[3]
                if keep.any():
                    stack.append((child, alive[keep], new[:, keep]))
        return found


def _near(trie: Trie, words: Collection[str]) -> dict[str, list[tuple[int, str, bool, float]]]:
    """The terms near each word that is no match without an edit."""
    rest = [(w, p) for w in words if not trie._exact(w) and not trie._exact(p := w.translate(_PLAINER))]
    return {rest[at][0]: near for at, near in trie.near([p for _, p in rest]).items()}


Find = tuple[int, int, str, str, bool]


def _quotations(line: str, marks: list[int]) -> list[tuple[int, int]]:
    """Spans between an opening and the next closing mark; straight marks open after white space and before none."""
    spans, start, by = [], None, ""
    for at in marks:
        mark = line[at]
        apart = (at == 0 or not line[at - 1].isalnum() and line[at - 1] not in ".,!?") and at + 1 < len(line) and not line[at + 1].isspace()
        opens = {"\"": apart, "“": by != "„", "„": True, "«": by != "»", "»": by != "«" and apart}.get(mark, False)
        if opens:
            start, by = at, mark
        elif start is not None:
            spans.append((start, at))
            start, by = None, ""
    return spans


def _finds(low: str, hits: dict[str, Hit]) -> Iterator[tuple[Find, str, float, bool]]:
    """The finds of a text in lower case, with what they would be without edits, their weights, and whether they are aimed; contexts end with the paragraph."""
    start = 0
    for line in low.split("\n"):
        words = _WORDS.findall(line)
        if not hits.keys().isdisjoint(words):
            spans = _quotations(line, [m.start() for m in _MARKS.finditer(line)])
            for i, m in enumerate(_WORDS.finditer(line)):
                if m[0] in hits:
                    kind, plain, term, weight = hits[m[0]]
                    near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
                    quoted = not QUOTING.isdisjoint(near) or any(a < m.start() < b for a, b in spans)
                    yield (start + m.start(), start + m.end(), kind, term, quoted), plain, weight, not quoted and not AIMING.isdisjoint(near)
        start += len(line) + 1


def _scan(low: str, n: int, hits: dict[str, Hit]) -> tuple[list[float], list[Find]]:
    """Features of a text of ``n`` words, and its finds ``(start, end, kind, term, quoted)``."""
    counts = dict.fromkeys(("exact", "stem", "fuzzy", "quoted", "aimed"), 0)
    finds, weight, kinds = [], 0.0, set()
    for find, plain, w, aimed in _finds(low, hits):
        _, _, kind, term, quoted = find
        # a misspelled term speaks as the term does; its edits are such as texts of label 0 bear
        counts["quoted" if quoted else plain] += 1
        counts["fuzzy"] += not quoted and kind == "fuzzy"
        counts["aimed"] += aimed
        if not quoted:
            weight += max(0.0, w)
            kinds.add(term)
        finds.append(find)
    strong = counts["exact"] + counts["stem"]
    return [*map(math.log1p, counts.values()), math.log1p(200 * strong / (n + 20)), math.log1p(len(kinds)), math.log1p(weight)], finds


_NONE: tuple[list[float], list[Find]] = ([0.0] * len(FEATURES), [])


def lower(text: str) -> str:
    """In lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def scan_all(texts: list[str | None], trie: Trie) -> Iterator[tuple[list[float], list[Find]]]:
    """Features and finds of each text; the distinct words of a block of texts are looked up at once."""
    at = 0
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size + len(texts[at] or "") <= BLOCK):
            block.append(lower(texts[at] or ""))
            size += len(block[-1])
            at += 1
        held = [_WORDS.findall(low) for low in block]
        hits = trie.look_up(set().union(*held))
        for low, words in zip(block, held, strict=True):
            yield _NONE if hits.keys().isdisjoint(words) else _scan(low, len(words), hits)


def scan(text: str | None, trie: Trie) -> tuple[list[float], list[Find]]:
    return next(scan_all([text], trie))


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, bool, float], ...]
    coefficients: tuple[float, ...]
    intercept: float
    #: The terms' edits; if empty, their lengths decide.
    edits: tuple[int, ...] = ()

    def trie(self) -> Trie:
        edits = {(t, s): e for (t, s, _), e in zip(self.terms, self.edits, strict=True)} if self.edits else None
        return Trie({(t, s): w for t, s, w in self.terms}, edits)

    def probability(self, features: list[float]) -> float:
        """The likelihood of label 1; at most 1/2 where nothing was found."""
        if not any(features):
            return 1 / (1 + math.exp(-max(-30.0, min(0.0, self.intercept))))
        z = self.intercept + sum(a * b for a, b in zip(self.coefficients, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of three words in a row, which copies share."""
    for batch in common.slices(batches):
        keys = []
        for text in batch.column(0).to_pylist():
            words = lower(text or "").split()
            grams = map(" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [" ".join(words)]
            keys.append(min(map(xxh3_64_intdigest, grams)) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["text", "label", "key"])


def _times(text: str | None) -> Counter:
    """How often each term of a text - a word of three letters or more, or its beginning - is in it."""
    terms: Counter = Counter()
    for word, n in Counter(_WORDS.findall(lower(text or ""))).items():
        if len(word) >= 3:
            terms[word, False] += n
            for k in STEM_LENGTHS:
                if len(word) > k:
                    terms[word[:k], True] += n
    return terms


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label each term is once or more, and twice or more, summed in the task."""
    counts: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())

    def rows() -> pa.RecordBatch:
        keys = sorted(set().union(*counts))
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["term", "stem", "zeros", "ones", "zeros2", "ones2"])
        for c in counts:
            c.clear()
        return out

    for batch in common.slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            times = _times(text)
            counts[label].update(times.keys())
            counts[2 + label].update(t for t, n in times.items() if n > 1)
        if sum(map(len, counts)) > HELD_TERMS:
            yield rows()
    yield rows()


def _hold(terms: tuple[tuple[str, bool, float], ...]):
    """Which of the terms each text holds, and which twice."""
    place = {(t, stem): i for i, (t, stem, _) in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows, twice = [], []
            for text in batch.column(0).to_pylist():
                times = _times(text)
                held = sorted(place[t] for t in times.keys() & place.keys())
                rows.append(held)
                twice.append([i for i in held if times[terms[i][:2]] > 1])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(twice, pa.list_(pa.int32()))], names=["label", "held", "twice"])

    return run


def _asked(term: str, stem: bool) -> int:
    """The edits that a term may get if the texts of label 0 bear them."""
    return max(_edits(term), int(len(term) == 4))


def _count_near(terms: tuple[tuple[str, bool, float], ...]):
    """In how many texts of each label a word is one or two edits from each term and no match without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie({(t, s): w for t, s, w in terms}, {(t, s): _asked(t, s) for t, s, _ in terms})
        place = {(t, s): i for i, (t, s, _) in enumerate(terms)}

        counts: Counter = Counter()
        for batch in common.slices(batches, 64):
            held = [set(_WORDS.findall(lower(text or ""))) for text in batch.column(0).to_pylist()]
            known = {w: [(place[t, s], d) for d, t, s, _ in found] for w, found in _near(trie, set().union(*held)).items()}
            for words, label in zip(held, batch.column(1).to_pylist(), strict=True):
                least: dict[int, int] = {}
                for word in words & known.keys():
                    for at, d in known[word]:
                        least[at] = min(d, least.get(at, d))
                counts.update((at, d, label) for at, d in least.items())
        rows = sorted(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(3)] + [pa.array([n for _, n in rows], pa.int64())], names=["at", "edits", "label", "n"])

    return run


def _bearable(terms: tuple[tuple[str, bool, float], ...], counts: dict[tuple[int, int, int], int], ones: int, zeros: int) -> tuple[int, ...]:
    """The most edits at which a term still marks label 1, or meets no text of label 0."""
    out = []
    for at, (term, stem, _) in enumerate(terms):
        edits = _asked(term, stem)
        while edits:
            n1, n0 = (sum(counts.get((at, d, label), 0) for d in range(1, edits + 1)) for label in (1, 0))
            if not n0 or ((n1 + 0.5) / (ones + 1)) / ((n0 + 0.5) / (zeros + 1)) >= RATIO:
                break
            edits -= 1
        out.append(edits)
    return tuple(out)


def _beside(chosen: tuple[tuple[str, bool, float], ...], terms: list[tuple[str, bool, float]]) -> tuple[tuple[str, bool, float], ...]:
    """The chosen terms, and the whole words with evidence that begin with a chosen stem: their misspellings may be far from it."""
    stems = {t for t, stem, _ in chosen if stem}
    return tuple(sorted({*chosen, *(t for t in terms if not t[1] and any(t[0][:k] in stems for k in range(1, len(t[0]) + 1)))}))


def _choose(terms: list[tuple[str, bool, float]], texts: list[tuple[int, list[int], list[int]]]) -> tuple[tuple[str, bool, float], ...]:
    """Greedily the term with the most evidence, by being in a text once or twice, in the texts of label 1 that the chosen ones do not cover yet.

    Words that only come with others - those of a text that was copied often - thus stay out.
    """
    ones, zeros = (sum(t[0] == v for t in texts) for v in (1, 0))
    n0, n1 = np.zeros((2, len(terms))), np.zeros((2, len(terms)))
    held_by: list[list[int]] = [[] for _ in terms]  # the texts of label 1 that hold a term
    for i, (label, held, twice) in enumerate(texts):
        for times, at in enumerate((held, twice)):
            (n1 if label else n0)[times, at] += 1
        for at in held if label else ():
            held_by[at].append(i)
    covered, chosen = [0] * len(texts), []
    free = np.ones(len(terms), bool)
    share = ones / (ones + zeros)
    while len(terms):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = n1 * np.log(n1 / ((n1 + n0) * share)) + np.where(n0 > 0, n0 * np.log(n0 / ((n1 + n0) * (1 - share))), 0.0)
            ratio = ((n1 + 0.5) / (ones + 1)) / ((n0 + 0.5) / (zeros + 1))
        gain = np.where(free & (n1 >= 3) & (ratio >= RATIO), gain, -1.0).max(axis=0)
        best = int(np.argmax(gain))
        if gain[best] < EVIDENCE:
            break
        chosen.append(terms[best])
        free[best] = False
        for i in held_by[best]:
            covered[i] += 1
            if covered[i] == COVER:
                for times in (0, 1):
                    n1[times, texts[i][1 + times]] -= 1
    return tuple(sorted(chosen))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, over features of one spread."""
    spread = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    a = np.c_[x / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the rows of ``labels`` that are given; at most ``sample_rows`` of each label, by hash order of the id."""
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    picked = [marked.where(F.col("label") == v).orderBy(F.xxhash64(F.col("id")), "id").limit(sample_rows) for v in (0, 1)]
    few = picked[0].union(picked[1])
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    near = source.join(F.broadcast(few), "id").select("text", "label").mapInArrow(common.tidy(_keyed), "text string, label int, key long")  # at most 2 * sample_rows ids
    # copies, and most near copies, say no more than one of them; the smallest text stays
    sample = common.stage(near.groupBy("label", "key").agg(F.min("text").alias("text")).select("text", "label"), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return Model((), (0.0,) * len(FEATURES), math.log((ones + 0.5) / (zeros + 0.5)))  # nothing is found, so at most 1/2
    counted = sample.mapInArrow(common.tidy(_count_terms), "term string, stem boolean, zeros long, ones long, zeros2 long, ones2 long").groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "zeros2", "ones2")))

    def evidence(n1: Column, n0: Column) -> Column:
        share = ones / (ones + zeros)
        gain = n1 * F.log(n1 / ((n1 + n0) * share)) + F.when(n0 > 0, n0 * F.log(n0 / ((n1 + n0) * (1 - share)))).otherwise(0.0)
        odds = F.log((n1 + 0.5) / (ones + 1.0)) - F.log((n0 + 0.5) / (zeros + 1.0))
        return F.when((n1 >= 3) & (odds >= math.log(RATIO)), F.struct(gain.alias("gain"), odds.alias("odds")))

    # a term speaks by being in a text, or by being in it twice
    best = F.greatest(evidence(F.col("ones"), F.col("zeros")), evidence(F.col("ones2"), F.col("zeros2")))
    top = counted.where("ones >= 3").withColumn("best", best).where(F.col("best.gain") >= EVIDENCE).orderBy(F.desc("best.gain"), "stem", "term").select("term", "stem", "best.odds").collect()  # terms of at most 2 * sample_rows texts
    strong = [(r["term"], r["stem"], float(r["odds"])) for r in top]
    candidates = _prune(strong)
    held = sample.mapInArrow(common.tidy(_hold(tuple(candidates))), "label int, held array<int>, twice array<int>").collect()  # at most 2 * sample_rows short rows
    trie_terms = _beside(_choose(candidates, [(r["label"], r["held"], r["twice"]) for r in held]), strong)
    near_counts = sample.mapInArrow(common.tidy(_count_near(trie_terms)), "at int, edits int, label int, n long").groupBy("at", "edits", "label").agg(F.sum("n").alias("n")).collect()  # at most four rows a term
    edits = _bearable(trie_terms, {(r["at"], r["edits"], r["label"]): r["n"] for r in near_counts}, ones, zeros)
    model = Model(trie_terms, (0.0,) * len(FEATURES), 0.0, edits)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model.trie()
        for batch in common.slices(batches):
            rows = [x for x, _ in scan_all(batch.column(0).to_pylist(), trie)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = sample.mapInArrow(common.tidy(features), "x array<double>, label int").collect()  # at most 2 * sample_rows short rows
    got.sort(key=lambda r: (r["label"], r["x"]))  # sums in one order
    x, y = np.array([r["x"] for r in got]), np.array([r["label"] for r in got], float)
    # a find never speaks against label 1: features that would are left out, the worst first
    used = list(range(len(FEATURES)))
    while True:
        w, b = np.zeros(len(FEATURES)), 0.0
        w[used], b = _fit(x[:, used], y)
        spread = x.std(axis=0) * w
        worst = min((i for i in used if FEATURES[i] != "quoted"), key=lambda i: spread[i])
        if spread[worst] >= 0:
            break
        used.remove(worst)
    common.unstage(sample)
    return Model(trie_terms, tuple(float(v) for v in w), b, edits)


def _prune(terms: list[tuple[str, bool, float]]) -> list[tuple[str, bool, float]]:
    """Of terms by falling evidence, those of whose words no earlier one speaks: stems before what they begin, words before their own beginnings."""
    kept: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for term, stem, weight in terms:
        if any(term[:k] in stems for k in range(1, len(term) + 1)) or stem and term in begun:
            continue
        kept.append((term, stem, weight))
        if stem:
            stems.add(term)
        begun.update(term[:k] for k in range(1, len(term)))
    return sorted(kept)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", finds_col: str | None = None) -> DataFrame:
    """Adds ``score`` and, if asked for, the finds with their places, terms and whether they are quoted."""
    names = [c for c in (score_col, finds_col) if c]
    base = docs.drop(*names).withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType(base.schema.fields[:])
    schema = schema.add(score_col, "double")
    if finds_col:
        schema = schema.add(finds_col, T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("kind", "string").add("term", "string").add("quoted", "boolean")))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("term", pa.string()), ("quoted", pa.bool_())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        trie = model.trie()
        for batch in common.slices(batches):
            found = list(scan_all(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), trie))
            columns = [*batch.columns, pa.array([model.probability(f[0]) for f in found], pa.float64())]
            if finds_col:
                columns.append(pa.array([[dict(zip(("start", "end", "kind", "term", "quoted"), x, strict=True)) for x in f[1]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return base.mapInArrow(common.tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
