"""Subject areas of documents, by labelling functions whose accuracies are learned.

A text is cut into sentences. For each sentence several labelling functions vote
for a subject, for "none", or abstain: words of a learned lexicon, its phrases,
addresses (headings, designations, coordinates, references), the section around
the sentence, and the source of the document. A latent model learns from all
documents how often each function is right; its posterior decides about each
sentence, and a document has the subjects of enough of its sentences.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterweave.runtime import materialize, small_side

#: At most so many labelled documents train the lexicon, the first by a hash of their ids.
TRAIN_DOCS = 20_000
#: More rows of subject areas are an error.
MOST_AREAS = 1000
#: Words and phrases are hashed to so many features.
FEATURES = 1 << 16
#: A function votes if its likeliest class has this probability.
SURE = 0.6
#: Words are cut to so many letters, which takes off most endings.
STEM = 6
#: Sentences whose class has this probability count as certain; up to so many others are reckoned exactly.
CERTAIN, EXACT = 0.999, 32

#: Parts sentences joined for one search; no pattern crosses it.
_PART = "\0"
_WORD = re.compile(r"[^\W\d_]{2,}")
_WORD_OR_PART = re.compile(r"[^\W\d_]{2,}|\0")
_BREAK = re.compile(r"(?<=[.!?;…])[\"”’)]*\s+(?=[\"“„(\[#=\-–—•*]*\s*[^\W_a-zß-öø-ÿąćęłńóśźż])|[\n\r\f\v\x1c-\x1e\x85\u2028\u2029]+")
_SECTION = re.compile(r"(?:\r?\n[ \t]*){2,}")
_OPENER = re.compile(r"^[\W_]*([^\W\d_][^.,:;!?\n]{1,28}[,:])\s")
_HEADING = re.compile(r"^\W*(?:\[[^\]]*\]|=+.*=+|#\d+\b.*|\W*RA\s.*DEC\s.*)\W*$", re.IGNORECASE)
_MARK = re.compile(r"^\s*(?:\[[^\]]*\d[^\]]*\]|#\d+\s*\[\w+\])\s*")
_SHORT = re.compile(r"\b([A-Za-z]{1,4}(?:\d(?=-))?)(?:([\s-]?\d)\d*[a-z]?\b|\b)")
_HOST = re.compile(r"(?:https?://|www\.|@)([\w-]+(?:\.[\w-]+)+)")


class _Folds(dict):
    """For str.translate: each character's lower case without diacritics, as one character; nothing for a diacritic of its own."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKD", chr(code).lower().translate(_LETTERS))
        self[code] = "".join(c for c in plain if not unicodedata.combining(c))[:1]
        return self[code]


_LETTERS = str.maketrans({"ł": "l", "ß": "s", "æ": "a", "ø": "o"})
_FOLDS = _Folds()


def fold(text: str) -> str:
    """Lower case without diacritics, of the same length unless these are characters of their own."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def opener(sentence: str) -> str | None:
    """The phrase up to the first comma or colon, with numbers as 9."""
    found = _OPENER.match(sentence)
    return re.sub(r"\d+", "9", fold(found[1])) if found else None


def learned_prefixes(texts: list[str]) -> list[str]:
    """What stands before numbers in designations: short words that mostly have a number after them."""
    numbered, all_uses = Counter(), Counter()
    for text in texts:
        found = _SHORT.findall(text)
        all_uses.update(word for word, _ in found)
        numbered.update(word for word, number in found if number)
    return sorted(p for p, n in numbered.items() if n >= 5 and n >= 0.7 * all_uses[p])


class Splitter:
    """Cuts texts into sentences, also where a stop is missing before a usual opening phrase.

    ``openers`` are such phrases, ``prefixes`` those of designations besides
    words of up to four capitals.
    """

    def __init__(self, openers: list[str], prefixes: list[str] = ()) -> None:
        alternatives = "|".join(re.escape(o).replace("9", r"\d+").replace(r"\ ", r"\s+") for o in sorted(openers, key=len, reverse=True))
        self.missing = re.compile(rf"(?<=[^\s.!?;…])\s+(?=(?:{alternatives})\s)") if openers else None
        before = "|".join(["[A-Z]{1,4}", *(re.escape(p) for p in sorted(prefixes, key=len, reverse=True))])
        self.name = re.compile(rf"\b({before})[\s-]?\d+[a-z]?\b")

    def cut(self, text: str) -> list[tuple[int, str]]:
        """(section, sentence) in order; sections are parted by blank lines; headings and bare designations are left out."""
        text = text.replace(_PART, " ")
        # a phrase that opens sentences opens one without a stop before it, too: a line end is put in its place
        if self.missing is not None:
            folded = fold(text)
            ends = [m.end() for m in self.missing.finditer(folded)]
            if ends and len(folded) != len(text):
                places = [i for i, c in enumerate(text) if _FOLDS[ord(c)]]
                ends = [places[end] for end in ends]
            if ends:
                text = "\v".join(text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True))
        out = []
        for number, section in enumerate(_SECTION.split(text)):
            for part in _BREAK.split(section):
                part = part.strip()
                if part and part[0] in "[#":
                    part = _MARK.sub("", part).strip()
                if _WORD.search(part) and not _HEADING.match(part):
                    out.append((number, part))
        if not out:
            return out
        # one search over all sentences: those with designations only are left out
        plain = self.name.sub(" ", _PART.join(s for _, s in out)).split(_PART)
        return [o for o, p in zip(out, plain, strict=True) if _WORD.search(p)]

    def words(self, sentences: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, str]]]:
        """(stems of all sentences, number of stems of each, (sentence, designation prefix or host))."""
        if not sentences:
            return [], np.zeros(0, np.int64), []
        blob = _PART.join(sentences)
        marks = [(m.start(), m[1]) for m in self.name.finditer(blob)]
        marks += [(m.start(), m[1].lower()) for m in _HOST.finditer(blob)] if "." in blob else []
        starts = np.cumsum([0, *(len(s) + 1 for s in sentences)])
        at = np.searchsorted(starts, [m[0] for m in marks], side="right") - 1
        found = _WORD_OR_PART.findall(fold(self.name.sub(" ", blob)))
        parts = np.flatnonzero(np.fromiter((w == _PART for w in found), bool, len(found)))
        sizes = np.diff(np.concatenate(([-1], parts, [len(found)]))) - 1
        return [w[:STEM] for w in found if w != _PART], sizes.astype(np.int64), list(zip(at.tolist(), (m[1] for m in marks), strict=True))


class _Places(dict):
    """The number of a word, remembered for words met before."""

    def __missing__(self, token: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[token] = place = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return place


_PLACES = _Places()


def features(words: list[str], sizes: np.ndarray, phrases: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) of the words or the phrases of two words of sentences, each once in a sentence, in order."""
    number = np.fromiter(map(_PLACES.__getitem__, words), np.int64, len(words))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    if phrases:
        same = rows[1:] == rows[:-1]
        a, b = number[:-1][same].astype(np.uint64), number[1:][same].astype(np.uint64)
        mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
        rows, number = rows[1:][same], (mixed >> np.uint64(40)).astype(np.int64)
    pairs = np.sort(rows * FEATURES + number % FEATURES)
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs
    return pairs // FEATURES, pairs % FEATURES


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row; ``rows`` ascend."""
    out = np.zeros((n, values.shape[1]))
    if len(rows):
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _normal(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Lexicon:
    """What is learned from labelled documents; the last class is "none"."""

    subjects: list[str]
    openers: list[str]
    prefixes: list[str]
    words: np.ndarray
    phrases: np.ndarray
    prior: np.ndarray
    source_votes: dict[str, int]
    addresses: dict[str, np.ndarray] = field(default_factory=dict)

    def posteriors(self, rows: np.ndarray, at: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
        """Class probabilities of each sentence by its features; the prior where it has none."""
        return _normal(_summed(rows, table[at].astype(np.float64), n) + self.prior)


def fit_lexicon(texts: list[tuple[str, str | None, list[str]]], subjects: list[str], rounds: int = 200, tolerance: float = 0.01) -> Lexicon:
    """Learn from (text, source, subjects of the text) which words and addresses tell of which subject.

    Expectation maximization: a sentence of a labelled text is about one of the
    text's subjects or about none; which one is latent. It ends when no
    sentence's probabilities change by more than ``tolerance``.
    """
    index = {s: i for i, s in enumerate(subjects)}
    none, k = len(subjects), len(subjects) + 1
    prefixes = learned_prefixes([text for text, _, _ in texts])
    plain = Splitter([], prefixes)
    cuts = [plain.cut(text) for text, _, _ in texts]
    begin = Counter(o for cut in cuts for _, s in cut if (o := opener(s)))
    total = max(1, sum(begin.values()))
    openers = [o for o, n in begin.items() if n >= 5 and n >= 0.004 * total]
    splitter = Splitter(openers, prefixes)
    lex = Lexicon(subjects, openers, prefixes, np.zeros((FEATURES, k)), np.zeros((FEATURES, k)), np.zeros(k), {})
    sentences, masks, counts = [], np.zeros((len(texts), k)), []
    for n, (text, _, own) in enumerate(texts):
        masks[n, [index[s] for s in own if s in index]] = 1.0
        again = splitter.missing is not None and splitter.missing.search(fold(text))
        found = [s for _, s in (splitter.cut(text) if again else cuts[n])]
        sentences += found
        counts.append(len(found))
    masks[:, none] = 1.0
    sources: dict[str, Counter] = {}
    for _, source, own in texts:
        if source:
            sources.setdefault(source, Counter()).update(s for s in own if s in index)
    lex.source_votes = {s: index[c.most_common(1)[0][0]] for s, c in sources.items() if c}
    if not sentences:
        return lex
    mask = np.repeat(masks, counts, axis=0)
    q = mask.copy()
    q[:, none] *= 0.1
    q /= q.sum(axis=1, keepdims=True)
    words, sizes, marks = splitter.words(sentences)
    views = []
    for phrases in (False, True):
        rows, at = features(words, sizes, phrases)
        by = np.argsort(at, kind="stable")
        views.append((rows, at, rows[by], at[by]))
    for _ in range(rounds):
        prior = np.log(q.sum(axis=0) / q.sum() + 1e-9)
        scores, tables = np.tile(prior, (len(sentences), 1)), []
        for rows, at, rows_by, at_by in views:
            met = _summed(at_by, q[rows_by], FEATURES)
            overall = met.sum(axis=1, keepdims=True) / max(1.0, met.sum())
            tables.append(np.log((met + k * overall + 1e-3) / (met.sum(axis=0) + k + 1e-3 * FEATURES)))
            scores += _summed(rows, tables[-1][at], len(sentences))
        before, q = q, _normal(np.where(mask > 0, scores, -1e9))
        if np.abs(q - before).max() <= tolerance:
            break
    lex.words, lex.phrases, lex.prior = tables[0].astype(np.float32), tables[1].astype(np.float32), prior
    told: dict[str, np.ndarray] = {}
    for row, mark in marks:
        told[mark] = told.get(mark, 0.0) + q[row]
    usual = q.sum(axis=0) / q.sum()
    lex.addresses = {m: np.log((n + k * usual) / (n.sum() + k) / usual) for m, n in told.items()}
    return lex


#: The labelling functions, in the order of a vote pattern's digits.
FUNCTIONS = ("words", "phrases", "address", "section", "source")


def votes(lex: Lexicon, splitter: Splitter, docs: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """(vote pattern of each sentence, sentences of each document) for (text, source): digits to base classes + 1, 0 for an abstention."""
    none, base = len(lex.subjects), len(lex.subjects) + 2
    cuts = [splitter.cut(text) if text else [] for text, _ in docs]
    counts = np.array([len(c) for c in cuts], dtype=np.int64)
    n = int(counts.sum())
    if not n:
        return np.zeros(0, np.int64), counts
    sentences = [s for cut in cuts for _, s in cut]
    words, sizes, marks = splitter.words(sentences)

    def vote(p: np.ndarray) -> np.ndarray:
        return np.where(p.max(axis=1) >= SURE, p.argmax(axis=1) + 1, 0)

    by_words, by_phrases = (vote(lex.posteriors(*features(words, sizes, f), n, t)) for f, t in ((False, lex.words), (True, lex.phrases)))
    # An address alone has little besides designations and numbers; otherwise what it names tells.
    address = np.zeros(n, np.int64)
    known = [(row, lex.addresses[m]) for row, m in marks if m in lex.addresses]
    if known:
        known.sort(key=lambda x: x[0])
        rows = np.array([r for r, _ in known])
        told = _normal(_summed(rows, np.array([v for _, v in known]), n)[np.unique(rows)] + lex.prior)
        address[np.unique(rows)] = vote(told)
    for i in np.flatnonzero(sizes <= 3).tolist():
        if any(c.isdigit() for c in sentences[i]):
            address[i] = none + 1
    # The section around a sentence names the subject that most of its other sentences do, two at least.
    doc = np.repeat(np.arange(len(docs)), counts)
    number = np.array([number for cut in cuts for number, _ in cut], dtype=np.int64)
    change = np.concatenate(([True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])))
    group = np.cumsum(change) - 1
    tally = np.zeros((int(group[-1]) + 1, none), np.int64)
    about = (by_words > 0) & (by_words <= none)
    np.add.at(tally, (group[about], by_words[about] - 1), 1)
    rest = tally[group]
    rest[np.flatnonzero(about), by_words[about] - 1] -= 1
    section = np.zeros(n, np.int64)
    if none:
        top = rest.argmax(axis=1)
        most = rest[np.arange(n), top]
        rest[np.arange(n), top] = -1
        section = np.where((most >= 2) & (most > rest.max(axis=1)), top + 1, 0)
    source = np.repeat([lex.source_votes.get(source or "", -1) + 1 for _, source in docs], counts)
    pattern = np.zeros(n, np.int64)
    for column in (by_words, by_phrases, address, section, source):
        pattern = pattern * base + column
    return pattern, counts


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors of each pattern, accuracy of each function) by expectation maximization.

    A function that votes is right with its own probability, else it names any
    other class alike; classes have a prior. Nothing but the votes is used.
    """
    base = classes + 1
    digits = np.stack([patterns // base ** (len(FUNCTIONS) - 1 - f) % base for f in range(len(FUNCTIONS))], axis=1)
    accuracy = np.array([0.9, 0.85, 0.8, 0.7, 0.2])
    prior = np.full(classes, 1.0 / classes)
    post = np.full((len(patterns), classes), 1.0 / classes)
    for _ in range(rounds if len(patterns) else 0):
        before = accuracy.copy()
        scores = np.tile(np.log(prior), (len(patterns), 1))
        for f in range(len(FUNCTIONS)):
            voted = digits[:, f] > 0
            wrong = np.log((1 - accuracy[f]) / (classes - 1))
            scores[voted] += wrong
            scores[np.flatnonzero(voted), digits[voted, f] - 1] += np.log(accuracy[f]) - wrong
        scores -= scores.max(axis=1, keepdims=True)
        post = np.exp(scores)
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = (weight.sum(axis=0) + 1.0) / (weight.sum() + classes)
        for f in range(len(FUNCTIONS)):
            voted = np.flatnonzero(digits[:, f] > 0)
            right = weight[voted, digits[voted, f] - 1].sum()
            accuracy[f] = np.clip((right + 1.0) / (weight[voted].sum() + 2.0), 0.05, 0.995)
        if np.abs(accuracy - before).max() <= tolerance:
            break
    return post, accuracy


def share_probability(sure: int, sure_content: int, unsure: list[tuple[float, float]], at_least: float) -> float:
    """How probable it is that a class has the share ``at_least`` of a document's content sentences, and one at least.

    ``sure`` sentences are of the class, of ``sure_content`` with content;
    ``unsure`` has for each other sentence the probability that it is of the
    class, and that it has content of another. Reckoned exactly for up to
    ``EXACT`` unsure sentences, by a normal approximation beyond.
    """
    if len(unsure) > EXACT:
        p, o = np.array(unsure).T
        mean = sure - at_least * sure_content + (p * (1 - at_least) - o * at_least).sum()
        spread = (p * (1 - at_least) ** 2 + o * at_least**2 - (p * (1 - at_least) - o * at_least) ** 2).sum()
        return 0.5 * (1 + math.erf((mean + 0.5 * at_least) / math.sqrt(2 * max(spread, 1e-12))))
    states = {(sure, sure_content): 1.0}
    for p, other in unsure:
        after: dict[tuple[int, int], float] = {}
        for (own, content), w in states.items():
            for key, v in (((own + 1, content + 1), p), ((own, content + 1), other), ((own, content), 1 - p - other)):
                if v > 0:
                    after[key] = after.get(key, 0.0) + w * v
        states = after
    return sum(w for (own, content), w in states.items() if own and own >= at_least * content - 1e-9)


def subject_shares(
    docs: DataFrame, labels: DataFrame, areas: DataFrame, train_docs: int = TRAIN_DOCS, at_least: float = 0.25,
    keep: tuple[str, ...] = (), measure: Callable[[], Callable[[str], int]] | None = None,
) -> DataFrame:
    """(doc_id, sentences, shares): of each document its content sentences and each subject's share of them.

    ``sentences`` is their expected number by the posterior probabilities.
    ``shares`` is an array of (subject, share, confidence): the expected share
    and the probability that the subject has the share ``at_least``. Sentences
    about nothing are not counted. Texts are read whole; a null, empty or blank
    text has 0 sentences. ``labels`` (doc_id, subject) train the lexicon, up to
    ``train_docs`` documents; the descriptions of ``areas`` (subject,
    description) do so where a subject has no labels. Everything else, the
    accuracies too, is learned from all documents. Repeated ids are taken each
    for itself; other columns are ignored.

    ``keep`` are columns of ``docs`` to carry along; ``measure`` makes a function
    of a text whose result comes out as ``measured`` (0 for a null text), so that
    texts are read once.
    """
    spark = docs.sparkSession
    area_rows = areas.where("subject is not null").select("subject", "description").limit(MOST_AREAS + 1).collect()
    if len(area_rows) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} subject areas")
    subjects = sorted({r.subject for r in area_rows})
    known = small_side(labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")))
    taught = docs.select("doc_id", "text", "source").where("text is not null").join(known, "doc_id").orderBy(F.xxhash64("doc_id")).limit(train_docs)
    lessons = [(r.text, r.source, r.subjects) for r in taught.toLocalIterator()]
    lessons += [(f"{r.subject}. {r.description or ''}.", None, [r.subject]) for r in area_rows]
    lexicon = spark.sparkContext.broadcast(fit_lexicon(lessons, subjects))
    del lessons
    carried = docs.select("doc_id", *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), "text", "source")
    width = len(keep) + 1
    head = carried.columns[:width]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema[:width])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        splitter = Splitter(lex.openers, lex.prefixes)
        size = measure() if measure else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(width).to_pylist()
                patterns, counts = votes(lex, splitter, list(zip(texts, part.column(width + 1).to_pylist(), strict=True)))
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(patterns, pa.int64()))
                sizes = pa.array([size(t) if size and t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(width)), sizes, lists], names=[*head, "measured", "patterns"])

    voted = materialize(carried.mapInArrow(vote, f"{kinds}, measured bigint, patterns array<bigint>"), "votes")
    # as many rows as there are patterns of votes, whatever the corpus
    tally = voted.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    patterns = np.array([r.pattern for r in tally], np.int64)
    post, _ = learn_accuracies(patterns, np.array([r.n for r in tally], float), len(subjects) + 1)
    decided = spark.sparkContext.broadcast(dict(zip(patterns.tolist(), post, strict=True)))

    def shares_of(own: list[int], of: dict[int, np.ndarray]) -> tuple[float, list[dict]]:
        none = len(subjects)
        expected, sure, unsure = np.zeros(none + 1), Counter(), []
        for pattern, n in Counter(own).items():
            p = of[pattern]
            expected += n * p
            if p.max() >= CERTAIN:
                sure[int(p.argmax())] += n
            else:
                unsure += [p] * n
        content, sure_content = float(expected[:none].sum()), sum(sure.values()) - sure[none]
        told = []
        for c in np.flatnonzero(expected[:none] > 0.01).tolist():
            confidence = share_probability(sure[c], sure_content, [(float(p[c]), float(1 - p[c] - p[none])) for p in unsure], at_least)
            told.append({"subject": subjects[c], "share": float(expected[c]) / content, "confidence": confidence})
        return content, told

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("subject", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())]))
        for batch in batches:
            found = [shares_of(own, decided.value) for own in batch.column(width + 1).to_pylist()]
            columns = [pa.array([t for t, _ in found], pa.float64()), pa.array([f for _, f in found], kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width + 1)), *columns], names=[*head, "measured", "sentences", "shares"])

    struct = "array<struct<subject:string,share:double,confidence:double>>"
    out = voted.mapInArrow(share, f"{kinds}, measured bigint, sentences double, shares {struct}")
    named = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select("doc_id", *named, *(["measured"] if measure else []), "sentences", "shares")


def subjects_of(shares: DataFrame, confidence: float = 0.5) -> DataFrame:
    """(doc_id, subject, confidence): the subjects that a document has with at least this probability, surest row of repeated ids."""
    each = shares.select("doc_id", F.explode("shares").alias("s")).where(F.col("s.confidence") >= confidence)
    return each.groupBy("doc_id", F.col("s.subject").alias("subject")).agg(F.max("s.confidence").alias("confidence"))
