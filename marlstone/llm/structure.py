"""Text quality statistics, and natural prose told from lists, tables, records, code, keywords, filler and noise.

A text's distribution over single function words is compared with each language's profile; the nearest by Jensen-Shannon
divergence is its language. Where no language's words make up a text that is written in sentences, a general prose profile
takes their place. Each line then becomes two distributions, of word kinds (function words, plain words, sentence ends,
numbers, identifiers, ...) and of character classes. Its divergence from the language's prose profile and from each
structural profile, weighed by its words and together with its neighbours' in the same paragraph, assigns it to the
nearest one. Words inside passages that the text keeps repeating count as filler.

Prose profiles are estimated from the samples of marlstone.llm.prose; letters of all scripts count alike.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.prose import LANGUAGES, SAMPLE_CHARS, SAMPLES, zipf_profiles
from marlstone.llm.words import TAG, visible

# Common words of four languages, mostly function words.
FUNCTION_WORDS = {
    "en": """a about after again all although an and another any are as at be because been before behind beside but by can could did do does during
        each either every few for from had has have he her his how however i if in inside into is it its just may me might more most must my near neither
        never no nobody nor not of off on once one only or other our out over own per rather she should since so some such than that the their them then
        there these they this those though through to too under unless until up us very was we were what when where whereas whether which while who why
        will with within without would yet you your two three four five six seven eight nine ten""",
    "de": """aber alle allen als also am an andere auch auf aus bei bis da damit dann das dass dem den denn der des die dies diese dieser doch durch ein
        eine einem einen einer eines er es für gegen hat hatte ich ihr ihre im in ist ja jede jeder jetzt kann kein keine mit nach nicht noch nun nur ob
        obwohl oder ohne schon sehr seit sich sie sind so über um und uns unter vom von vor während war was weil wenn werden wie wieder wir wird wo
        zu zum zur zwischen zwei drei vier fünf sechs sieben acht neun zehn""",
    "fr": """à afin ainsi alors après au aucun aucune aussi autre aux avant avec bien car ce cela ces cet cette chaque chez comme comment contre dans de
        depuis des donc dont du elle en encore entre est et étaient était être eu fait il ils je jamais jusque la le les leur leurs lors lorsque lui mais
        même ne ni nos notre nous on ont ou où par parce pas pendant personne peu plus pour puis qu quand que quel qui quoi sa sans se selon ses si son
        sont sous sur tandis tous tout toute très un une vers vos votre vous a y deux trois quatre cinq six sept huit neuf dix""",
    "es": """a al algo algunos ante antes así aunque bajo cada como con contra cuando de del desde donde dos durante el ella en entre era es esa ese eso
        esta está este esto estos fue ha había hasta hay la las le lo los mas más me mi mientras muy nada nadie ni no nos o otra otro para pero
        poco por porque pues que quien se según ser si sí sin sobre su sus también tan todo todos tras un una uno y ya tres cuatro cinco seis siete
        ocho nueve diez""",
}

#: Word kinds, in the order of a distribution's places; the first is that of the text's own language.
KINDS = ("function", "plain", "title", "ending", "number", "name", "mark", "odd")
_PLACE = {k: i for i, k in enumerate(KINDS)}
#: Character classes.
CLASSES = ("lower", "upper", "digit", "space", "stop", "sign", "foreign")

#: The prior for all prose, in hundredths, and the words that it weighs as much as.
_PROSE_KINDS = {"function": 33, "plain": 48, "title": 4, "ending": 9, "number": 3, "name": 2, "mark": 0.5, "odd": 0.5}
_PROSE_CLASSES = {"lower": 79, "upper": 2, "digit": 1, "space": 15, "stop": 2, "sign": 0.8, "foreign": 0.2}
PRIOR_WORDS = 300
#: The general profile: words of up to SHORT letters stand for function words.
_OTHER_KINDS = {"function": 20, "plain": 61, "title": 5, "ending": 9, "number": 3, "name": 1, "mark": 0.5, "odd": 0.5}
SHORT = 3
#: Function words in the language's own shares that are added to those of a text or paragraph.
SMOOTHING = 10
#: How many words of a paragraph the whole text weighs as much as, where they tell of different languages.
TEXT_WORDS = 6
#: A text is in none of the languages if the nearest one's function words are a smaller share of its words, and if so many
#: of its sentences begin as sentences do.
LEAST_FUNCTION, LEAST_BEGUN = 0.08, 0.8
# Structural profiles, as shares of word kinds and of character classes in hundredths.
PROFILES = {
    "list": ({"plain": 66, "title": 4, "ending": 0.5, "number": 5, "name": 1, "mark": 22, "function": 0.6, "odd": 0.4}, {"lower": 74, "upper": 1, "digit": 2, "space": 15, "stop": 3, "sign": 4, "foreign": 0.2}),
    "numbered list": ({"plain": 66, "title": 4, "ending": 0.5, "number": 24, "name": 3, "mark": 1, "function": 0.6, "odd": 0.4}, {"lower": 74, "upper": 1, "digit": 4, "space": 14, "stop": 3, "sign": 4, "foreign": 0.2}),
    "table": ({"plain": 35, "title": 1, "ending": 0.4, "number": 32, "name": 28, "mark": 3, "function": 0.5, "odd": 0.6}, {"lower": 45, "upper": 1, "digit": 22, "space": 18, "stop": 3, "sign": 11, "foreign": 0.2}),
    "record": ({"plain": 14, "title": 14, "ending": 0.4, "number": 14, "name": 55, "mark": 1, "function": 1, "odd": 0.6}, {"lower": 48, "upper": 6, "digit": 24, "space": 9, "stop": 5, "sign": 8, "foreign": 0.2}),
    "code": ({"plain": 18, "title": 2, "ending": 0.4, "number": 3, "name": 55, "mark": 16, "function": 5, "odd": 0.6}, {"lower": 62, "upper": 4, "digit": 4, "space": 16, "stop": 4, "sign": 10, "foreign": 0.2}),
    "encoded": ({"plain": 2, "title": 1, "ending": 0.2, "number": 20, "name": 66, "mark": 0.3, "function": 0.2, "odd": 10}, {"lower": 36, "upper": 24, "digit": 26, "space": 8, "stop": 0.5, "sign": 5, "foreign": 0.2}),
    "keywords": ({"plain": 96, "title": 2, "ending": 0.3, "number": 0.5, "name": 0.5, "mark": 0.3, "function": 0.3, "odd": 0.3}, {"lower": 86, "upper": 0.5, "digit": 0.3, "space": 12, "stop": 0.4, "sign": 0.6, "foreign": 0.2}),
    "headings": ({"plain": 4, "title": 80, "ending": 0.3, "number": 8, "name": 1, "mark": 6, "function": 0.3, "odd": 0.3}, {"lower": 70, "upper": 11, "digit": 3, "space": 11, "stop": 1, "sign": 4, "foreign": 0.2}),
    "noise": ({"plain": 12, "title": 1, "ending": 4, "number": 0.5, "name": 2, "mark": 1, "function": 1, "odd": 78}, {"lower": 79, "upper": 2, "digit": 1, "space": 13, "stop": 3, "sign": 1, "foreign": 1}),
    "gibberish": ({"plain": 44, "title": 1, "ending": 18, "number": 0.5, "name": 1, "mark": 0.5, "function": 1, "odd": 34}, {"lower": 81, "upper": 1, "digit": 0.3, "space": 13, "stop": 3, "sign": 0.5, "foreign": 0.3}),
    "broken": ({"plain": 4, "title": 1, "ending": 0.5, "number": 0.5, "name": 1, "mark": 1, "function": 1, "odd": 92}, {"lower": 25, "upper": 10, "digit": 0.2, "space": 13, "stop": 1, "sign": 6, "foreign": 45}),
}
PROSE = (*(f"prose {x}" for x in LANGUAGES), "prose other")
OTHER = len(LANGUAGES)
NAMES = (*PROSE, *PROFILES, "filler")

#: The profile of lines that hold nothing but tags.
MARKUP = "code"
#: Words in a row that a text must repeat so many times to count as filler.
FILLER_WORDS, FILLER_TIMES = 8, 3
#: How much two neighbouring lines of a paragraph weigh against the line itself: where the first leaves its sentence
#: open, and where it ends one.
OPEN, CLOSED = 1.1, 0.4
#: Characters that weigh as much as a word, for lines of few long words.
WORD_CHARS = 7

_BARE = re.compile(r"^[^\w]+|[^\w]+$")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’‑-][^\W\d_]+)*")
_NUMBER = re.compile(r"[#(\[]?[+-]?\d+(?:[.,:/-]\d+)*[%)\].:]*")
_RUN = re.compile(r"[bcdfghjklmnpqrstvwxzßç]{5,}|[aeiouyäöüáéíóúàèìòùâêîôû]{4,}|(.)\1\1")
_VOWEL = re.compile(r"[aeiouyœæøı]")
# What UTF-8 looks like where it was read as a one-byte encoding.
_MISREAD = re.compile("[ÂÃÐÑâï][\u0080-\u00bfŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
# Characters of scripts that don't part words with spaces; each counts as a word, the signs behind it with it.
_UNSPACED = re.compile(r"([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")
_STOPS = frozenset(".,;:!?'\"’“”«»，。！？；：、「」《》（）…·؟،।")
_ENDS, _CLOSERS = ".!?。！？؟।…;"[:-1] + "\u037e", "\"')»”」’"


def _script(c: str) -> str | None:
    """A letter's script as far as words keep to one; null for letters that no common language writes with."""
    o = ord(c)
    if o < 0x180 or 0x1E00 <= o < 0x1F00 or c in "ƠơƯư" or 0x218 <= o < 0x21C:
        return "latin"
    if o < 0x250:
        return None
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "other"


def _odd(low: str) -> bool:
    """Whether a word of letters alone can't be one: scripts mixed, encodings misread, or letters that can't be said."""
    scripts = {_script(c) for c in low if c.isalpha()}
    if len(scripts) > 1 or None in scripts or _MISREAD.search(low):
        return True
    if scripts != {"latin"}:
        return False
    if _RUN.search(low):
        return True
    plain = low if low.isascii() else unicodedata.normalize("NFD", low)
    return len(low) > 3 and not _VOWEL.search(plain)


_NUMBERS, _SHARES_OF = zipf_profiles(FUNCTION_WORDS)
_KNOWS = _SHARES_OF > 0
#: Columns of a word's row: its kind if it is no function word, its characters by class but space, whether it is a function
#: word of each language (and short, for OTHER), whether it ends a sentence, and whether it could begin one.
_N_KINDS, _N_CLASSES = len(KINDS), len(CLASSES) - 1
_FLAGS = _N_KINDS + _N_CLASSES
_STOPPED, _OPENS, _UNSPACED_AT = _FLAGS + OTHER + 1, _FLAGS + OTHER + 2, _FLAGS + OTHER + 3
_WIDTH = _UNSPACED_AT + 1


def _row(word: str) -> tuple[list[float], int]:
    """A word's row, and its number among function words, -1 where it is none."""
    if not word.isascii():  # vowel signs and accents belong to their letters
        word = "".join(c for c in unicodedata.normalize("NFC", word) if unicodedata.category(c)[0] != "M") or word
    if len(word) > 5 and word.isupper() and word.isalpha():  # shouted prose is prose
        word = word.lower()
    bare = _BARE.sub("", word)
    low = bare.lower()
    row = [0.0] * _WIDTH
    number = _NUMBERS.get(low, -1)
    closed = word.rstrip(_CLOSERS)
    stopped = bool(bare) and closed[-1:] in _ENDS and closed[-1:] != ""
    if not bare:
        kind = "mark"
    elif _NUMBER.fullmatch(word):
        kind = "number"
    elif _PLAIN.fullmatch(bare) and len(word) - len(bare) <= 4:
        if number < 0 and _odd(low):
            kind = "odd"
        elif word[-1] in _ENDS or word[-2:-1] in tuple(_ENDS) and word[-1] in _CLOSERS:
            kind = "ending"
        else:
            kind = "title" if bare[0].isupper() else "plain"
            if bare == low and len(bare) <= SHORT:
                row[_FLAGS + OTHER] = 1.0
    elif sum(ord(c) > 0x7F and not c.isalpha() for c in word) * 4 > len(word):
        kind = "odd"
    else:
        kind = "name"
    row[_PLACE[kind]] = 1.0
    if number >= 0:
        row[_FLAGS : _FLAGS + OTHER] = _KNOWS[:, number].astype(float).tolist()
    row[_STOPPED], row[_OPENS] = float(stopped), float(bare[:1].isupper() or (bare[:1].isalpha() and bare[:1].upper() == bare[:1].lower()) or not bare[:1].isalpha())
    row[_UNSPACED_AT] = float(bool(_UNSPACED.match(bare)))
    lower = upper = digit = stop = sign = foreign = 0
    for c in word:
        if c.isdigit():
            digit += 1
        elif c in _STOPS:
            stop += 1
        elif ord(c) < 0x80 and not c.isalpha():
            sign += 1
        elif not c.isalpha() or not _script(c):
            foreign += 1
        elif c.isupper():
            upper += 1
        else:
            lower += 1
    row[_N_KINDS:_FLAGS] = (lower, upper, digit, stop, sign, foreign)
    return row, number


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q."""
    out = np.empty((len(p), len(q)), np.float32)
    logs = lambda x: x * np.log2(np.maximum(x, 1e-12))
    own = logs(p).sum(1)
    for j, other in enumerate(q):
        out[:, j] = (own + logs(other).sum()) / 2 - logs((p + other) / 2).sum(1)
    return np.maximum(out, 0)


class WordTable:
    """Remembers what _row gives, a row of an array for each word; starts anew when it has grown large."""

    def __init__(self, limit: int = 300_000) -> None:
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.empty((1_024, _WIDTH), np.float32)
        self.functions = np.empty(1_024, np.int32)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.numbers) > self.limit:
            self.reset()
        numbers = self.numbers
        known = len(numbers)
        out = [numbers.setdefault(w, len(numbers)) for w in words]
        new = list(islice(numbers, known, None))
        while len(numbers) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.functions = np.concatenate([self.functions, np.empty_like(self.functions)])
        if new:
            rows, functions = zip(*map(_row, new), strict=True)
            self.rows[known : len(numbers)] = rows
            self.functions[known : len(numbers)] = functions
        return np.array(out, np.int64)


_TABLE = WordTable()


def _split(line: str) -> list[str]:
    """A line's words; quote marks before it are layout."""
    bare = line.lstrip("> \t|") if line[:1] in "> |" else line
    return bare.split() if bare.isascii() else _UNSPACED.sub(r" \1", bare).split()


def _kinds_and_classes(rows: np.ndarray, flag: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distributions of the words from each start on; flag: whether a word is a function word of its text's language."""
    kinds = rows[:, :_N_KINDS] * (1 - flag[:, None])
    kinds[:, 0] = flag
    sums = np.add.reduceat(np.hstack([kinds, rows[:, _N_KINDS:_FLAGS], 1 - rows[:, _UNSPACED_AT :]]), starts, axis=0)
    counts = np.insert(sums[:, _N_KINDS:-1], 3, sums[:, -1], axis=1)  # one space a word
    return sums[:, :_N_KINDS] / sums[:, :_N_KINDS].sum(1, keepdims=True), counts / np.maximum(counts.sum(1, keepdims=True), 1)


def _estimated() -> tuple[np.ndarray, np.ndarray]:
    """The prose profiles: of each language its sample with the prior, and the general one; then the structural profiles."""
    norm = lambda x: (a := np.array(x, np.float64)) / a.sum()
    prior, letters = norm([_PROSE_KINDS[k] for k in KINDS]), norm([_PROSE_CLASSES[c] for c in CLASSES])
    kinds, classes = [], []
    for at, language in enumerate(LANGUAGES):
        found = [w for line in SAMPLES[language][:SAMPLE_CHARS].splitlines() for w in _split(line)]
        rows = np.array([_row(w)[0] for w in found])
        k, c = _kinds_and_classes(rows, rows[:, _FLAGS + at], np.array([0]))
        weight = len(found) / (len(found) + PRIOR_WORDS)
        kinds.append(weight * k[0] + (1 - weight) * prior)
        classes.append(weight * c[0] + (1 - weight) * letters)
    kinds.append(norm([_OTHER_KINDS[k] for k in KINDS]))
    classes.append(letters)
    for k, c in PROFILES.values():
        kinds.append(norm([k.get(x, 0.2) + (0.6 if x == "function" else 0) for x in KINDS]))
        classes.append(norm([c[x] for x in CLASSES]))
    return np.array(kinds, np.float32), np.array(classes, np.float32)


_KIND_PROFILES, _CLASS_PROFILES = _estimated()


def languages(functions: np.ndarray, group_of: np.ndarray, n_groups: int) -> np.ndarray:
    """How far each group of words is from each language: words that are none of its function words are wholly apart (1 bit),
    the others as far as their shares, one by one, diverge from the language's. To the group's function words SMOOTHING more are
    added that have the language's own shares, so that few words don't tell more than they can.

    functions: the number of each word among function words, or -1; group_of: the group of each word.
    """
    size = np.maximum(np.bincount(group_of, minlength=n_groups), 1)[:, None]
    hit = functions >= 0
    pair, often = np.unique(group_of[hit] * len(_NUMBERS) + functions[hit], return_counts=True)
    group, word = pair // len(_NUMBERS), pair % len(_NUMBERS)
    q = _SHARES_OF[:, word].T
    columns = lambda x: np.stack([np.bincount(group, weights=x[:, j], minlength=n_groups) for j in range(OTHER)], axis=1)
    own = np.where(q > 0, often[:, None], 0)
    total = columns(own)
    p = (own + SMOOTHING * q) / (total + SMOOTHING)[group]
    logs = lambda x, y: x * np.log2(np.maximum(x, 1e-12) / np.maximum(y, 1e-12))
    # What the group's own words add; of the language's other words each has the same fraction of its share.
    left = SMOOTHING / (total + SMOOTHING)
    others = (logs(left, (left + 1) / 2) + logs(1, (left + 1) / 2)) / 2
    single = columns((logs(p, (p + q) / 2) + logs(q, (p + q) / 2)) / 2) + (1 - columns(q)) * others
    return 1 - total / size * (1 - single)


def shape(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of its characters by place in NAMES (zeros for a null or blank text)."""
    words: list[str] = []
    line_words, line_chars, line_text, gap, ends = [], [], [], [], []
    tagged = [0] * len(texts)
    for t, text in enumerate(texts):
        blank = True
        text = visible(text) if text else ""
        if "<" in text:
            text = TAG.sub(lambda tag: " ".join(tag[0].splitlines()), text)  # a tag over several lines is one of the first
        for line in text.splitlines():
            bare = TAG.sub(" ", line) if "<" in line else line
            found = _split(bare)
            if not found:
                blank = True
                if bare != line:  # nothing but tags
                    tagged[t] += len(line.strip()) + 1
                continue
            words += found
            line_words.append(len(found))
            line_chars.append(len(line.strip()) + 1)
            line_text.append(t)
            gap.append(blank)
            ends.append(found[-1].endswith((".", "!", "?")))
            blank = False
    shares = np.zeros((len(texts), len(NAMES)), np.float64)
    shares[:, NAMES.index(MARKUP)] = tagged
    if not words:
        return np.sign(shares), np.zeros(len(texts), np.int64)
    numbers = _TABLE.lookup(words)
    n_words, chars, owner, gap = np.array(line_words), np.array(line_chars, np.float64), np.array(line_text), np.array(gap)
    starts = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    line_of = np.repeat(np.arange(len(n_words)), n_words)
    text_of = owner[line_of]
    rows = _TABLE.rows[numbers]
    block = np.cumsum(gap | np.append(True, owner[1:] != owner[:-1])) - 1
    language = _languages_of(rows, _TABLE.functions[numbers], text_of, block[line_of])[block]
    flag = rows[np.arange(len(rows)), _FLAGS + language[line_of]]
    kinds, classes = _kinds_and_classes(rows, flag, starts)
    apart = divergence(kinds, _KIND_PROFILES) + 0.5 * divergence(classes, _CLASS_PROFILES)
    apart[:, : len(PROSE)] = np.where(np.arange(len(PROSE)) == language[:, None], apart[:, : len(PROSE)], np.inf)
    weight = np.maximum(n_words, chars / WORD_CHARS)[:, None]
    joined = weight * apart
    inner = ~gap[1:]
    link = np.where(np.array(ends[:-1], bool), CLOSED, OPEN)[:, None]
    shared = (link * np.minimum(weight[1:], weight[:-1]))[inner]  # no neighbour has more words than the line itself
    joined[1:][inner] += shared * apart[:-1][inner]
    joined[:-1][inner] += shared * apart[1:][inner]
    nearest = joined.argmin(1)
    # Filler: stretches of words that occur FILLER_TIMES times or more in the same text.
    repeated = _repeated(numbers, text_of)
    filler = np.add.reduceat(repeated.astype(np.float64), starts) / n_words
    np.add.at(shares, (owner, nearest), chars * (1 - filler))
    np.add.at(shares, (owner, np.full(len(owner), len(NAMES) - 1)), chars * filler)
    total = shares.sum(1)
    shares[total > 0] /= total[total > 0, None]
    return shares, np.bincount(owner, weights=n_words, minlength=len(texts)).astype(np.int64)


def _languages_of(rows: np.ndarray, functions: np.ndarray, text_of: np.ndarray, block_of: np.ndarray) -> np.ndarray:
    """The place in PROSE of each paragraph's language: the nearest, with the whole text's; or OTHER in texts in sentences that
    lack its words.
    """
    n_texts, n_blocks = int(text_of[-1]) + 1, int(block_of[-1]) + 1
    first = np.flatnonzero(np.append(True, block_of[1:] != block_of[:-1]))
    size = np.bincount(block_of, minlength=n_blocks)
    apart = size[:, None] * languages(functions, block_of, n_blocks) + TEXT_WORDS * languages(functions, text_of, n_texts)[text_of[first]]
    language = apart.argmin(1)
    count = lambda x: np.bincount(text_of, weights=x, minlength=n_texts)
    known = count(rows[np.arange(len(rows)), _FLAGS + language[block_of]]) / np.maximum(count(np.ones(len(rows))), 1)
    stopped = rows[:, _STOPPED] > 0
    begins = np.append(True, stopped[:-1] | (text_of[1:] != text_of[:-1]))
    begun = count(begins & (rows[:, _OPENS] > 0)) / np.maximum(count(begins), 1)
    sentences = (count(stopped) > 0) & (begun >= LEAST_BEGUN)
    return np.where(((known < LEAST_FUNCTION) & sentences)[text_of[first]], OTHER, language)


def _repeated(numbers: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Marks the words inside FILLER_WORDS-word stretches that a text holds FILLER_TIMES times or more."""
    n = FILLER_WORDS
    marked = np.zeros(len(numbers), bool)
    if len(numbers) < n * FILLER_TIMES:
        return marked
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        code = text_of.astype(np.uint64)[: len(numbers) - n + 1] * mix
        for j in range(n):
            code = (code ^ numbers[j : len(numbers) - n + 1 + j].astype(np.uint64)) * mix
            code ^= code >> np.uint64(29)
    inside = text_of[: len(code)] == text_of[n - 1 :]
    _, where, often = np.unique(code, return_inverse=True, return_counts=True)
    hit = np.flatnonzero((often[where] >= FILLER_TIMES) & inside)
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge)[:-1] > 0


_SHAPE = T.StructType([T.StructField("profile", T.StringType()), T.StructField("prose_share", T.DoubleType()), T.StructField("profile_share", T.DoubleType())])


@F.pandas_udf(_SHAPE)
def structure(texts: pd.Series) -> pd.DataFrame:
    """The structural profile of most characters, its share, and the share of prose; null for null and blank texts."""
    given = [t if isinstance(t, str) else None for t in texts]
    out = []
    for at in range(0, len(given), 500):
        shares, _ = shape(given[at : at + 500])
        prose = shares[:, : len(PROSE)].sum(1)
        best = shares.argmax(1)
        for s, p, b in zip(shares, prose, best, strict=True):
            out.append((NAMES[b], float(p), float(s[b])) if s.any() else (None, None, None))
    return pd.DataFrame(out, columns=["profile", "prose_share", "profile_share"])


#: The basic counts of a text.
STATISTICS = ("n_words", "mean_word_length", "symbol_share", "ended_line_share", "common_word_share")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with basic counts of a text: words, mean word length, and shares of symbols, of lines that end in punctuation and of
    common words. Null for a null text; shares of nothing (no words, no lines) are null. All are JVM expressions, each worked
    out once. Columns of df of the same names are replaced.
    """
    given = F.col(text)
    bare = F.btrim(given, F.lit(" \t\n\x0b\f\r"))  # what \s stands for
    # Signs around words go in one pass over the text; each run of signs is looked at once.
    sign = r"[^\p{L}\p{N}\s]"
    plain = F.lower(F.regexp_replace(bare, rf"(?<!\S){sign}++|(?<!{sign}){sign}++(?!\S)", ""))
    words = lambda c: F.when(bare != "", F.split(c, r"\s+")).when(bare == "", F.array().cast("array<string>"))
    lines = F.filter(F.split(given, "\n"), lambda x: x.rlike(r"\S"))
    split = df.withColumns({"_words": words(bare), "_plain": words(plain), "_lines": lines})
    counted = split.withColumns({
        "n_words": F.when(given.isNotNull(), F.size("_words")).cast("bigint"),
        "_letters": F.length(F.array_join("_words", "")),
        "_symbols": F.length(F.regexp_replace(given, r"[\p{L}\p{N}\p{M}\s]+", "")),
        "_n_lines": F.size("_lines"),
        "_ended": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;…][\"'”’»)\]]*\s*$"))),
        "_common": F.size(F.filter("_plain", lambda w: w.isin(*COMMON))),
    })
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counted.withColumns({
        "mean_word_length": share("_letters", "n_words"), "symbol_share": share("_symbols", "_letters"), "ended_line_share": share("_ended", "_n_lines"), "common_word_share": share("_common", "n_words"),
    }).drop("_words", "_plain", "_lines", "_letters", "_symbols", "_n_lines", "_ended", "_common")


#: Common words of four languages together, in the order of the alphabet.
COMMON = tuple(sorted({w for words in FUNCTION_WORDS.values() for w in words.split()}))
