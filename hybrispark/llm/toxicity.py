"""Abusive, hateful and sexual passages, scored by weak supervision.

Every text is folded and cut into passages.  Lexicon and pattern voters, several
for each language and several against abuse for all of them, vote on passages;
voters for abuse can fire only near a trigger word, so that an automaton finds
all passages they may fire on.  The counts of all combinations of votes over
the whole corpus fit a generative label model for each language: voters fire
given the hidden class along a dependency tree of each class, so both their
accuracies and their correlations are estimated, by expectation maximisation.
A linear classifier over hashed words is trained on the posterior labels of a
bounded sample of passages, those without a trigger among them, and scores
every passage; a document has the score of its worst passage.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybrispark.llm import toxic_lexicon as lex
from hybrispark.session import checkpointed

_invisible = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_marks = re.compile("[\u0300-\u036f]")
_other_script = re.compile("[Ͱ-ϿЀ-ԯɑɡɩʏ]")
#: Letters of other scripts that look like Latin ones, a fixed list in pairs.
_LOOK = "аaеeоoрpсcуyхxіiѕsјjԁdһhɡgӏlкkмmтtвbнhгrпnԛqԝwαaβbεeηnιiκkνvοoρpτtυuχxγyɑaɩi"
_look_alike = str.maketrans(_LOOK[::2], _LOOK[1::2])
#: A word spelt letter by letter with one sign between, words apart by sign, blank, sign.
_spelt = re.compile(r"(?<![^\W_])[^\W_]([ .\-_*·])[^\W_](?:\1(?: \1)?[^\W_])+(?![^\W_])")
_stretched = re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
_run = re.compile(r"([^\W\d_])\1{2,}")
#: Words that hold digits or signs in place of letters.
_leet = re.compile(r"(?<![\w@$*!])(?=[\d@$!*+|€]*[a-z])[a-z]*[@$*!013457+|€8][a-z\d@$!*+|€]*")
_IN_LEET = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@$!*+|€")
_LEET = "0o1i3e4a5s7t8b@a$s!i+t|l€e"
_as_letters = str.maketrans(_LEET[::2], _LEET[1::2])
_as_letters_l = str.maketrans({**dict(zip(_LEET[::2], _LEET[1::2])), "1": "l", "!": "l", "|": "i"})
_beyond = re.compile(r"[^\x00-\x7f]+")
_split = re.compile(r"[\n\r\x0b\x0c\u0085\u2028\u2029]+|-->|<!--|(?<=[.!?])[\s)\]]+(?=[^\s.])|(?<=[。！？])|(?<=[)\]])\s+(?=[a-z])")
_new_sentence = re.compile(r", (?=(?:[A-Z][a-z]+[ ,'’]|A ))")
_DIGIT = re.compile(r"\d+")
_token = re.compile(r"[^\W\d_]+|[一-鿿\u3040-ヿ]")


@functools.cache
def _masked(token: str) -> str | None:
    shape = re.compile("".join("[a-z]" if c == "*" else re.escape(c) for c in token.translate(_as_letters)))
    found = [w for w in lex.HIDDEN if len(w) == len(token) and shape.fullmatch(w)]
    return max(found, key=lambda w: (lex.HIDDEN[w], w), default=None)


def _unmask(m: re.Match) -> str:
    word = m.group()
    core = word.rstrip("!*+|")
    for w in dict.fromkeys((core, word)):
        if len(w) < 2:
            continue
        if "*" in w:
            if sum(c == "*" for c in w) < len(w) - 1 and (found := _masked(w)):
                return found + word[len(w) :]
            continue
        for table in (_as_letters, _as_letters_l):
            plain = w.translate(table)
            if plain != w and plain in lex.HIDDEN:
                return plain + word[len(w) :]
    return word


def _unstretch(m: re.Match) -> str:
    word = m.group()
    for to in (r"\1", r"\1\1"):
        plain = _run.sub(to, word)
        if plain in lex.HIDDEN:
            return plain
    return word


def _join_spelt(m: re.Match) -> str:
    sign = m.group(1)
    return m.group().replace(f"{sign} {sign}", "\0").replace(sign, "").replace("\0", " ")


#: By byte: 1 for a letter, 2 for a digit or sign that may stand for one, 3 for any other digit.
_BYTE = np.zeros(256, np.uint8)
_BYTE[97:123] = 1
_BYTE[48:58] = 3
_BYTE[np.frombuffer(b"@$*!013457+|8", np.uint8)] = 2


_BETWEEN = np.zeros(256, bool)
_BETWEEN[np.frombuffer(b" .-_*", np.uint8)] = True


def _disguises(text: str) -> tuple[bool, list[int], bool]:
    """Whether some letter stands three times in a row, where a sign or digit touches a letter, and whether words may be spelt letter by letter.

    What isn't ASCII is taken for a letter where it could be one of a spelt word.
    """
    code = np.frombuffer(text.replace("·", "*").encode("ascii", "replace"), np.uint8)
    if len(code) < 3:
        return False, [], False
    kind = _BYTE[code]
    same = code[1:] == code[:-1]
    stretch = bool((same[1:] & same[:-1] & (kind[2:] == 1)).any())
    # A question mark stands for a character beyond ASCII, the sign for the euro among them.
    other = code == 63
    sign = (kind == 2) | other
    letter = kind == 1
    touch = np.flatnonzero((letter[1:] & sign[:-1]) | (letter[:-1] & sign[1:])).tolist()
    word = letter | (kind == 3) | other | ((code >= 48) & (code < 58))
    between = _BETWEEN[code]
    # Letter, sign, letter, the same sign, and a letter or a blank again.
    n = len(code) - 4
    spelt = word[:n] & between[1 : n + 1] & word[2 : n + 2] & (code[3 : n + 3] == code[1 : n + 1]) & (word[4:] | (code[4:] == 32)) if n > 0 else word[:0]
    spelt[1:] &= ~word[: max(n - 1, 0)]
    return stretch, touch, bool(spelt.any())


def _unmask_words(text: str, touch: list[int]) -> str:
    """The text with the words about these places written plainly."""
    out, done = [], 0
    for at in touch:
        if at < done:
            continue
        low = at
        while low > done and (text[low - 1] in _IN_LEET):
            low -= 1
        m = _leet.search(text, low, at + 2 + 40)
        if m and m.start() <= at + 1:
            m = _leet.match(text, m.start())
            if m:
                out.append(text[done : m.start()])
                out.append(_unmask(m))
                done = m.end()
    out.append(text[done:])
    return "".join(out)


def fold(text: str) -> str:
    """Lower-case text without accents, invisible or look-alike characters, with disguised words plain.

    A comma before a capitalised word ends a line: a sentence that follows
    another without a full stop is a passage of its own.
    """
    text = _new_sentence.sub(",\n", text).lower()
    if not text.isascii():
        text = _beyond.sub(_plain_run, text)
    stretch, touch, spelt = _disguises(text)
    if spelt:
        joined = _spelt.sub(_join_spelt, text)
        if joined != text:
            text = joined
            stretch, touch, _ = _disguises(text)
    if touch:
        text = _unmask_words(text, touch)
    return _stretched.sub(_unstretch, text) if stretch else text


def _plain_run(m: re.Match) -> str:
    run = m.group()
    return _plain_short(run) if len(run) < 6 else _plain(run)


def _plain(run: str) -> str:
    """Characters beyond ASCII without marks and invisible ones, look-alikes as Latin letters."""
    run = unicodedata.normalize("NFKD", _invisible.sub("", run))
    run = unicodedata.normalize("NFC", _marks.sub("", run)).lower()
    return _other_script.sub(lambda m: m.group().translate(_look_alike), run)


_plain_short = functools.lru_cache(100_000)(_plain)


@functools.cache
def _triggers():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for bit, words in enumerate(lex.TRIGGERS.values()):
        for t in words:
            automaton.add_word(t, (len(t), automaton.get(t, (0, 0))[1] | 1 << bit))
    automaton.make_automaton()
    return automaton


def _hits(text: str) -> Iterator[tuple[int, int]]:
    """Where a trigger ends, and the languages it belongs to, one bit each."""
    for end, (size, languages) in _triggers().iter(text):
        before = text[end - size : end - size + 1] if end >= size else ""
        # A trigger begins a word; the end is open for inflections but after short ones.
        if before.isascii() and before.isalnum():
            continue
        if size > 4 or text[end - size + 1 : end + 1] not in lex.WHOLE or not text[end + 1 : end + 2].isalnum():
            yield end, languages


def suspect_passages(text: str | None) -> dict[str, int]:
    """The different folded passages of a text that hold a trigger word, and the languages of their triggers."""
    if not text:
        return {}
    text = fold(text)
    hits = list(_hits(text))
    if not hits:
        return {}
    cuts = [0, *(m.end() for m in _split.finditer(text)), len(text)]
    out: dict[str, int] = {}
    k = 0
    for h, languages in hits:
        while cuts[k + 1] <= h:
            k += 1
        passage = " ".join(text[cuts[k] : cuts[k + 1]].split())
        out[passage] = out.get(passage, 0) | languages
    return out


LANGUAGES = tuple(lex.LANGUAGES)
#: Names of the voters of each language, those against abuse last.
NAMES = {language: (*voters, *lex.CLEAN) for language, voters in lex.LANGUAGES.items()}
#: Bits of a vote below the number of its language.
VOTE_BITS = max(map(len, NAMES.values()))


def votes(passage: str, languages: int = (1 << len(LANGUAGES)) - 1) -> int:
    """The voters that fire on a passage, one bit each, above them the number of the language.

    A passage is of the language of which most voters for abuse fire, the
    first of equals.
    """
    best, fired = (0, 0), 0
    for number, (language, voters) in enumerate(lex.LANGUAGES.items()):
        if not languages >> number & 1:
            continue
        bits = sum(1 << j for j, pattern in enumerate(voters.values()) if pattern.search(passage))
        strong = sum(bits >> j & 1 for j, name in enumerate(voters) if name not in lex.WEAK)
        if (strong, -number) > best or not fired and bits and not best[0]:
            best, fired = (strong, -number), number << VOTE_BITS | bits
    first = len(lex.LANGUAGES[LANGUAGES[fired >> VOTE_BITS]])
    return fired | sum(1 << first + j for j, pattern in enumerate(lex.CLEAN.values()) if pattern.search(passage))


def fired_matrix(voted: list[int]) -> np.ndarray:
    """Votes of passages of one language as a row of zeros and ones each."""
    n = len(NAMES[LANGUAGES[voted[0] >> VOTE_BITS]]) if voted else 0
    return np.array([[v >> j & 1 for j in range(n)] for v in voted], int).reshape(len(voted), n)


@dataclass
class LabelModel:
    """Trees over the voters, one for each kind of passage: P(voter | its parent, kind).

    Kind 0 is clean, the others are the kinds of abuse.
    """

    language: str
    prior: np.ndarray
    parent: list[list[int]]
    table: np.ndarray  # kind, voter, value of the parent: probability to fire

    @property
    def polarity(self) -> np.ndarray:
        return _polarity(self.language)

    def kinds(self, fired: np.ndarray) -> np.ndarray:
        """P(kind | votes), a row for each combination of votes."""
        out = np.empty((len(fired), len(self.prior)))
        for y, parents in enumerate(self.parent):
            p = np.empty(fired.shape)
            for j, up in enumerate(parents):
                p[:, j] = self.table[y, j, fired[:, up] if up >= 0 else 0]
            out[:, y] = np.log(np.where(fired, p, 1 - p)).sum(1) + np.log(self.prior[y])
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(any kind of abuse | votes); none without a vote for it."""
        if not len(fired):
            return np.empty(0)
        return np.where(_accused(fired, self.language), 1 - self.kinds(fired)[:, 0], 0.0)

    def accuracies(self, fired: np.ndarray, count: np.ndarray) -> dict[str, float]:
        """The estimated share of right votes of every voter."""
        q = self.posterior(fired)
        right = {1: q, -1: 1 - q}
        return {
            n: float(count @ (fired[:, j] * right[v]) / max(count @ fired[:, j], 1e-9))
            for j, (n, v) in enumerate(zip(NAMES[self.language], self.polarity))
        }

    def correlations(self) -> list[tuple[int, str, str, float]]:
        """(kind, voter, voter, difference in firing) along the trees."""
        return [
            (y, NAMES[self.language][up], NAMES[self.language][j], float(self.table[y, j, 1] - self.table[y, j, 0]))
            for y, parents in enumerate(self.parent)
            for j, up in enumerate(parents)
            if up >= 0
        ]


def _tree(weight: np.ndarray, fired: np.ndarray, smooth: float) -> list[int]:
    """Parents in the tree of the largest mutual information (Chow and Liu)."""
    m = fired.shape[1]
    total = weight.sum() + 4 * smooth
    f = fired.astype(float)
    both = (f * weight[:, None]).T @ f
    ones = np.diag(both)
    information = np.zeros((m, m))
    for a in (0, 1):
        for b in (0, 1):
            n = {
                (1, 1): both,
                (1, 0): ones[:, None] - both,
                (0, 1): ones[None] - both,
                (0, 0): weight.sum() - ones[:, None] - ones[None] + both,
            }[a, b]
            p = (n + smooth) / total
            pa_ = ((ones if a else weight.sum() - ones) + 2 * smooth) / total
            pb_ = ((ones if b else weight.sum() - ones) + 2 * smooth) / total
            information += p * np.log(p / (pa_[:, None] * pb_[None]))
    parent, linked = [-1] * m, {0}
    while len(linked) < m:
        i, j = max(((i, j) for i in linked for j in range(m) if j not in linked), key=lambda x: information[x])
        parent[j] = i
        linked.add(j)
    return parent


def _polarity(language: str) -> np.ndarray:
    """1 for each voter for abuse, -1 for each against it."""
    return np.array([1] * len(lex.LANGUAGES[language]) + [-1] * len(lex.CLEAN))


def _expected_rates(language: str) -> np.ndarray:
    """How often each voter is taken to fire in each kind of passage, before anything is seen."""
    names, kinds, polarity = NAMES[language], lex.KINDS[language], _polarity(language)
    rates = np.empty((1 + len(kinds), len(names)))
    rates[0] = np.where(polarity > 0, 0.05, 0.40)
    rates[1:] = np.where(polarity > 0, 0.08, 0.05)
    for y, voters in enumerate(kinds, 1):
        for name in voters:
            rates[y, names.index(name)] = 0.5
    # What is known to mean something else is hardly ever abuse.
    rates[1:, names.index("homograph")] = 0.005
    for name in lex.WEAK & set(names):
        rates[0, names.index(name)] = 0.25
    return rates


def _accused(fired: np.ndarray, language: str) -> np.ndarray:
    """Whether any voter for abuse fires that tells something by itself."""
    strong = [j for j, name in enumerate(lex.LANGUAGES[language]) if name not in lex.WEAK]
    return fired[:, strong].any(1)


def fit_label_model(fired: np.ndarray, count: np.ndarray, language: str = "english", rounds: int = 30, trust: float = 0.05) -> LabelModel:
    """Expectation maximisation over vote combinations and how often each occurs.

    Only combinations with a vote for abuse leave something to decide and are
    fitted to.  The expected rates weigh like a share ``trust`` of all passages
    at every size of corpus, so that kinds of which few voters tell keep their
    meaning.
    """
    if len(fired):
        open_ = _accused(fired, language)
        fired, count = fired[open_], count[open_]
    expected = _expected_rates(language)
    kinds, m = expected.shape
    model = LabelModel(language, np.full(kinds, 1 / kinds), [[-1] * m] * kinds, np.repeat(expected[:, :, None], 2, axis=2))
    if not len(fired):
        return model
    f = fired.astype(int)
    strength = max(10.0, trust * count.sum())
    for step in range(rounds):
        q = model.kinds(f)
        prior = (count @ q + strength / kinds) / (count.sum() + strength)
        parents, table = [], np.empty((kinds, m, 2))
        for y in range(kinds):
            weight = count * q[:, y]
            # The first rounds take voters as independent, until kinds are told apart.
            parents.append(_tree(weight, f, strength / m) if step >= 5 else [-1] * m)
            flat = (weight @ f + strength * expected[y]) / (weight.sum() + strength)
            for j, up in enumerate(parents[y]):
                for v in (0, 1):
                    w = weight if up < 0 else weight * (f[:, up] == v)
                    # Drawn towards the voter's rate without its parent.
                    table[y, j, v] = (w @ f[:, j] + strength * flat[j]) / (w.sum() + strength)
        model = LabelModel(language, prior, parents, np.clip(table, 1e-4, 1 - 1e-4))
    return model


#: Voters of all languages have weights of their own, before those of words.
_OFFSET = dict(zip(LANGUAGES, np.cumsum([0, *(len(NAMES[x]) for x in LANGUAGES)]).tolist()))
N_VOTERS = sum(len(x) for x in NAMES.values())
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_LETTER, _SIGN = 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """By character: 1 for a letter, 2 for one that is a word by itself."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = _LETTER
    table[0x3040:0x3100] = _SIGN
    table[0x4E00:0xA000] = _SIGN
    return table


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root of the words' hash and of its inverse."""
    root, back = np.full(n, _ROOT), np.full(n, _BACK)
    root[0] = back[0] = 1
    return np.cumprod(root, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def hashed_words(text: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the text where words begin, and the hashes of the words and of each with the next.

    A word is a run of letters or a Chinese or Japanese sign.  Its hash is that
    of a polynomial in its characters, taken from sums over the whole text.
    """
    if text.isascii():
        chars = np.frombuffer(text.encode(), np.uint8)
    else:
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _kinds()[chars]
    letter = kind == _LETTER
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    single = kind == _SIGN
    start, end = np.flatnonzero(begins | single), np.flatnonzero(ends | single) + 1
    up, down = _powers(1 << max(10, (len(chars) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], dtype=np.uint64)])
        word = (sums[end] - sums[start]) * down[start]
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pair = word[:-1] * np.uint64(0x94D049BB133111EB) + word[1:]
        pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(64 - bits)
    return start, (word >> shift).astype(np.int64), (pair >> shift).astype(np.int64)


@dataclass
class Classifier:
    """Logistic regression on the share of hashed words and pairs of words, and on votes."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, passages: list[str], voted: list[int]) -> np.ndarray:
        owner, place, scale = _places(passages, voted, self.bits)
        z = self.bias + np.bincount(owner, self.weights[place] * scale, len(passages))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def worst_plain(self, texts: list[str]) -> np.ndarray:
        """The highest score by words among the passages of each text that hold no trigger; 0 without any."""
        joined = "\n".join(t.lower() for t in texts)
        worst = np.zeros(len(texts))
        if not joined:
            return worst
        start, word, pair = hashed_words(joined, self.bits)
        if not len(start):
            return worst
        passage = _passage_numbers(joined)[start]
        heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        sizes = np.diff(np.append(heads, len(start)))
        w = self.weights[N_VOTERS:]
        within = np.append(passage[1:] == passage[:-1], False)
        value = w[word]
        value[:-1] += np.where(within[:-1], w[pair], 0.0)
        z = self.bias + np.add.reduceat(value, heads) / np.sqrt(2 * sizes - 1)
        text_ends = np.cumsum([len(t) + 1 for t in map(str.lower, texts)])
        owner = np.searchsorted(text_ends, start[heads], "right")
        cuts = np.append(start[heads], len(joined))
        # The worst passage of a text counts unless it holds a trigger; then the next worst.
        order = np.lexsort((-z, owner))
        done = -1
        for at in order.tolist():
            if owner[at] == done:
                continue
            if next(_hits(joined[cuts[at] : cuts[at + 1]]), None) is None:
                worst[owner[at]] = 1 / (1 + np.exp(-z[at])) if z[at] > -500 else 0.0
                done = owner[at]
        return worst


@functools.cache
def _marks_table() -> np.ndarray:
    """By character: 1 ends a line, 2 a sentence if a blank or bracket follows, 3 always, 4 is a blank or closing bracket."""
    table = np.zeros(0x110000, np.uint8)
    table[[ord(c) for c in "\n\r\x0b\x0c\u0085\u2028\u2029"]] = 1
    table[[ord(c) for c in ".!?"]] = 2
    table[[ord(c) for c in "。！？"]] = 3
    table[[c for c in range(0x3001) if chr(c).isspace() and not table[c]]] = 4
    table[[ord(c) for c in ")]"]] = 4
    return table


def _passage_numbers(text: str) -> np.ndarray:
    """The number of the passage each character lies in; passages end with lines and sentences."""
    chars = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    mark = _marks_table()[chars]
    ends = (mark == 1) | (mark == 3)
    ends[:-1] |= (mark[:-1] == 2) & (mark[1:] == 4)
    return np.concatenate([[0], np.cumsum(ends)[:-1]])


def _places(passages: list[str], voted: list[int], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of passages: whose each is, its place among the weights, and its value."""
    joined = "\n".join(passages)
    start, word, pair = hashed_words(joined, bits)
    ends = np.cumsum([len(p) + 1 for p in passages])
    owner = np.searchsorted(ends, start, "right")
    within = owner[1:] == owner[:-1]
    whose = np.concatenate([owner, owner[:-1][within]])
    place = np.concatenate([word, pair[within]]) + N_VOTERS
    size = np.bincount(whose, minlength=len(passages))
    scale = 1 / np.sqrt(np.maximum(size, 1))[whose]
    by_votes = [(i, _OFFSET[LANGUAGES[v >> VOTE_BITS]] + j) for i, v in enumerate(voted) for j in range(VOTE_BITS) if v >> j & 1]
    if by_votes:
        who, which = np.array(by_votes).T
        # A vote weighs as one word in four would.
        whose, place, scale = np.concatenate([whose, who]), np.concatenate([place, which]), np.concatenate([scale, np.full(len(who), 0.5)])
    return whose, place, scale


def train_classifier(passages: list[str], voted: list[int], labels: np.ndarray, bits: int = 15, steps: int = 300, penalty: float = 1e-4) -> Classifier:
    """Full-batch Adam on the posterior labels; voters' weights are penalised less than words'.

    A passage without words is taken to be clean, with a tenth of all weight,
    so that what was never seen stays so.
    """
    size = N_VOTERS + (1 << bits)
    if not len(passages):
        return Classifier(np.zeros(size), -5.0, bits)
    owner, flat, scale = _places(passages, voted, bits)
    n = len(passages) + 1
    labels = np.append(labels, 0.0)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    decay = np.full(size, penalty)
    decay[:N_VOTERS] /= 10
    # Both classes weigh the same.
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    weight = labels * 0.5 / share + (1 - labels) * 0.5 / (1 - share)
    weight[-1] = 0.1 * weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[flat] * scale, n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / n
        g = np.bincount(flat, error[owner] * scale, size) + decay * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Classifier(w, float(b), bits)


#: Votes of a passage without a trigger, kept as an example of clean text.
PLAIN = -1


def _plain_samples(text: str, most: int) -> list[str]:
    """A few passages of a text without a trigger, at most ``most`` and not long."""
    out = []
    for m in re.finditer(r"[^.!?。！？\n]{30,400}", text.lower()):
        if len(out) >= most:
            break
        if zlib.crc32(m.group().encode("utf-8", "replace")) % 16 == 0 and next(_hits(m.group()), None) is None:
            out.append(" ".join(m.group().split()))
    return out


def voted_passages(docs: DataFrame, id_col: str, text_col: str, plain_per_task: int = 500) -> DataFrame:
    """(id, passage, votes) of every suspect passage of every text, and from each task some passages without a trigger."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("passage", T.StringType()), T.StructField("votes", T.IntegerType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = plain_per_task
        known: dict[tuple[str, int], int] = {}
        for batch in batches:
            rows, passages, fired = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for p, languages in suspect_passages(text).items():
                    rows.append(i)
                    passages.append(p)
                    key = (p, languages)
                    if key not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[key] = votes(p, languages)
                    fired.append(known[key])
                if left and text:
                    for p in _plain_samples(text, min(left, 5)):
                        rows.append(i)
                        passages.append(p)
                        fired.append(PLAIN)
                        left -= 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(passages, pa.string()), pa.array(fired, pa.int32())],
                    names=schema.fieldNames(),
                )

    return docs.select(docs[id_col], docs[text_col]).where(docs[text_col].isNotNull()).mapInArrow(vote, schema)


def fit(voted: DataFrame, sample_rows: int = 20_000, sample_chars: int = 2_000) -> Classifier:
    """The classifier for the votes of a corpus.

    The label models are fitted to the votes on all suspect passages, of which
    there are at most as many combinations as subsets of a language's voters.
    The classifier is trained on the ``sample_rows`` different passages of the
    smallest hash with a trigger, and as many without, of up to
    ``sample_chars`` characters.
    """
    different = voted.select("passage", "votes").distinct()
    patterns: dict[int, list[tuple[int, int]]] = {}
    for r in different.where(F.col("votes") >= 0).groupBy("votes").count().collect():
        patterns.setdefault(r["votes"] >> VOTE_BITS, []).append((r["votes"], r["count"]))
    label = {PLAIN: 0.0}
    for number, seen in patterns.items():
        found = [v for v, _ in seen]
        fired = fired_matrix(found)
        model = fit_label_model(fired, np.array([n for _, n in seen], float), LANGUAGES[number])
        label |= dict(zip(found, model.posterior(fired).tolist()))
    short = different.where(F.length("passage") <= sample_chars)
    sample = []
    for part in (short.where(F.col("votes") >= 0), short.where(F.col("votes") == PLAIN)):
        sample += part.orderBy(F.xxhash64("passage"), "passage", "votes").limit(sample_rows).collect()
    return train_classifier([r["passage"] for r in sample], [max(r["votes"], 0) for r in sample], np.array([label[r["votes"]] for r in sample]))


def passage_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passage, votes, score) of every suspect passage."""
    voted = checkpointed(voted_passages(docs, id_col, text_col))
    return _score_voted(voted, fit(voted))


def _score_voted(voted: DataFrame, classifier: Classifier) -> DataFrame:
    schema = T.StructType([*voted.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = classifier.score(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=schema.fieldNames())

    return voted.where(F.col("votes") >= 0).mapInArrow(score, schema)


def _score_plain(docs: DataFrame, id_col: str, text_col: str, classifier: Classifier, slice_chars: int = 1_000_000) -> DataFrame:
    """(id, score): the worst passage without a trigger of every text, by its words."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            low = 0
            while low < len(texts):
                high, held = low, 0
                while high < len(texts) and (high == low or held + len(texts[high]) <= slice_chars):
                    held += len(texts[high])
                    high += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(classifier.worst_plain(texts[low:high]))], names=schema.fieldNames())
                low = high

    return docs.select(docs[id_col], docs[text_col]).where(docs[text_col].isNotNull()).mapInArrow(score, schema)


def worst_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the worst passage of every document with a text; several rows for an id, the highest of which counts."""
    voted = checkpointed(voted_passages(docs, id_col, text_col))
    classifier = fit(voted)
    return _score_voted(voted, classifier).select(id_col, "score").unionByName(_score_plain(docs, id_col, text_col, classifier))


def toxicity_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, score) of every document: the score of its worst passage.

    Documents with null or empty texts have score 0; rows with a null id stay,
    without evidence of their own.  Repeated rows each come out with the score
    of their id.
    """
    worst = worst_scores(docs, id_col, text_col).groupBy(id_col).agg(F.max("score").alias("score"))
    return (
        docs.select(id_col, *extra)
        .join(worst, id_col, "left")
        .select(id_col, *extra, F.coalesce("score", F.lit(0.0)).alias("score"))
    )


def source_rates(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents, flagged documents and their rate of every source; a null source is one of its own."""
    scored = toxicity_scores(docs, extra=("source",))
    flagged = F.sum((F.col("score") >= threshold).cast("long"))
    return scored.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        flagged.alias("n_flagged"),
        (flagged / F.count("*")).alias("rate"),
    )
