"""Statistics of texts that tell natural prose from lists, tables, record sheets and junk.

All texts of a batch are laid end to end as one array of characters, and every statistic is counted
on it with array operations: characters by class, words (runs of letters; each Chinese or Japanese
character is a word), lines, and segments (what lies between sentence ends and line ends). Nothing is
decided here: these are counts and shares. Words and pairs of words are also looked up in tables
of `WordTables`, which the classifier learns; without them (or in a language they don't know) what
they say is 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Words that natural sentences can't do without, by language (fixed values).
COMMON_WORDS = {
    "en": "the a of and to in is it that was for on with as but not this have you i",
    "de": "der die das und ist nicht ich es ein eine zu den mit auf im war auch so aber wie",
    "fr": "le la les de des et est un une que qui dans pas je il en ce pour mais avec",
    "es": "el la los de que y en un una es no se por con para lo su pero como más",
    "it": "il di che non un una per con sono è ma anche come della si questo",
    "pt": "o os de que não um uma para com em do da mas como muito isso foi",
    "nl": "het een van en dat niet ik met voor op zijn maar ook wat er",
    "ru": "и в не на что я с он это как но по все так у за мы бы же из",
}
#: Characters that Chinese, Japanese and Korean sentences are held together by (fixed values).
COMMON_CHARACTERS = "的了是我在有不这也就和看说很个到" + "のはがをにてとでもなるいすまたしだ" + "은는이가을를에의다고요지한하"

(SPACE, NEWLINE, LOWER, UPPER, LETTER, WIDE, DIGIT, END, PAUSE, PUNCT, ODD, SYMBOL) = range(12)
_ENDS, _PAUSES = ".!?。！？…", ",;:，；：、—"
_CLOSERS = "\"')）”」』》]"
_ITEMS = "-*+•·◦‣▪—–|[#"
BUCKETS = 1 << 18
_BASE, _MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)

NAMES = (
    "log_chars", "log_words", "log_lines", "mean_word_length", "word_length_spread", "symbol_share", "digit_share", "odd_share", "wide_share", "upper_share", "lower_start_share", "common_share",
    "ends_per_word", "pauses_per_word", "lines_ended_share", "segments_ended_share", "item_share", "digit_line_share", "gap_share", "bar_share", "comma_line_share", "colon_line_share", "short_line_share", "mean_line_chars",
    "words_per_segment", "longest_segment", "longest_word", "word_variety", "distinct_line_share", "distinct_segment_share", "top_segment_share", "run_share", "no_vowel_share", "mixed_word_share",
    "word_odds", "pair_odds", "known_pairs", "prose_segment_share", "prose_word_share",
)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character of the basic plane: its class, its lower case, whether it is a vowel."""
    kind = np.full(65_537, ODD, dtype=np.uint8)
    lower = np.arange(65_537, dtype=np.uint64)
    for i in range(65_536):
        c = chr(i)
        cat = unicodedata.category(c)
        if cat[0] == "L" or cat[0] == "M":
            wide = 0x3005 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF or 0xF900 <= i <= 0xFAFF or 0xFF66 <= i <= 0xFF9F
            kind[i] = WIDE if wide else UPPER if cat in ("Lu", "Lt") else LOWER if cat == "Ll" else LETTER
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
        elif cat[0] == "N":
            kind[i] = DIGIT
        elif cat[0] == "Z" or c in "\t\r\v\f":
            kind[i] = SPACE
        elif cat[0] == "P":
            kind[i] = PUNCT
        elif cat in ("Sm", "Sc", "Sk"):
            kind[i] = SYMBOL if not 0x2500 <= i <= 0x25FF else ODD
    for chars, k in ((_ENDS, END), (_PAUSES, PAUSE), ("\n", NEWLINE)):
        kind[[ord(c) for c in chars]] = k
    kind[0x3000] = SPACE
    kind[0xFFFD] = ODD
    vowel = np.ones(65_537, dtype=bool)
    vowel[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x400, 0x460)]] = False
    vowel[[ord(c) for c in "aeiouyäöüáéíóúàèìòùâêîôûãõåæøëïœýаеёиоуыэюяіїє"]] = True
    return kind, lower, vowel


def _hash(words: Sequence[str]) -> np.ndarray:
    """The hash that `Words` gives to words, which are in lower case."""
    return np.unique(Words(list(words)).hash) if words else np.zeros(0, dtype=np.uint64)


@cache
def _common() -> np.ndarray:
    return _hash([w for ws in COMMON_WORDS.values() for w in ws.split()] + list(COMMON_CHARACTERS))


def _power(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1), _BASE)]).astype(np.uint64))


@dataclass
class WordTables:
    """Log odds of words and of pairs of words to stand in prose, by the bucket of their hash; 0 where unknown."""

    words: np.ndarray
    pairs: np.ndarray


class Words:
    """The words of texts, none of which is empty: where they stand, and their hashes."""

    def __init__(self, texts: Sequence[str]):
        kind_of, lower_of, _ = _tables()
        code = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(code, 65_536)
        kind = kind_of[at]
        kind[(code >= 0x20000) & (code < 0x40000)] = WIDE
        kind[(code >= 0xD800) & (code < 0xE000)] = ODD
        self.code, self.at, self.kind, self.n = code, at, kind, len(texts)
        self.size = np.array([len(t) + 1 for t in texts])
        self.first = np.cumsum(self.size) - self.size  # where each text begins
        self.text_of = np.repeat(np.arange(self.n), self.size)
        letter = (kind >= LOWER) & (kind <= LETTER)
        digit = kind == DIGIT
        wide = kind == WIDE
        before = np.empty_like(kind)
        before[0], before[1:] = NEWLINE, kind[:-1]
        starts = wide | letter & ~((before >= LOWER) & (before <= LETTER)) | digit & (before != DIGIT)
        self.start = np.nonzero(starts)[0]
        inside = letter | digit | wide
        word_no = np.cumsum(starts) - 1
        lower = np.where(at < 65_536, lower_of[at], code.astype(np.uint64))
        lower[digit] = 48  # numbers are one word
        if len(self.start):
            self.length = np.add.reduceat(inside.astype(np.int64), self.start)
            pos = np.where(inside, np.arange(len(code)) - self.start[np.maximum(word_no, 0)], 0)
            with np.errstate(over="ignore"):
                part = np.where(inside & ~(digit & (pos > 0)), (lower + np.uint64(1)) * _power(64)[np.minimum(pos, 63)], np.uint64(0))
                h = np.add.reduceat(part, self.start)
                h = (h ^ (h >> np.uint64(31))) * _MIX
                self.hash = h ^ (h >> np.uint64(29))
        else:
            self.length, self.hash = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        self.inside, self.word_text = inside, self.text_of[self.start]
        # lines and segments, numbered over all texts; a segment begins after a line end, or after a sentence end
        ended = kind == NEWLINE
        # several sentence ends in a row end one segment
        stop = ended | (kind == END) & np.concatenate([kind[1:] != END, [True]])
        self.line_of = np.concatenate([[0], np.cumsum(ended)[:-1]])
        self.segment_of = np.concatenate([[0], np.cumsum(stop)[:-1]])

    def buckets(self) -> np.ndarray:
        return (self.hash >> np.uint64(46)).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, bucket) of neighbours in a line."""
        line = self.line_of[self.start]
        first = np.nonzero(line[1:] == line[:-1])[0] if len(line) else np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            h = (self.hash[first] * _PAIR + self.hash[first + 1]) * _MIX
        return first, (h >> np.uint64(46)).astype(np.int64)


def _per(where: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(where, weights, n).astype(float)


def _max_per(where: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, where, value)
    return out


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has."""
    if not len(text):
        return np.zeros(n)
    with np.errstate(over="ignore"):
        mixed = np.unique((value.astype(np.uint64) * _MIX) ^ (text.astype(np.uint64) * _BASE), return_index=True)[1]
    return _per(text[mixed], n)


def statistics(texts: Sequence[str], tables: WordTables | None = None) -> np.ndarray:
    """One row of the statistics NAMES for each text; none may be empty. Whole texts, however long."""
    if not len(texts):
        return np.zeros((0, len(NAMES)))
    w = Words(texts)
    n, kind, text_of = w.n, w.kind, w.text_of
    _, _, vowel = _tables()
    by = np.bincount(text_of * 12 + kind, minlength=n * 12).reshape(n, 12).astype(float)
    dense = np.maximum(1, by[:, 2:].sum(axis=1))
    words = np.maximum(1, _per(w.word_text, n))
    first_kind = kind[w.start]
    letters = (first_kind >= LOWER) & (first_kind <= LETTER)
    latin = np.maximum(1, _per(w.word_text[letters], n))
    size = w.length[letters].astype(float)
    mean = _per(w.word_text[letters], n, size) / latin
    spread = np.sqrt(np.maximum(0, _per(w.word_text[letters], n, size**2) / latin - mean**2))
    common = np.isin(w.hash, _common())
    # lines: those with a character that isn't blank
    n_lines = int(w.line_of[-1]) + 1
    shown = (kind != SPACE) & (kind != NEWLINE)
    line_chars = _per(w.line_of[shown], n_lines)
    where = np.nonzero(shown)[0]
    head = np.zeros(n_lines, dtype=np.int64)
    tail = np.zeros(n_lines, dtype=np.int64)
    head[w.line_of[where[::-1]]] = where[::-1]
    tail[w.line_of[where]] = where
    real = line_chars > 0
    line_text = np.zeros(n_lines, dtype=np.int64)
    line_text[w.line_of] = text_of
    own, head, tail, line_chars = line_text[real], head[real], tail[real], line_chars[real]
    lines = np.maximum(1, _per(own, n))
    last = kind[tail]
    after_end = (last == END) | np.isin(w.code[tail], [ord(c) for c in _CLOSERS]) & (kind[np.maximum(tail - 1, 0)] == END)
    item = np.isin(w.code[head], [ord(c) for c in _ITEMS])
    number = kind[head] == DIGIT

    def on_lines(hit: np.ndarray, least: int) -> np.ndarray:
        """Share of lines with at least so many of the characters."""
        return _per(own[np.bincount(w.line_of[hit], minlength=n_lines)[real] >= least], n) / lines

    blank = kind == SPACE
    gap = np.zeros_like(blank)
    gap[1:-1] = blank[1:-1] & blank[:-2] & shown[2:]
    gap |= w.code == 9
    gap[head] = False
    far = np.ones(n_lines, dtype=bool)
    colon = (w.code == 58) | (w.code == 0xFF1A)
    near = np.nonzero(colon)[0]
    line_head = np.zeros(n_lines, dtype=np.int64)
    line_head[real] = head
    close_by = near[(near - line_head[w.line_of[near]] <= 20)]
    far[w.line_of[close_by]] = False
    # segments
    n_seg = int(w.segment_of[-1]) + 1
    seg_chars = _per(w.segment_of[shown], n_seg)
    seg_words = _per(w.segment_of[w.start], n_seg)
    seg_text = np.zeros(n_seg, dtype=np.int64)
    seg_text[w.segment_of] = text_of
    seg_ended = np.zeros(n_seg, dtype=bool)
    seg_ended[w.segment_of[kind == END]] = True
    full = seg_words > 0
    st = seg_text[full]
    segments = np.maximum(1, _per(st, n))
    pos = np.arange(len(kind))
    seg_first = np.full(n_seg, len(kind), dtype=np.int64)
    np.minimum.at(seg_first, w.segment_of[shown], pos[shown])
    with np.errstate(over="ignore"):
        part = np.where(shown, (w.code.astype(np.uint64) + np.uint64(1)) * _power(256)[np.clip(pos - seg_first[w.segment_of], 0, 255)], np.uint64(0))
        seg_starts = np.nonzero(np.concatenate([[True], w.segment_of[1:] != w.segment_of[:-1]]))[0]
        seg_hash = np.add.reduceat(part, seg_starts)
        line_starts = np.nonzero(np.concatenate([[True], w.line_of[1:] != w.line_of[:-1]]))[0]
        line_hash = np.add.reduceat(part, line_starts)[real]
    # the segment that comes most often, by its share of the characters
    order = np.lexsort((seg_hash, seg_text))
    order = order[full[order]]
    top = np.zeros(n)
    if len(order):
        a, b = seg_text[order], seg_hash[order]
        edge = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(edge) - 1
        times = np.bincount(group)
        chars = np.bincount(group, seg_chars[order])
        top = _max_per(a[edge], np.where(times > 2, chars, 0.0), n)
    run = np.zeros(n)
    for p in (1, 2, 3, 4, 6, 8):
        if len(w.code) > p:
            same = np.nonzero((w.code[p:] == w.code[:-p]) & shown[p:] & (text_of[p:] == text_of[:-p]))[0]
            run = np.maximum(run, _per(text_of[same], n) / dense)
    has_vowel = np.add.reduceat((vowel[w.at] & w.inside).astype(np.int64), w.start) > 0 if len(w.start) else np.zeros(0, dtype=bool)
    # words with an upper case letter after the first, or right beside digits
    after = np.zeros(len(kind), dtype=bool)
    after[1:] = (kind[1:] == UPPER) & ((kind[:-1] == LOWER) | (kind[:-1] == DIGIT)) | (kind[1:] == DIGIT) & ((kind[:-1] == LOWER) | (kind[:-1] == UPPER))
    lower_start = (first_kind == LOWER) | (first_kind == LETTER)
    k = np.bincount(w.word_text, minlength=n)
    out = [
        np.log1p(w.size - 1), np.log1p(k), np.log1p(_per(own, n)), mean, spread, by[:, [PAUSE, END, PUNCT, ODD, SYMBOL]].sum(axis=1) / dense, by[:, DIGIT] / dense, by[:, ODD] / dense, by[:, WIDE] / dense,
        by[:, UPPER] / np.maximum(1, by[:, LOWER] + by[:, UPPER]), _per(w.word_text[lower_start], n) / latin, _per(w.word_text[common], n) / words, by[:, END] / words, by[:, PAUSE] / words, _per(own[after_end], n) / lines,
        _per(st[seg_ended[full]], n) / segments, _per(own[item], n) / lines, _per(own[number], n) / lines, on_lines(gap, 1), on_lines(w.code == 124, 2) + on_lines((w.code >= 0x2500) & (w.code < 0x2580), 2), on_lines(w.code == 44, 3),
        _per(own[~far[real]], n) / lines, _per(own, n, (line_chars < 30).astype(float)) / lines, np.log1p(dense / lines), np.log1p(words / segments), np.log1p(_max_per(st, seg_words[full], n)),
        np.log1p(_max_per(w.word_text, w.length.astype(float), n)), np.log1p(_distinct(w.word_text, w.hash, n)) / np.log1p(words), _distinct(own, line_hash, n) / lines, _distinct(st, seg_hash[full], n) / segments, top / dense, run, _per(w.word_text[letters & ~has_vowel], n) / words,
        _per(text_of[after], n) / dense,
    ]
    if tables is None:
        out += [np.zeros(n)] * 5
    else:
        odds = tables.words[w.buckets()]
        first, bucket = w.pairs()
        pair = tables.pairs[bucket]
        seg = w.segment_of[w.start]
        score = _per(seg, n_seg, odds) + _per(seg[first], n_seg, pair)
        pairs = np.maximum(1, _per(w.word_text[first], n))
        out += [
            _per(w.word_text, n, odds) / words, _per(w.word_text[first], n, pair) / pairs, _per(w.word_text[first[pair != 0]], n) / pairs,
            _per(seg_text, n, seg_chars * (score > 0)) / dense, _per(w.word_text[odds > 0], n) / words,
        ]
    return np.stack(out, axis=1)


def learn_tables(texts: Sequence[str], label: np.ndarray, least: int = 3) -> WordTables:
    """Tables from labelled texts (1 is junk): smoothed log odds of a text of either kind to hold a word, or a pair.

    A bucket that fewer than `least` texts hold is left at 0.
    """
    w = Words(texts)
    first, pair = w.pairs()
    label = np.asarray(label)
    n = np.array([max(1, (label == k).sum()) for k in (0, 1)])
    out = []
    for bucket, text in ((w.buckets(), w.word_text), (pair, w.word_text[first])):
        once = np.unique(bucket * w.n + text)
        b, y = once // w.n, label[once % w.n]
        c = np.stack([np.bincount(b[y == k], minlength=BUCKETS) for k in (0, 1)])
        odds = np.log((c[0] + 0.5) / (n[0] + 1)) - np.log((c[1] + 0.5) / (n[1] + 1))
        out.append(np.where(c.sum(axis=0) >= least, np.clip(odds, -4, 4), 0.0).astype(np.float32))
    return WordTables(*out)
