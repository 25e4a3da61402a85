"""Weak signals: what tells that a text of the training sample is surely prose, or surely junk.

Each signal looks at one side of a text (its sentences, its lines, its characters, repetition, word
order) and votes or keeps silent; a text on which signals disagree, or all keep silent, gets no label.
They are costly, and right only in clear cases: they label a bounded sample, and the classifier that
learns from it sees other statistics (`statistics`) and none of these.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log1p

import numpy as np
import regex

from forumlake.llm.statistics import COMMON_WORDS

#: More common words of two languages, for the order of words and for sentences (fixed values).
MORE_WORDS = {
    "en": "about after all an are at be because by can did do does from had has have he her him his how if its just know like me more my no one or our out she so some than that their them then there they this too up was we were what when where which who why will with would your",
    "de": "aber als am aus bei bis da das dass dem den des die doch du einen einer er für habe hat ich ja kein man mehr nach noch nur ob oder schon sehr sich sie sind um uns vom von vor was weil wenn wer wir wird zum zur über",
}
#: Characters that Chinese and Japanese sentences are held together by, and those that Korean words of sentences end in (fixed values).
COMMON_CHARACTERS = "的了是我你他在有不这那就也都和把说看得还没么吗呢吧啊什一个会对过很太给着被让来去到可以因为所如果但而与其实只谢第" + "のはがをにたてでともなかいるれすましよねだうけ"
KOREAN_ENDS = frozenset("은는이가을를에의도로고다요지한하게만서")
_BY_LANGUAGE = {k: frozenset(f"{v} {MORE_WORDS.get(k, '')}".split()) for k, v in COMMON_WORDS.items()}
_COMMON = frozenset().union(*_BY_LANGUAGE.values())
_GLUE = frozenset(COMMON_CHARACTERS)
#: Articles; in a sentence a noun or an adjective comes after them, hardly ever a common word of their language.
_ARTICLES = {"a": "en", "an": "en", "the": "en", "ein": "de", "eine": "de", "einen": "de"}

_CJK_RANGE = "\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_CJK_RANGE}]|[^\W\d_{_CJK_RANGE}](?:[^\W\d_{_CJK_RANGE}]|['’\-])*|\d+")
_LINES = re.compile(r"\r\n|\n|\r")
_ITEM = re.compile(r"^\s*(?:[-*+•·◦‣▪]\s+|\d{1,4}\s*[.)、:：]|\[[ xX✓]?\]|EP?\s?\d+\b|#\d+|\|)")
_PAIR = re.compile(r"^\s*(?:[^\W\d_]| ){1,16}\s?[:：]\s?(?:[?\-]$|[\w《\"].{0,40}$)")
_ROW = re.compile(r"\t|\s\|\s|[│┃║]|[┌┐└┘├┤─━═]{2}|\[/?t[rdh]\]|</?t[rdh]>|\S {3,}\S")
_ENDED = re.compile(r"[.!?。！？…」』”\"')）]\s*$")
_CUT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|(?<=……)")
_URL = re.compile(r"\b[a-z]+://\S+")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{2,}\b")
#: Periods in which a text may repeat itself, for the share of periodic characters.
_PERIODS = 12
_ODD = regex.compile(r"[�\p{Co}\p{Cn}\p{So}\p{Sk}─-◿]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_PAUSE = re.compile(r"[,;:，；：、—]")
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûãõåæøœýаеёиоуыэюяіїє")
_END = re.compile(r"[.!?。！？…]")

_NAMES = (
    "log_chars", "log_words", "mean_word_length", "symbol_share", "digit_share", "odd_share", "cjk_share", "common_share", "capital_share", "lines_ended_share", "item_share", "row_share", "pair_share",
    "mean_line_chars", "log_lines", "repeated_share", "distinct_word_share", "ends_per_word", "pauses_per_word", "words_per_stop", "sentence_share", "list_share", "run_share", "url_share", "hex_share",
    "compression", "top_word_share", "vowelless_share", "broken_article_share",
)


def _is_cjk(c: str) -> bool:
    """Whether a character is a Chinese or Japanese one (the blocks of ideographs and kana)."""
    return c >= "\u3005" and (c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\uff66" <= c <= "\uff9f" or "\U00020000" <= c <= "\U0003ffff")


def _is_common(word: str) -> bool:
    return word in _COMMON or "\uac00" <= word[-1] <= "\ud7a3" and word[-1] in KOREAN_ENDS


def _has_vowel(word: str) -> bool:
    """Whether a word can be spoken; words of other scripts than Latin and Cyrillic count as such."""
    return not _VOWELS.isdisjoint(word) or word[0] > "\u052f" or "\u0370" <= word[0] < "\u0400"


def _is_sentence(unit: str) -> bool:
    """Whether a unit reads as a sentence: words held together by common ones, with stops in reach."""
    words = _WORD.findall(unit)
    if not words:
        return False
    cjk = [w for w in words if w[0] >= "\u3005" and _is_cjk(w[0])]
    if len(cjk) * 2 > len(words):
        glue = sum(c in _GLUE for c in cjk)
        stops = 1 + len(_PAUSE.findall(unit)) + len(_END.findall(unit))
        return glue >= 1 and glue >= 0.08 * len(cjk) and len(cjk) / stops <= 45 and len(set(cjk)) * 4 > min(len(cjk), 60)
    latin = [w for w in words if w[0].isalpha()]
    if len(latin) < 2 or len(latin) * 2 < len(words):
        return False
    lower = [w.lower() for w in latin]
    common = sum(map(_is_common, lower))
    stops = 1 + len(_PAUSE.findall(unit)) + len(_END.findall(unit))
    return common >= 1 and common >= 0.12 * len(latin) and len(latin) / stops <= 25 and sum(len(w) for w in latin) / len(latin) < 12


def _is_row(line: str) -> bool:
    """Whether a line has the form of a table row: cell borders, wide gaps, or short cells between commas."""
    return _ROW.search(line) is not None or 3 <= line.count(",") and len(line) < 25 * (line.count(",") + 1) and ", " not in line


def _periodic_share(text: str) -> float:
    """The share of characters that equal the one some fixed number of places before, for the best number."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return max((np.count_nonzero(x[p:] == x[:-p]) / (len(x) - p) for p in range(1, _PERIODS + 1) if len(x) >= 5 * p and len(x) > 12), default=0.0)


def _is_listed(line: str) -> bool:
    """Whether a line has the form of a list item, a table row or a record's field."""
    if _is_row(line) and not _is_sentence(line):
        return True
    if _ITEM.match(line) or _PAIR.match(line):
        rest = _ITEM.sub("", line)
        return not (_is_sentence(rest) and len(_WORD.findall(rest)) >= 6)
    return False


def measures(text: str) -> dict[str, float]:
    """What the signals look at, of a text that isn't blank."""
    n = len(text)
    dense = max(1, sum(map(len, text.split())))
    words = _WORD.findall(text)
    nw = max(1, len(words))
    cjk = [w for w in words if w[0] >= "\u3005" and _is_cjk(w[0])]
    latin = [w for w in words if w[0].isalpha() and not (w[0] >= "\u3005" and _is_cjk(w[0]))]
    lower = [w.lower() for w in latin]
    lines = [x for x in _LINES.split(text) if x.strip()]
    nl = max(1, len(lines))
    listed = [_is_listed(x) for x in lines]
    # units: list lines by themselves, other lines joined as long as they run on
    chars = {True: 0, False: 0}
    paragraph: list[str] = []
    seen: Counter[str] = Counter()

    def close() -> None:
        if paragraph:
            joined = " ".join(paragraph)
            for unit in _CUT.split(joined):
                if unit and unit.strip():
                    chars[_is_sentence(unit)] += len(unit)
                    seen[unit.strip()] += 1
            paragraph.clear()

    in_list = 0
    for x, is_list in zip(lines, listed, strict=True):
        if is_list:
            close()
            in_list += len(x.strip())
            seen[x.strip()] += 1
            continue
        wide = len(x.rstrip()) >= 40
        paragraph.append(x.strip())
        if not wide or _ENDED.search(x):
            close()
    close()
    total = max(1, in_list + chars[True] + chars[False])
    repeated = sum(len(k) * v for k, v in seen.items() if v > 2)
    # what comes again and again is a sentence of its own only once
    flood = sum(len(k) * (v - 1) for k, v in seen.items() if v > 2 and _is_sentence(k)) if repeated > 0.6 * total else 0
    chars[True] = max(0, chars[True] - flood)
    chars[False] += flood
    ends, pauses = len(_END.findall(text)), len(_PAUSE.findall(text))
    common = sum(map(_is_common, lower)) + sum(c in _GLUE for c in cjk)
    raw = text.encode("utf-8", "replace")
    tops = Counter(lower or cjk).most_common(1)
    out = [
        log1p(n), log1p(len(words)), sum(map(len, latin)) / max(1, len(latin)), len(_SYMBOL.findall(text)) / dense, sum(len(w) for w in words if w[0].isnumeric()) / dense, len(_ODD.findall(text)) / dense, len(cjk) / nw,
        common / max(1, len(latin) + len(cjk)), sum(w[0].isupper() for w in latin) / max(1, len(latin)), sum(bool(_ENDED.search(x)) for x in lines) / nl, sum(bool(_ITEM.match(x)) for x in lines) / nl,
        sum(map(_is_row, lines)) / nl, sum(bool(_PAIR.match(x)) for x in lines) / nl, n / nl, log1p(len(lines)), repeated / total, len(set(lower) | set(cjk)) / nw,
        ends / nw, pauses / nw, nw / (1 + ends + pauses), chars[True] / total, in_list / total, _periodic_share(text), sum(map(len, _URL.findall(text))) / dense, sum(map(len, _HEX.findall(text))) / dense,
        len(raw) / max(1, len(zlib.compress(raw, 1))), (tops[0][1] if tops else 0) / nw, sum(not _has_vowel(w) for w in lower) / max(1, len(latin)),
    ]
    articles = [i for i, w in enumerate(lower[:-1]) if w in _ARTICLES]
    out.append(sum(lower[i + 1] in _BY_LANGUAGE[_ARTICLES[lower[i]]] for i in articles) / max(2, len(articles)))
    return dict(zip(_NAMES, out, strict=True))


def signals(text: str) -> dict[str, int]:
    """The votes of the signals that don't keep silent: 1 for junk, 0 for prose."""
    v = measures(text)
    words, chars = v["log_words"], v["log_chars"]
    junk = {
        "few sentences": v["sentence_share"] < 0.3 and (v["list_share"] > 0.6 or chars > 4.0 or v["log_lines"] > 1.5),
        "runs": v["run_share"] > 0.6,
        "addresses": v["url_share"] > 0.6 or v["hex_share"] > 0.5,
        "odd characters": v["odd_share"] > 0.3 or v["symbol_share"] > 0.75 and chars > 2.5,
        "repetition": v["repeated_share"] > 0.7,
        "word order": v["broken_article_share"] > 0.25 and words > 3.0 or v["cjk_share"] < 0.3 and v["ends_per_word"] < 0.03 and v["words_per_stop"] > 18 and words > 3.2,
        "no words": v["vowelless_share"] > 0.5 and v["common_share"] == 0 and words > 1.0,
    }
    prose = {
        "sentences": v["sentence_share"] > 0.7 and v["repeated_share"] < 0.4 and v["run_share"] < 0.3 and v["words_per_stop"] < 18,
        "short reply": (chars < 4.0 or chars < 4.7 and v["sentence_share"] > 0.25) and v["log_lines"] < 1.2 and words > 0 and v["repeated_share"] < 0.5 and v["symbol_share"] < 0.4 and v["list_share"] < 0.5 and v["run_share"] < 0.5
        and v["url_share"] == 0 and v["odd_share"] <= 0.3 and (v["vowelless_share"] <= 0.5 or v["cjk_share"] > 0.3),
    }
    return {k: 1 for k, x in junk.items() if x} | {k: 0 for k, x in prose.items() if x}


def weak_label(text: str) -> int | None:
    """1 for structural junk, 0 for prose, None where signals disagree or keep silent.

    On a line or two of words other signals have nothing to go by, so a short reply is prose whatever they say.
    """
    votes = signals(text)
    if "short reply" in votes:
        return 0
    return votes.popitem()[1] if len(set(votes.values())) == 1 else None
