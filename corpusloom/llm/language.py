"""A small language guess by script and function words, for rules that need one."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words that few other languages share.
STOP = {
    "en": "the of and to in is that it was for on with as by this its an which when if then our more at be are from not but",
    "de": "der die das und den dem ein eine einer ist nicht mit von zu im auf für aus bei nach über wird am des vor ohne oder vom zum jede auch",
    "fr": "le la les des une et du est que dans pour sur par pas au avec sans de un en ce cette chaque aux après avant l d qu",
    "es": "el los las una y del es que en por para con sin se lo como de la un cada al antes más según",
}
_LATIN = re.compile(r"[^\W\d_]+")
_WORDS = {}
for _lang, _list in STOP.items():
    for _w in _list.split():
        _WORDS.setdefault(_w, []).append(_lang)
_SHARE = {w: {k: 1 / len(v) for k in v} for w, v in _WORDS.items()}
_SCRIPTS = (
    ("ja", re.compile(r"[ぁ-ヿ]")),
    ("zh", re.compile(r"[一-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("th", re.compile(r"[฀-๿]")),
    ("ko", re.compile(r"[가-힯]")),
)
_OTHER = re.compile(r"[Ѐ-퟿]")
_MARKS = (("de", re.compile("[äöüßÄÖÜ]")), ("es", re.compile("[ñ¿¡áíóú]")), ("fr", re.compile("[èêëçœàâîïûù«»]")))


def language(text: str, count: Counter | None = None) -> str:
    """The language of most of the text: a script's, or the one of the four Latin ones whose function words prevail; '' if nothing tells.

    ``count``: the counted words of the text in lower case, where they are at hand.
    """
    if not text:
        return ""
    if not text.isascii():
        counts = dict.fromkeys((k for k, _ in _SCRIPTS), 0)
        if _OTHER.search(text):
            counts = {k: len(p.findall(text)) for k, p in _SCRIPTS}
    if not text.isascii() and any(counts.values()):
        latin = sum(map(len, re.findall(r"[A-Za-zÀ-ÿ]+", text))) / 3
        if counts["ja"] and counts["ja"] * 8 > counts["zh"]:
            counts["ja"] += counts["zh"]
        best = max(counts, key=counts.get)
        if counts[best] > latin:
            return best
    score = dict.fromkeys(STOP, 0.0)
    if count is None:
        count = Counter(_LATIN.findall(text.lower()))
    for w in _SHARE.keys() & count.keys():
        n = count[w]
        for k, v in _SHARE[w].items():
            score[k] += n * v
    if not text.isascii():
        for k, p in _MARKS:
            score[k] += 0.34 * len(p.findall(text))
    best = max(score, key=score.get)
    return best if score[best] > 0 else ""
