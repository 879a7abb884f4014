"""Extraction kernels in plain Python: HTML, feeds, lenient JSON, identifiers."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

#: Parts of a page that are dropped.
_DROP = {"script", "style", "noscript", "svg", "nav", "header", "footer", "form"}
_BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.drop = 0
        self.inside: list[str] = []
        self.parts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.links: list[tuple[str, str]] = []
        self.href, self.label = "", ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _DROP:
            self.drop += 1
        if tag in ("article", "main"):
            self.inside.append(tag)
        if tag in _BREAK:
            self._add("\n")
        if tag == "a":
            self.href, self.label = dict(attrs).get("href") or "", ""

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROP and self.drop:
            self.drop -= 1
        if tag in ("article", "main") and tag in self.inside:
            self.inside.remove(tag)
        if tag in _BREAK:
            self._add("\n")
        if tag == "a" and self.href:
            self.links.append((self.href, " ".join(self.label.split())))
            self.href = ""

    def handle_data(self, data: str) -> None:
        if self.href:
            self.label += data
        self._add(data)

    def _add(self, data: str) -> None:
        if not self.drop:
            for name in {*self.inside, "body"}:
                self.parts[name].append(data)


def readable(html: str) -> str:
    """The text of the article, else the main part, else the body, without navigation, forms and scripts."""
    r = _Reader()
    r.feed(html)
    text = next(("".join(r.parts[k]) for k in ("article", "main", "body") if "".join(r.parts[k]).strip()), "")
    return "\n".join(" ".join(x.split()) for x in text.split("\n") if x.strip())


def links(html: str, base: str = "", least: int = 4, most: int = 25) -> list[tuple[str, str]]:
    """Absolute, distinct links with a label of at least four characters."""
    r, out, seen = _Reader(), [], set()
    r.feed(html)
    for href, label in r.links:
        url = urljoin(base, href)
        if len(label) >= least and url.startswith(("http://", "https://")) and url not in seen:
            seen.add(url)
            out.append((url, label))
    return out[:most]


def feed_items(xml: str) -> list[dict]:
    """Items of an RSS 2.0 or Atom feed; [] for what isn't one."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out = []
    for node in root.iter():
        if node.tag.split("}")[-1] in ("item", "entry"):
            kids = {k.tag.split("}")[-1]: k for k in node}
            link = kids.get("link")
            url = (link.text or link.get("href") or "").strip() if link is not None else ""
            text = lambda *names: next(((kids[n].text or "").strip() for n in names if n in kids), "")
            out.append({"title": text("title"), "url": url, "key": text("guid", "id") or url, "snippet": text("description", "summary", "content")})
    return out


_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def repaired_escapes(text: str) -> str:
    """JSON text in which a backslash that begins no escape is doubled, in one pass over its escapes.

    A control escape before a small letter is taken for a command of formulas (``\\frac``, ``\\tan``), not for a control character.
    """
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        follows = text[k + 1 : k + 2]
        if follows == "u" and len(text) >= k + 6 and all(c in "0123456789abcdefABCDEF" for c in text[k + 2 : k + 6]):
            width, kept = 6, True
        elif follows in ("\\", '"', "/") and follows:
            width, kept = 2, True
        else:
            control = follows != "" and follows in "bfnrt"
            kept = control and not ("a" <= text[k + 2 : k + 3] <= "z")
            width = 2 if control else 1
        out.append(text[k : k + width] if kept else "\\" + text[k : k + width])
        at = k + width
    return "".join(out) + text[at:]


def _first_value(body: str) -> tuple[bool, object]:
    """The first object or array that a bracket of the text begins; strictly, then with its escapes repaired."""
    decoder = json.JSONDecoder()
    for form in (body, repaired_escapes(body)):
        for m in re.finditer(r"[\[{]", form):
            try:
                return True, decoder.raw_decode(form, m.start())[0]
            except ValueError:
                continue
    return False, None


def _whole_elements(body: str) -> list:
    """The elements of an array that was cut, up to the cut."""
    kept, at, decoder = [], body.find("[") + 1, json.JSONDecoder()
    while 0 < at < len(body):
        while at < len(body) and body[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(body, at)
        except ValueError:
            break
        kept.append(value)
    return kept


def lenient_json(text: str) -> object | None:
    """The JSON of a model's answer: of the fenced part first, then of the whole text.

    Brackets are tried one after the other, so prose in brackets before the answer does no harm; stray backslashes are
    doubled; an array that was cut keeps its whole elements.
    """
    parts = [*_FENCED.findall(text), text]
    for part in parts:
        first = re.search(r"[\[{]", part)
        # a cut array: its elements, rather than the first object in it
        if first and part[first.start()] == "[":
            body = part[first.start() :]
            for form in (body, repaired_escapes(body)):
                try:
                    return json.JSONDecoder().raw_decode(form)[0]
                except ValueError:
                    if kept := _whole_elements(form):
                        return kept
        found, value = _first_value(part)
        if found:
            return value
    return None


def snap_identifier(word: str, known: list[str], floor: float = 0.82) -> str | None:
    """The known identifier that is the same but for separators and case, or else the most similar one from the floor on."""
    plain = lambda s: re.sub(r"[-_.\s]", "", s).lower()
    same = sorted(k for k in known if plain(k) == plain(word))
    if same:
        return same[0]
    scored = [(SequenceMatcher(None, word.lower(), k.lower()).ratio(), k) for k in known]
    best = max(scored, key=lambda x: (x[0], x[1]), default=(0.0, None))
    return best[1] if best[0] >= floor else None
