"""Words of a text in wiki markup, with their places. Markup is overwritten, never cut, so that every place stays true:
what parts words becomes blanks, what may stand within a word (bold marks, soft hyphens) becomes JOIN.

What a reader doesn't meet in the running text, comments, footnotes, short arguments of templates, categories and
alternative texts of images, is no part of it, so that it parts no sentence; it is read as segments of its own. Only names
of tags, templates, arguments and link targets, attributes, addresses and switches are markup that nobody reads."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import regex

JOIN = "\0"

# Tags of HTML and of the wiki that may stand within a word, and those that part words. Anything else in
# angle brackets is text.
_INLINE = "b|i|u|s|em|strong|span|font|small|big|sup|sub|nowiki|code|tt|del|ins|mark|abbr|bdi|q|cite|noinclude|includeonly"
_TAGS = "a|address|article|aside|audio|blockquote|body|br|caption|center|col|colgroup|dd|div|dl|dt|figure|footer|gallery|h1|h2|h3|h4|h5|h6|head|header|hr|html|img|kbd|li|link|math|meta|nav|ol|onlyinclude|p|poem|pre|ref|references|rp|rt|ruby|samp|script|section|source|style|syntaxhighlight|table|tbody|td|tfoot|th|thead|timeline|title|tr|ul|var|video|wbr"

#: Words from which on an argument of a template is running text.
RUNNING = 8

#: Takes what is no running text: its place and the text, of the same length as there.
Aside = Callable[[int, str], None]


def _fill(ch: str):  # noqa: ANN202
    return lambda m: ch * len(m[0])


def _entity(m) -> str:  # noqa: ANN001
    c = html.unescape(m[0])
    if c == m[0] or not c:
        return " " * len(m[0])
    if unicodedata.category(c[0]) == "Cf":
        return JOIN * len(m[0])
    return c[0] + JOIN * (len(m[0]) - 1) if c[0].isalnum() or c[0] in "'’-‐" else " " * len(m[0])


_NAMED = re.compile(r"\s*[\w.-]+(?: [\w.-]+)?\s*=")


def _template(m, aside: Aside) -> str:  # noqa: ANN001
    """Arguments of RUNNING words or more are running text; the others are read aside, all of one template together."""
    running, rest = [], []
    for i, arg in enumerate(m[0].split("|")):
        arg = arg.replace("}", " ")
        name = _NAMED.match(arg) if i else None
        text = " " * len(name[0]) + arg[name.end() :] if name else arg if i else " " * len(arg)
        long = len(text.split()) >= RUNNING
        running.append(text if long else " " * len(arg))
        rest.append(" " * len(arg) if long else text)
    short = "\n".join(rest)
    if not short.isspace():
        aside(m.start(), short)
    return " ".join(running)


def _footnote(m, aside: Aside) -> str:  # noqa: ANN001
    if m[1]:
        aside(m.start(1), m[1])
    return " " * len(m[0])


def _comment(m, aside: Aside) -> str:  # noqa: ANN001
    aside(m.start(1), m[1])
    return JOIN * len(m[0])


_ALT = re.compile(r"\|\s*alt\s*=([^|]*)", re.I)


def _link(m, aside: Aside) -> str:  # noqa: ANN001
    body = m[1]
    at = body.rfind("|")
    head = body.split(":", 1)[0].strip().casefold()
    if head in ("category", "kategorie", "categoría", "catégorie", "категория"):
        aside(m.start(1) + body.index(":") + 1, body.split(":", 1)[1].replace("|", "\n"))
        return " " * len(m[0])
    if at < 0:
        return JOIN * 2 + body + JOIN * 2
    picture = head in ("file", "image", "datei", "archivo", "fichier", "файл")
    if picture and (alt := _ALT.search(body, 0, at)):
        aside(m.start(1) + alt.start(1), alt[1])
    ch = " " if picture else JOIN
    return ch * (2 + at + 1) + body[at + 1 :] + ch * 2


_STEPS = [
    (re.compile(r"<!--(.*?)-->", re.S), _comment),
    (re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(.*?)</ref\s*>", re.S | re.I), _footnote),
    (re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I), _fill(JOIN)),
    (re.compile(rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>", re.I), _fill(" ")),
    (re.compile(r"\{\{[^{}]*\}\}"), _template),
    (re.compile(r"\{\{[^{}]*\}\}"), _template),
    (re.compile(r"^[ \t]*(?:\{\||\|-).*$|^[ \t]*\|\+", re.M), lambda m: " " * len(m[0])),
    (re.compile(r"""(?:^|(?<=\|\|)|(?<=!!))[ \t]*[|!]?[ \t]*(?:[\w-]+=(?:"[^"\n]*"|\w+)[ \t]*)+\|(?!\|)""", re.M), lambda m: " " * len(m[0])),
    (re.compile(r"\[\[([^\[\]\n]*)\]\]"), _link),
    (re.compile(r"\[\[([^\[\]\n]*)\]\]"), _link),
    (re.compile(r"\[?\b(?:https?|ftp)://[^\s\]|<>]+"), _fill(" ")),
    (re.compile(r"__[A-Z]+__"), _fill(" ")),
    (re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w{2,31});"), _entity),
    (re.compile(r"''+"), _fill(JOIN)),
    (regex.compile(r"(?<=\p{L})[-‐]\r?\n[ \t]*(?=\p{L})"), _fill(JOIN)),
    (regex.compile(r"\p{Cf}"), JOIN),
]
#: What each step needs to have anything to do.
_NEEDS = ["<!--", "<", "<", "<", "{{", "{{", "|", "=", "[[", "[[", "://", "__", "&", "''", "\n", None]
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}\0'’‘ʼ‐‑-]+")
_DROP = str.maketrans("", "", "\0'’‘ʼ‐‑-")


_ASIDE = (_comment, _footnote, _template, _link)


def _nowhere(place: int, text: str) -> None:
    pass


def plain(text: str, aside: Aside = _nowhere) -> str:
    """The running text, its markup overwritten, of the same length; what is none goes to aside."""
    if JOIN in text:
        text = text.replace(JOIN, " ")
    for (pattern, by), need in zip(_STEPS, _NEEDS, strict=True):
        if (need in text) if need else not text.isascii():
            text = pattern.sub((lambda m, by=by: by(m, aside)) if by in _ASIDE else by, text)
    return text


def segments(text: str) -> Iterator[tuple[int, str]]:
    """(place, text without markup) of the running text and of everything aside of it, each part of the text once."""
    todo = [(0, text)]
    while todo:
        base, s = todo.pop()
        out = plain(s, lambda place, t, base=base: todo.append((base + place, t)))
        if out and not out.isspace():
            yield base, out


def spell(raw: str) -> str:
    """A word as it is compared: without apostrophes, hyphens and joins, in lower case; may be empty."""
    w = raw.translate(_DROP)
    return w.lower() if w.isascii() else unicodedata.normalize("NFKC", w).casefold()


def raw_words(plain_text: str) -> list[str]:
    """The words of words() in a text without markup, before spell() and with empty ones."""
    return _WORD.findall(plain_text)


def words(plain_text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of every word of a text without markup: letters, digits and marks in lower case; apostrophes and
    hyphens within a word are dropped, all other punctuation parts words."""
    found = ((spell(m[0]), m.start(), m.end()) for m in _WORD.finditer(plain_text))
    return [w for w in found if w[0]]
