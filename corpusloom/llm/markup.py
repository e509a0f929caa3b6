"""Markup residue to clean text that keeps headings, lists, code and formulas.

A text is read once: quoted code and formulas are set aside, the rest is fed to the standard library's streaming HTML parser,
whose events give text and tags by line; lines are clustered by their smoothed text-to-tag ratio; and the remaining lines are
rid of Markdown, wiki and LaTeX marks. Clean text is written alike whatever the markup was: `# ` before a heading, `- ` before
a list item, code between fences, formulas between dollar signs, cells between bars.
"""

import html.entities
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML, by what they do to the text.
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset head header hgroup hr html legend "
            "main nav noframes noscript ol p section summary table tbody tfoot thead title tr ul br caption menu option select".split())
INLINE = set("a abbr acronym applet area audio b base basefont bdi bdo big button canvas cite code col colgroup data datalist del dfn em embed font frame i iframe img input "
             "ins kbd label link map mark meta meter object optgroup output param picture pre progress q rp rt ruby s samp script slot small source span strike strong "
             "style sub sup svg td template textarea th time track tt u var video wbr li h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = {"nav", "footer", "header", "aside", "form", "head", "noscript", "iframe"}
SILENT = {"script", "style", "head", "template"}
WIKI_TAGS = {"ref", "references", "gallery", "nowiki", "noinclude", "includeonly", "onlyinclude", "syntaxhighlight"}

# Private characters stand for what must not be read again: set-aside parts, and characters that were entities.
_OPEN, _SHUT, _LT, _GT, _AMP = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_FORTH = str.maketrans({"<": _LT, ">": _GT, "&": _AMP})

_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CODE = re.compile(r"^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*$|\\begin\{(?P<env>verbatim|lstlisting|minted)\*?\}|<(?P<tag>pre|code|syntaxhighlight|nowiki)\b[^<>]*>|(?P<tick>`+)", re.M | re.I)
_FORMULA = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}|\$\$|\\\[|\\\(|\$(?=[^\s$\d])[^$\n]+(?<=[^\s\\$])\$(?!\w)|\$(?=\d)(?=[^$\n]*[\\^_=])[^$\n]+(?<=[^\s\\$])\$(?!\w)")
_GAPS = re.compile(r"\n{3,}")
_MATHS = re.compile(r"[\\^_=+*/<>{}|-]|^\w{1,3}$")


class _Store:
    """Parts set aside, each a character triple in the text."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, str]] = []
        self.langs: set[str] = set()
        self.missing: set[str] = set()

    def put(self, kind: str, body: str) -> str:
        self.parts.append((kind, body))
        return f"{_OPEN}{len(self.parts) - 1}{_SHUT}"

    def find(self, text: str, what: str, at: int) -> int:
        """text.find; what was not found once is not sought again, so that openings without an end cost nothing."""
        if what in self.missing:
            return -1
        if (k := text.find(what, at)) < 0:
            self.missing.add(what)
        return k


def _set_code_aside(text: str, store: _Store) -> str:
    out, at, low = [], 0, text.lower()
    while m := _CODE.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if fence := m["fence"]:
            store.langs.add("markdown")
            end = re.compile(rf"^[ ]{{0,3}}{re.escape(fence)}+[ \t]*$", re.M)
            if fence not in store.missing and (e := end.search(text, at)):
                out.append("\n" + store.put("block", text[at : e.start()].strip("\n")) + "\n")
                at = e.end()
            else:
                store.missing.add(fence)
        elif env := m["env"]:
            store.langs.add("latex")
            close = "\\end{" + env.lower()
            if (e := store.find(low, close, at)) >= 0:
                out.append("\n" + store.put("block", text[at:e].strip("\n")) + "\n")
                at = low.find("}", e) + 1 or len(text)
        elif tag := m["tag"]:
            store.langs.add("wiki" if tag.lower() in WIKI_TAGS else "html")
            if (e := store.find(low, f"</{tag.lower()}", at)) >= 0:
                body = re.sub(r"^\s*<code\b[^>]*>|</code>\s*$", "", text[at:e], flags=re.I)
                body = _ENTITY.sub(lambda x: html.unescape(x[0]), body)
                wide = tag.lower() in ("pre", "syntaxhighlight") or "\n" in body
                out.append("\n" + store.put("block", body.strip("\n")) + "\n" if wide else store.put("inline", body))
                at = text.find(">", e) + 1 or len(text)
        else:
            tick = m["tick"]
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            e = re.compile(rf"(?<!`){tick}(?!`)").search(text, at, stop)
            body = text[at : e.start()] if e else ""
            if body.strip():
                store.langs.add("markdown")
                out.append(store.put("inline", body.strip()))
                at = e.end()
            else:
                out.append(tick)
    out.append(text[at:])
    return "".join(out)


def _set_formulas_aside(text: str, store: _Store) -> str:
    ends = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}
    out, at = [], 0
    while m := _FORMULA.search(text, at):
        out.append(text[at : m.start()])
        at, found = m.end(), m[0]
        if m[1] or found in ends:
            close = f"\\end{{{m[1]}{m[2]}}}" if m[1] else ends[found]
            e = store.find(text, close, at)
            if e >= 0 and (body := text[at:e].strip()):
                store.langs.add("latex")
                body = re.sub(r"\\label\{[^{}]*\}", "", body).strip()
                out.append(store.put("formula", body) if found == "\\(" else "\n" + store.put("display", body) + "\n")
                at = e + len(close)
            elif e >= 0:  # an empty one: its close opens nothing
                out.append(text[m.start() : e + len(close)])
                at = e + len(close)
            else:
                out.append(found)
        elif _MATHS.search(found[1:-1]):
            store.langs.add("latex")
            out.append(store.put("formula", found[1:-1].strip()))
        else:
            out.append(found[0])
            at = m.start() + 1
    out.append(text[at:])
    return "".join(out)


class _Reader(HTMLParser):
    """Parser events to lines of text, with the tags, the text and the linked text that each source line holds."""

    def __init__(self, store: _Store) -> None:
        super().__init__(convert_charrefs=False)
        self.store, self.out = store, []
        self.silent = self.link = self.aside = 0
        self.lists: list[str] = []
        self.tags: dict[int, int] = {}
        self.chars: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        self.framed: dict[int, bool] = {}
        self.shaped: set[int] = set()  # source lines with an item, cell or heading outside the frames
        self.at: list[tuple[int, int]] = []  # (index into out, source line)

    def _put(self, s: str) -> None:
        self.at.append((len(self.out), self.getpos()[0]))
        self.out.append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in WIKI_TAGS:
            self.store.langs.add("wiki")
            return
        if tag not in BLOCK and tag not in INLINE:
            self.handle_data(self.get_starttag_text() or "")
            return
        self.store.langs.add("html")
        line = self.getpos()[0]
        self.tags[line] = self.tags.get(line, 0) + 1
        if tag in SILENT:
            self.silent += 1
        if tag in BOILERPLATE:
            self.aside += 1
        if tag == "a":
            self.link += 1
        if tag in ("ul", "ol"):
            self.lists.append(tag)
        if not self.aside and (tag in ("li", "td", "th", "dt", "dd") or re.fullmatch("h[1-6]", tag)):
            self.shaped.add(line)
        if tag == "li":
            self._put("\n" + "  " * max(0, len(self.lists) - 1) + "- ")
        elif tag in ("td", "th"):
            self._put(" | ")
        elif re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + _OPEN + "h" + tag[1] + _SHUT)
        elif tag in BLOCK:
            self._put("\n" if tag in ("br", "tr") else "\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in WIKI_TAGS or tag not in BLOCK and tag not in INLINE:
            if tag not in WIKI_TAGS:
                self.handle_data(f"</{tag}>")
            return
        self.store.langs.add("html")
        line = self.getpos()[0]
        self.tags[line] = self.tags.get(line, 0) + 1
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in BOILERPLATE:
            self.aside = max(0, self.aside - 1)
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if re.fullmatch("h[1-6]", tag) or tag in BLOCK and tag not in ("br", "hr"):
            self._put("\n" if tag == "tr" else "\n\n")

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        line = self.getpos()[0]
        for k, part in enumerate(data.split("\n")):
            n = len(part.strip())
            self.chars[line + k] = self.chars.get(line + k, 0) + n
            if self.link:
                self.linked[line + k] = self.linked.get(line + k, 0) + n
            if self.aside:
                self.framed[line + k] = True
            self.at.append((len(self.out), line + k))
            self.out.append(("\n" if k else "") + part)

    def handle_comment(self, data: str) -> None:
        self.store.langs.add("html")

    def handle_decl(self, decl: str) -> None:
        self.store.langs.add("html")

    def handle_pi(self, data: str) -> None:
        self.handle_data(f"<?{data}>")

    def unknown_decl(self, data: str) -> None:
        self.handle_data(f"<![{data}]>")


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """values under a Gaussian of sigma lines, at the ends with the weights that remain."""
    r = max(1, math.ceil(2 * sigma))
    g = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    for k in range(len(values)):
        pairs = [(values[k + j], g[j + r]) for j in range(-r, r + 1) if 0 <= k + j < len(values)]
        out.append(sum(v * w for v, w in pairs) / sum(w for _, w in pairs))
    return out


def threshold(values: list[float]) -> float:
    """Between the two clusters of values, by Lloyd's iteration from the extremes; below all if they are one cluster."""
    if not values or max(values) - min(values) < 1e-9:
        return -1.0
    lo, hi = min(values), max(values)
    for _ in range(50):
        t = (lo + hi) / 2
        a, b = [v for v in values if v <= t], [v for v in values if v > t]
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def _regions(r: _Reader) -> set[int]:
    """Source lines outside the content: of the cluster with little text a tag, and in a frame of the page or nearly all links.

    Lines without tags are content, and so are lines with a heading, item or cell outside the frames, whatever they link to.
    """
    if not r.tags:
        return set()
    last = max([*r.tags, *r.chars])
    ratio = [math.log1p(r.chars.get(k, 0) / max(1, r.tags.get(k, 0))) for k in range(1, last + 1)]
    soft = smoothed(ratio)
    t = threshold(soft)
    return {k for k in r.tags if soft[k - 1] <= t and (r.framed.get(k) or k not in r.shaped and r.chars.get(k, 0) and r.linked.get(k, 0) > 0.8 * r.chars[k] and r.tags[k] >= 6)}


def _hints(s: str | None) -> tuple[str, ...]:
    """Strings parted by | of which a text must hold one; none for None, which stands for a bar."""
    return ("|",) if s is None else tuple(s.split("|"))


def _held(text: str, hints: tuple[str, ...]) -> bool:
    for h in hints:
        if h in text:
            return True
    return not hints


def _marks(flags: int, *pairs: tuple[str | None, str]) -> list:
    return [(_hints(h), re.compile(p, flags)) for h, p in pairs]


# A pattern is looked for only where one of the strings before it is in the text: it cannot match without.
_LINE_MARKS = {
    "markdown": _marks(
        re.M,
        ("#", r"^ {0,3}#{1,6}[ \t]+\S"), ("\n===|\n---", r"^(?![ \t]*(?:[-=|]|\Z))[^\n]*\S[^\n]*\n(?:={3,}|-{3,})[ \t]*$"), ("**", r"(?<![\\*])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?!\*)"),
        ("__", r"(?<![\w\\])__(?=[^\s_])(?!(?:NO)?TOC__)[^_\n]+?(?<=[^\s_])__(?!\w)"), ("~~", r"~~(?=\S)[^~\n]+?(?<=\S)~~"), ("*", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])"),
        ("_", r"(?<![\w\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w)"), ("](", r"!?\[[^\[\]\n]*\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"), ("][|] [", r"(?<!\[)\[[^\[\]\n]+\] ?\[[^\[\]\n^][^\[\]\n]*\](?!\])"),
        ("]:", r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S"), ("[^", r"\[\^[^\[\]\s]+\]"), (">", r"^ {0,3}>(?:[ \t]|$)"), ("[ ] |[x] |[X] ", r"^[ \t]*[-*+] \[[ xX]\] "),
        (None, r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$"),
    ),
    "wiki": _marks(
        re.M | re.I,
        ("[[", r"\[\[[^\[\]\n]+\]\]"), ("{{", r"\{\{[^{}\n|]+(?:\|[^{}]*)?\}\}"), ("==", r"^(={2,6})(?!=)[ \t]*\S(?:[^\n]*\S)?[ \t]*(?<!=)\1[ \t]*$"), ("''", r"(?<!')'''?(?=[^\s'])[^\n]+?(?<=[^\s'])'''?(?!')"),
        (None, r"^\{\|"), (None, r"^\|\}[ \t]*$"), ("://", r"(?<!\])\[(?:https?|ftp)://[^\s\[\]]+[ \t]+[^\[\]\n]+\](?![(\[])"), ("#", r"^#REDIRECT\b"), ("__", r"__(?:NO)?TOC__"),
    ),
    "latex": _marks(
        re.M,
        ("\\", r"\\(?:begin|end)\{[A-Za-z]+\*?\}"), ("\\", r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{"), ("\\", r"^[ \t]*\\item\b"),
        ("\\", r"\\(?:emph|text[a-z]{2}|underline|footnote|cite[a-z]*|label|ref|eqref|url|href|caption|title|author|date|usepackage|documentclass|includegraphics|newcommand|input|include|bibliography)\*?[\[{]"),
        ("\\", r"\\(?:maketitle|tableofcontents|noindent|centering|hline|newpage|bigskip|medskip)\b"),
    ),
}


def _subs(*rules: tuple[str | None, str, object, int]) -> list:
    return [(_hints(h), re.compile(p, flags), to) for h, p, to, flags in rules]


def _template(m: re.Match) -> str:
    return "; ".join(x.strip().replace("=", ": ", 1) for x in m[1].split("|")[1:] if x.strip())


def _target(m: re.Match) -> str:
    name, _, shown = m[1].partition("|")
    if not shown and re.match(r"(?:category|categoria|kategorie)\s*:", name, re.I):
        return ""
    return (shown.rpartition("|")[2] or name.partition("#")[0] or name).strip()


_CLEAN = {
    "wiki": _subs(
        ("#", r"^#REDIRECT\s*", "", re.M | re.I), ("{{", r"\{\{[^{}\n|]+\}\}", "", 0), ("{{", r"\{\{([^{}]*)\}\}", _template, 0), ("[[", r"!?\[\[([^\[\]\n]+)\]\]", _target, 0),
        ("==", r"^(={2,6})(?!=)[ \t]*(\S(?:[^\n]*?\S)?)[ \t]*\1[ \t]*$", lambda m: f"\n{'#' * len(m[1])} {m[2]}\n", re.M), ("'''", r"'''(?=\S)([^\n]+?)'''", r"\1", 0), ("''", r"(?<!')''(?=[^\s'])([^\n]+?)''(?!')", r"\1", 0),
        (None, r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n]*$", "", re.M), ("", r"^[|!](?![}-])[ \t]*([^\n]*)$", lambda m: "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]), re.M),
        ("://", r"\[(?:https?|ftp)://[^\s\[\]]+[ \t]+([^\[\]\n]+)\]", r"\1", re.I), ("*", r"^(\*+)(?:[ \t]+|(?=\[\[|''))", lambda m: "  " * (len(m[1]) - 1) + "- ", re.M), ("__", r"__(?:NO)?TOC__", "", 0),
    ),
    "latex": _subs(
        ("\\", r"\\(sub)*(?:section|chapter|paragraph)\*?\{([^{}\n]*)\}", lambda m: "\n" + "#" * (1 + m[0].count("sub")) + f" {m[2]}\n", 0), ("\\", r"^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m[1] or ""), re.M),
        ("\\", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "", 0), ("\\", r"~?\\cite[a-z]*(?:\[[^\]\n]*\])*\{([^{}\n]*)\}", r" [\1]", 0), ("\\", r"\\footnote\{([^{}]*)\}", r" (\1)", 0),
        ("\\", r"\\(?:label|ref|eqref|usepackage|documentclass|includegraphics|input|include|bibliography)(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", 0), ("\\", r"\\(?:emph|text[a-z]{2}|underline|caption|title|author|date|url)\{([^{}]*)\}", r"\1", 0),
        ("\\", r"\\(?:maketitle|tableofcontents|noindent|centering|hline|newpage|bigskip|medskip)\b", "", 0), ("&", r"[ \t]*(?<!\\)&[ \t]*([^\n]*?)[ \t]*\\\\[ \t]*$", r" | \1", re.M),
    ),
    "markdown": _subs(
        ("#", r"^ {0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", r"\n\1 \2\n", re.M), ("\n===", r"^(?![ \t]*(?:[-=|]|\Z))([^\n]*\S[^\n]*)\n={3,}[ \t]*$", r"\n# \1\n", re.M), ("\n---", r"^(?![ \t]*(?:[-=|]|\Z))([^\n]*\S[^\n]*)\n-{3,}[ \t]*$", r"\n## \1\n", re.M),
        ("]:", r"^ {0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]+\S[^\n]*\n?", "", re.M), ("]:", r"^ {0,3}\[\^([^\[\]\s]+)\]:[ \t]*", r"(\1) ", re.M), ("[^", r"\[\^[^\[\]\s]+\]", "", 0),
        ("](", r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", 0), ("][|] [", r"(?<!\[)\[([^\[\]\n]+)\] ?\[[^\[\]\n]*\](?!\])", r"\1", 0), ("**", r"(?<![\\*])\*\*(?=[^\s*])([^*\n]+?)\*\*(?!\*)", r"\1", 0),
        ("__", r"(?<![\w\\])__(?=[^\s_])(?!(?:NO)?TOC__)([^_\n]+?)__(?!\w)", r"\1", 0), ("~~", r"~~(?=\S)([^~\n]+?)~~", r"\1", 0), ("*", r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])", r"\1", 0),
        ("_", r"(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)", r"\1", 0), (">", r"^ {0,3}(?:>[ \t]?)+", "", re.M), ("[ ] |[x] |[X] ", r"^([ \t]*)[-*+] \[([ xX])\] ", r"\1- ", re.M), ("* |+ ", r"^([ \t]*)[*+] ", r"\1- ", re.M),
        (None, r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$\n?", "", re.M), (None, r"^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", re.M), ("", r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", "", re.M),
    ),
}


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, the markup languages in it, in alphabetical order). Null stays null; a blank text becomes empty."""
    if text is None:
        return None, []
    store = _Store()
    t = text
    for old, new in ((_OPEN, ""), (_SHUT, ""), (_LT, ""), (_GT, ""), (_AMP, ""), ("\r\n", "\n"), ("\r", "\n")):
        t = t.replace(old, new)
    if _held(t, ("`", "~~~", "<", "\\begin")):
        t = _set_code_aside(t, store)
    if _held(t, ("$", "\\")):
        t = _set_formulas_aside(t, store)

    def decode(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#" and name + ";" not in html.entities.html5:
            return m[0]
        store.langs.add("html")
        return html.unescape(m[0]).translate(_FORTH)

    if "&" in t:
        t = _ENTITY.sub(decode, t).replace("&", _AMP)
    if "<" in t:
        r = _Reader(store)
        r.feed(t)
        r.close()
        if "html" in store.langs:
            gone = _regions(r)
            where = dict(r.at)
            t = "".join(("\n" if s.startswith("\n") else "") if where.get(k) in gone and _OPEN not in s else s for k, s in enumerate(r.out))
        elif "wiki" in store.langs:
            t = "".join(r.out)
    flat = t.replace(_AMP, "&")
    for lang, marks in _LINE_MARKS.items():
        if any(_held(flat, h) and p.search(flat) for h, p in marks):
            store.langs.add(lang)
    t = flat
    for lang in ("wiki", "latex", "markdown"):
        if lang in store.langs:
            for h, p, to in _CLEAN[lang]:
                if _held(t, h):
                    t = p.sub(to, t)
    if _OPEN in t:
        t = re.sub(f"{_OPEN}h([1-6]){_SHUT}\\s*([^\n]*)", lambda m: f"{'#' * int(m[1])} {m[2]}" if m[2].strip() else "", t)

    def back(m: re.Match) -> str:
        kind, body = store.parts[int(m[1])]
        return {"block": f"\n```\n{body}\n```\n", "display": f"\n$${body}$$\n", "formula": f"${body}$", "inline": body}[kind]

    if " \n" in t or "\t\n" in t:
        t = re.sub(r"(?<![ \t])[ \t]+\n", "\n", t)
    if "\n\n\n" in t:
        t = _GAPS.sub("\n\n", t)
    if _OPEN in t:
        t = re.sub(f"{_OPEN}(\\d+){_SHUT}", back, t)
    for private, plain in ((_LT, "<"), (_GT, ">"), (_AMP, "&")):
        t = t.replace(private, plain)
    if store.langs:
        if "| " in t:
            t = re.sub(r"^\s*\| ", "", t, flags=re.M)
        t = _GAPS.sub("\n\n", t)
    return t.strip(), sorted(store.langs)


def cleaned(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clean_text, markup): see clean(); markup is an array of `html`, `latex`, `markdown`, `wiki`, empty for plain text.

    A row for each row, alike or with a null key or not; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [clean(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=[key, "clean_text", "markup"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, clean_text string, markup array<string>")
