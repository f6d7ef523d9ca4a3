"""Sentence boundaries in LaTeX documents across languages and scripts.

A document is first masked, character by character and without changing any
offset: preamble, headings, captions, bibliographies, comments and formulas
become marker characters, so that what is left is prose. In the masked text
every closing mark (with the quotes, brackets and footnotes attached to it) is a
candidate. Tables of ordered rules decide it: each rule is a pair of regular
expressions for the text before and after the position and either breaks or
doesn't; the tables of the document's language are asked first, then the general
one, and the first rule that matches decides. The language is the one whose script
or, in Latin script, whose function words the text has most of.

Work is per document and row-wise (no shuffle); texts stream through Arrow
batches, so memory is bounded by a batch. Whole texts are processed.

Defined results: null and empty texts have no sentences; an unclosed
environment, formula or comment runs to the next blank line or the edge of the
text; a missing \\begin or \\end of the document means the edge of the text; the
lang column isn't trusted: the text itself chooses the tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marker characters of the masked text.
HARD = "\x00"  # not prose; ends a sentence
GAP = "\x01"  # comment or the like: part of a sentence that goes on
DISPLAY = "\x02"  # formula of its own line: likewise
ATOM = "\x03"  # inline formula, citation, macro: like a word
CLOSER = "\x04"  # what may follow a closing mark: footnote, end of a formula

_ENV_SKIP = "figure|table|thebibliography|verbatim|lstlisting|tabular|tikzpicture"
_ENV_DISPLAY = "equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat"
_BRACES = r"\{(?:[^{}\\\n]|\\.|\{(?:[^{}\\\n]|\\.|\{[^{}\n]*\})*\}|\n(?!\s*\n))*\}"
_ARGS = rf"(?:\*?(?:\[[^\]\n]*\])?(?:{_BRACES})*)"

#: Ordered: the first alternative that matches at a position decides what it is.
_TOKENS = regex.compile(
    rf"""
      (?P<gap>(?<!\\)%[^\n]*(?:\n[ \t]*(?!\n)|\n?) | \\iffalse\b.*?(?:\\fi\b|\Z) | \\begin\{{comment\}}.*?(?:\\end\{{comment\}}|\Z))
    | (?P<skip>\\begin\{{(?P<e1>(?:{_ENV_SKIP})\*?)\}}.*?(?:\\end\{{(?P=e1)\}}|\Z))
    | (?P<display>\\begin\{{(?P<e2>(?:{_ENV_DISPLAY})\*?)\}}.*?(?:\\end\{{(?P=e2)\}}|(?=\n[ \t]*\n)|\Z) | \\\[.*?(?:\\\]|(?=\n[ \t]*\n)|\Z) | \$\$.*?(?:\$\$|(?=\n[ \t]*\n)|\Z))
    | (?P<math>\$(?:[^$\\\n]|\\.|\n(?![ \t]*\n))+\$ | \\\((?:[^\\\n]|\\[^)]|\n(?![ \t]*\n))*\\\))
    | (?P<foot>\\footnote(?:\[[^\]\n]*\])?{_BRACES})
    | (?P<hard>\\(?:section|subsection|subsubsection|paragraph|subparagraph|chapter|part|title|author|date|documentclass|usepackage|newcommand|renewcommand|providecommand|bibliographystyle|bibliography|input|include|caption|includegraphics|begin|end|vspace|hspace|thanks|affiliation|address|keywords|newtheorem|graphicspath){_ARGS}
        | \\def\s*\\[A-Za-z]+{_BRACES} | \\(?:maketitle|item|appendix|clearpage|newpage|tableofcontents|centering|noindent|bigskip|medskip|smallskip|par)\b\*?(?:\[[^\]\n]*\])? | \\bibitem{_ARGS} | \n[ \t]*\n\s* )
    | (?P<quiet>\\label{_ARGS})
    | (?P<cite>\\(?:cite[a-zA-Z]*|ref|eqref|autoref|cref|url|texttt|verb|textsc|input)\b{_ARGS})
    | (?P<space>\\[,;:!\ ])
    | (?P<esc>\\[%$&#_{{}}])
    | (?P<macro>\\[A-Za-z]+(?:\{{\}})?)
    """,
    regex.X | regex.S,
)
_SPECIAL = re.compile(r"[\\%$]|\n[ \t]*\n")


def mask(text: str) -> str:
    """The text with everything but prose as marker characters, of the same length."""
    start = text.find("\\begin{document}")
    start = start + 16 if start >= 0 else 0
    end = text.find("\\end{document}", start)
    end = end if end >= 0 else len(text)
    out, at, here = [HARD * start], start, start
    while (found := _SPECIAL.search(text, here, end)) is not None:
        here = found.start()
        m = _TOKENS.match(text, here, end)
        if m is None:
            here += 1
            continue
        a, b = m.span()
        here = b
        out.append(text[at:a])
        kind, n = m.lastgroup, b - a
        if kind in ("skip", "e1") or m["skip"]:
            out.append(HARD * n)
        elif m["display"]:
            out.append(DISPLAY * n)
        elif kind == "gap":
            out.append(GAP * n)
        elif kind == "math":
            close = 1 if text[a] == "$" else 2
            inner = text[a : b - close].rstrip()
            if inner[-1:] in ".!?" and inner[-2:-1] not in "\\.":
                out.append(ATOM * (len(inner) - 1) + inner[-1] + CLOSER * (b - a - len(inner)))
            else:
                out.append(ATOM * n)
        elif kind == "foot":
            out.append(CLOSER * n)
        elif kind == "hard":
            out.append(HARD * n)
        elif kind == "quiet":
            out.append(GAP * n)
        elif kind == "space":
            out.append(" " * n)
        else:
            out.append(ATOM * n)
        at = b
    out.append(text[at:end])
    out.append(HARD * (len(text) - end))
    return "".join(out)


# Candidates: closing marks with what is attached to them.
_CLOSE = r"[\"'”’»›」』）)\]}】〉》〕" + CLOSER + "]"
_MARKS = r"(?:[.!?…]+|[。！？｡．।॥؟۔]+(?:…+)?|…+)"
_MARK = regex.compile(rf"{_MARKS}(?:[ \u00a0\u202f~]?[»›]|{_CLOSE})*(?:[.。])?{CLOSER}*")
#: Where „ opens quotations, “ closes them.
_MARK_LOW = regex.compile(rf"{_MARKS}(?:[ \u00a0\u202f~]?[»›]|{_CLOSE}|“)*(?:[.。])?{CLOSER}*")

# Rule tables: (breaks, before, after). before ends at the candidate's end, after starts there; first match decides.
_SP = rf"[\s~{GAP}{DISPLAY}]*"
_UP = r"[\p{Lu}\p{Lt}]"
_Q = r"[\"'”’»›」』]*"
_MONTHS = "Jan|Feb|März|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez"
#: Abbreviations that never end a sentence, in texts of any language and of one.
_SHARED = "e\\.g|i\\.e|et al|cf|Cf|vs|approx|Figs?|figs?|Eqs?|Sec|Tab|Ref|vol|Vol|viz|resp|Dr|Prof|Mr|Mrs|Ms|St|ed|eds|ca|incl"
_INNER = {
    "en": "",
    "fr": "p\\.\\s?ex|c\\.-à-d|env|Mme|Mlle|M|MM|éd|chap|art|tabl|éq|p|pp|No|Nos",
    "de": "z\\.\\s?B|d\\.\\s?h|u\\.\\s?a|bzw|Abb|Nr|S|vgl|Vgl|Kap|Bd|Hr|Fr|sog|bspw|Gl|zzgl|ggf|p|pp",
    "es": "Sr|Sra|Dra|aprox|núm|pág|págs|p\\.\\s?ej|EE|cap|ec|p|pp",
    "cyrl": "т\\.\\s?е|ок|табл|рис|см|стр|ср|проф|др|им|ул|акад|напр|гл|разд|т|с",
    "deva": "डॉ|श्री|प्रो|चि|सं",
    "thai": "ดร|รศ|ผศ|ศ|นพ|พญ",
    "east": "",
}
#: Words that abbreviate only before a number: No. 5, pp. 3-4.
_NUMBERED = "No|Nos|p|pp"
#: English words that open a sentence: after a single capital they show that it wasn't an initial.
_OPENERS = "The|This|These|Those|That|There|Then|Thus|They|It|Its|In|If|We|Our|He|She|His|Her|A|An|And|As|At|But|By|For|From|Here|Hence|However|Later|Moreover|Next|On|To|When|Where|While|With"
#: What a text of a language holds most of: fixed words between blanks.
_FUNCTION_WORDS = {
    "en": ("the", "of", "and", "is", "that", "we", "it", "to", "for"), "fr": ("les", "des", "est", "une", "dans", "et", "le", "du"), "de": ("der", "und", "die", "ist", "das", "wir", "ein", "mit"),
    "es": ("los", "una", "del", "las", "el", "por", "con"),
}
_ABBR_EITHER = "etc|a\\.m|p\\.m|usw|Jh|т\\.\\s?д|т\\.\\s?п|г|гг|в|вв|U\\.S|Inc|Ltd|Co|Jr|Bros|млн|млрд|тыс|руб"  # end only before a capital
_Rule = tuple[bool, str | None, str | None]
GENERAL: list[_Rule] = [
    (False, rf"\p{{Nd}}[.．]$", r"\p{Nd}"),  # decimals, versions
    (True, r"\p{Ll}{2}\.$", r"\p{Lu}\p{Ll}"),  # the blank between two sentences is missing
    (False, r"(?<!\p{L})z\.$", r"[\s~]*B\."),
    (False, r"[.．]$", r"[\p{L}\p{Nd}_]"),  # inside abbreviations, names of files
    (False, rf"(?<![\p{{L}}\p{{M}}.])(?:{_SHARED})\.$", rf"(?!{_SP}(?:{HARD}|\Z))"),
    (False, rf"(?<![\p{{L}}\p{{M}}.])(?:{_NUMBERED})\.$", rf"{_SP}(?:[\p{{Nd}}{ATOM}]|[ivxlcIVXLC]+\b)"),
    (False, rf"(?<![\p{{L}}\p{{M}}.])(?:{_ABBR_EITHER})\.$", rf"{_SP}(?!\p{{Ll}}\p{{Lu}})[^\s~{GAP}{DISPLAY}\p{{Lu}}{ATOM}{HARD}«„“‘`¿¡(\[]"),
    (False, rf"(?<!\p{{L}})\p{{Lu}}\.$", rf"{_SP}\p{{Lu}}\p{{Ll}}"),  # initials
    (False, rf"(?<!\p{{L}})\p{{Lu}}\.$", rf"[\s~]*(?:-|\p{{Lu}}\.)"),
    (False, rf"(?<![\p{{L}}\p{{Nd}}.,])\p{{Nd}}{{1,2}}\.$", rf"[\s~]+(?:{_MONTHS})"),  # ordinals of dates
    (False, None, rf"{_SP}(?:[,;:\p{{Pd}}]|\p{{Ll}}(?!\p{{Lu}}))"),  # the sentence goes on
    (True, None, rf"{_SP}(?:{HARD}|\Z)"),
    (True, None, rf"[\s~{GAP}{DISPLAY}]"),
]
EAST_ASIAN: list[_Rule] = [
    (False, r"[.．]$", r"\p{Nd}"),
    (False, r"…$", rf"{_SP}[\p{{L}}]"),  # an ellipsis inside a sentence goes on with a word
    (False, r"[？！?!][”’」』»]+$", r"[\p{L}、，,]"),  # a quoted question goes on with who asked
    (False, r"[）)】」』”]$", r"[，、；：と]"),
    (False, r"[。！？｡．]$", r"[）)】」』”’]"),
    (True, r"[。！？｡][”’」』）)】]*[.。]?" + f"{CLOSER}*$", None),
]
DEVANAGARI: list[_Rule] = [
    (False, r"[?!][”’\"']+$", rf"{_SP}[\p{{L}}]"),
    (True, r"[।॥][”’\"')\]]*" + f"{CLOSER}*$", None),
]
THAI: list[_Rule] = [
    (False, r"\.$", r"[\s~]+\p{Thai}"),
]
CYRILLIC: list[_Rule] = [
    (False, r"(?<!\p{L})\p{Lu}\.$", rf"{_SP}\p{{Lu}}\p{{Ll}}"),
]
ENGLISH: list[_Rule] = [
    (True, r"(?<!\p{L})\p{Lu}\.$", rf"{_SP}(?:{_OPENERS})\b(?![.-])"),  # a letter as a name: vitamin C
]


def _abbreviations(language: str) -> list[_Rule]:
    words = "|".join(w for w in _INNER.values() if w) if language == "latn" else _INNER[language]
    return [(False, rf"(?<![\p{{L}}\p{{M}}.])(?:{words})\.$", rf"(?!{_SP}(?:{HARD}|\Z))")] if words else []


_TABLES = {"east": EAST_ASIAN, "deva": DEVANAGARI, "thai": THAI, "cyrl": CYRILLIC, "en": ENGLISH, "fr": [], "de": [], "es": [], "latn": []}


def _compile(table: list[_Rule]) -> list[tuple[bool, object, object]]:
    # Matched backwards from the position, so that a pattern that doesn't end there fails at once.
    return [(b, regex.compile("(?r)" + x) if x else None, regex.compile(y) if y else None) for b, x, y in table]


#: The general rules up to the abbreviations stand before those of a language.
_FIRST = 4
RULES = {name: _compile((table if name != "en" else []) + GENERAL[:_FIRST] + (table if name == "en" else []) + _abbreviations(name) + GENERAL[_FIRST:]) for name, table in _TABLES.items()}
#: Code point ranges of the scripts that have their own tables.
_SCRIPTS = {"east": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FFFF)), "deva": ((0x0900, 0x097F),), "thai": ((0x0E00, 0x0E7F),), "cyrl": ((0x0400, 0x052F),)}
_THAI_SPACE = regex.compile(r"(?<=[\p{Thai}])[ \t]+(?=\p{Thai})|(?<=\p{Thai})[ \t]*\n[ \t]*(?=\p{Thai})")
_OPEN = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“"}
_BRACKET = regex.compile(r"[()\[\]（）【】「」『』“”«»„]")
_PARTS = regex.compile(f"[^{HARD}]+")
_LEAD = regex.compile(rf"[\s~{GAP}{DISPLAY}{CLOSER}]*")


def language_of(masked: str) -> str:
    """The language, or the script of languages that have one of their own, whose rule tables a text needs."""
    points = np.frombuffer(b"" if masked.isascii() else masked.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = {name: int(sum(((points >= lo) & (points <= hi)).sum() for lo, hi in ranges)) for name, ranges in _SCRIPTS.items()}
    best = max(n, key=n.get)
    latin = int((((points | 32) >= 97) & ((points | 32) <= 122)).sum() + ((points >= 0xC0) & (points <= 0x24F)).sum())
    if n[best] * 4 > latin and n[best]:
        return best
    text = f" {masked.lower()} "
    held = {name: sum(text.count(f" {w} ") for w in words) for name, words in _FUNCTION_WORDS.items()}
    most = max(held, key=held.get)
    return most if held[most] else "latn"


def _decide(rules: list, s: str, at: int) -> bool:
    # On the whole part: comments, displays and footnotes keep their length, so no fixed look-around is enough.
    for breaks, b, a in rules:
        if (b is None or b.match(s, 0, at)) and (a is None or a.match(s, at)):
            return breaks
    return False


def _inside(s: str, start: int, mark: int, end: int) -> bool:
    """Whether the mark stands in a bracket or quotation that was opened inside the sentence and goes on."""
    stack = []
    for m in _BRACKET.finditer(s, start, mark):
        c = m[0]
        if stack and c == _OPEN[stack[-1][0]]:
            stack.pop()
        elif c in _OPEN:
            stack.append((c, m.start()))
    if not stack:
        return False
    opener, at = stack[0]
    close = s.find(_OPEN[opener], mark)
    return close >= end and at > start


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence of the running prose, in code points, end exclusive."""
    if not text:
        return []
    masked = mask(text)
    language = language_of(masked)
    rules, out = RULES[language], []
    for part in _PARTS.finditer(masked):
        s, base = part[0], part.start()
        ends = [m.span() for m in (_MARK_LOW if "„" in s else _MARK).finditer(s)]
        if language == "thai":
            ends = sorted(ends + [(m.start(), m.start()) for m in _THAI_SPACE.finditer(s)])
        start = _LEAD.match(s).end()
        for mark, end in ends:
            if end <= start:
                continue
            if (mark == end or _decide(rules, s, end)) and not _inside(s, start, mark, end):
                out.append((base + start, base + end))
                start = _LEAD.match(s, end).end()
        tail = len(s.rstrip(f" \t\r\n~{GAP}{DISPLAY}"))
        if tail > start:
            out.append((base + start, base + tail))
    return out


def sentence_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sent_start, sent_end of every sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for a, b in sentences(t.as_py()):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "sent_start", "sent_end"])

    given = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("long"), F.col(text))
    return given.mapInArrow(run, "doc_id long, sent_start long, sent_end long")
