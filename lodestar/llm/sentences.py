"""Sentence boundaries by character properties, for all scripts.

The rules follow the outline of Unicode's sentence breaking: terminators that always end a sentence and full stops
that may be something else, closing marks that stay with their sentence, and a look at what follows. On top of that come
abbreviations by language, quotations that stay with the words that introduce or report them, and spaces as boundaries
in scripts without terminators. A text is scanned once, from mark to mark.

Texts mix languages and tags are wrong, so the language of an abbreviation is told by the function words around it, up to
the sentence's next mark: that for which most of them speak, and that of the document's tag if any does. Where no word says
anything, any language's abbreviation counts: the next sentence may be in another language than this one or the tag's.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import spread



def _having(prop: str) -> str:
    """All characters with a property of the Unicode data."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return "".join(regex.findall(rf"\p{{{prop}}}", every))


#: Terminators that end a sentence whatever their neighbours' case, and full stops: the classes STerm and ATerm.
STRONG, STOPS = _having("Sentence_Break=STerm"), _having("Sentence_Break=ATerm")
ELLIPSIS = "…"
GREEK_QUESTION = ";;"
#: Quotation marks that open, with those that close them.
QUOTES = {"「": "」", "『": "』", "《": "》", "〈": "〉", "﹁": "﹂", "﹃": "﹄", "〝": "〞〟", "“": "”", "‘": "’", "„": "“”", "‚": "‘’", "«": "»", "‹": "›", '"': '"', "＂": "＂"}
#: Brackets: opening punctuation of the class Close, with the closing one that stands one or two places further on.
BRACKETS = {c: next(chr(ord(c) + d) for d in (1, 2) if unicodedata.category(chr(ord(c) + d)) == "Pe") for c in _having("Sentence_Break=Close") if unicodedata.category(c) == "Ps" and c not in QUOTES and "Pe" in (unicodedata.category(chr(ord(c) + 1)), unicodedata.category(chr(ord(c) + 2)))}
OPENERS = BRACKETS | QUOTES
CLOSERS = set("".join(OPENERS.values()))
DASHES = "-‐‑–—―−"

#: Abbreviations by language, without the last full stop. Before a number a full stop after NUMBER (lower
#: case) ends nothing; after TITLE (as written), not before a name either; after NEVER (as written), never.
NUMBER = {
    "en": "no nos fig figs p pp sec vol ch art approx eq nr ca",
    "de": "nr s bd abb abs art ca tel kap str",
    "fr": "p pp env no art fig chap vol",
    "es": "pág págs p núm art aprox fig cap vol tel",
    "it": "pag pagg p art fig cap vol ca",
    "ru": "рис стр гл ст табл",
    "el": "σελ αρ κεφ",
}
TITLE = {
    "en": "Mr Mrs Ms Dr Prof Gen Col Capt Lt Sgt Maj Adm Rev Hon Gov Sen Rep Pres St Mt Messrs",
    "de": "Dr Prof Hr Fr Frl St Dipl Ing",
    "fr": "M MM Mme Mlle Dr Pr Mgr",
    "es": "Sr Sra Srta Sres Sras Dr Dra D Dña Ud Uds Prof Profa Ing Lic Sto Sta",
    "it": "sig sigg dott prof ing avv arch geom rag Sig Sigg Dott Prof Ing Avv",
    "ru": "им проф акад тов ул пос",
    "el": "κ κα κος δρ καθ",
    "hi": "डॉ श्री प्रो पं कु",
    "ar": "د أ م أ.د",
    "ur": "ڈاکٹر",
    "am": "ዶ/ር",
}
NEVER = {
    "en": "e.g i.e cf vs viz E.g I.e Cf",
    "de": "z.B d.h u.a i.d.R bzw vgl sog bspw z d Vgl",
    "fr": "cf c.-à-d p.ex Cf",
    "es": "EE p.ej",
    "it": "cfr v Cfr",
    "ru": "т т.е т.к т.д напр см См",
    "el": "π.χ δηλ βλ",
}
#: Frequent function words, by which languages of one script are told apart and sentences known to begin.
FUNCTION = {
    "en": "the an and of to is was were are be it i am he she they we you in on at with from for but not this that these those there here his her their has had have will would who which when if as by or our your its",
    "de": "der die das den dem des ein eine einen einem einer und ist war sind waren nicht auch mit von zu zum zur im am auf für aus bei nach es er sie wir ihr sich wird wurde hat als wie aber oder dass noch nur",
    "fr": "le la les des du un une et est était sont dans sur avec pour par pas ne que qui il elle nous vous ils elles ce cette ces au aux son sa ses plus mais ou où se été",
    "es": "el la los las del un una y es era son en con por para que se su sus al lo como más pero muy este esta estos fue ha hay sin sobre cuando porque",
    "it": "il lo la gli le del della dei delle un una e è era sono in con per non che si su al alla ai come più ma anche questo questa nel nella dal dalla ha di ed",
}
#: German months and nouns that ordinals count, words before an ordinal.
ORDINAL_NEXT = set("Jahrhundert Jahrhunderts Jh Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Klasse Auflage Kapitel Stock Platz Tag Woche Band Teil Mal".split())
ORDINAL_BEFORE = set("am im der den dem das des vom zum zur beim seit".split())
#: English verbs of speech, as they follow the name of the one who speaks.
_SPEECH = "say says said tell tells told ask asks asked answer answers answered reply replies replied cry cries cried shout shouts shouted whisper whispers whispered add adds added write writes wrote explain explains explained insist insists insisted remark remarks remarked exclaim exclaims exclaimed murmur murmurs murmured repeat repeats repeated continue continues continued"
REPORT = re.compile(rf"(?!(?:When|As|If|Once|After|Before|Then|Nobody|Who)\b)[^\W\d_]+ (?:{'|'.join(_SPEECH.split())})\b")
_FUNCTION_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION.items():
    for _w in _words.split():
        _FUNCTION_OF[_w] = (*_FUNCTION_OF.get(_w, ()), _lang)
_LATIN_WORD = re.compile(r"[^\W\d_]+")


_NEXT_MARK = re.compile(r"(?<=[^\W\d_]{3})[.!?]|(?<=\d)[.!?](?=\s)")


def spoken(text: str, tag: str = "") -> set[str]:
    """The languages of FUNCTION that most of its words speak for, and the tag's if any does; none if no word does."""
    votes: dict[str, int] = {}
    for w in _LATIN_WORD.findall(text):
        for lang in _FUNCTION_OF.get(w.lower(), ()):
            votes[lang] = votes.get(lang, 0) + 1
    return {lang for lang, n in votes.items() if n == max(votes.values()) or lang == tag}


_TERMINATORS = STRONG + STOPS + ELLIPSIS + GREEK_QUESTION
_TERMINATOR = frozenset(_TERMINATORS)
_MARK = frozenset(_TERMINATORS).union(OPENERS, CLOSERS)
# scripts without terminators
_UNMARKED = re.compile("[\u0e00-\u0e7f\u0e80-\u0eff]")


@lru_cache(maxsize=1 << 14)
def _finders(marks: str, unmarked: bool) -> tuple[re.Pattern, re.Pattern]:
    """Patterns for any of these marks, and for a run of terminators among them: a text holds a few of all there are, and
    a small class is found ten times as quickly. With `unmarked`, the spaces of scripts without terminators too."""
    ends = "".join(c for c in marks if c in _TERMINATOR)
    any_ = [f"[{re.escape(marks)}]"] * bool(marks) + [f"(?<={_UNMARKED.pattern})\\s+"] * unmarked
    return re.compile("|".join(any_) or r"(?!)"), re.compile(f"[{re.escape(ends)}]+" if ends else r"(?!)")


_LINE = "(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x85\\u2028])"
_BLANK_LINE = re.compile(f"{_LINE}[^\\S\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]*{_LINE}\\s*|\\u2029\\s*")
_WORD_BEFORE = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-ःऺ-्]|[.\-/](?=[^\W\d_]))*$")
_DIGITS_BEFORE = re.compile(r"(?:(?P<w>[^\W\d_]+)\s+)?(?P<d>\d+)$")
_WORD_AFTER = re.compile(r"[^\W\d_]+")
_CHUNK = re.compile(r"\S*")
_SPACE = re.compile(r"\s*")


def _languages(lists: dict[str, str]) -> dict[str, frozenset[str]]:
    """The languages in whose list each word stands."""
    out: dict[str, frozenset[str]] = {}
    for lang, listed in lists.items():
        for w in listed.split():
            out[w] = out.get(w, frozenset()) | {lang}
    return out


_NUMBER, _TITLE, _NEVER = _languages(NUMBER), _languages(TITLE), _languages(NEVER)


_STRONG, _ENDS = frozenset(STRONG), frozenset(STRONG + STOPS + ELLIPSIS)
_SOFT_END = tuple(STOPS + ELLIPSIS)


class Rules:
    """The rules for a document tagged with `lang`, if it is."""

    def __init__(self, lang: str | None = None):
        self.tag = (lang or "").strip().lower()[:2]

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of every sentence, without white space at either end."""
        if text is None:
            return []
        out: list[tuple[int, int]] = []
        self.marks, self.run = _finders("".join(sorted(_MARK.intersection(text))), bool(_UNMARKED.search(text)))
        at = 0
        for m in _BLANK_LINE.finditer(text):
            self._paragraph(text, at, m.start(), out)
            at = m.end()
        self._paragraph(text, at, len(text), out)
        return out

    def _speaks(self, langs: frozenset[str], text: str, start: int, a: int, end: int) -> bool:
        """Whether the sentence around `a` may be in one of these languages. Those not in FUNCTION have scripts or words
        of their own."""
        if not langs <= FUNCTION.keys():
            return True
        m = _NEXT_MARK.search(text, a + 2, min(end, a + 120))
        near = spoken(text[max(start, a - 300) : m.start() if m else min(end, a + 120)], self.tag)
        return not near or not langs.isdisjoint(near)

    def _paragraph(self, text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        start = min(_SPACE.match(text, start, end).end(), end)
        open_: list[tuple[str, int, bool]] = []  # mark, place, whether it began its sentence
        at = start
        while start < end:
            m = self.marks.search(text, at, end)
            if not m:
                break
            at, c = m.end(), text[m.start()]
            if c in _TERMINATOR:
                at = self.run.match(text, m.start(), end).end()
            elif not c.isspace():
                self._quote(text, m.start(), start, open_)
                continue
            else:
                nxt = text[at] if at < end else ""
                if not open_ and nxt and not nxt.isdigit() and nxt not in "ๆฯ":
                    out.append((start, m.start()))
                    start = at
                continue
            stop, at = self._ends(text, m.start(), at, start, end, open_)
            if stop:
                out.append((start, at))
                start = at = min(_SPACE.match(text, at, end).end(), end)
        if start < end:
            last = end
            while last > start and text[last - 1].isspace():
                last -= 1
            if last > start:
                out.append((start, last))

    @staticmethod
    def _quote(text: str, i: int, start: int, open_: list[tuple[str, int, bool]]) -> None:
        c = text[i]
        for k in range(len(open_) - 1, -1, -1):
            if c in OPENERS[open_[k][0]]:
                del open_[k:]
                return
        if c in OPENERS and not (c in "‘‚" and i and text[i - 1].isalnum()):
            begins = all(x in OPENERS or x in DASHES or x.isspace() for x in text[start:i])
            open_.append((c, i, begins))

    def _ends(self, text: str, a: int, b: int, start: int, end: int, open_: list[tuple[str, int, bool]]) -> tuple[bool, int]:
        """Whether the terminators text[a:b] end the sentence begun at `start`, and where it ends or the scan goes on."""
        run = text[a:b]
        strong = not _STRONG.isdisjoint(run)
        if not strong and all(c in GREEK_QUESTION for c in run):
            before = text[a - 1] if a > start else ""
            if not ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"):
                return False, b
            strong = True
        elif not strong and run[-1] in GREEK_QUESTION:
            return False, b
        j, quote, bracket = b, None, None
        while j < end:
            k = j
            c = text[k]
            if c.isspace():  # a closing mark set off by a space
                k = _SPACE.match(text, j, end).end()
                if k >= end or text[k] not in "»›" or not any(text[k] in OPENERS[o[0]] for o in open_):
                    break
                c = text[k]
            hit = next((n for n in range(len(open_) - 1, -1, -1) if c in OPENERS[open_[n][0]]), None)
            if hit is None:
                if k == j and c in CLOSERS and (c not in OPENERS or c in "\"＂" and (k + 1 >= end or text[k + 1].isspace())):
                    j = k + 1  # opened in an earlier paragraph or not at all
                    continue
                if c in _ENDS and j > b:
                    j = k + 1
                    strong = strong or c in _STRONG
                    continue
                break
            mark = open_[hit]
            del open_[hit:]
            if mark[0] in BRACKETS:
                bracket = mark
            else:
                quote = mark
            j = k + 1
        k = min(_SPACE.match(text, j, end).end(), end)
        if k >= end:
            return True, j
        if any(o[0] in BRACKETS and not o[2] for o in open_):
            return False, j
        nxt, glued = text[k], k == j
        dash = False
        while k < end and text[k] in DASHES:
            dash = True
            k = min(_SPACE.match(text, k + 1, end).end(), end)
        if k >= end:
            return True, j
        c = text[k]
        camel = c.islower() and k + 1 < end and text[k + 1].isupper()
        lower = c.islower() and not camel
        starter = c.isupper() or c.istitle() or camel or c.isdigit() or c.isalpha() and not lower or c in OPENERS or c in "¿¡" or unicodedata.category(c)[0] in "SM" or dash
        if not starter and not lower:
            return False, j
        if dash and (lower or quote):
            return False, j
        if quote:
            if lower:
                return False, j
            if c.isalpha() and not (c.isupper() or camel):  # no case to tell: words after a quotation report it
                return not quote[2], j
            return not (quote[2] and REPORT.match(text, k, end)), j
        if bracket:
            return (bracket[2] or not lower), j
        if strong:
            return not (lower and (glued or run.endswith(_SOFT_END))), j
        if lower:
            return False, j
        if len(run) > 1 or run in ELLIPSIS:
            return not glued or not (c.isalnum() and ord(c) < 0x250 and len(run) == 1 and run == "."), j
        return self._full_stop(text, a, j, k, nxt, start, end, glued), j

    def _full_stop(self, text: str, a: int, j: int, k: int, nxt: str, start: int, end: int, glued: bool) -> bool:
        """Whether a single full stop, not followed by a lower-case word, ends the sentence."""
        c = text[k]
        before = text[max(start, a - 40) : a]
        if glued and j == a + 1:
            if not self._glued(text, a, j, start, end, nxt):
                return False
        word = _WORD_BEFORE.search(before)
        if word:
            w = word.group()
            if w in _NEVER and self._speaks(_NEVER[w], text, start, a, end):
                return False
            if c.isdigit() and w.casefold() in _NUMBER and self._speaks(_NUMBER[w.casefold()], text, start, a, end):
                return False
            name = c.isalpha() or c in OPENERS
            title = _TITLE.get(w) or w.isupper() and _TITLE.get(w.capitalize())
            if name and title and self._speaks(title, text, start, a, end):
                return False
            if len(w) == 1 and w.isupper() and (c.isupper() or not name):
                return c.isdigit()
            if len(w) == 1 and not w.isupper() and k + 1 < end and text[k + 1] == "." and c.isalpha():
                return False
            if "." in w and w.replace(".", "").isupper() and c.isupper():
                following = _WORD_AFTER.match(text, k, end)
                return bool(following and following.group().istitle() and following.group().lower() in _FUNCTION_OF)
            return True
        number = _DIGITS_BEFORE.search(before)
        if number and len(number["d"]) <= 3:
            if a - len(number["d"]) <= start and not c.isdigit():
                return False  # the number of a list item
            following = _WORD_AFTER.match(text, k, end)
            if following and len(number["d"]) <= 2 and following.group()[:1].isupper():
                counted = following.group() in ORDINAL_NEXT or (number["w"] or "").lower() in ORDINAL_BEFORE
                if counted and self._speaks(frozenset(["de"]), text, start, a, end):
                    return False
        return True

    def _glued(self, text: str, a: int, j: int, start: int, end: int, nxt: str) -> bool:
        """Whether a full stop with no space after it can end a sentence at all: not in numbers, names of hosts, initials."""
        prev = text[a - 1] if a > start else ""
        if nxt in OPENERS or nxt in "¿¡":
            return True
        if nxt.isdigit():
            chunk = _CHUNK.match(text, j, end).group()
            return prev.isalpha() and prev.islower() and chunk.isdigit() and len(chunk) >= 3
        if not nxt.isalpha():
            return False
        if not nxt.isupper() and not nxt.islower():
            return not prev.isdigit()
        if not (prev.islower() or prev.isdigit() or prev.isalpha() and not prev.isupper() or prev in CLOSERS or prev == "%"):
            return False
        chunk = _CHUNK.match(text, j, end).group()
        if "/" in chunk or "@" in chunk or re.match(r"[^\s.]*\.[^\W_]", chunk):
            return False
        own = re.search(r"\S*$", text[max(start, a - 60) : a]).group()
        return not ("/" in own or "@" in own or own.lower().startswith("www."))


def split_sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text", with_text: bool = True, lang: str | None = "lang") -> DataFrame:
    """doc, sentence_no, start_pos, end_pos (and the sentence): the sentences of every document in order, numbered
    from 0; positions in code points. `lang` is the column of language tags, if there is one.

    Null, empty and blank texts have no sentences. Repeated ids are split row by row; a null id is kept. A null, unknown or
    wrong tag does little harm. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[doc]
    tag = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), tag.alias("lang")))
    schema = f"doc_id {kind}, sentence_no int, start_pos int, end_pos int" + ", sentence string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, no, starts, ends, said = [], [], [], [], []
            for i, (t, tag_) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                spans = Rules(tag_).spans(t)
                take += [i] * len(spans)
                no += range(len(spans))
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
                if with_text:
                    said += [t[s:e] for s, e in spans]
            cols = [batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(x, pa.int32()) for x in (no, starts, ends)]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(said, pa.string())] * with_text, names=["doc_id", "sentence_no", "start_pos", "end_pos"] + ["sentence"] * with_text)

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", doc)
