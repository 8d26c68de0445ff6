"""Weak labels of segments: statuses, slots' syntax, notes and general phrases. The classifier learns from them; they decide nothing."""

from __future__ import annotations

import re

import ahocorasick

from skewline.llm import phrases
from skewline.llm.segments import squeeze

#: ``.+?`` between double marks may be of any length; marks end it, so the search stays linear
_NAME = r"[^\W\d_][\w.\- ]*"
_SLOTS = re.compile(
    rf"\{{\{{[^{{}}\\^=+*/]+\}}\}}|\$\{{[^{{}}\\^]+\}}|%%{_NAME}%%|<%=?[^<>]+%>|\[\[{_NAME}\]\]|#\{{[^{{}}\\^]+\}}|(?<!_)__[^\W\d_][\w.\-]*?__(?!_)|@@{_NAME}@@|%\({_NAME}\)s|\{{%[^{{}}]+%\}}"
    rf"|&lt;{_NAME}&gt;|(?<!\$)\${_NAME}\$(?!\$)|«{_NAME}»|<<{_NAME}>>|(?<![\w\\^_{{}}\])=])\{{{_NAME}\}}(?![+\-*/^_}}])"
)
_NOTE = re.compile(r"_{3,}\s*\(?\w|(?<![^\W\d_])(?:TODO|TBD|FIXME|tbd|todo)(?![^\W\d_])|xxx[^\n]+xxx\s*$|[\[<(（［【][^\])>）］】]*(?:goes here|einfügen|ergänzen|à compléter|à remplir|aquí|请输入|此处填写|入力|記入)[^\])>）］】]*[\])>）］】]|[\[<(（［](?:[Ii]nsert|[Ee]nter|Insérer|insérer|Insertar|insertar|Hier|Your)\b[^\])>）］]*[\])>）］]\s*$|\[\.\.\.[^\[\]]*\.\.\.\]\s*$|^[^\[\]]+\.\.\.\]\s*$")
#: of these, as squeezed, every text that ``_NOTE`` fits has at least one
_NOTE_SIGNS = ("___", "todo", "tbd", "fixme", "xxx", "goes here", "einfügen", "ergänzen", "à compléter", "à remplir", "aquí", "请输入", "此处填写", "入力", "記入", "[...", "...]", *(a + b for a in "[<(" for b in ("insert", "enter", "insérer", "hier", "your")))
_STATUS = re.compile(r"^(?:\d+\.|\[\d+\])?\s*(?:(?:HTTP|Error|Erreur|Fehler|Status)\W{0,3}(?:Status|Error)?\W{0,2}[1-5]\d\d\b|[45]\d\d (?:Not Found|Forbidden|Bad|Internal|Service|Unauthorized|Gateway|Too Many)|at [\w.$<>]+ ?\([\w.$]+:\d+(?::\d+)?\)|[\w.]+(?:Exception|Error): |Reference #[0-9a-f]{6,}|Traceback )")
#: what any slot begins with
_CUE = re.compile(r"[{<%$\[#_@&«]")
#: words of a sentence that writes about such things
_ABOUT = re.compile(r"\b(?:such as|e\.g\.|for example|denot\w+|placeholders?|variables?|Platzhaltern?|Variablen?|wie|tel(?:le)?s que|par exemple|marcador(?:es)?|como|por ejemplo)\b|などの|という|変数|プレースホルダ|場合|变量|占位符|等|时，|例如", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SYLLABLE = re.compile(r"[^aeiou]*[aeiou](?:[^aeiou]+(?=[^aeiou][aeiou])|[^aeiou]+$)?")
#: pieces that filler words are made of, by rule: consonants up to a vowel, and the consonants after it that begin no other piece
_PIECES = sorted({p for w in phrases.FILLER_WORDS for p in _SYLLABLE.findall(w)} | set(phrases.FILLER_WORDS), key=lambda p: (-len(p), p))
_LATIN = re.compile(rf"(?:{'|'.join(_PIECES)}){{1,}}")
_MASH = re.compile(r"(?:asdf|jkl[öo;]?|qwer|xxx|foo|bar|baz|test|blah|text|dummy|bla)+")
KINDS = ("scripts", "error", "filler", "note")


def _automaton() -> ahocorasick.Automaton:
    """All phrases and signs of notes, squeezed, in one automaton: a segment is read once, however many there are. It gives (rank of a phrase or ``len(KINDS)``, whether it is a sign)."""
    a = ahocorasick.Automaton()
    signs = {squeeze(w) for w in _NOTE_SIGNS}
    for w in signs:
        a.add_word(w, (len(KINDS), True))
    for rank in reversed(range(len(KINDS))):
        for w in (phrases.SCRIPTS, phrases.ERRORS, phrases.FILLER, phrases.NOTES)[rank]:
            a.add_word(squeeze(w), (rank, squeeze(w) in signs))
    a.make_automaton()
    return a


_PHRASES: list[ahocorasick.Automaton] = []


def weak_label(raw: str, squeezed: str | None = None) -> str | None:
    """Kind of residue that a segment seems to show; None for a segment that writes about such things."""
    kind = cues(raw, squeezed)
    return None if kind in (None, ABOUT) else kind


#: what ``cues`` says of a segment that holds signs of residue and writes about them
ABOUT = "about"


def cues(raw: str, squeezed: str | None = None) -> str | None:
    """The kind of residue that a segment shows signs of, or ``ABOUT``."""
    if not _PHRASES:
        _PHRASES.append(_automaton())
    kind = None
    hits = [x for _, x in _PHRASES[0].iter(squeeze(raw) if squeezed is None else squeezed)]
    if _CUE.search(raw) and _SLOTS.search(raw) or any(sign for _, sign in hits) and _NOTE.search(raw):
        kind = "slot"
    elif _STATUS.search(raw.strip()):
        kind = "error"
    else:
        rank = min((r for r, _ in hits), default=len(KINDS))
        if rank < len(KINDS):
            kind = KINDS[rank]
        elif _is_filler(raw):
            kind = "filler"
    return ABOUT if kind and _ABOUT.search(raw) else kind


class _Shapes(dict[str, int]):
    """1: made of filler pieces, 2: typed at random, 3: both, 0: neither, of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        w = word.lower()
        got = self[word] = 0 if len(w) < 2 else (_LATIN.fullmatch(w) is not None) + 2 * (_MASH.fullmatch(w) is not None)
        return got


_KNOWN = _Shapes()
#: what isn't a letter becomes a space
_LETTERS = "".join(chr(c) if chr(c).isalpha() else " " for c in range(128))


def _is_filler(raw: str) -> bool:
    """More than three words, three quarters of all, are made of filler pieces or typed at random."""
    words = raw.translate(_LETTERS).split() if raw.isascii() else _WORD.findall(raw)
    need = max(4, 0.75 * len(words))
    if len(words) < need:
        return False
    # most sentences are told by their first half
    if list(map(_KNOWN.__getitem__, words[: len(words) // 2 + 1])).count(0) > len(words) - need:
        return False
    shapes = list(map(_KNOWN.__getitem__, words))
    return sum(x & 1 for x in shapes) >= need or sum(x > 1 for x in shapes) >= need
