"""Personal information in free text: candidates, boosted trees, calibrated redaction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.llm import lexicon as L
from stratamesh.llm.boosting import BoostedTrees
from stratamesh.llm.tokens import slices
from stratamesh.llm.writer import Writer, luhn, plain

KINDS = ("email", "phone", "id_number", "address", "name")

_LATIN = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1e00-\u1eff"
_MARK = "\u0300-\u036f"
# a word that goes on in digits, or from them, is a code and no word
_WORD = re.compile(rf"(?<![\d_])(?:[{_LATIN}][{_LATIN}{_MARK}]*(?:[-‐‑'’][{_LATIN}][{_LATIN}{_MARK}]*)*|[\u0400-\u052f][\u0400-\u052f{_MARK}]*(?:-[\u0400-\u052f]+)*)(?![{_LATIN}{_MARK}\u0400-\u052f]|[-‑/_]?\d)")
_BLANK = " \t\xa0\u2002\u2003\u2009\u202f\u3000"
_GAP = re.compile(rf"[{_BLANK}]{{1,3}}|(,[{_BLANK}]{{1,2}})")
_CONTEXT = re.compile(rf"[{_LATIN}][{_LATIN}{_MARK}'’-]*|[\u0400-\u052f]+|\d+|\S")
_AT = r"(?:[@＠]|[ ]?[(\[{<][ ]?(?:at|arobase|@|собака|en)[ ]?[)\]}>][ ]?)"
_DOT = r"(?:\.|[ ]?[(\[{<][ ]?(?:dot|point|punkt|punto|точка)[ ]?[)\]}>][ ]?)"
_LABEL = rf"[{_LATIN}\d](?:[{_LATIN}\d-]*[{_LATIN}\d])?"
_EMAIL = re.compile(
    rf"(?<![{_LATIN}\d._%+-])(?P<local>[{_LATIN}\d](?:[{_LATIN}\d._%+'-]*[{_LATIN}\d_])?)(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|[ ](?:at|arobase|AT)[ ]{_LABEL}(?:[ ](?:dot|point|DOT)[ ]{_LABEL})+)",
    re.I,
)
_SPELLED = re.compile(r"[(\[{<][ ]?(?:at|arobase|собака|en)[ ]?[)\]}>]|[ ](?:dot|point)[ ]", re.I)
# digit runs are possessive, so that long ones are read once; whole groups at the end are given back where a letter follows
_PHONE = regex.compile(r"(?<![\p{Latin}\d@.,:/#_‑-])(?:\+ ?\d{1,3}+|\(\d{1,5}\)|\d++)(?:[ \xa0  .‑–/-]?(?:\(\d{1,5}\)|\d++|(?<=\)) \d++))*(?![\p{Latin}\d])")
_GROUP = re.compile(r"\+ ?\d+|\(\d+\)|\d+")
_NINE = re.compile(rf"(?<![{_LATIN}\d.‑/+-])\d{{3}}([ \xa0\u2002\u2009‑.-]?)\d{{3}}\1\d{{3}}(?![{_LATIN}\d])")
_PASS = re.compile(rf"(?<![{_LATIN}\d-])(?:[A-Za-z]{{1,3}}[ \xa0]?\d{{5,8}}|\d{{8,9}}|\d{{2}} ?\d{{2}} ?\d{{6}}|\d{{2}}[A-Z]{{2}}\d{{5}}|(?=[A-Z]*\d)[A-Z][A-Z0-9]{{8}})(?![{_LATIN}\d])")


def _alt(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) + (r"(?!\w)" if w[-1].isalpha() else "") + (r"\.?" if w in L.ABBREVIATED else "") for w in sorted(set(words), key=len, reverse=True)) + ")"


_W = rf"[{_LATIN}\u0400-\u052f](?:[{_LATIN}\u0400-\u052f{_MARK}]|['’-](?=[{_LATIN}\u0400-\u052f]))*"
_SP = f"[{_BLANK}]"
_HOUSE = rf"\d{{1,5}}(?:½|-?[A-Za-z](?![{_LATIN}\d])|{_SP}(?:bis|ter|quater)\b)?"
_LINK = rf"(?:(?:de|du|des|del|la|le|les|los|las|el|der|den|dem)(?!\w){_SP}|[dl]['’])*"
_NUMBER = re.compile(rf"(?<![{_LATIN}\u0400-\u052f\d.,:/]){_HOUSE}")
# number first: the rest is matched after a number; street first: searched from the street's word on
_AFTER = [
    ("en", re.compile(rf",?{_SP}(?:(?:{_W}|(?:St|Ste|Mt|Dr|Ft|[NSEW])\.){_SP}){{1,3}}?{_alt(L.STREETS_EN)}", re.I)),
    ("fr", re.compile(rf",?{_SP}{_alt(L.STREETS_FR)}{_SP}{_LINK}(?:{_W}|\d{{1,2}}{_SP}{_W})(?:{_SP}(?-i:[A-ZÀ-Þ]){_W})?", re.I)),
]
_STREET = [
    ("de", re.compile(rf"(?<!\w)(?:{_W}(?:straße|strasse|weg|platz|gasse|allee|ufer|damm|ring|str\.)|{_W}[ -](?:Straße|Strasse|Str\.|Weg|Platz|Allee|Ring|Gasse)){_SP}{_HOUSE}", re.I), ("str", "weg", "platz", "gasse", "allee", "ufer", "damm", "ring")),
    ("ru", re.compile(rf"(?<!\w)(?:{_alt(L.STREETS_RU)}{_SP}?(?:{_W}|\d+-[йя]{_SP}{_W})(?:{_SP}{_W})?|{_W}{_SP}{_alt(L.STREETS_RU)}),?{_SP}?(?:(?:дом|д)(?!\w)\.?{_SP}?)?\d{{1,5}}(?!\d)", re.I), tuple(w for w in L.STREETS_RU if len(w) > 1)),
    ("es", re.compile(rf"(?<!\w){_alt(L.STREETS_ES)}{_SP}{_LINK}{_W}(?:{_SP}{_W})?(?:,?{_SP}(?:n\.?{_SP}?[º°o]\.?{_SP}?|núm(?:ero|\.){_SP}?|#{_SP}?)?){_HOUSE}(?!\d)", re.I), tuple(L.STREETS_ES)),
    ("zh", re.compile(rf"(?:[{_LATIN}](?:[{_LATIN}]|['’-])*|[\u4e00-\u9fff]{{2,4}}?)(?:{'|'.join(L.STREETS_ZH)})\d{{1,5}}(?:号|號)"), ("号", "號")),
]
_HAS_DIGIT = re.compile(r"\d")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(L.TITLES, key=len, reverse=True)))})\.?[{_BLANK}\n]{{1,2}}", re.I)
_RUSSIAN_ENDS = ("а", "у", "ом", "ем", "ой", "ей", "е", "ы", "и", "ю", "я", "ю", "ь", "й", "ым")


def _fold(s: str) -> str:
    return (s if s.isascii() else unicodedata.normalize("NFC", s)).casefold()


@lru_cache(maxsize=1 << 16)
def _shape(w: str) -> str:
    if len(w) > 1 and w.isupper():
        return "U"
    return "l" if w.islower() else "T" if w[0].isupper() else "m"


@lru_cache(maxsize=1 << 16)
def _classes(w: str) -> tuple[str, ...]:
    """The word lists that a folded word, or a part of it between hyphens, is in."""
    parts = (w, *w.split("-")) if "-" in w else (w,)
    return tuple(name for name, words in (("place", L.PLACE_WORDS), ("org", L.ORG_WORDS), ("stop", L.STOP_WORDS), ("date", L.CALENDAR), ("street", _STREETS), ("title", L.TITLES), ("filler", _FILLERS)) if any(p in words for p in parts))


_STREETS = frozenset([*L.STREETS_EN, *L.STREETS_FR, *L.STREETS_DE, *L.STREETS_RU, *L.STREETS_ES])
_FILLERS = frozenset(w.casefold() for words in L.FILLER.values() for w in words)
_PAIRS = frozenset(_fold(p) for p in L.CAPITAL_PAIRS)
_FAMILY = frozenset(map(_fold, [*L.FAMILY_LATIN, *L.FAMILY_CYRILLIC]))


def _stems(w: str) -> set[str]:
    """A Cyrillic word and what is left of it without a case ending."""
    return {w, *(w[: -len(e)] for e in _RUSSIAN_ENDS if w.endswith(e) and len(w) > len(e) + 2)}


class Names:
    """Given names (of the reference list and the lexicon) and family names, told from any case of a Cyrillic one."""

    def __init__(self, given: Iterable[str]) -> None:
        self.given = frozenset(map(_fold, given))
        every = self.given | frozenset(map(_fold, [*L.GIVEN_LATIN, *L.GIVEN_CYRILLIC]))
        self._given = every | {s for w in every if w[0] > "Ѐ" for s in _stems(w)}
        self._family = _FAMILY | {s for w in _FAMILY if w[0] > "Ѐ" for s in _stems(w)}
        self.is_given, self.is_family = lru_cache(1 << 16)(lambda w: self._in(w, self._given)), lru_cache(1 << 16)(lambda w: self._in(w, self._family))
        self.given_as_written = lru_cache(1 << 16)(lambda w: self._in(_fold(w), self._given))

    @staticmethod
    def _in(w: str, words: Iterable[str]) -> bool:
        return w in words or (w[0] > "Ѐ" and not words.isdisjoint(_stems(w))) or ("-" in w and w.split("-")[0] in words)

    def __reduce__(self):
        return Names, (sorted(self.given),)


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    features: list[str]


def _around(text: str, start: int, end: int) -> list[str]:
    """The words and marks near a span; digits count as one."""
    left = ["#" if w.isdigit() else _fold(w) for w in _CONTEXT.findall(text, max(0, start - 32), start)[-3:]][::-1]
    right = ["#" if w.isdigit() else _fold(w) for w in _CONTEXT.findall(text, end, min(len(text), end + 32))[:3]]
    f = [f"L{k}={w}" for k, w in enumerate(left)]
    f += [f"R{k}={w}" for k, w in enumerate(right)]
    f += [f"near={w}" for w in {*left, *right}]
    for side, words in (("L", left), ("R", right)):
        if words:
            f += [f"{side}is={c}" for c in _classes(words[0])]
    if not left:
        f.append("first")
    elif not text[start - 1].isspace():
        f.append("touch=" + (text[start - 1] if not text[start - 1].isalnum() else "x"))
    if not right:
        f.append("last")
    elif end < len(text) and text[end] == "\n":
        f.append("ends line")
    if "\n" in text[max(0, start - 2) : start]:
        f.append("starts line")
    return f


def _names(text: str, names: Names) -> Iterator[Candidate]:
    """Spans of two or three words that may be a person: capitalised ones, and ones in lower case where a word is a known
    name or a title stands before; with a comma, initials or particles between."""
    tokens = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    if len(tokens) < 2:
        return
    shapes = [_shape(w) for _, _, w in tokens]
    known = [names.given_as_written(w) for _, _, w in tokens]
    n, titled = len(tokens), {m.end() for m in _TITLED.finditer(text)}
    for k in range(n - 1):
        capital = shapes[k] in "TU"
        if not (capital or known[k] or known[k + 1] or tokens[k][0] in titled):
            continue
        a, b, w = tokens[k]
        titled_here = a in titled
        low_ok = not capital and (titled_here or known[k])
        initials = b - a == 1 and w.isupper() and text[b : b + 1] == "." and _fold(w) not in L.TITLES
        if (b - a < 2 and not initials) or not (capital or low_ok or shapes[k + 1] in "lTU" and known[k + 1]):
            continue
        if k and capital and text[a - 1] in "-'’" and tokens[k - 1][1] == a - 1:
            continue
        # goes on word by word: an initial or a particle may stand between, then the next word ends a span
        form, words, at = "i" if initials else "", [_fold(w)], k
        while at + 1 < n and len(words) < 4:
            c, d, v = tokens[at + 1]
            e = tokens[at][1]
            if len(tokens[at][2]) == 1 and text[e : e + 1] == "." and (at > k or initials):
                e += 1
            g = _GAP.fullmatch(text, e, c)
            if not g or (g[1] and (form or len(words) > 1 or initials)):
                break
            form += "C" if g[1] else ""
            at += 1
            x = _fold(v)
            if d - c == 1:
                if v.isupper() and "I" not in form:
                    form += "I"
                    continue
                if x not in L.PARTICLES:
                    break
            if x in L.INNER_PARTICLES and "p" not in form:
                break
            if x in L.PARTICLES and (shapes[at] == "l" or at + 1 < n and shapes[at + 1] in "TU"):
                if "C" in form:
                    break
                form += "p"
                continue
            if shapes[at] not in ("TU" if capital else "l") and not (capital and shapes[k] == "U" == shapes[at]):
                break
            words.append(x)
            if not capital and not (low_ok or names.is_given(x)):
                break
            yield _name(text, a, d, k, at, tokens, shapes, words, form, titled_here, names)
            if len(words) == 3 or not capital:
                break


def _name(text: str, a: int, d: int, k: int, at: int, tokens: list, shapes: list[str], words: list[str], form: str, titled: bool, names: Names) -> Candidate:
    f = _around(text, a, d)
    w1, w2 = words[0], words[-1]
    f += [f"form={form}", f"shapes={''.join((shapes[k], shapes[at]))}", f"n={len(words)}", f"e1={w1[-2:]}", f"e2={w2[-3:]}", f"E2={w2[-2:]}", "ru" if w1[0] > "Ѐ" else "la"]
    given, family = [names.is_given(w) for w in words], [names.is_family(w) for w in words]
    f += [x for x, on in (("g1", given[0]), ("g2", given[-1]), ("gg", all(given)), ("nog", not any(given)), ("s1", family[0]), ("s2", family[-1]), ("gs", given[0] and family[-1]), ("titled", titled), ("after", text[d : d + 2] in L.TITLES_AFTER or text[d : d + 1] == " " and text[d + 1 : d + 3] in L.TITLES_AFTER), ("pair", _fold(text[a:d]) in _PAIRS)) if on]
    classes = [_classes(w) for w in words]
    f += [f"is1={c}" for c in classes[0]] + [f"is2={c}" for c in classes[-1]] + [f"mid={c}" for c in {c for x in classes[1:-1] for c in x}]
    if not any(classes):
        f.append("no class")
    # is it part of a longer run of capitalised words
    if k and shapes[k - 1] in "TU" and text[tokens[k - 1][1] : a].strip(_BLANK) == "":
        f += ["Lcap", *[f"Lcap={c}" for c in _classes(_fold(tokens[k - 1][2])) or ("none",)]]
    if at + 1 < len(tokens) and shapes[at + 1] in "TU" and text[d : tokens[at + 1][0]].strip(_BLANK) == "":
        f += ["Rcap", *[f"Rcap={c}" for c in _classes(_fold(tokens[at + 1][2])) or ("none",)]]
    before = text[max(0, a - 3) : a].rstrip()[-1:]
    if before in (".", "!", "?", "…", "。", "") or "starts line" in f:
        f.append("opens")
    mail = text[max(0, a - 40) : a] + text[d : d + 60]
    if "@" in mail or "＠" in mail or " at" in mail:
        low = plain(mail).lower() if not mail.isascii() else mail.lower()
        f.append("mail")
        f += [x for x, w in (("mail1", w1), ("mail2", w2)) if plain(w).lower()[:6] in low and len(w) > 2]
    return Candidate("name", a, d, f)


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _NUMBER.finditer(text):
        for form, rx in _AFTER:
            if x := rx.match(text, m.end()):
                yield form, m.start(), x.end()
    low = text.lower()
    for form, rx, words in _STREET:
        if any(w in low for w in words):
            at = 0
            while x := rx.search(text, at):
                yield form, x.start(), x.end()
                at = x.start() + 1


def candidates(text: str, names: Names) -> Iterator[Candidate]:
    """Every span that may be a mention; spans overlap freely."""
    if "@" in text or "＠" in text or _SPELLED.search(text):
        for m in _EMAIL.finditer(text):
            yield Candidate("email", m.start(), m.end(), _around(text, m.start(), m.end()) + ["sign" if "@" in m[0] or "＠" in m[0] else "spelled", f"labels={len(re.findall(_DOT, m[0][len(m['local']) :]))}", f"digits={sum(c.isdigit() for c in m[0]) * 4 // len(m[0])}"])
    if _HAS_DIGIT.search(text):
        for m in _PHONE.finditer(text):
            groups = [(g.start(), g.end(), sum(map(str.isdigit, g[0]))) for g in _GROUP.finditer(text, m.start(), m.end())]
            if sum(g[2] for g in groups) < 8:
                continue
            before = text[max(0, m.start() - 40) : m.start()].casefold()
            told = [x for x, words in (("insurance", L.INSURANCE), ("passport", L.PASSPORT)) if any(w in before for w in words)]
            for i, (s, _, _) in enumerate(groups):
                n = 0
                before_it = "none" if not i else "+" if text[groups[i - 1][0]] == "+" else text[groups[i - 1][0] : groups[i - 1][1]] if groups[i - 1][2] == 1 else str(groups[i - 1][2])
                for j in range(i, len(groups)):
                    e, n = groups[j][1], n + groups[j][2]
                    if n > 15:
                        break
                    if n >= 8:
                        t = text[s:e]
                        ends = [*told, f"before={before_it}", f"before={before_it[:1]}", f"next={groups[j + 1][2] if j + 1 < len(groups) else 0}", "whole" if s == m.start() else "part", "to end" if e == m.end() else "to inside"]
                        mask = "".join(str(g[2]) + ("+" if text[g[0]] == "+" else "(" if text[g[0]] == "(" else ".") for g in groups[i : j + 1])
                        yield Candidate("phone", s, e, _around(text, s, e) + ends + [f"digits={n}", "mask=" + mask, "begins=" + t[:2], "begin=" + t[:1], f"groups={j - i + 1}", "seps=" + "".join(sorted(set(re.sub(r"\d", "", t))))])
        low = None
        for rx in (_NINE, _PASS):
            for m in rx.finditer(text):
                low = low or text.casefold()
                # the words before it on the same line, or shortly before
                before, digits = low[max(0, m.start() - 120) : m.start()], re.sub(r"\D", "", m[0])
                f = _around(text, m.start(), m.end()) + [f"n={len(digits)}", "nine" if rx is _NINE else "pass", "letters" if m[0][0].isalpha() else "bare"]
                f += [x for x, on in (("luhn", rx is _NINE and luhn(digits)), *((f"{what}{k}", any(w in before[-k:] for w in words)) for what, words in (("passport", L.PASSPORT), ("insurance", L.INSURANCE)) for k in (18, 40, 120))) if on]
                yield Candidate("id_number", m.start(), m.end(), f)
        for form, s, e in _addresses(text):
            letters = re.findall(r"[^\W\d]+", text[s:e])
            yield Candidate("address", s, e, _around(text, s, e) + [f"form={form}", f"house={len(re.sub(r'[^0-9]', '', text[s:e]))}", "shape=" + "".join(map(_shape, letters))[:6], f"last={letters[-1].casefold()}", *[f"in={c}" for w in letters for c in _classes(w.casefold())]])
    yield from _names(text, names)


@dataclass
class Detector:
    names: Names
    models: dict[str, BoostedTrees]

    def mentions(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of the mentions of each text, in order, none overlapping. Of overlapping candidates over
        their thresholds the likelier stays, then the longer, then the earlier."""
        found: list[list[tuple[float, Candidate]]] = [[] for _ in texts]
        waiting: dict[str, list[tuple[int, Candidate]]] = {kind: [] for kind in self.models}

        def judge(kind: str) -> None:
            mine, model = waiting[kind], self.models[kind]
            for (i, c), p in zip(mine, model.predict([c.features for _, c in mine])):
                if p >= model.threshold:
                    found[i].append((float(p), c))
            mine.clear()

        # judged by the thousand: a long table of numbers has many candidates
        for i, t in enumerate(texts):
            for c in candidates(t, self.names) if t else ():
                waiting[c.kind].append((i, c))
                if len(waiting[c.kind]) >= 4096:
                    judge(c.kind)
        for kind in self.models:
            if waiting[kind]:
                judge(kind)
        out = []
        for spans in found:
            kept: list[Candidate] = []
            taken: list[tuple[int, int]] = []
            for _, c in sorted(spans, key=lambda x: (-round(x[0], 2), x[1].start - x[1].end, x[1].start, x[1].kind)):
                if all(c.end <= a or c.start >= b for a, b in taken):
                    kept.append(c)
                    taken.append((c.start, c.end))
            out.append(sorted((c.kind, c.start, c.end) for c in kept))
        return out


def train(given_names: Iterable[str], *, sample_texts: int = 12_000, seed: int = 7) -> Detector:
    """Fits one model for each kind on ``sample_texts`` labelled texts written by ``Writer`` (nothing is sampled from any
    table but the list of given names), that for phones on as many again with lists of numbers, a quarter of them
    held out to set the thresholds. Deterministic for the same names and seed."""
    given = sorted({g.strip() for g in given_names if g and g.strip()})
    names, writer, listed = Names(given), Writer(given, seed), Writer(given, seed + 1)
    parts: dict[bool, dict[str, tuple[list[list[str]], list[int]]]] = {h: {k: ([], []) for k in KINDS} for h in (False, True)}
    for i in range(2 * sample_texts):
        more = i >= sample_texts
        text, spans = (listed if more else writer).text(more)
        starts = {(k, a) for k, a, _ in spans}
        # a phone ends where it was written to end, before an extension
        phones = {(a, a + len(text[a:b].split(" ext.")[0])) for k, a, b in spans if k == "phone"}
        for c in candidates(text, names):
            if more and c.kind != "phone":
                continue
            rows, y = parts[i % 4 == 3][c.kind]
            rows.append(c.features)
            y.append(int((c.start, c.end) in phones if c.kind == "phone" else (c.kind, c.start, c.end) in spans if c.kind == "name" else (c.kind, c.start) in starts))
    models = {}
    for kind in KINDS:
        rows, y = parts[False][kind]
        held, z = parts[True][kind]
        size = {"trees": 150, "depth": 5} if kind in ("name", "phone") else {}
        models[kind] = BoostedTrees(**size).fit(rows, np.array(y)).calibrate(held, np.array(z), beta=2.0 if kind == "name" else 1.0)
    return Detector(names, models)


def find_mentions(df: DataFrame, detector: Detector, *, key: str, text: str) -> DataFrame:
    """(``key``, ``pii_kind``, ``start_at``, ``end_at``): one row per mention, places in Unicode characters. One pass
    over Arrow batches, no shuffle.

    Defined results: null, empty and blank texts have no mentions; texts of any length are read whole; repeated rows
    give repeated mentions; an empty table gives none; other columns are not read.
    """
    src = df.select(F.col(key), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(i, *m) for i, ms in enumerate(detector.mentions(part.column(1).to_pylist())) for m in ms]
                keys = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], [key, "pii_kind", "start_at", "end_at"])

    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, pii_kind string, start_at bigint, end_at bigint")


def redact(df: DataFrame, detector: Detector, *, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``text`` with each mention replaced by its kind in brackets, e.g. [EMAIL]. Null stays null."""
    df = df.drop(out) if out in df.columns else df
    names, at = df.columns, df.columns.index(text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def clean(t: str | None, ms: list[tuple[str, int, int]]) -> str | None:
        for kind, a, b in sorted(ms, key=lambda m: -m[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                new = [clean(t, ms) for t, ms in zip(texts, detector.mentions(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string())], [*names, out])

    return df.mapInArrow(run, f"{head}, `{out}` string")
