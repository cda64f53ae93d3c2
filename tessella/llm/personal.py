"""Personal information inside free text.

Generators with high recall propose overlapping spans (addresses, e-mail
addresses, digit runs, spoken digits, runs of name-like tokens); boosted trees
judge each span by its format and its context; thresholds calibrated on held-out
rows select; of overlapping spans the surer and longer one stays, and addresses
and e-mail addresses swallow what stands inside them.  Selected spans are
replaced by a placeholder of their kind; nothing else of a text changes.

The trees are trained here, on sentences made by ``synthetic.py`` from a fixed
seed, in which a part of the given names is treated as unknown and a part of the
family names as common, so that a name is known by where and how it stands, not
by a list.  How words are used is counted over the whole corpus: a word of many
texts is ordinary if it is mostly written small inside sentences, and proper if
it is mostly written with a capital.  Both kinds are bounded by the share of
texts from which a word counts; the class is a feature, and no capitalised run
is left out because its words are common.

Defined cases: null and empty texts hold nothing; texts of any length are read
whole; a text written twice is judged twice alike; occurrences of a kind count
from 1 in reading order within one field; a name has ``NAME_TOKENS`` words at
most.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.boosting import Boosted
from tessella.llm.names import NICKNAMES, TITLES, fold
from tessella.plans.durable import spread

KINDS = ("email", "phone", "identity", "address", "name")
#: A word is common when it stands in more than this share of the texts and in ``COMMON_FLOOR`` of them: at most
#: (words a text) / share common words.
COMMON_SHARE = 1e-4
COMMON_FLOOR = 5
#: ... and proper, if at least so many uses inside sentences are known, of which more than this share has a capital.
PROPER_USES, PROPER_SHARE = 5, 0.5
#: Words of the longest name.
NAME_TOKENS = 12

_SHORT = {s for v in NICKNAMES.values() for s in v.split()}
GIVEN = frozenset(NICKNAMES) | _SHORT
#: Given names that are words as well (fixed values).
DOUBTFUL = frozenset("bill will dot rich mark grace fe le val bel lu may art rose hope joy tom kim ana mia pat bob ed jack lisa nana bela dora kit ze du mari vale".split())

# ---- generators

_L = r"A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
_MAIL = re.compile(
    rf"(?:mailto:)?[\w.+%-]+(?:\s?@\s?|\s*[(\[]\s*(?:at|arroba)\s*[)\]]\s*|\s+arroba\s+)[\w-]+(?:(?:\s?\.\s?|\s*[(\[]\s*(?:dot|ponto)\s*[)\]]\s*|\s+(?:ponto|dot)\s+)[\w-]+)+",
    re.I,
)
_TOWN = rf"(?P<town{{n}}>,[ ](?-i:(?!(?:Apto|Apt|Casa|Bloco)\b)[A-ZÀ-Ý][{_L}]+(?:[ ][A-ZÀ-Ý][{_L}]+){{{{0,2}}}})(?![{_L}]))?"
_TAIL = r"(?:[ ]?[,–-]?[ ]?(?:\bfundos|\bfrente|\b(?:apto?|ap|apartamento|casa|bloco|block|bl|sala|apt|unit|flat|suite|lote|quadra)\b\.?[ ]?\w{1,5}\b))*"
_CEP = r"(?:,?[ ](?:CEP:?[ ])?\d{5}-?\d{3}(?!\d))?"
_STREET = re.compile(
    rf"(?<![{_L}])(?:rua|r\.|avenida|av\.?|travessa|trav\.?|alameda|al\.|estrada|estr\.|pra[cç]a|pç\.?|rodovia|rod\.|largo|viela|beco|ladeira)[ ](?:d[aeo]s?[ ])?[{_L}'’-]+(?:[ ](?:d[aeo]s?[ ])?[{_L}'’-]+){{0,3}}?"
    rf"[ ]?,?[ ]?(?:n[ºo°.]{{0,2}}[ ]?\d+|\d+|s/n|km[ ]?\d+){_TAIL}{_TOWN.format(n=1)}{_CEP}{_TOWN.format(n=2)}",
    re.I,
)
_ROAD = re.compile(
    rf"(?:\b(?:flat|apt|unit|suite)\.?[ ]\w{{1,5}},[ ])?(?<![\d:.,])\b\d{{1,5}}[ ][{_L}'’-]+(?:[ ][{_L}'’-]+){{0,2}}?[ ](?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|close|crescent|terrace|boulevard|blvd|place|square)\b\.?"
    rf"{_TAIL}{_TOWN.format(n=1)}(?:,?[ ]\d{{5}}(?:-\d{{3,4}})?(?!\d))?",
    re.I,
)
_RUN = re.compile(r"(?<![\w.,/:-])(?:\+|\(\+?|00)?\d(?:(?:[ .\-–]|\)[ .-]?| \()?\d)*(?![\w])")
_PASS = re.compile(r"(?<!\w)[A-Za-z]{2}\d{6,9}(?!\w)")
_DDD = re.compile(r",?\s(?:ddd|area code|code)\s\d{2,3}", re.I)
_EXT = re.compile(r",?\s?(?:ext|ramal|extension|r)\.?\s?\d{1,5}\b", re.I)
#: Digits as words, in English and Portuguese (fixed values).
_SPOKEN = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "um": "1", "dois": "2", "tres": "3", "três": "3", "quatro": "4", "cinco": "5", "seis": "6", "meia": "6", "sete": "7", "oito": "8", "nove": "9",
}
_SAID = "|".join(sorted(_SPOKEN, key=len, reverse=True))
_SPELT = re.compile(rf"(?<![\w])(?:{_SAID}|\d)(?:[ ,.-]{{1,2}}(?:{_SAID}|\d{{1,4}})){{5,}}(?![\w])", re.I)
_SPLIT = re.compile(r"[ ,.-]+")
_DIGIT = re.compile(r"\d")
_SAID_WORD = re.compile(rf"\b(?:{_SAID})\b", re.I)
_TOKEN = re.compile(rf"[{_L}]+(?:['’-][{_L}]+)*\.?")
_PARTICLES = frozenset("de da do dos das del von van".split())

_PHONE_CUE = r"tel|telefone|phone|fone|celular|cell|call me|ring|liga|ligue|whats\w*|zap|text|sms|number|n[uú]mero novo|landline|reach|atende|picks up|mobile|fax|contato|ramal"
_ID_CUE = r"cpf|rg|ssn|social security|passport|passaporte|cnh|nin|document|documento|identity|identidade|form|cadastro|ficha pede|desk wanted|anote a[ií]|please note|id"
_OTHER_CUE = r"pedido|order|protocolo|ticket|bill|boleto|lote|lot|serial|rastreio|tracking|vers[aã]o|build|version|paguei|paid|cobrad[oa]|charged|custa|costs?|valor|forno|kiln|hit|medi|weigh\w*|gramas|termina em|ends in|nota|note|place|ref|invoice|fatura|conta|cupom|coupon|sala|room|km|aro|came|reais|your"
_LEFT = re.compile(rf"\b(?:(?P<o>{_OTHER_CUE})|(?P<p>{_PHONE_CUE})|(?P<i>{_ID_CUE}))\b", re.I)
_AFTER_BAD = re.compile(r"\s?(?:reais|dollars|euros|gramas|grams|graus|degrees|kg|km|horas|hours|anos|years|%|came|veio|h\b)", re.I)

_PERSON_CUE = re.compile(
    r"(?:com|with|aqui é|this is|assinado,?|regards,?|signed,?|obrigad[oa],?|thank you|thanks,?|ask|cc|nome de|under|filh[ao]|son|daughter|turma de|group of|retirar é|pickup is by|by|cliente|client|sr|sra|mr|mrs|ms|dr|dra|prof|dona|for|para|to|chama|name is|meu nome é|sou)\s*[.:,]?\s*$",
    re.I,
)
_PET_CUE = re.compile(r"(?:cachorr[oa]|gat[oa]|dog|cat|pet|puppy|hamster|papagaio|parrot)\s*[:=]?\s*$", re.I)
_THING_CUE = re.compile(r"(?:plano|plan|city|cidade|moro em|live in|loja|shop|store|firma|empresa|company|a|the|é a|is a|vers[aã]o|modelo|model|app)\s*[:=]?\s*$", re.I)
_FIRM = re.compile(r"\b(?:ltda|ltd|inc|s\.?a\.?|me|livraria|padaria|bakery|oficina|workshop|cl[ií]nica|escola|institut[eo]|cooperativa|companhia|associação|foundry|laborat[oó]rio)\b", re.I)


class Span:
    __slots__ = ("kind", "lo", "hi", "x")

    def __init__(self, kind: str, lo: int, hi: int, x: list[int]):
        self.kind, self.lo, self.hi, self.x = kind, lo, hi, x


def _left(text: str, lo: int, n: int = 34) -> str:
    s = text[max(0, lo - n) : lo]
    # a sentence or line before says nothing about what follows
    for cut in ("\n", "; ", " / ", ". "):
        at = s.rfind(cut)
        while cut == ". " and at > 0 and re.search(r"\b(?:no|n|tel|sr|sra|dr|prof|ms|mr|r|av|nº)$", s[:at], re.I):
            at = s.rfind(cut, 0, at)
        if at >= 0:
            s = s[at + len(cut) :]
    return s


@lru_cache(maxsize=100_000)
def _number_cues(left: str) -> tuple[str, str, bool]:
    """(the last cue before a number, all of them, whether the name of a document stands right before it)."""
    # what stands before another number belongs to that one
    left = re.split(r"\d", left)[-1]
    cues = "".join(m.lastgroup for m in _LEFT.finditer(left))
    return cues[-1:], cues, bool(_NAMED.search(left))


_NAMED = re.compile(r"\b(?:cpf|rg|ssn|passport|social security|passaporte)\W*(?:n[ºo.]*)?\W*$", re.I)


@lru_cache(maxsize=100_000)
def _name_cues(left: str) -> tuple[int, int, int, int]:
    """Whether a person, a pet or a thing is announced before a name, and whether nothing stands there."""
    return int(bool(_PERSON_CUE.search(left))), int(bool(_PET_CUE.search(left))), int(bool(_THING_CUE.search(left))), int(left.strip() == "")


def _number_features(text: str, lo: int, hi: int, run: str) -> list[int]:
    last, cues, named = _number_cues(_left(text, lo))
    groups = re.findall(r"\d+", run)
    lens = [len(g) for g in groups]
    right = text[hi : hi + 16]
    return [
        sum(lens), len(lens), min(15, lens[0]), min(15, lens[-1]), min(15, max(lens)),
        int("+" in run), int("(" in run), int(run.startswith("00")), run.count("."), run.count("-") + run.count("–"), run.count(" "),
        int(lens == [3, 3, 3, 2]), int(lens == [9, 2]), int(lens == [2, 3, 3, 1]), int(lens == [3, 2, 4]), int(lens == [11]),
        int(len(lens) == 4 and run.count(".") == 3 and "-" not in run), int(lens[0] == 4 and run[:2] == "20" and len(lens) == 2 and lens[1] == 8), int(lens == [5, 3]),
        int(lens[-2:] in ([4, 4], [5, 4], [3, 4])), int("555" in groups), int(len(lens) == 5 and lens[0] == 1),
        int(last == "p"), int(last == "i"), int(last == "o"), int("p" in cues), int("i" in cues), int("o" in cues),
        int(bool(re.match(r"\s?\((?:cpf|rg|ssn)", right, re.I))), int(bool(_AFTER_BAD.match(right))), int(right[:1] in ("/", ":", ",") and right[1:2].isdigit()),
        int(bool(_DDD.match(right))), int(bool(_EXT.match(right))), int(named),
    ]


def _mail_features(m: str) -> list[int]:
    return [int("@" in m), int(bool(re.search(r"\s@\s", m))), m.count("."), min(15, len(m) // 4), int(bool(re.search(r"arroba|\(at|\[at", m, re.I))), int(bool(re.search(r"(?:\.|ponto|dot\W*)\s*[a-z]{2,8}$", m, re.I)))]


def _address_features(a: str, left: str, looks: list[tuple]) -> list[int]:
    return [
        sum(v[6] or (v[8] and v[7] not in _STREET_WORDS) for v in looks), sum(v[5] and v[7] not in _STREET_WORDS for v in looks), sum(v[8] and v[7] not in _STREET_WORDS for v in looks),
        int(bool(re.search(r"\d", a))), int("s/n" in a.lower()), int(" km" in a.lower()), int(bool(re.search(r"\d{5}-?\d{3}", a))), min(15, len(a) // 5),
        int(bool(re.search(r"apto?|apt|bloco|casa|flat|fundos", a, re.I))), int(bool(re.match(r"[A-ZÀ-Ý\d]", a))), a.count(","), int(bool(_LEFT.search(left) and _LEFT.search(left).lastgroup == "o")),
    ]


_STREET_WORDS = frozenset(
    "rua avenida av travessa alameda estrada praca rodovia largo fundos frente apto ap apt apartamento casa bloco block sala unit flat suite cep km street st road rd lane ln avenue ave drive court do da de dos das no".split()
)


def _whole_address(m: re.Match, words: "_Words") -> int:
    """Where an address ends: a town is made of ordinary words, a name after the address is not."""
    end = m.end()
    for group in ("town2", "town1"):
        town = m.groupdict().get(group)
        if town and not all(words.look(w)[5] or words.look(w)[8] for w in _TOKEN.findall(town)):
            end = m.start(group)
    return end


class _Words:
    """The classes of words, by their folded form."""

    def __init__(self, ordinary: frozenset, proper: frozenset = frozenset()):
        self.ordinary, self.proper = ordinary, proper
        self.memo: dict[str, tuple] = {}

    def classes(self, f: str) -> tuple[bool, bool, bool]:
        """(known given name, ordinary, proper)."""
        return f in GIVEN, f in self.ordinary, f in self.proper

    def look(self, token: str) -> tuple:
        """(given, doubtful, initial, particle, title, ordinary, rare, letters, proper)."""
        v = self.memo.get(token)
        if v is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            f = fold(token.rstrip(".")).replace("'", "").replace("’", "")
            given, ordinary, proper = self.classes(f)
            rest = not given and len(f) > 1
            v = self.memo[token] = (given, given and f in DOUBTFUL, len(f) == 1, f in _PARTICLES, f in TITLES and len(f) > 1, ordinary and rest, rest and not ordinary and not proper and len(f) > 3, f, rest and proper and not ordinary)
        return v


class _TrainingWords(_Words):
    """For the synthetic texts: every fourth given name is unknown, every seventh family name common, names of things any of them."""

    def __init__(self, ordinary: frozenset, things: frozenset):
        super().__init__(ordinary)
        self.things = things

    def classes(self, f: str) -> tuple[bool, bool, bool]:
        lot = zlib.crc32(f.encode("utf-8", "surrogatepass"))
        if f in self.things:
            return f in GIVEN, lot % 6 == 0, lot % 6 > 1
        if f in self.ordinary:
            return f in GIVEN, f not in GIVEN, False
        known = f in GIVEN and lot % 4 > 0
        return known, False, not known and lot % 7 == 0 and len(f) > 2


def _name_spans(text: str, words: _Words, covered: list[tuple[int, int]]) -> list[Span]:
    toks = [(*m.span(), m[0]) for m in _TOKEN.finditer(text)]
    memo = words.memo
    looks = [memo.get(t[2]) or words.look(t[2]) for t in toks]
    n = len(toks)
    # most words are ordinary and begin nothing
    seeds = [i for i in range(n) if looks[i][4] or not looks[i][5] and (looks[i][0] or (looks[i][8] and toks[i][2][0].isupper()) or (looks[i][6] and (toks[i][2][0].isupper() or (i and looks[i - 1][0]))) or (looks[i][2] and toks[i][2][0].isupper() and i + 1 < n and looks[i + 1][6]))]
    out, done = [], set()

    def inside(lo: int, hi: int) -> bool:
        return any(a < hi and lo < b for a, b in covered)

    def gap(i: int) -> str:
        return text[toks[i][1] : toks[i + 1][0]] if i + 1 < n else "\n"

    def member(i: int) -> bool:
        given, _, initial, particle, _title, _ordinary, rare, _f, proper = looks[i]
        return given or rare or ((initial or proper) and toks[i][2][0].isupper()) or particle

    for s in seeds:
        if looks[s][4]:
            s += 1
            if s >= n or gap(s - 1) not in (" ", "  ", "\xa0"):
                continue
        for first in (s, s - 1):
            if first < 0 or (first < s and not (member(first) and not looks[first][3] and gap(first) in (" ", ", "))):
                continue
            if not member(first) or looks[first][3]:
                continue
            last, comma = first, False
            while True:
                lo, hi = toks[first][0], toks[last][1]
                tok = toks[last][2]
                # the full stop belongs to an initial only
                if tok.endswith(".") and not looks[last][2]:
                    hi -= 1
                if not looks[last][3] and (first, last) not in done and not inside(lo, hi):
                    done.add((first, last))
                    out.append(Span("name", lo, hi, _name_features(text, toks, looks, first, last, lo, hi, comma, member, gap)))
                if last + 1 >= n or last - first >= NAME_TOKENS - 1 or not member(last + 1):
                    break
                g = gap(last)
                stops = toks[last][2].endswith(".") and not looks[last][2]
                if g == ", " and not comma and not stops and last - first <= 1 and looks[first][6]:
                    comma = True  # FAMILY, Given
                elif g not in (" ", "  ", "\xa0") or stops:
                    break
                last += 1
    return out


def _name_features(text, toks, looks, first, last, lo, hi, comma, member, gap) -> list[int]:
    span = range(first, last + 1)
    person, pet, thing, alone = _name_cues(_left(text, lo))
    before, after = first - 1, last + 1
    tied_left = before >= 0 and gap(before) in (" ", "  ", "\xa0")
    tied_right = after < len(toks) and gap(last) in (" ", "  ", "\xa0") and not (toks[last][2].endswith(".") and not looks[last][2])
    given = [looks[i][0] for i in span]
    rare = [looks[i][6] for i in span]
    caps = [toks[i][2][0].isupper() for i in span if not looks[i][3]]
    upper = [toks[i][2].isupper() for i in span if len(toks[i][2]) > 2]
    shouted = text[max(0, lo - 12) : lo].isupper() or text[hi : hi + 12].isupper()
    return [
        last - first + 1, sum(given), int(given[0]), sum(rare), sum(looks[i][2] for i in span), int(looks[first][2]), int(looks[last][2]), sum(looks[i][1] for i in span),
        int(all(caps)), int(any(caps)), int(bool(upper) and all(upper)), int(shouted), int(comma), int(comma and given[-1]),
        person, pet, thing, int(tied_left and looks[before][4]),
        int(tied_left and member(before) and not looks[before][4] and (toks[before][2][0].isupper() or looks[before][0])), int(tied_right and looks[after][6]), int(tied_right and (looks[after][0] or looks[after][2])),
        int(tied_right and toks[after][2][0].isupper()), int(lo == 0 or text[lo - 1] in "\n" or alone), int(hi >= len(text) or text[hi] in ".,;\n!?"),
        int(bool(_FIRM.search(text[max(0, lo - 16) : hi + 14]))), sum(looks[i][3] for i in span), int(last + 1 < len(toks) and gap(last) == ", " and looks[after][0]), int(first > 0 and gap(before) == ", " and looks[before][6] and (toks[before][2][0].isupper())),
        sum(looks[i][8] for i in span), int(looks[first][8]), int(looks[last][8]), int(tied_right and looks[after][8] and toks[after][2][0].isupper()), int(tied_left and looks[before][8] and toks[before][2][0].isupper()), int(tied_left and looks[before][5]), int(tied_right and looks[after][5]),
        int(tied_right and looks[after][3]), int(tied_left and looks[before][3]), int(text[hi : hi + 1] in "=:" if hi < len(text) else 0), int(lo > 0 and text[lo - 1] in "@/_#"), int(text[hi : hi + 2].strip()[:1].isdigit() if hi < len(text) else 0),
    ]




def propose(text: str, words: _Words) -> list[Span]:
    """All candidate spans of a text, overlapping ones included."""
    spans: list[Span] = []
    covered: list[tuple[int, int]] = []
    low = text.lower()
    if "@" in text or "arroba" in low or "(at" in low or "[at" in low:
        for m in _MAIL.finditer(text):
            spans.append(Span("email", m.start(), m.end(), _mail_features(m[0])))
            covered.append(m.span())
    if _DIGIT.search(text) or "s/n" in low:
        for rx in (_STREET, _ROAD):
            for m in rx.finditer(text):
                lo, hi = m.start(), _whole_address(m, words)
                if not any(a < hi and lo < b for a, b in covered):
                    a = text[lo:hi]
                    x = _address_features(a, _left(text, lo), [words.look(w) for w in _TOKEN.findall(a)])
                    spans.append(Span("address", lo, hi, x))
                    # what is no address (no invented name in it) may hold other things
                    if x[0]:
                        covered.append((lo, hi))
        for rx in (_RUN, _PASS):
            for m in rx.finditer(text):
                if sum(ch.isdigit() for ch in m[0]) < 6 or any(a < m.end() and m.start() < b for a, b in covered):
                    continue
                lo, hi = m.span()
                x = _number_features(text, lo, hi, m[0])
                spans.append(Span("identity", lo, hi, x))
                if rx is _RUN:
                    d = _DDD.match(text, hi) or _EXT.match(text, hi)
                    spans.append(Span("phone", lo, d.end() if d else hi, x))
    for m in _SPELT.finditer(text) if not _SPOKEN.keys().isdisjoint(_SPLIT.split(low)) else ():
        lo, hi = m.span()
        run = _SAID_WORD.sub(lambda w: _SPOKEN[w[0].lower()], m[0])
        if m[0] != run and not any(a < hi and lo < b for a, b in covered):
            # judged as the digits that are said, in one run
            x = _number_features(text, lo, hi, re.sub(r"\D", "", run))
            spans += [Span("phone", lo, hi, x), Span("identity", lo, hi, x)]
            covered.append((lo, hi))
    spans += _name_spans(text, words, covered)
    return spans


# ---- models


class Models:
    def __init__(self, trees: dict[str, Boosted]):
        self.trees = trees

    def select(self, texts: list[list[Span]]) -> list[list[Span]]:
        """Of each text's candidates the ones that stand, in reading order."""
        scores: dict[int, float] = {}
        for kind in KINDS:
            own = [s for spans in texts for s in spans if s.kind == kind]
            if own:
                model = self.trees[kind]
                p = model.predict(np.array([s.x for s in own], np.int64))
                for s, v in zip(own, p):
                    if v >= model.threshold:
                        # comparable between kinds: how far above its threshold
                        scores[id(s)] = (v - model.threshold) / (1 - model.threshold + 1e-9)
        rank = {"email": 0, "address": 1, "identity": 2, "phone": 2, "name": 3}
        out = []
        for spans in texts:
            live = sorted((s for s in spans if id(s) in scores), key=lambda s: (rank[s.kind], -round(scores[id(s)], 2), s.lo - s.hi, s.lo))
            kept: list[Span] = []
            for s in live:
                if all(s.hi <= k.lo or k.hi <= s.lo for k in kept):
                    kept.append(s)
            out.append(sorted(kept, key=lambda s: s.lo))
        return out


@lru_cache(maxsize=1)
def trained() -> Models:
    """The models, trained on synthetic sentences; a fifth of them is held out for the thresholds."""
    from tessella.llm import synthetic

    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    words = _TrainingWords(synthetic.ordinary_words(), synthetic.things())
    for number, (text, truth) in enumerate(synthetic.sentences()):
        marked = {(k, lo, hi) for k, lo, hi in truth}
        for s in propose(text, words):
            if s.kind == "name":
                y = (s.kind, s.lo, s.hi) in marked
            else:
                y = any(k == s.kind and lo < s.hi and s.lo < hi for k, lo, hi in marked)
            xs, ys, held = rows[s.kind]
            xs.append(s.x)
            ys.append(y)
            held.append(number % 5 == 0)
    trees = {}
    for kind, (xs, ys, held) in rows.items():
        x, y, h = np.array(xs, np.int64), np.array(ys, float), np.array(held)
        trees[kind] = Boosted().fit(x[~h], y[~h]).calibrate(x[h], y[h])
    return Models(trees)


# ---- dataflow


def word_classes(fields: DataFrame) -> tuple[frozenset, frozenset]:
    """(ordinary, proper): the words that stand in more than a fixed share of the texts, by how they are written inside sentences.

    Counted over all texts, combined before the shuffle; what comes to the driver is bounded by the share.
    """
    # copies of one text, whatever their dress, count once
    letters = F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", ""))
    texts = fields.select(letters.alias("h"), "text").groupBy("h").agg(F.min("text").alias("text"))
    n = fields.count()
    least = max(COMMON_FLOOR, int(n * COMMON_SHARE))
    zero, one = F.lit(0), F.lit(1)
    all_ = F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1))), lambda w: F.struct(w.alias("w"), one.alias("n"), zero.alias("uses"), zero.alias("capital")))
    # words after a small letter or a digit stand inside a sentence; words written large say nothing
    inside = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<=[\p{Ll}\p{N}],? )(\p{L}{2,})"), F.lit(1))), lambda w: w != F.upper(w))
    used = F.transform(inside, lambda w: F.struct(F.lower(w).alias("w"), zero.alias("n"), one.alias("uses"), w.rlike(r"^\p{Lu}").cast("int").alias("capital")))
    rows = texts.select(F.explode(F.concat(all_, used)).alias("e")).groupBy("e.w").agg(F.sum("e.n").alias("n"), F.sum("e.uses").alias("uses"), F.sum("e.capital").alias("capital"))
    seen: dict[str, list[int]] = {}
    for r in rows.where(F.col("n") > least).select("w", "uses", "capital").collect():
        uses = seen.setdefault(fold(r["w"]), [0, 0])
        uses[0] += r["uses"]
        uses[1] += r["capital"]
    proper = frozenset(w for w, (uses, capital) in seen.items() if uses >= PROPER_USES and capital > PROPER_SHARE * uses)
    return frozenset(seen) - proper, proper


def text_fields(turns: DataFrame, memories: DataFrame) -> DataFrame:
    """tbl, row_id, field_name, text of the three fields."""
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("user_input", "response")))).alias("f")
    a = turns.select(F.lit("turns").alias("tbl"), F.col("id").cast("string").alias("row_id"), both).select("tbl", "row_id", "f.field_name", "f.text")
    b = memories.select(F.lit("memories").alias("tbl"), F.col("id").cast("string").alias("row_id"), F.lit("content").alias("field_name"), F.col("content").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull() & (F.col("text") != ""))


def _judge_batches(shared, words_shared, emit):
    def run(batches):
        models, words = shared.value, _Words(*words_shared.value)
        memo: dict[str, tuple] = {}
        for b in batches:
            texts = b.column(b.schema.names.index("text")).to_pylist()
            new = [t for t in dict.fromkeys(texts) if t not in memo]
            if len(memo) + len(new) > 200_000:
                memo.clear()
                new = list(dict.fromkeys(texts))
            for t, spans in zip(new, models.select([propose(t, words) for t in new])):
                memo[t] = tuple((s.kind, s.lo, s.hi) for s in spans)
            yield emit(b, texts, memo)

    return run


def occurrences(fields: DataFrame) -> DataFrame:
    """tbl, row_id, field_name, pii_kind, nth: one row per occurrence."""
    sc = fields.sparkSession.sparkContext
    shared, words = sc.broadcast(trained()), sc.broadcast(word_classes(fields))

    def emit(b, texts, memo):
        at, kinds, nths = [], [], []
        for i, t in enumerate(texts):
            seen: dict[str, int] = {}
            for kind, _, _ in memo[t]:
                seen[kind] = seen.get(kind, 0) + 1
                at.append(i)
                kinds.append(kind)
                nths.append(seen[kind])
        ix = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), b.column(2).take(ix), pa.array(kinds, pa.string()), pa.array(nths, pa.int32())], names=["tbl", "row_id", "field_name", "pii_kind", "nth"])

    return spread(fields).mapInArrow(_judge_batches(shared, words, emit), "tbl string, row_id string, field_name string, pii_kind string, nth int")


def redact(text: str, spans: tuple) -> str:
    parts, at = [], 0
    for kind, lo, hi in spans:
        parts += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join(parts) + text[at:]


def redacted(fields: DataFrame) -> DataFrame:
    """tbl, row_id, field_name, text: every text with its personal information replaced by typed placeholders."""
    sc = fields.sparkSession.sparkContext
    shared, words = sc.broadcast(trained()), sc.broadcast(word_classes(fields))

    def emit(b, texts, memo):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([redact(t, memo[t]) for t in texts], pa.string())], names=["tbl", "row_id", "field_name", "text"])

    return spread(fields).mapInArrow(_judge_batches(shared, words, emit), "tbl string, row_id string, field_name string, text string")
