"""Variant spellings of names typed by people.

Labels are read into parts (given, middle and family name, generation; or kind
of business, family, addition), equal readings are collapsed, and only
different readings are compared.  A symmetric-delete index over the distinct
tokens of a scope finds the tokens a few edits apart (deletions of a token meet
those of another in a join); readings that share such a token are candidates.
Candidates are verified by the optimal assignment of their tokens, which permits
initials, abbreviations, nicknames and reordering.  Links are of different
strength: a full given name is strong, a left-out middle name or addition, an
initial or an acronym is weak and counts only where it points to one entity.

What the names are made of is learned from all labels (``learn_lore``): tokens
that mostly stand where given names stand, words that many firms share, and
short forms, which are given names that share families with another far more
often than chance.  The lists below are only what is known before.

Entities are components, found by joins over numbers: strong links first; then
weak ones, round by round, wherever all weak links of an entity point to one
other.  No group is collected in a task; no component is.

Defined cases: null or empty labels and labels without a letter take no part;
types other than PERSON and ORG take no part; a null scope is a scope of its
own; equal labels are one entity; a generation suffix is part of the name; a
token that many readings of a scope share is joined together with a second key,
so that no group is compared all with all; every pair that the verifier accepts
shares one.  Readings are numbered by 64 bits of their hash.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.durable import cut, spread
from tessella.plans.skew import hot_keys

#: Forms of address (fixed values).
TITLES = frozenset("mr mrs ms miss mx dr dra dr prof profa sr sra srta snr dona dom don doutor doutora professor professora senhor senhora sir madam".split())
#: Generation suffixes and the one each is short for (fixed values).
GENERATIONS = {"jr": "jr", "junior": "jr", "filho": "filho", "fo": "filho", "neto": "neto", "sobrinho": "sobrinho", "ii": "ii", "iii": "iii", "segundo": "ii"}
#: Short forms in common use in Portuguese and English, known before any are learned (fixed values).
NICKNAMES = {
    "alexandre": "alex xande xandao", "antonio": "tonho toninho tony tom toni", "beatriz": "bia bea bibi", "cecilia": "cica ceci cissa",
    "dorothy": "dot dolly dottie dora", "eduardo": "edu dudu duda", "elizabeth": "liz betty beth lizzie eliza bess lisa", "fernanda": "fe nanda fer",
    "francisco": "chico chiquinho kiko paco fran xico", "gabriela": "gabi gaby bibi", "guilherme": "gui guiga", "henrique": "rique henri kike",
    "isabel": "bel isa belinha bela", "joaquim": "quim quincas quinzinho juca kim", "jose": "ze zeca zeze zezinho juca", "katherine": "kate kathy katie kitty kat kath",
    "leticia": "le lele leti", "luis": "lula luisinho lulu luiz lu", "margaret": "maggie peggy meg marge greta", "mariana": "mari nana mary",
    "nathaniel": "nate nat nathan", "otavio": "tavinho tavio otavinho", "patricia": "pati paty patty tricia pat", "rafael": "rafa rafinha",
    "richard": "dick rick rich richie ricky", "robert": "bob rob bobby bert robbie", "roberto": "beto betinho berto", "sebastiao": "tiao bastiao seba",
    "teresa": "tete tere tess terry", "theodore": "ted teddy theo", "ursula": "ursa ursi sula", "valentina": "val tina vale", "vinicius": "vini vinny",
    "william": "bill will billy willy liam", "yolanda": "yoli yola landa yoyo", "zacarias": "zaca zac zeca", "joao": "joca jo jojo", "maria": "mia mimi",
    "ana": "aninha", "paulo": "paulinho", "carlos": "carlinhos cacau", "pedro": "pedrinho", "james": "jim jimmy", "john": "jack johnny", "charles": "charlie chuck",
    "thomas": "tommy", "michael": "mike mick", "edward": "ed eddie ned", "helena": "lena", "manuel": "mane manu",
}
#: Kinds of business in Portuguese and English, known before any are learned (fixed values).
KINDS = frozenset(
    "institute instituto companhia company bakery padaria associacao association oficina workshop escola school clinica clinic cooperativa cooperative "
    "livraria bookshop foundry fundicao laboratorio laboratory fundacao foundation hospital hotel restaurante restaurant farmacia pharmacy mercado market "
    "loja store banco bank editora publisher studio estudio academia academy".split()
)
#: Legal forms (fixed values).
LEGAL = frozenset("me sa ltda limitada ltd limited inc incorporated eireli epp llc plc corp corporation co gmbh".split())
#: Additions to a firm's name and the words that tie them to it (fixed values).
ADDITIONS = frozenset("sons filhos irmaos brothers bros central nova novo new northern north southern south harbour harbor vale serra atlantica atlantic pacific norte sul da do de dos das and e".split())
_TIES = frozenset("da do de dos das and e".split())
_PARTICLES = frozenset("de da do das dos del von van der la".split())


@dataclass(frozen=True)
class Lore:
    """What is known of the words names are made of."""

    #: Given names and short forms, each with the names it may stand for.
    behind: dict[str, frozenset]
    #: Full given names; a word an edit apart from one of five letters or more is one as well.
    given: frozenset
    kinds: frozenset
    #: What each short form that was learned goes with.
    learned: dict[str, frozenset]

    @staticmethod
    def fixed() -> "Lore":
        behind: dict[str, frozenset] = {}
        for full, short in NICKNAMES.items():
            for s in (full, *short.split()):
                behind[s] = behind.get(s, frozenset()) | {full}
        return Lore(behind, frozenset(NICKNAMES), KINDS, {})

    def with_learned(self, given: Iterable[str], kinds: Iterable[str], pairs: Iterable[tuple[str, str]]) -> "Lore":
        learned: dict[str, frozenset] = {}
        for a, b in pairs:
            learned[a] = learned.get(a, frozenset()) | {b}
            learned[b] = learned.get(b, frozenset()) | {a}
        behind = dict(self.behind)
        for g in given:
            behind.setdefault(g, frozenset((g,)))
        return Lore(behind, self.given, self.kinds | frozenset(kinds), learned)

    def is_given(self, w: str) -> bool:
        return w in self.behind or (len(w) >= 5 and any(near(w, g) for g in self.given))

    def alike(self, a: str, b: str) -> bool:
        """One stands for the other, or both for a third name."""
        if self.behind.get(a, frozenset()) & self.behind.get(b, frozenset()) or b in self.learned.get(a, ()):
            return True
        # a nickname against a misspelt name
        return any(near(g, y) for x, y in ((a, b), (b, a)) if len(y) >= 5 for g in self.behind.get(x, frozenset()) | self.learned.get(x, frozenset()))

    def names_of(self, w: str) -> frozenset:
        """The word and all it may stand for."""
        return frozenset((w,)) | self.behind.get(w, frozenset()) | self.learned.get(w, frozenset())


#: Readings of one token in one scope beyond which they are joined on a second feature as well.
HOT_TOKEN = 400
_LOOKS = str.maketrans("0135", "oles")


def fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()) if not unicodedata.combining(ch))


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _plain(word: str) -> str:
    w = re.sub(r"['’]", "", fold(word))
    # a digit inside letters is a letter that looks like it
    return w.translate(_LOOKS) if any(ch.isalpha() for ch in w) else w


@lru_cache(maxsize=200_000)
def near(a: str, b: str, most: int = 1) -> bool:
    """Edit distance (with swaps of neighbours) of at most ``most``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    if most == 1:
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1] <= most


def spellings(token: str) -> set[str]:
    """Two tokens that ``_same`` accepts have one in common: the deletions of the token and of its shape, two of a long token."""
    if len(token) <= 3:
        return {token}
    out = {token} | {w[:i] + w[i + 1 :] for w in {token, _shape(token)} for i in range(len(w))} | {_shape(token)}
    if len(token) >= 9:
        out |= {token[:i] + token[i + 1 : j] + token[j + 1 :] for i, j in itertools.combinations(range(len(token)), 2)}
    return out


def _same(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or (n >= 4 and (near(a, b) or near(_shape(a), _shape(b)))) or (n >= 9 and near(a, b, 2))


def _shape(w: str) -> str:
    """A family name as scanners see it: r and n side by side are one m."""
    return w.replace("rn", "m")


# ---- reading


LORE = Lore.fixed()


def _person_words(label: str) -> tuple[list[str], list[str], str]:
    """(words before a comma, words after it, generation), forms of address left out."""
    head, comma, tail = label.partition(",")
    left, right = ([w for w in (_plain(x) for x in _WORD.findall(part)) if w] for part in (head, tail))
    generation = ""

    def strip(ws: list[str]) -> list[str]:
        nonlocal generation
        ws = [w for w in ws if w not in TITLES] or ws
        while len(ws) > 1 and ws[-1] in GENERATIONS:
            generation = GENERATIONS[ws[-1]]
            ws = ws[:-1]
        return ws

    if comma and len(right) == 1 and right[0] in GENERATIONS:
        generation, right = GENERATIONS[right[0]], []
    left, right = strip(left) if left else [], strip(right) if right else []
    if right and all(w in TITLES for w in left):
        left = []
    return left, right, generation


def read_person(label: str, lore: Lore = LORE) -> str | None:
    """``given|middles|family|generation``, tokens of middles spaced; None without a token."""
    left, right, generation = _person_words(label)
    if right and left:
        words = right + left  # family, given
    else:
        words = left or right
        if len(words) > 1 and not lore.is_given(words[0]) and len(words[0]) > 1:
            # family first without a comma: a given name stands second, or an initial stands last
            if lore.is_given(words[1]) or (len(words) == 2 and len(words[1]) == 1):
                words = words[1:] + words[:1]
    words = [w for w in words if w not in _PARTICLES] or words
    if not words or not any(ch.isalpha() for w in words for ch in w):
        return None
    if len(words) == 1:
        return f"||{words[0]}|{generation}"
    return f"{words[0]}|{' '.join(words[1:-1])}|{words[-1]}|{generation}"


def _short_for(short: str, full: str) -> bool:
    """An abbreviation: same first letter, its letters stand in the word in this order."""
    if not short or len(short) >= len(full) or short[0] != full[0]:
        return False
    it = iter(full)
    return all(ch in it for ch in short)


def _kind(w: str, lore: Lore) -> str | None:
    if w in lore.kinds:
        return w
    return min((k for k in lore.kinds if near(w, k)), default=None) if len(w) >= 5 else None


def read_org(label: str, lore: Lore = LORE) -> str | None:
    """``kind|family|additions|initials``; kind may be an abbreviation, marked by a final dot; an acronym has initials only."""
    raw = label.strip()
    letters = re.sub(r"[.\s]", "", raw)
    if 2 <= len(letters) <= 6 and letters.isalpha() and (letters.isupper() or "." in raw) and ("." in raw or " " not in raw) and all(len(x) == 1 for x in raw.split(".") if x.strip()) | (letters == raw):
        return f"|||{''.join(sorted(fold(letters)))}"
    # S.A., S/A and M.E. are one word each
    raw = re.sub(r"\b([SM])[./\s]?([AE])\b\.?", r"\1\2", raw, flags=re.I) if re.search(r"\b[SM][./][AE]\b", raw, re.I) else raw
    words = [w for w in (_plain(x) for x in _WORD.findall(raw.replace("&", " and "))) if w]
    if not words:
        return None
    while len(words) > 1 and words[-1] in LEGAL:
        words = words[:-1]
    kind, rest = "", []
    for w in words:
        k = _kind(w, lore) if not kind else None
        if k:
            kind = k
        else:
            rest.append(w)
    if not kind and len(rest) > 1:
        # an abbreviated kind stands first or last, or before an addition
        for w in sorted(rest, key=len):
            if len(w) <= 5 and w not in ADDITIONS and any(_short_for(w, k) for k in lore.kinds):
                kind = w + "."
                rest.remove(w)
                break
    family = [w for w in rest if w not in ADDITIONS]
    extra = [w for w in rest if w in ADDITIONS]
    if not family:
        if not extra:
            return None
        family, extra = extra, []
    # what is left beside the first family token belongs to the addition
    main = max(family, key=len)
    extra = [w for w in rest if w != main and w not in _TIES] if main in rest else extra
    initials = "".join(sorted([w[0] for w in rest] + ([kind[0]] if kind else [])))
    return f"{kind}|{main}|{' '.join(extra)}|{initials}"


# ---- verifying

STRONG, LEFT_OUT, INITIAL = "strong", "left_out", "initial"


def _given(a: str, b: str, lore: Lore) -> str | None:
    if not a or not b:
        return INITIAL
    if _same(a, b):
        return STRONG
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return INITIAL
        # the initial of the full name behind a nickname
        long, short = (a, b) if len(b) == 1 else (b, a)
        return INITIAL if any(g[0] == short for g in lore.names_of(long)) else None
    if lore.alike(a, b):
        return STRONG
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return STRONG
    return None


def best_assignment(gain: list[list[int]]) -> list[int]:
    """The column of every row of the assignment of the greatest total gain (rows <= columns), by shortest augmenting paths."""
    rows, cols = len(gain), len(gain[0])
    u, v, match = [0] * (rows + 1), [0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        match[0], at = i, 0
        least, came, done = [float("inf")] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while match[at]:
            done[at], row, step, to = True, match[at], float("inf"), 0
            for j in range(1, cols + 1):
                if not done[j]:
                    cost = -gain[row - 1][j - 1] - u[row] - v[j]
                    if cost < least[j]:
                        least[j], came[j] = cost, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(cols + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            match[at], at = match[came[at]], came[at]
    out = [0] * rows
    for j in range(1, cols + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _assign(xs: list[str], ys: list[str]) -> tuple[int, int] | None:
    """The best assignment of the shorter list into the longer: (full matches, initials), None if a token finds no partner."""
    if len(xs) > len(ys):
        xs, ys = ys, xs
    full, none = len(xs) + 1, -((len(xs) + 1) ** 2)
    gain = [[full if _same(x, y) else 1 if (len(x) == 1 or len(y) == 1) and x[0] == y[0] else none for y in ys] for x in xs]
    if len(xs) == 1:
        best = max(gain[0])
        return None if best < 0 else (int(best == full), int(best == 1))
    got = [row[j] for row, j in zip(gain, best_assignment(gain))]
    return None if none in got else (got.count(full), got.count(1))


def compare_persons(a: str, b: str, lore: Lore = LORE) -> str | None:
    ga, ma, fa, na = a.split("|")
    gb, mb, fb, nb = b.split("|")
    if na != nb:
        return None
    ms, mt = ma.split(), mb.split()
    if _same(fa, fb) and len(fa) > 1:
        g = _given(ga, gb, lore)
        if g is None:
            return None
        if not ms and not mt:
            return g
        if ms and mt:
            fit = _assign(ms, mt)
            if fit is None:
                return None
            return g if len(ms) == len(mt) or g == INITIAL else LEFT_OUT
        return INITIAL if g == INITIAL else LEFT_OUT
    # reordered: every token finds its partner, two at least in full
    xs, ys = [x for x in (ga, *ms, fa) if x], [y for y in (gb, *mt, fb) if y]
    if len(xs) == len(ys) and len(xs) >= 2:
        fit = _assign(xs, ys)
        if fit and fit[0] >= 2:
            return STRONG if fit[1] == 0 else INITIAL
    return None


def compare_orgs(a: str, b: str, lore: Lore = LORE) -> str | None:
    ka, fa, ea, ia = a.split("|")
    kb, fb, eb, ib = b.split("|")
    if not fa or not fb:
        if fa == fb:
            return STRONG if ia == ib else None
        return INITIAL if ia == ib else None
    if not _same(fa, fb):
        return None
    kind = STRONG
    if ka != kb:
        sa, sb = ka.endswith("."), kb.endswith(".")
        if not ka or not kb:
            kind = INITIAL
        elif sa and sb:
            if not (ka.startswith(kb[:-1]) or kb.startswith(ka[:-1])):
                return None
        elif sa or sb:
            if not _short_for(*((ka[:-1], kb) if sa else (kb[:-1], ka))):
                return None
            # an abbreviation may stand for several kinds
            short = ka[:-1] if sa else kb[:-1]
            kind = STRONG if sum(_short_for(short, k) for k in lore.kinds) == 1 else INITIAL
        else:
            return None
    xs, ys = ea.split(), eb.split()
    if xs and ys:
        if len(xs) != len(ys) or _assign(xs, ys) is None:
            return None
        return kind
    if xs or ys:
        return INITIAL if kind == INITIAL else LEFT_OUT
    return kind


def compare(kind: str, a: str, b: str, lore: Lore = LORE) -> str | None:
    return (compare_persons if kind == "PERSON" else compare_orgs)(a, b, lore)


def less_first(a: str, b: str, strength: str) -> tuple[str, str]:
    """The reading that says less, then the other."""

    def says(r: str) -> int:
        return len(r) if strength == INITIAL else sum(len(x) for x in r.split("|")[1:3])

    return (a, b) if (says(a), a) <= (says(b), b) else (b, a)


# ---- dataflow

_READ = "node_id bigint, scope string, kind string, reading string"


#: A token counts as learned from this share of all labels of its kind on (and from a few on), so that at most
#: (tokens a label) / share are ever learned.
LORE_SHARE, LORE_FLOOR = 1e-4, 5
#: A kind of business stands in this share of the firms' labels.
KIND_SHARE, KIND_FLOOR = 2e-3, 20
#: Given names of one family in one scope; families with more say nothing of who is who.
FAMILY_NAMES = 8
#: How much oftener than by chance two given names share families.
LIFT = 5.0


def _labels(nodes: DataFrame) -> DataFrame:
    kind = F.upper(F.trim("node_type"))
    return nodes.where(kind.isin("PERSON", "ORG") & F.col("label").isNotNull()).select(F.col("id").alias("node_id"), F.coalesce("scope", F.lit("\x00")).alias("scope"), kind.alias("kind"), "label")


def learn_lore(nodes: DataFrame, base: Lore = LORE) -> Lore:
    """What the labels themselves say of given names, short forms and kinds of business, counted over all of them.

    A token that stands where given names stand at least four times in five is one; a word that stands first in many
    firms' labels, before many different words, is a kind; two given names that share families ``LIFT`` times oftener than
    by chance are forms of one.  What comes to the driver is bounded by the shares.
    """

    def words(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for scope, kind, label in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                if kind == "PERSON":
                    left, right, _ = _person_words(label)
                    ws = [w for w in left + right if w not in _PARTICLES]
                    if len(ws) < 2:
                        continue
                    given, family = (right[0], left[-1]) if left and right else (ws[0], ws[-1])
                else:
                    ws = [w for w in (_plain(x) for x in _WORD.findall(label)) if len(w) > 2 and w not in LEGAL]
                    if len(ws) < 2 or ws[0] in ADDITIONS:
                        continue
                    given, family = ws[0], ws[1]
                if len(given) > 1 and len(family) > 1:
                    for col, v in zip(out, (scope, kind, given, family, bool(kind == "PERSON" and left and right))):
                        col.append(v)
            st = pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (st, st, st, st, pa.bool_()))], names=["scope", "kind", "given", "family", "sure"])

    rows = cut(spread(_labels(nodes)).mapInArrow(words, "scope string, kind string, given string, family string, sure boolean"))
    totals = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    people, firms = totals.get("PERSON", 0), totals.get("ORG", 0)
    place = F.explode(F.array(F.struct(F.lit(1).alias("first"), F.col("given").alias("w"), F.col("family").alias("other")), F.struct(F.lit(0).alias("first"), F.col("family").alias("w"), F.col("given").alias("other"))))
    counts = rows.select("kind", place.alias("p")).groupBy("kind", "p.w").agg(F.sum("p.first").alias("first"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("p.other").alias("others"))
    of_people = (F.col("kind") == "PERSON") & (F.col("first") >= max(LORE_FLOOR, people * LORE_SHARE)) & (F.col("first") >= 0.8 * F.col("n"))
    of_firms = (F.col("kind") == "ORG") & (F.col("first") >= max(KIND_FLOOR, firms * KIND_SHARE)) & (F.col("first") >= 0.6 * F.col("n")) & (F.col("others") >= F.col("first") / 4)
    known = counts.where(of_people | of_firms).select("kind", "w").collect()
    given = {r["w"] for r in known if r["kind"] == "PERSON"}
    kinds = {r["w"] for r in known if r["kind"] == "ORG"} - LEGAL - ADDITIONS
    # short forms: given names that share families
    held = rows.where("kind = 'PERSON'").select("scope", "family", "given").distinct()
    small = held.groupBy("scope", "family").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= FAMILY_NAMES)
    sets = cut(held.join(small.select("scope", "family"), ["scope", "family"], "left_semi"))
    n = small.count()
    if not n:
        return base.with_learned(given, kinds, ())
    alone = sets.groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.join(sets.withColumnRenamed("given", "g2"), ["scope", "family"]).where("given < g2").groupBy("given", "g2").agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.where(F.col("c") >= max(LORE_FLOOR, n * LORE_SHARE))
    pairs = pairs.join(alone, "given").join(alone.select(F.col("given").alias("g2"), F.col("n").alias("n2")), "g2")
    found = pairs.where(F.col("c") * n >= LIFT * F.col("n") * F.col("n2")).select("given", "g2").collect()
    return base.with_learned(given, kinds, [(r["given"], r["g2"]) for r in found])


def read_labels(nodes: DataFrame, lore: Lore = LORE) -> DataFrame:
    """node_id, scope, kind, reading of the PERSON and ORG nodes."""
    shared = nodes.sparkSession.sparkContext.broadcast(lore)

    def run(batches):
        own = shared.value
        for b in batches:
            ids, scopes, kinds, labels = (b.column(i).to_pylist() for i in range(4))
            readings = [(read_person if k == "PERSON" else read_org)(x, own) for k, x in zip(kinds, labels)]
            keep = [i for i, r in enumerate(readings) if r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64()), *(pa.array([c[i] for i in keep], pa.string()) for c in (scopes, kinds, readings))], names=["node_id", "scope", "kind", "reading"]
            )

    return spread(_labels(nodes)).mapInArrow(run, _READ)


def _tokens(kind: str, reading: str, lore: Lore = LORE) -> list[str]:
    """The tokens a reading is found by: the least common ones."""
    parts = reading.split("|")
    if kind == "ORG":
        return ([parts[1]] if parts[1] else []) + ([f"#{parts[3]}"] if len(parts[3]) > 2 else [])
    names = [w for w in (*parts[1].split(), parts[2]) if len(w) > 2]
    # reordered names may have the family name in the first place
    if len(parts[0]) > 2 and not lore.is_given(parts[0]):
        names.append(parts[0])
    return sorted(set(names)) or [x for x in (parts[2], parts[0]) if x][:1]


def _second(kind: str, reading: str, token: str, lore: Lore = LORE) -> tuple[list[str], list[str]]:
    """What readings of a very common token must share as well: keys of the reading as the left and as the right of a pair.

    Two readings that ``compare`` accepts and that meet in a token share a key: a spelling of the given name, of a full
    name behind it or its first letters, or the kind.  A reading that says less (no given name or kind, an initial, an
    acronym) asks, and those that it may stand for answer; such readings are few, and two that only answer do not meet.
    """
    parts = reading.split("|")
    first = parts[0]
    both, asks, answers = set(), set(), {"e"}
    if kind == "ORG":
        if not parts[1] or (not first and token[0] != "#"):
            asks.add("e")
        if token[0] == "#":
            both = {"f" + v for v in spellings(parts[1])} if parts[1] else set()
        elif first.endswith("."):
            both = {"k" + k for k in lore.kinds if _short_for(first[:-1], k)} | {"a" + first[0]}
        elif first:
            both = {"k" + first}
    else:
        others = [w for w in (*parts[1].split(), parts[2]) if w]
        # reordered: a given name is a token in another place
        answers |= {"g" + v for w in others for v in spellings(w)}
        if first:
            both = {"d" + v for g in lore.names_of(first) for v in spellings(g)} | ({"p" + first[:3]} if len(first) > 2 else set())
            asks |= {"g" + v for v in spellings(first)}
            answers |= {"i" + g[0] for g in lore.names_of(first)}
        else:
            asks.add("e")
        if len(first) == 1:
            asks.add("i" + first)
        # reordered with initials: two of the other tokens agree, of which one is not this token
        initial = any(len(w) == 1 for w in (first, *others))
        if token in others:
            others.remove(token)
        rest = {"o" + v for w in others for v in spellings(w)}
        answers |= rest
        if initial:
            asks |= rest
    return sorted(both | {"<" + k for k in asks} | {">" + k for k in answers}), sorted(both | {">" + k for k in asks} | {"<" + k for k in answers})


def links(readings: DataFrame, lore: Lore = LORE) -> DataFrame:
    """scope, kind, a, b, strength over the distinct readings (scope, kind, reading); of a pair, ``a`` says less."""
    shared = readings.sparkSession.sparkContext.broadcast(lore)
    spark_type = "scope string, kind string, reading string, token string"

    def index(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for s, k, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                for t in _tokens(k, r, shared.value):
                    for col, v in zip(out, (s, k, r, t)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["scope", "kind", "reading", "token"])

    by_token = cut(readings.mapInArrow(index, spark_type))
    block = ["scope", "kind"]
    tokens = by_token.groupBy(*block, "token").agg((F.count(F.lit(1)) > HOT_TOKEN).alias("hot"))

    def neighbourhood(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for s, k, t, h in zip(*(b.column(i).to_pylist() for i in range(4))):
                for v in {t} if t[0] == "#" else spellings(t):
                    for col, x in zip(out, (s, k, t, h, v)):
                        col.append(x)
            st = pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (st, st, st, pa.bool_(), st))], names=["scope", "kind", "token", "hot", "variant"])

    variants = cut(tokens.mapInArrow(neighbourhood, "scope string, kind string, token string, hot boolean, variant string"))
    other = variants.select(*block, F.col("token").alias("token2"), F.col("hot").alias("hot2"), "variant")
    met = variants.join(other, [*block, "variant"]).where("token <= token2").select(*block, "token", "token2", (F.col("hot") | F.col("hot2")).alias("hot")).distinct()
    left = by_token.select(*block, "token", F.col("reading").alias("a"))
    right = by_token.select(*block, F.col("token").alias("token2"), F.col("reading").alias("b"))
    cold = met.where(~F.col("hot")).join(left, [*block, "token"]).join(right, [*block, "token2"]).where("a <> b")

    def seconds(batches):
        for b in batches:
            s, k, r, t = (b.column(i).to_pylist() for i in range(4))
            keys = [_second(*z, shared.value) for z in zip(k, r, t)]
            lists = [pa.array([x[side] for x in keys], pa.list_(pa.string())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *lists], names=["scope", "kind", "reading", "token", "sa", "sb"])

    hot = met.where("hot")
    common = hot.select(*block, "token").union(hot.select(*block, "token2")).distinct()
    keyed = by_token.join(common, [*block, "token"], "left_semi").select(*block, "reading", "token").mapInArrow(seconds, spark_type + ", sa array<string>, sb array<string>")
    hot_left = keyed.select(*block, "token", F.col("reading").alias("a"), F.explode("sa").alias("second"))
    hot_right = keyed.select(*block, F.col("token").alias("token2"), F.col("reading").alias("b"), F.explode("sb").alias("second"))
    warm = hot.join(hot_left, [*block, "token"]).join(hot_right, [*block, "token2", "second"]).where("a <> b")
    pairs = cold.select(*block, "a", "b").unionByName(warm.select(*block, "a", "b")).select(*block, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(batches):
        for b in batches:
            s, k, x, y = (b.column(i).to_pylist() for i in range(4))
            found = [compare(*z, shared.value) for z in zip(k, x, y)]
            keep = [i for i, f in enumerate(found) if f]
            for i in keep:
                x[i], y[i] = less_first(x[i], y[i], found[i])
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.string()) for c in (s, k, x, y, found)], names=["scope", "kind", "a", "b", "strength"])

    return pairs.mapInArrow(verify, "scope string, kind string, a string, b string, strength string")


def components(edges: DataFrame) -> DataFrame:
    """x, root of every end of the edges (x, y): connected components named by their least number, grown until nothing changes."""
    both = cut(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:
        lower = both.join(state.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("low"))
        # also jump to the root of the root
        jump = state.select(F.col("x").alias("root"), F.col("root").alias("far"))
        new = cut(state.join(lower, "x").join(jump, "root", "left").select("x", F.least("root", "low", "far").alias("new"), "root"))
        changed = new.where("new <> root").limit(1).count()
        state = new.select("x", F.col("new").alias("root"))
        if not changed:
            return state


def settled(links_: DataFrame) -> DataFrame:
    """x, root of every reading that has links (less, more, strength; numbers): which entity it belongs to.

    Strong links make components.  Then, first for what leaves something out and after that for initials, an entity all of
    whose weak links point to one other entity joins it, round by round until no entity does.
    """
    alone = links_.select(F.col("less").alias("x")).unionByName(links_.select(F.col("more").alias("x"))).distinct()
    strong = components(links_.where(F.col("strength") == STRONG).select(F.col("less").alias("x"), F.col("more").alias("y")))
    state = cut(alone.join(strong, "x", "left").select("x", F.coalesce("root", "x").alias("root")))
    for strength in (LEFT_OUT, INITIAL):
        weak = links_.where(F.col("strength") == strength).select("less", "more")
        while True:
            from_ = state.select(F.col("x").alias("less"), F.col("root").alias("x"))
            to = state.select(F.col("x").alias("more"), F.col("root").alias("y"))
            ends = weak.join(from_, "less").join(to, "more").where("x <> y")
            # one target: the least and the greatest are the same
            one = cut(ends.groupBy("x").agg(F.min("y").alias("y"), F.max("y").alias("__m")).where("y = __m").select("x", "y"))
            if not one.limit(1).count():
                break
            moved = components(one).select(F.col("x").alias("root"), F.col("root").alias("new"))
            state = cut(state.join(moved, "root", "left").select("x", F.coalesce("new", "root").alias("root")))
    return state


def resolve(readings: list[str], links_: list[tuple[int, int, str]]) -> list[int]:
    """The same on lists, for a few readings: the entity (number of a reading) of every reading."""
    root = list(range(len(readings)))

    def join(pairs: list[tuple[int, int]]) -> None:
        while True:
            low = {}
            for a, b in pairs:
                a, b = root[a], root[b]
                if a != b:
                    low[max(a, b)] = min(low.get(max(a, b), b), a, b)
            if not low:
                return
            root[:] = [low.get(r, r) for r in root]

    join([(a, b) for a, b, s in links_ if s == STRONG])
    for strength in (LEFT_OUT, INITIAL):
        while True:
            targets: dict[int, set[int]] = {}
            for a, b, s in links_:
                if s == strength:
                    less, more = less_first(readings[a], readings[b], s)
                    x, y = root[readings.index(less)], root[readings.index(more)]
                    if x != y:
                        targets.setdefault(x, set()).add(y)
            one = [(x, *ys) for x, ys in targets.items() if len(ys) == 1]
            if not one:
                break
            join(one)
    return root


def _number() -> Column:
    return F.xxhash64("scope", "kind", "reading")


def entities(nodes: DataFrame, lore: Lore | None = None) -> DataFrame:
    """node_id, scope, kind, entity: every PERSON and ORG node and its entity, a number of one of its readings."""
    lore = lore or learn_lore(nodes)
    rows = cut(read_labels(nodes, lore).withColumn("x", _number()))
    found = links(rows.select("scope", "kind", "reading").distinct(), lore)
    ends = [F.xxhash64("scope", "kind", c).alias(c) for c in ("a", "b")]
    roots = settled(cut(found.select(*ends, "strength").withColumnsRenamed({"a": "less", "b": "more"})))
    return rows.join(roots, "x", "left").select("node_id", "scope", "kind", F.coalesce("root", "x").alias("entity"))


#: Parts that the pairs of a very large entity are made in.
PAIR_SALTS = 64


def same_entity_pairs(nodes: DataFrame, lore: Lore | None = None) -> DataFrame:
    """node_a, node_b: all pairs of nodes of one entity; those of a large one are made in ``PAIR_SALTS`` parts."""
    rows = cut(entities(nodes, lore).select("node_id", "entity"))
    many = hot_keys(rows, ["entity"])
    salt = F.lit(0) if many is None else F.when(F.col("__hot"), F.pmod(F.xxhash64("node_id"), F.lit(PAIR_SALTS))).otherwise(0)
    salts = F.array(F.lit(0)) if many is None else F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__hot", F.lit(False)) if many is None else rows.join(F.broadcast(many.withColumn("__hot", F.lit(True))), "entity", "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    a = rows.select(F.col("node_id").alias("node_a"), "entity", salt.cast("int").alias("__s"))
    b = rows.select(F.col("node_id").alias("node_b"), "entity", F.explode(salts).alias("__s"))
    return a.join(b, ["entity", "__s"]).where("node_a < node_b").select("node_a", "node_b").distinct()
