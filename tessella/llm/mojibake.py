"""Garbled text from wrong character encoding.

A multinomial classifier over hashed byte bigrams is trained on synthetically
garbled words - words of a bounded sample of sound documents put through every
encoding chain of ``CHAINS`` - and predicts, for each word that is not plain
ASCII, the exact chain it went through, or that it is sound.  A prediction
counts only if the chain can be inverted with strict decoding and the result
looks sounder than what is there.  Words are judged one by one, so documents
garbled only in part are found too; a word's verdict is kept and reused.

A document is a case when a garbled word stands in it as text.  Garbled words
that are quoted, or that stand in one line with their own sound form, are
examples; a document with nothing else is sound.  U+FFFD inside a word is
garbling that cannot be restored.

The sample (``SAMPLE_DOCS`` documents at most, the first by a hash of the key)
only trains the classifier; every document is judged, whole.  How common a word
is, which decides between two readings where strict decoding proves nothing, is
counted over all documents.

Defined cases: null, empty and plain ASCII texts are sound; scripts no chain
can produce are sound; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.durable import spread

SAMPLE_DOCS = 4000
#: A word is known from this share of the documents on (and from a few on).
KNOWN_SHARE, KNOWN_FLOOR = 1e-4, 3
#: Buckets of the bigram hash.
BUCKETS = 1 << 15
#: Least log odds of a chain against "sound" for a word to count as garbled.
LEAST_ODDS = 3.0
#: A chain between single-byte code pages inverts on any text, so strict decoding proves nothing: such words count only
#: if the odds of the document's different ones add up to this; the evidence a verdict needs, at every size of corpus.
LEAST_DOCUMENT_ODDS = 8.0

#: Western and Cyrillic code pages that UTF-8 or each other's bytes are misread as.
_UTF8_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "gbk", "cp1250", "cp1254", "koi8_r", "cp866")
_WESTERN = ("cp1252", "mac_roman", "cp850", "cp437")
_CYRILLIC = ("cp1251", "koi8_r", "cp866")

Chain = tuple[tuple[str, str], ...]
#: Every chain is a series of (encoded as, decoded as).
CHAINS: tuple[Chain, ...] = (
    *((("utf-8", w),) for w in _UTF8_AS),
    *((("utf-8", w), ("utf-8", w)) for w in ("cp1252", "latin-1")),
    *(((a, b),) for a in _WESTERN for b in _WESTERN if a != b),
    *(((a, b),) for a in _CYRILLIC for b in _CYRILLIC if a != b),
    *(((a, b),) for a in _CYRILLIC for b in ("cp1252", "latin-1")),
)

_SINGLE = ("cp1252", "cp1250", "cp1251", "cp1254")


def _table(codec: str) -> str:
    """A single-byte code page with its undefined bytes as the control characters of the same number, as browsers do."""
    return "".join(bytes([b]).decode(codec, "replace").replace("�", chr(b)) for b in range(256))


_TABLES = {c: _table(c) for c in _SINGLE}
_BACK = {c: {ch: b for b, ch in enumerate(t)} for c, t in _TABLES.items()}


def _decode(raw: bytes, codec: str) -> str:
    t = _TABLES.get(codec)
    return "".join(t[b] for b in raw) if t else raw.decode(codec, "replace")


def _encode(text: str, codec: str) -> bytes:
    back = _BACK.get(codec)
    if back is None:
        return text.encode(codec)
    try:
        return bytes([back[ch] for ch in text])
    except KeyError:
        raise UnicodeEncodeError(codec, text, 0, 1, "not in the code page") from None


def garble(text: str, chain: Chain) -> str | None:
    """The text after the chain; None where it has characters the chain's encoding lacks."""
    try:
        for right, wrong in chain:
            text = _decode(_encode(text, right), wrong)
    except UnicodeError:
        return None
    return text


def invert(text: str, chain: Chain) -> str | None:
    """What the text was before the chain; None unless every step decodes strictly."""
    try:
        for right, wrong in reversed(chain):
            raw = _encode(text, wrong)
            text = raw.decode("utf-8") if right == "utf-8" else _decode(raw, right)
    except UnicodeError:
        return None
    return text


_NON_ASCII_WORD = re.compile(r"[^ \t\n\r]*[^\x00-\x7f][^ \t\n\r]*")


def _bigrams(word: str) -> np.ndarray:
    raw = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    return ((raw[:-1] * 257 + raw[1:] * 40503) >> 1) % BUCKETS


_C1 = re.compile(r"[\x80-\x9f]")
_FFFD = "�"


def _suspect(word: str) -> bool:
    """Obvious garbling, kept out of the sound class: a UTF-8 chain inverts it."""
    if _FFFD in word or _C1.search(word):
        return True
    return any((u := invert(word, (("utf-8", w),))) is not None and u != word for w in _UTF8_AS)


_EDGE = "`\"'“”‘’«»()[]{}<>,.;:!?*_…"

_STOPS = ",.;:!?"


def _lettered(text: str) -> bool:
    return any(ch.isalpha() and not ch.isascii() for ch in text)


class Classifier:
    """Multinomial classifier: class 0 is sound, class k is CHAINS[k - 1]."""

    def __init__(self, words: dict[str, int], known: dict[str, int] | None = None, smoothing: float = 0.05):
        #: In how many documents of the whole corpus each common bare word stands.
        self.known: dict[str, int] = {}
        for w, k in (words if known is None else known).items():
            w = w.strip(_EDGE) or w
            self.known[w] = self.known.get(w, 0) + k
        n = len(CHAINS) + 1
        counts = np.full((n, BUCKETS), smoothing)
        seen = np.zeros(n)
        for w, k in words.items():
            np.add.at(counts[0], _bigrams(w), k)
            seen[0] += k
            for c, chain in enumerate(CHAINS, 1):
                g = garble(w, chain)
                if g is not None and g != w:
                    np.add.at(counts[c], _bigrams(g), k)
                    seen[c] += k
        # all classes over the total of the sound one: a chain that touches one language only gets that language's share
        self.log = np.log(counts / counts[0].sum()).astype(np.float32)
        self.log[seen == 0] = -50.0

    def commoner(self, word: str, other: str) -> bool:
        """Whether the corpus has ``word`` more often than ``other``."""
        return self.known.get(word.strip(_EDGE) or word, 0) > self.known.get(other.strip(_EDGE) or other, 0)

    def scores(self, word: str) -> np.ndarray:
        return self.log[:, _bigrams(word)].sum(1)

    def soundness(self, word: str) -> float:
        return float(self.log[0, _bigrams(word)].mean())


@dataclass
class Verdict:
    chain: int = 0  # number in CHAINS from 1; 0: sound; -1: garbled for good
    restored: str | None = None
    odds: float = 0.0


class Judge:
    def __init__(self, model: Classifier):
        self.model = model
        self.memo: dict[str, Verdict] = {}

    def word(self, word: str) -> Verdict:
        v = self.memo.get(word)
        if v is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            v = self.memo[word] = self._word(word)
        return v

    def _word(self, word: str) -> Verdict:
        if _FFFD in word:
            whole = any(ch.isalnum() for ch in word)
            return Verdict(-1 if whole else 0, None, LEAST_ODDS)
        # very long runs are judged by their first characters' bigrams like any other; inversion takes them whole
        s = self.model.scores(word)
        likely = [int(c) for c in np.argsort(-s) if c and s[c] - s[0] >= LEAST_ODDS]
        # strict decoding of UTF-8 proves more than odds do
        for c in sorted(likely, key=lambda c: CHAINS[c - 1][0][0] != "utf-8"):
            odds = float(s[c] - s[0])
            chain = CHAINS[c - 1]
            back = invert(word, chain)
            if back is None and word[-1:] == "Ã":
                # the no-break space that ended it became a space
                back = invert(word + "\xa0", chain)
            if back is None or back == word or _C1.search(back):
                continue
            if chain[0][0] != "utf-8" and (self.model.commoner(word, back) or not _lettered(word) or not _lettered(back)):
                continue
            if self.model.soundness(back) > self.model.soundness(word) + 0.5:
                return Verdict(c, back, odds)
            if chain[0][0] == "utf-8":
                # bytes that are UTF-8 are no single-byte text
                break
        if _C1.search(word) and not word.isspace():
            return Verdict(-1, None, LEAST_ODDS)
        return Verdict()

    def document(self, text: str | None) -> tuple[list[tuple[int, int, Verdict]], bool]:
        """The garbled words with their places, and whether the document is a case."""
        if not text or text.isascii():
            return [], False
        found = []
        for m in _NON_ASCII_WORD.finditer(text):
            v = self.word(m[0])
            if v.chain:
                found.append((m.start(), m.end(), v))
        weak: dict[str, float] = {text[lo:hi]: v.odds for lo, hi, v in found if v.chain > 0 and CHAINS[v.chain - 1][0][0] != "utf-8"}
        if weak and sum(weak.values()) < LEAST_DOCUMENT_ODDS:
            found = [x for x in found if text[x[0] : x[1]] not in weak]
        if not found:
            return [], False
        found = self._one_chain(text, found)
        as_text = [x for x in found if not self._example(text, *x)]
        return found, bool(as_text)

    def _one_chain(self, text: str, found: list[tuple[int, int, Verdict]]) -> list[tuple[int, int, Verdict]]:
        """A document mostly went through one single-byte chain: its other words are inverted by that one too, if they can be."""
        odds: dict[int, float] = {}
        for *_, v in found:
            if v.chain > 0 and CHAINS[v.chain - 1][0][0] != "utf-8":
                odds[v.chain] = odds.get(v.chain, 0.0) + v.odds
        if len(odds) < 2:
            return found
        best = max(sorted(odds), key=odds.get)
        out = []
        for lo, hi, v in found:
            if v.chain in odds and v.chain != best:
                back = invert(text[lo:hi], CHAINS[best - 1])
                if back is not None and _lettered(back):
                    v = Verdict(best, back, v.odds)
            out.append((lo, hi, v))
        return out

    def _example(self, text: str, lo: int, hi: int, v: Verdict) -> bool:
        """Quoted, or in one line with its own sound form."""
        start, end = text.rfind("\n", 0, lo) + 1, text.find("\n", hi)
        line = text[start : end if end >= 0 else len(text)]
        lo, hi = lo - start, hi - start
        for m in _QUOTED.finditer(line):
            if m.start() <= lo + 1 and hi - 1 <= m.end() + 2 and m.end() > lo:
                return True
        if v.restored:
            bare = v.restored.strip(_EDGE) or v.restored.strip(_STOPS)
            others = (line[:lo] + " " + line[hi:]).split()
            return any((o.strip(_EDGE) or o.strip(_STOPS)) == bare for o in others)
        return False


_QUOTED = re.compile(r"`[^`\n]{1,80}`|(?<!\w)\"[^\"\n]{1,80}\"|(?<!\w)'[^'\n]{1,80}'(?!\w)|“[^”\n]{1,80}”|«[^»\n]{1,80}»")


def common_words(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many documents each word that is not plain ASCII stands, of all documents, from ``KNOWN_SHARE`` of them on.

    Counted before the shuffle; at most (words a document) / share words come to the driver.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7f]"))
    least = max(KNOWN_FLOOR, int(rows.count() * KNOWN_SHARE))
    words = F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"([^ \t\n\r]*[^\x00-\x7f][^ \t\n\r]*)"), F.lit(1)))).alias("w")
    edge = "[" + "".join("\\" + ch for ch in _EDGE) + "]+"
    bare = rows.select(words).select(F.regexp_replace("w", f"^{edge}|{edge}$", "").alias("w")).where((F.col("w") != "") & (F.length("w") < 64))
    return {r["w"]: r["n"] for r in bare.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """The classifier from at most ``sample_docs`` documents, the first by a hash of the key; word counts are those of all documents."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7f]"))
    picked = rows.select(text_col, F.xxhash64(id_col).alias("__h")).orderBy("__h", text_col).limit(sample_docs).collect()
    words: dict[str, int] = {}
    for text, _ in picked:
        for w in _NON_ASCII_WORD.findall(text):
            words[w] = words.get(w, 0) + 1
    known = common_words(docs, text_col)
    sound = Classifier({}, known)

    def doubtful(w: str) -> bool:
        # a single-byte chain makes a commoner word of it; short words are words in several alphabets
        long = sum(ch.isalpha() for ch in w) >= 4
        return _suspect(w) or long and any((u := invert(w, c)) is not None and u != w and _lettered(u) and sound.commoner(u, w) for c in CHAINS if c[0][0] != "utf-8")

    return Classifier({w: k for w, k in words.items() if len(w) < 200 and not doubtful(w)}, known)


_JUDGED = "doc_id bigint, is_case boolean, n_garbled int, chain string, restored string"


def judge(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, is_case, n_garbled, chain, restored of every document with a garbled word.

    ``restored`` has each garbled word put right as far as it can be; ``chain`` is the chain most of them went through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches):
        j = Judge(shared.value)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, case = j.document(text)
                if not found:
                    continue
                parts, at, chains = [], 0, {}
                for lo, hi, v in found:
                    if v.restored is not None:
                        parts += [text[at:lo], v.restored]
                        at = hi
                    chains[v.chain] = chains.get(v.chain, 0) + 1
                best = max(sorted(chains), key=lambda c: chains[c])
                name = " + ".join(f"{r} as {w}" for r, w in CHAINS[best - 1]) if best > 0 else "lost"
                for col, value in zip(out, (key, case, len(found), name, "".join(parts) + text[at:])):
                    col.append(value)
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "is_case", "n_garbled", "chain", "restored"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, _JUDGED)


def garbled(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that are cases."""
    return judge(docs).where("is_case").select("doc_id")


def restored(docs: DataFrame) -> DataFrame:
    """doc_id, chain, n_garbled, restored of the cases."""
    return judge(docs).where("is_case").select("doc_id", "chain", "n_garbled", "restored")
