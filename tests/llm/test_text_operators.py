"""Copies, conversations, encoding, leaks and garbled text: against plain versions, round trips and held-out accuracy."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import conversations, copies, leaks, mojibake, tokenizing

NULLS = [None, "", " ", "\n", "–", "x" * 50_000]


# ---- copies (5)


def mem(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "id string, scope string, category string, content string, group_id int, text_id string")


def test_copies(spark):
    rows = [
        ("a", "s", "fact", "Owns 21 kilns, and one loom."), ("b", "s", "FACT.", "owns 21   kilns and\none loom"), ("c", "t", "fact", "owns 21 kilns and one loom"), ("d", "s", "fact", "owns 22 kilns and one loom"),
        ("e", "s", None, "City: Port; day=Monday"), ("f", "s", "", "DAY : monday | city: PORT;"), ("g", "s", " ", "city port, day monday"), ("h", "s", "", "day: Port; city: Monday"),
        ("i", "s", "fact", None), ("j", "s", "fact", "--"), ("k", "s", "fact", "--"), ("l", None, "x", "Café"), ("m", None, "x", "Café"), ("n", None, "x", "Cafe"),
    ]
    got = {(r.first_id, r.copy_id) for r in copies.copy_pairs(mem(spark, rows)).collect()}
    assert got == {("a", "b"), ("e", "f"), ("e", "g"), ("l", "m")}
    n = {r.first_id: r.n_copies for r in copies.collapse(mem(spark, rows)).collect()}
    assert n["a"] == 2 and n["e"] == 3 and "i" not in n and "j" not in n


def test_equal_letters_and_equal_fields_tie_in_turn(spark):
    rows = [
        ("a", "s", "c", "nome: Ana; cidade: Xis"), ("b", "s", "c", "no: meAna; cidade: Xis"), ("c", "s", "c", "cidade=Xis | NO=meana"), ("d", "s", "c", "nome Ana cidade Xis"),
        ("e", "t", "c", "cidade: Xis; no: meAna"), ("f", "t", "c", "nome: Ana; cidade: Xis"), ("g", "s", "d", "nome: Ana; cidade: Xis"), ("h", "s", "c", "nome: Ana; cidade: Xi"),
    ]
    got = {(r.first_id, r.copy_id) for r in copies.copy_pairs(mem(spark, rows)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d")}


def test_every_value_is_canonicalised_once(spark):
    rows = [(f"{k}", "s", "fact" if k % 2 else "FACT", f"Text {k % 3}!") for k in range(30)]
    df = copies.encode(mem(spark, rows))
    assert {f.dataType.simpleString() for f in df.schema if f.name not in ("id", "scope")} == {"bigint", "array<bigint>"}
    assert df.select("text_id").distinct().count() == 3 and df.select("cat_id").distinct().count() == 1


def test_copies_of_odd_and_no_rows(spark):
    rows = [(f"i{k}", None, None, t) for k, t in enumerate(NULLS * 2)]
    assert {(r.first_id, r.copy_id) for r in copies.copy_pairs(mem(spark, rows)).collect()} == {("i11", "i5")}
    assert copies.copy_pairs(mem(spark, rows).limit(0)).collect() == []


def test_hot_group_of_copies(spark, monkeypatch):
    from tessella.plans import skew

    rows = [(f"{k:03d}", "s", "c", "same text" if k % 3 == 0 else f"text {k // 2}") for k in range(120)]
    plain = sorted(map(tuple, copies.copy_pairs(mem(spark, rows)).collect()))
    monkeypatch.setattr(copies, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, floor=20))
    assert sorted(map(tuple, copies.copy_pairs(mem(spark, rows)).collect())) == plain and len(plain) > 39


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_canonical_disregards_dress(s):
    assert copies.canonical(f" –{s}!\n") == copies.canonical(s)
    assert copies.canonical(unicodedata.normalize("NFD", s)) == copies.canonical(unicodedata.normalize("NFC", s))


# ---- conversations (7)

U = "a1b2c3d4-0000-4000-8000-00000000000"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "scope string, session_id string, turn_n int, user_input string, response string, kept string")


def test_conversations(spark):
    rows = [
        ("s", U + "1", 0, "hi", "yes"), ("s", (U + "1").upper(), 1, "and", "no"), ("s", (U + "1").replace("-", ""), 1, "and", "no"),  # whole, one row twice
        ("s", U + "2", 0, "hi", "yes"), ("s", U + "2", 2, "hi", "yes"),  # a gap
        ("s", U + "3", 0, "hi", "[no response]"), ("s", U + "4", 1, "hi", "yes"), ("s", U + "5", 0, "hi", "yes"), ("s", U + "5", 0, "hi", "no"),  # ambiguous
        ("s", U + "6", None, "hi", "yes"), ("s", U + "7", 0, "...", "yes"), ("s", "#x?", 0, None, "yes"), ("s", None, 0, "hi", None), ("s", " ", 0, "hi", None), ("t", U + "2", 0, "hi", "yes"), ("s", U + "8", 0, "null", "N/A"), (None, U + "9", 0, "ok", "ok"),
    ]
    t = turns(spark, rows)
    got = {(r.scope, r.session_id) for r in conversations.dropped(t).collect()}
    assert got == {("s", U + str(k)) for k in (2, 3, 4, 5, 6, 7, 8)} | {("s", "#x?")}
    m = sorted((r.place, r.role, r.text) for r in conversations.messages(t).where(f"scope = 's' AND session_id = '{U}1'").collect())
    assert m == [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "and"), (3, "assistant", "no")]
    assert conversations.messages(t).where("scope IS NULL").count() == 2
    assert conversations.dropped(t.limit(0)).collect() == []


def fragments(spark, rows):
    return spark.createDataFrame([(c, 0, f, h, "k") for c, f, h in rows], "c1 bigint, c2 bigint, fragment bigint, hashes array<bigint>, head string")


def test_fragments_without_numbers_are_assembled(spark):
    rows = [
        (1, 10, [1, 2, 3]), (1, 11, [3, 4, 5, 6]), (1, 12, [5, 6, 7]), (1, 13, [4, 5]), (1, 14, [1, 2, 3]),  # one inside another, one twice
        (2, 20, [1, 2]), (2, 21, [3, 4]),  # a gap
        (3, 30, [1, 2]), (3, 31, [2, 3]), (3, 32, [2, 4]),  # two followers
        (4, 40, [1, 2]), (4, 41, [2, 1]),  # a circle
        (5, 50, [9]), (6, 60, []), (6, 61, None), (7, 70, [1, 2, 1, 2]), (7, 71, [1, 2, 5]),  # the longest overlap
    ]
    df = fragments(spark, rows)
    assert {(r.left, r.right, r.n) for r in conversations.overlaps(df.where("c1 = 7")).collect()} == {(70, 71, 2)}
    got = {}
    for r in conversations.assemble(df).orderBy("c1", "place", "at").collect():
        got.setdefault(r.c1, []).append(r.hash)
    assert got == {1: [1, 2, 3, 4, 5, 6, 7], 5: [9], 7: [1, 2, 1, 2, 5]}
    assert conversations.assemble(df.limit(0)).collect() == []


def test_long_paths_take_few_rounds(spark):
    n = 200
    order = random.Random(3).sample(range(1000), n + 1)
    df = fragments(spark, [(1, k, [order[k], order[k + 1]]) for k in range(n)])
    got = [r.hash for r in conversations.assemble(df, 1).orderBy("place", "at").collect()]
    assert got == order


def test_numbered_rows_agree_with_assembled_fragments(spark):
    rng = random.Random(5)
    rows = [("s", U + str(c), rng.choice([0, 1, 2, 3, 3, None] if rng.random() < 0.1 else [0, 1, 2, 3]), rng.choice(["a", "a", "b"]), "r") for c in range(9) for _ in range(rng.randrange(1, 9))]
    t = turns(spark, rows)
    marked = conversations.exchanges(t).where("place is not null")
    whole = {(r.c1, r.c2) for r in conversations.assemble(marked.select("c1", "c2", "fragment", "hashes"), 1).select("c1", "c2").distinct().collect()}
    first = {(r.c1, r.c2) for r in marked.where("place = 0").collect()} - {(r.c1, r.c2) for r in conversations.exchanges(t).where("place is null").collect()}
    assert {(r.c1, r.c2) for r in conversations.assembled(t).where("kept").collect()} == whole & first


# ---- encoding (8)


def test_encoding_matches_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ph = tokenizing.perfect_hash(tokenizing.DEFAULT_VOCABULARY)
    ranks = tokenizing.read_vocabulary(tokenizing.DEFAULT_VOCABULARY)
    assert ph.n == len(ranks) and all(ph.get(k) == v for k, v in ranks.items()) and ph.get(b"zzqqxxyy") == -1
    enc = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    own, rng = tokenizing.Encoder(ph), random.Random(5)
    for _ in range(3000):
        s = "".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(1, 0x500), rng.randrange(0xE000, 0x1FFFF), 32, 10, 0x1C, 0x85])) for _ in range(rng.randrange(1, 40)))
        assert own.encode(s) == enc.encode_ordinary(s)
    for s in ("a" * 20_000, "<|endoftext|>", "don't  stop \n\n now", ""):
        assert own.encode(s) == enc.encode_ordinary(s)


def test_encoding_of_all_rows(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(NULLS)] + [(0, None, "x")], "doc_id bigint, text string, ids string")
    rows = tokenizing.encode_corpus(df).collect()
    assert len(rows) == len(NULLS) + 1 and [r.ids for r in rows if r.doc_id == 0] == [[], []]
    assert tokenizing.encode_corpus(df.limit(0)).collect() == []


# ---- leaks (9)


def test_leaks_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = ["été", "der", "Größe", "a1", "x", "mossdb", "The", "naïve", "и", "ы"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(8)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for k in range(60):
        ws = [rng.choice(vocabulary) for _ in range(20)]
        if k % 3 == 0:
            src = rng.choice(items[:8])[1].split()
            n, at = rng.choice([12, 13, 20]), rng.randrange(0, 10)
            ws[5:5] = [w.upper() + rng.choice([",", "\n>", " –", ""]) for w in src[at : at + n]]
        docs.append((k, " ".join(ws)))
    docs += [(70 + k, t) for k, t in enumerate(NULLS)] + [docs[0]]
    want = set()
    for d, t in docs:
        w = leaks.words(t or "")
        for i, u in items:
            v = leaks.words(u or "")
            grams = {tuple(v[j : j + 13]) for j in range(len(v) - 12)}
            if any(tuple(w[j : j + 13]) in grams for j in range(len(w) - 12)):
                want.add((d, i))
    D = spark.createDataFrame([(*r, "z") for r in docs], "doc_id bigint, text string, item_id string")
    I = spark.createDataFrame([(*r, "z") for r in items], "item_id bigint, text string, doc_id string")  # noqa: E741
    assert len(want) > 5
    for size in (leaks.BLOCK_CHARS, 300):
        assert {tuple(r) for r in leaks.leaked(D, I, block_chars=size).distinct().collect()} == want
    cleaned = sorted(map(str, leaks.without_spans(D, I).collect()))
    assert sorted(map(str, leaks.without_spans(D, I, block_chars=300).collect())) == cleaned
    clean = leaks.without_spans(D, I)
    assert {r.doc_id for r in clean.where("n_removed > 0").collect()} == {d for d, _ in want}
    assert leaks.leaked(clean.select("doc_id", "text"), I).collect() == []
    assert leaks.leaked(D.limit(0), I).collect() == []


# ---- garbled text (10)

SOUND = [
    "Não há informação sobre a peça elétrica", "O botão está à esquerda, é só apertar", "Der Schlüssel öffnet die große Tür für März", "El año pasado mañana señor pingüino acción", "L’été dernier, le côté gauche du bâtiment était fermé",
    "Скрытый журнал снова теряет простой разбор", "Ночной сервер долго ждёт новый отчёт", "It’s a “known” quirk – naïve résumé costs €40",
]


@pytest.fixture(scope="module")
def judge():
    words = {}
    for t in SOUND * 40:
        for w in mojibake._NON_ASCII_WORD.findall(t):
            words[w] = words.get(w, 0) + 1
    return mojibake.Judge(mojibake.Classifier(words))


@pytest.mark.parametrize("chain", [c for c in mojibake.CHAINS if c[0][0] == "utf-8" and c[0][1] != "gbk"])
def test_chains_are_found_and_inverted(judge, chain):
    right = total = 0
    for t in SOUND:
        g = mojibake.garble(t, chain)
        if g is None or g == t:
            continue
        found, case = judge.document(g)
        assert case
        total += 1
        parts, at = [], 0
        for lo, hi, v in found:
            if v.restored is not None:
                parts += [g[at:lo], v.restored]
                at = hi
        right += "".join(parts) + g[at:] == t
    assert total and right >= 0.6 * total


def test_sound_texts_and_examples(judge):
    for t in [*SOUND, "", None, "plain", "½ × ¾ ≠ ∞ ²³", "NÃO APAGUE", "進捗はどうですか？", 'Search for "pequeÃ±o" to find rows', "Why does it show `maÃ§Ã£` where maçã was typed?", "The log has a U+FFFD sign (�) in it"]:
        assert not judge.document(t)[1], t
    assert judge.document("J� tentou reiniciar?")[1]
    assert judge.document("Está tudo bem, mas a informaÃ§Ã£o nÃ£o veio")[1]


def test_many_quoted_examples_are_no_case(judge):
    quoted = 'Words like "pequeÃ±o", "maÃ§Ã£", "nÃ£o", "estÃ¡" and "Ã©" stand in the log'
    found, case = judge.document(quoted)
    assert len(found) >= 4 and not case
    assert judge.document(quoted + " e nÃ£o sei porquÃª")[1]


def test_counts_of_words_cover_all_documents(spark):
    df = spark.createDataFrame([(k, "é «à» café", "c") for k in range(5)] + [(9, "só", "c"), (10, None, "c"), (11, "plain", "c")], "doc_id bigint, text string, chain string")
    assert mojibake.common_words(df) == {"é": 5, "à": 5, "café": 5}


def test_garbled_dataflow(spark):
    g = [mojibake.garble(t, (("utf-8", "cp1252"),)) for t in SOUND]
    rows = [(k, t, "c") for k, t in enumerate(SOUND * 30)] + [(1000 + k, t, "c") for k, t in enumerate(g)] + [(2000 + k, t, "c") for k, t in enumerate(NULLS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chain string")
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == set(range(1000, 1000 + len(g)))
    back = {r.doc_id: r.restored for r in mojibake.restored(df).collect()}
    assert sum(back[1000 + k] == t for k, t in enumerate(SOUND)) >= 6
    assert mojibake.garbled(df.limit(0)).collect() == []


