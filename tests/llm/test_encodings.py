import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import encodings

WORDS = {
    "de": "für die größere Prüfung läuft über Sätze schließt Gebühr Änderung übersicht höchstens".split(),
    "fr": "créance supprimée vérifie à côté dès procédure Ça étape requête générale où façade".split(),
    "ru": "после шага строка обновляет журнал каждая проверка отклоняет ночная выгрузка".split(),
    "pl": "ponieważ własna wartość zawiera błąd ścieżka różnica następna główna łączy".split(),
}
PLAIN = "the ledger closes at step program reads every batch once".split()


def sentence(rng, lang):
    return " ".join(rng.choice(WORDS[lang] if rng.random() < 0.6 else PLAIN) for _ in range(12)) + "."


def corpus(seed=5, n=1200):
    rng = random.Random(seed)
    rows, bad = [], {}
    chains = [("cp1252", "utf_8", None), ("latin_1", "utf_8", None), ("cp437", "utf_8", None), ("mac_roman", "utf_8", None), ("cp1252", "cp850", "de"), ("cp1251", "koi8_r", "ru"), ("cp1252", "cp1250", "pl")]
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        good = " ".join(sentence(rng, lang) for _ in range(3))
        text = good + rng.choice(["", " Os campos «IRMÃ» e “MAÇÃ” ficam.", " Die Kürzel ‚Ñ‘ und »Â« stehen.", " 5 µs, ±3 °C", " ├── src └── x"])
        if rng.random() < 0.08:
            read, written, only = rng.choice(chains)
            if only in (None, lang):
                part = sentence(rng, lang) + " " + rng.choice(WORDS[lang])
                try:
                    wrong = part.encode(written).decode(read)
                except UnicodeError:
                    wrong = part
                if wrong != part:
                    bad[i] = part + " " + text
                    text = wrong + " " + text
        rows.append((i, text, rng.choice(["a", "A ", "b_c", "b-c", None]), 1))
    rows += [(n, None, "a", 1), (n + 1, "", "a", 1), (n + 2, "   ", None, 1), (n + 3, "plain ascii", "a", 1), (n + 4, "lost s�gn", "a", 1)]
    return rows, bad


def test_garbled_and_restored(spark):
    rows, bad = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, posterior int")
    found = {r.doc_id for r in encodings.garbled(df).collect()}
    assert len(bad) > 25
    want = set(bad) | {1204}
    assert len(found & want) / len(want) > 0.95 and len(found & want) / len(found) > 0.97
    fixed = {r.doc_id: r for r in encodings.repaired(df).collect()}
    assert fixed.keys() == found and not fixed[1204].whole
    assert sum(fixed[i].restored == t for i, t in bad.items() if i in fixed) / len(bad) > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert encodings.garbled(df).count() == 0 and encodings.repaired(df).count() == 0


def test_undo_is_the_inverse_of_wrong_reading():
    for lang, words in WORDS.items():
        text = " ".join(words)
        for read, written, times in encodings.CHAINS:
            if times == 2 or read in ("western", "cp932", "gbk") or written in ("western", "cp932", "euc_jp"):
                continue
            for w in words:
                try:
                    wrong = w.encode(written).decode(read)
                except UnicodeError:
                    continue
                if written == "utf_8":
                    assert encodings.undo(wrong, (read, written, 1)) == w, (text, read, written)
    assert encodings.undo("Ã¢â‚¬â€œ", ("western", "utf_8", 2)) == "–" and encodings.undo("â\x80\x93", ("western", "utf_8", 1)) == "–"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30), st.binary(max_size=40))
def test_candidates_never_fail(text, raw):
    for t in (text, raw.decode("cp437"), raw.decode("latin_1"), raw.decode("mac_roman")):
        for _, new in encodings.candidates(t):
            new.encode()


def test_a_garbled_sentence_in_a_long_correct_text(spark):
    rng = random.Random(11)
    rows, _ = corpus()
    long = {}
    for k, (lang, read, written) in enumerate([("de", "cp1252", "mac_roman"), ("fr", "cp1252", "cp437"), ("ru", "cp1251", "koi8_r")] * 4):
        part = " ".join(rng.choice([w for w in WORDS[lang] if not w.isascii()]) for _ in range(12))
        wrong = part.encode(written, "ignore").decode(read, "ignore")
        clean = [" ".join(rng.choice(WORDS[lang]) for _ in range(60)) for _ in range(8)]
        long[5000 + k] = " ".join([*clean[:4], part, *clean[4:]])
        rows.append((5000 + k, " ".join([*clean[:4], wrong, *clean[4:]]), "a", 1))
        rows.append((6000 + k, " ".join([*clean, part]), "a", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, posterior int")
    found = {r.doc_id for r in encodings.garbled(df).collect()}
    assert long.keys() <= found and not {i for i in found if i >= 6000}
