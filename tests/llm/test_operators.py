"""The corpus operators against brute force, on odd inputs, and the pipeline."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sheafline.llm import bpe, columns, components, decontam, langmix, linedrop, nearcopies, pii, queries, repetition, simhash, suffixdedup, warc, weaklabel
from sheafline.session import fresh_path

DOCS = "doc_id long, text string"
DATA = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"


def docs_of(spark, texts, first=1):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], DOCS)


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 977}" for k in range(20_000))
    rows = [(1, "Hello world this is a text.\nA second line of this text here."), (1, "Hello world this is a text.\nA second line of this text here."), (2, None), (3, ""), (4, "   \n\t\n"), (None, "Hello world this is a text.\nA second line of this text here."), (5, long), (6, "x" * 50_000), (7, "1234 5678 !!! ???"), (8, "é" * 60), (9, long)]
    return [(i, t, None if k % 3 else "en", "src", None, "chunk", k) for k, (i, t) in enumerate(rows)]


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key int"
SCHEMAS = {"embeddings": "vec_id long, embedding array<float>, label int", "items": "item_id long, price double", "sale_lines": "sale_id long, line_no int, item_id long, quantity int, amount double"}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with odd rows and columns that clash with internal names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "u", "<p>"), (2, None, None), (3, "u\r\nx%", ""), (None, "v", "<p>"), (2, None, None), (4, "w", "<p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 0), (None, None, None), (1, [1.0, 0.0], 0)], SCHEMAS["embeddings"]).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, 2.0), (None, None)], SCHEMAS["items"]).write.parquet(f"{folder}/items.parquet")
    spark.createDataFrame([(1, None, 2, 1, 2.0), (None,) * 5], SCHEMAS["sale_lines"]).write.parquet(f"{folder}/sale_lines.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": ODD_SCHEMA, "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", **SCHEMAS}.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_odd_rows(spark, odd_dir, name):
    found = entry.queries()[name](spark, odd_dir).collect()
    if name.startswith(("op1_", "op12_")):  # no leak; one source a language, and no term in thirty documents
        assert found == []
    elif name == "pipeline":
        assert {r["doc_id"] for r in found} >= {1, 5, 8} and 2 not in {r["doc_id"] for r in found}
    else:
        want = {"op10": 6, "op11": 3, "op13": 2}.get(name.split("_")[0])
        assert len(found) == (want or len(odd_rows()))


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    assert entry.queries()[name](spark, empty_dir).collect() == []


# --- 1


def test_reparameterised_question_is_found(spark):
    item = "Alice has 12 apples and gives 5 kg of them to Bob Jones. How many of the 12 apples does Alice keep at home?"
    texts = [
        "Once. Carol has 31 apples and gives 9 lb of them to Tom. How many of the 31 apples does Carol keep at home? yes",
        "nothing of the kind is in this text about apples and pears",
        item.upper(),
        "so it was. " + item + " And on",
    ]
    found = {r["doc_id"]: r for r in decontam.find_leaks(docs_of(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(found) == {1, 3, 4}
    assert found[1]["kind"] == "reparameterised" and "12=31" in found[1]["slots"]
    assert found[4]["kind"] == "literal" and found[4]["coverage"] == 1.0
    assert texts[3].encode()[found[4]["start_byte"] : found[4]["end_byte"]].decode() == item[:-1]


@pytest.mark.parametrize(
    "item",
    [
        "Wie groß ist der Fluß, der jährlich Öl und Güter über die Straße führt, und für wen fährt er?",
        "El niño añadió cuántos años había soñado; ¿dónde están los demás niños españoles, según él?",
        "Сколько яблок осталось у девочки, если мальчик съел половину и ушёл домой до ужина?",
        "Việt ạnh ẩn ệch ộng ừng ằng ẵng ỵnh ởng ẻng ặng",
    ],
)
def test_capitals_and_quotes_of_any_script(spark, item):
    texts = [item.upper(), "« " + item.replace(" ", "\u00a0") + " »", " ".join(f"“{w}”" for w in item.split()), "!! ".join(item.upper().split()), "nothing of it is in this text"]
    found = decontam.find_leaks(docs_of(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, 4}


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    items = [" ".join(rng.choices(words, k=rng.randint(12, 30))) for _ in range(12)]
    texts, want = [], set()
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 80))
        if d % 3 == 0:
            k = rng.randrange(len(items))
            at = rng.randint(0, len(text))
            text[at:at] = items[k].split()
            want.add((d + 1, k))
        texts.append(" ".join(text))
    grams = [{tuple(i.split()[a : a + 5]) for a in range(len(i.split()) - 4)} for i in items]
    for d, t in enumerate(texts):
        own = {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)}
        for k, g in enumerate(grams):
            assert (len(own & g) / len(g) >= 0.4) == ((d + 1, k) in want)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for own in ({}, {"block_items": 3}, {"block_bytes": 200}, {"block_items": 2, "keep_bytes": 300, "window_bytes": 1}, {"block_items": 1, "keep_bytes": 0}):
        got = decontam.find_leaks(docs_of(spark, texts), bench, decontam.LeakSettings(**own))
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted(want)
        left = decontam.drop_leaked(docs_of(spark, texts), bench, decontam.LeakSettings(**own))
        assert {r["doc_id"] for r in left.collect()} == set(range(1, 61)) - {d for d, _ in want}


UNITS = {"kg", "lb", "hours"}


def slow_template(text):
    """Template tokens and slot values of a plain ASCII text, by rules on words."""
    out, opens, after_number = [], True, False
    for m in re.finditer(r"[A-Za-z]+|[0-9]+|[.?]", text):
        w = m[0]
        if w in ".?":
            opens = True
            continue
        if w[0].isdigit():
            out.append(("#", w))
        elif after_number and w.lower() in UNITS:
            out.append(("unit", w.lower()))
        elif w[0].isupper() and not opens:
            out.append(("name", w.lower()))
        else:
            out.append((w.lower(), None))
        after_number, opens = w[0].isdigit(), False
    return out


def slow_reparameterised(text, item):
    """Is a copy of the item's template in the text, at one place, with slots that map one to one."""
    a, b = slow_template(text), slow_template(item)
    windows = [i for i in range(len(b) - 4)]
    for shift in range(-len(b), len(a)):
        hit = [i for i in windows if 0 <= i + shift and i + shift + 5 <= len(a) and [x for x, _ in a[i + shift : i + shift + 5]] == [x for x, _ in b[i : i + 5]]]
        hit = [i for i in hit if sum(v is None for _, v in b[i : i + 5]) >= 3]
        pairs = {(b[k][1], a[k + shift][1]) for i in hit for k in range(i, i + 5) if b[k][1] is not None}
        one_to_one = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
        if one_to_one and len(hit) >= 0.4 * len(windows):
            return True
    return False


def test_templates_against_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    names = [f"N{chr(97 + k)}{chr(97 + j)}o" for k in range(20) for j in range(10)]

    def sentence():
        out = [rng.choice(words).capitalize()]
        for _ in range(rng.randint(14, 26)):
            kind = rng.random()
            if kind < 0.12 and not out[-1][0].isdigit():
                out.append(str(rng.randint(10, 99)))
            elif kind < 0.2 and out[-1][0].islower():
                out.append(rng.choice(names))
            else:
                out.append(rng.choice(words))
        return out

    def moved(item, how):
        """The item with other values: one to one, all made equal, or drawn anew at each place."""
        seen, out = {}, []
        for k, w in enumerate(item):
            slot = w[0].isdigit() or (k > 0 and w[0].isupper())
            if slot and how == "map":
                fresh = (lambda: str(rng.randint(1000, 9999))) if w[0].isdigit() else (lambda: rng.choice(names))
                while w not in seen or list(seen.values()).count(seen[w]) > 1:
                    seen[w] = fresh()
                w = seen[w]
            elif slot and how == "equal":
                w = "5555" if w[0].isdigit() else names[0]
            out.append(w)
        return out

    items = [sentence() for _ in range(25)]
    texts, kinds = [], []
    for d in range(90):
        item = items[d % len(items)]
        kind = ("map", "equal", "none")[d % 3]
        own = moved(item, kind) if kind != "none" else []
        texts.append(". ".join(" ".join(x) for x in (sentence(), own, sentence()) if x) + ".")
        kinds.append(kind)
    bench = [" ".join(x) + "." for x in items]
    want = {(d + 1, k) for d, t in enumerate(texts) for k, i in enumerate(bench) if slow_reparameterised(t, i)}
    got = decontam.find_leaks(docs_of(spark, texts), spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()
    # Where all values are made equal the pieces that agree may still be a run of 13 tokens or 80 % of the windows.
    sure = {d + 1 for d, kind in enumerate(kinds) if kind != "equal"}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] in sure} == {x for x in want if x[0] in sure}
    assert {(d + 1, d % len(items)) for d, kind in enumerate(kinds) if kind == "map"} <= want


def test_two_values_are_not_one(spark):
    items = [(1, "There are 9 red marbles and then 3 blue marbles in the large green box")]
    texts = ["There are 8 red marbles and then 8 blue marbles in the large green box", "There are 7 red marbles and then 4 blue marbles in the large green box"]
    got = decontam.find_leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["coverage"] < 1 for r in got} in ({1: True, 2: False}, {2: False})


@pytest.mark.parametrize("settings", [decontam.LeakSettings(), decontam.LeakSettings(block_items=1, keep_bytes=0)])
def test_short_items(spark, settings):
    """Three and four tokens are found anywhere, one and two only as a whole text."""
    items = [(1, "What causes ocean tides?"), (2, "Define entropy"), (3, "Why?"), (4, "Name three primes"), (5, "Who wrote of Anna Karenina Petrovna here")]
    long = "so it goes on and on " * 5
    texts = [f"{long} what causes ocean tides? {long}", f"{long} define entropy {long}", "define ENTROPY!", "why", f"{long} why? {long}", f"{long}, name three primes", f"{long} who wrote of Emma Bovary here", "ocean tides", "what causes tides", None, ""]
    got = decontam.find_leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), settings)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 1), (3, 2), (4, 3), (6, 4), (7, 5)]


@pytest.mark.parametrize("between", [0, 5, 3000])
def test_copies_with_other_values_in_one_text(spark, between):
    item = "Alice has 12 apples and gives 5 kg of them to Bob Jones. How many of the 12 apples does Alice keep at home?"
    sheet = ["Carol has 31 apples and gives 9 lb of them to Tom. How many of the 31 apples does Carol keep at home?", "Peter has 88 apples and gives 7 oz of them to Ann. How many of the 88 apples does Peter keep at home?"]
    dense = "Add 1 plus 2 and 3 minus 4 then 5 times 6 over 7 less 8 and so 9 more"
    sums = ["Add 21 plus 22 and 23 minus 24 then 25 times 26 over 27 less 28 and so 29 more", "Add 31 plus 42 and 53 minus 64 then 75 times 86 over 97 less 18 and so 19 more"]
    mixed = [f"{sheet[0]}", "Who has 4 apples and gives 6 kg of nothing to 7 of them to Tim? How many of the 8 apples does 9 keep at home?"]
    filler = " ".join(f"filler{k}" for k in range(between))
    texts = [f" {filler} ".join(x) for x in (sheet, sums, sheet * 2, sums[:1], mixed)] + [filler]
    bench = spark.createDataFrame([(7, item), (8, dense)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(docs_of(spark, texts), bench).collect()}
    assert set(found) == {(1, 7), (2, 8), (3, 7), (4, 8), (5, 7)}
    assert all(r["kind"] == "reparameterised" for r in found.values())


def test_leaks_on_odd_rows(spark):
    """Rows without an id, repeated rows, long and null texts, repeated items: each pair of rows is reported."""
    item = "which river flows past the old mill before it meets the northern lake"
    long = " ".join(f"word{k % 977}" for k in range(20_000))
    rows = [(None, f"x {item} y"), (3, item), (3, item), (4, f"{long} {item.upper()} {long}"), (5, None), (6, ""), (7, "x" * 50_000), (8, long)]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["kind"]) for r in decontam.find_leaks(spark.createDataFrame(rows, DOCS).repartition(3), bench).collect())
    assert got == {(None, 1, "literal"): 2, (3, 1, "literal"): 4, (4, 1, "literal"): 2}
    left = decontam.drop_leaked(spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", chunk int"), bench)
    assert sorted((r["doc_id"], r["chunk"]) for r in left.collect()) == [(5, 7), (6, 7), (7, 7), (8, 7)]


# --- 2


def test_language_of_mixtures(spark):
    rng = random.Random(1)
    lexicon = {"aa": "the of and that with from this have".split(), "bb": "der die und nicht mit von das ein".split(), "cc": "les des pour dans une sur avec elle".split()}

    def text(lang, n):
        return " ".join(rng.choices(lexicon[lang], k=n))

    rows = [(k, text(lang, 60), lang) for k, lang in enumerate(itertools.islice(itertools.cycle(lexicon), 90))]
    model = langmix.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    tests = [text("aa", 50), text("bb", 50), text("aa", 70) + " " + text("cc", 30), "12 34", None]
    got = {r["doc_id"]: r for r in langmix.language_mixture(docs_of(spark, tests), model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 6)] == ["aa", "bb", "aa", "und", "und"]
    assert got[1]["langs"] == ["aa"] and got[3]["langs"] == ["aa", "cc"]
    assert 0.55 < got[3]["score"] < 0.85 and got[4]["score"] == 0


def slow_mixture(text, model):
    """Proportions by EM over segments and backward selection by BIC, with lists and loops; and the known share."""
    s, raw = model.settings, text.encode()
    low = [b + 32 if 65 <= b <= 90 else b for b in raw]
    fold = [b if 97 <= b <= 122 or b >= 128 else 32 for b in low]
    segments = defaultdict(list)
    for k in range(len(raw) - 3):
        own = fold[k : k + 4]
        if sum(b != 32 for b in own) < 2:
            continue
        key = int.from_bytes(bytes(own), "little") * 0x9E3779B1 % 2**32
        key = (key ^ key >> 15) * 0x85EBCA77 % 2**32
        segments[k // s.segment_bytes].append(model.log_p[key >> 32 - s.buckets_log2].astype(float))
    if not segments:
        return [0.0] * len(model.langs), 1.0
    n, langs = len(segments), range(len(model.langs))
    sums = [[sum(x[c] for x in own) for c in langs] for own in segments.values()]
    floor = -math.log(2**s.buckets_log2)
    known = (sum(max(x) >= floor * len(own) for x, own in zip(sums, segments.values(), strict=True)) + 1) / (n + 1)
    sums = [[v * s.temper for v in x] for x in sums]

    def fitted(active, rounds):
        share = [1 / len(active) if c in active else 0.0 for c in langs]
        for _ in range(rounds):
            total = [0.0 for _ in langs]
            for x in sums:
                part = [math.exp(x[c] - max(x)) * share[c] for c in langs]
                for c in langs:
                    total[c] += part[c] / (sum(part) + 1e-30)
            share = [t / n for t in total]
        evidence = sum(math.log(sum(math.exp(x[c] - max(x)) * share[c] for c in langs) + 1e-30) + max(x) for x in sums)
        return share, -2 * evidence + (len(active) - 1) * s.penalty * math.log(max(n, 2))

    active = set(langs)
    share, least = fitted(active, s.rounds)
    best = share
    while len(active) > 1:
        active.remove(min(active, key=lambda c: (share[c], c)))
        share, bic = fitted(active, s.rounds if len(active) > 1 else 0)
        if bic < least:
            best, least = share, bic
    return best, known


def test_mixtures_against_brute_force():
    rng = np.random.default_rng(11)
    settings = langmix.MixtureSettings(buckets_log2=12)
    weights = rng.gamma(0.2, size=(1 << 12, 5)) + 1e-6
    model = langmix.MixtureModel(list("abcde"), np.log(weights / weights.sum(axis=0)).astype(np.float32), np.full(5, 0.2), settings)
    words = ["the", "und", "Été", "über", "x", "7", "...", "casa", "of", "niño"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 120))) for _ in range(60)] + ["", "abc", "!!!! ????"]
    got, known = langmix.infer(columns.Texts(pa.array(texts)), model)
    for k, text in enumerate(texts):
        want, share = slow_mixture(text, model)
        assert np.allclose(got[k], want, atol=1e-6) and known[k] == pytest.approx(share)


def test_only_letters_make_a_language(spark):
    model = langmix.train(spark.createDataFrame([(1, "plain words of a text", "en")], "doc_id long, text string, lang string"))
    got = langmix.language_mixture(docs_of(spark, ["²½ ① Ⅷ 七", "²½ ① Ⅷ", "ß"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "und", "en"]


def test_languages_on_odd_rows(spark):
    """Equal texts are judged alike whatever their ids; long texts as a whole; null and empty ones are in no language."""
    model = langmix.train(spark.createDataFrame([(1, "the quick brown fox and the lazy dog " * 20, "en"), (2, "der schnelle braune fuchs und der faule hund " * 20, "de"), (None, "mehr von dem hund", "de"), (4, None, "fr")], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    long = "the dog and the fox " * 20_000
    rows = [(None, "the fox"), (7, "the fox"), (7, "the fox"), (8, long), (9, None), (10, ""), (11, "der hund " * 3 + long), (12, "x" * 50_000)]
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 6), r["known"]) for r in langmix.language_mixture(spark.createDataFrame(rows, DOCS).repartition(3), model).collect()]
    fox = {x[1:] for x in got if x[0] in (None, 7)}
    assert len(got) == 8 and len(fox) == 1 and fox.pop()[0] == "en"
    by_id = {x[0]: x[1:] for x in got}
    assert by_id[8][0] == by_id[11][0] == "en" and by_id[9] == by_id[10] == ("und", 0.0, 0.0) and all(0 <= x[2] <= 1 for x in got)


def test_texts_in_no_learned_language_go(spark):
    """The stage's decision follows the model: what it can't explain goes, what it was trained on stays."""
    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(150)] for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    rows = [(k, " ".join(rng.choices(words[lang], k=150)), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    model = langmix.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)) for _ in range(5)]
    mixed = [" ".join(rng.choices(words["aa"] + words["bb"], k=90)) for _ in range(5)]
    docs = docs_of(spark, [*noise, *mixed, rows[0][1], "7 8 9", None, "Zq."])
    assert sorted(r["doc_id"] for r in langmix.known_language_only(docs, model).collect()) == [6, 7, 8, 9, 10, 11, 14]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    folder = DATA.replace("0.001", "0.01")
    got = queries.op2_language_mixture(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


# --- 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(BASE[kind], text):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_identifiers_against_expressions():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice("01.1.2 -+(@ab.3@9") for _ in range(rng.randint(0, 60)))
        assert pii.find_base(text) == brute_base(text)
    assert pii.find_base("+1 (555) 555-7713 a@b.c 4539148803436467 1.2.3.4") == brute_base("+1 (555) 555-7713 a@b.c 4539148803436467 1.2.3.4")


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john.smith [at] mail dot example.com now", "email", "john.smith [at] mail dot example.com"),
        ("mail jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
        ("a＠b．com", "email", "a＠b．com"),
        ("call plus one five five five zero one two three four five six", "phone", "plus one five five five zero one two three four five six"),
        ("card 4539 l488 O343 6467 end", "card", "4539 l488 O343 6467"),
        ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("user (at) domain (dot) org", "email", "user (at) domain (dot) org"),
        ("user​@exam​ple.com", "email", "user​@exam​ple.com"),
    ],
)
def test_disguises_map_back(text, kind, span):
    _, added = pii.personal_data(text)
    assert (kind, text.index(span), text.index(span) + len(span)) in added


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("card 4111 1111 1111 1 one one one end", "card", "4111 1111 1111 1 one one one"),
        ("call 0171 555 12 three four now", "phone", "0171 555 12 three four"),
        ("card 411111111111111l end", "card", "411111111111111l"),
        ("card l234567890123452 end", None, None),
        ("write to me-%40example.com now", "email", "me-%40example.com"),
    ],
)
def test_disguises_without_further_signs(text, kind, span):
    _, added = pii.personal_data(text)
    # An unrelated invisible character behind the text opens every gate.
    assert added == pii.personal_data(text + " ;\u200b")[1]
    assert kind is None or (kind, text.index(span), text.index(span) + len(span)) in added


def test_gates_lose_nothing():
    rng = random.Random(33)
    parts = "4111 1111 11 1 0171 555 12 one two three vier double plus + l O I| 1l o . dot at @ %40 (at) a-b example.com mail, - word".split()
    for _ in range(6000):
        text = "".join(rng.choice(parts) + rng.choice((" ", " ", "", "-")) for _ in range(rng.randint(1, 14)))
        assert pii.personal_data(text) == pii.personal_data(text + " ;\u200b")


@pytest.mark.parametrize("text", ["look at the example.com page. He dot net is", "mail at dot com the dot", "he was one of two or three at home. Then four more came.", "", None, "at dot at dot", "x" * 3000 + "@"])
def test_clean_texts_stay_clean(text):
    assert pii.personal_data(text) == ([], [])


def test_personal_data_on_odd_rows(spark):
    long = "word " * 200_000
    rows = [(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (2, None), (3, ""), (4, long + "1.2.3.4 mail at x dot com " + long)]
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["spans"]) for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(None, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 1, "email:1000008:1000025,ip:1000000:1000007")}


@pytest.mark.parametrize(("text", "spans"), [("call 55512345 five six now", "phone:5:22"), ("card 411111111111111l end", "card:5:21"), ("card 4111 1111 1111 1 one one one", "card:5:33"), ("call 0171 555 12 three four", "phone:5:27")])
def test_what_is_found_depends_on_no_other_character(text, spans):
    for odd in ("", "\u00ad"):
        base, added = pii.personal_data(text + odd)
        assert pii._joined(base + added) == spans


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "1." * 150_000, "one " * 50_000, "a." * 100_000 + "@a"):
        pii.personal_data(text)


# --- 4


def test_labellers_and_scorer(spark):
    rng = random.Random(4)
    words = [f"word{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(400)]
    good = [" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(4000)]
    texts = ["\n".join(rng.sample(good, 6)) for _ in range(300)] + [" ".join(f"{w}###$$$" for w in rng.choices(words, k=60)) for _ in range(60)] + [" ".join(["spam ham"] * 40) for _ in range(60)]
    got = [r for r in weaklabel.weak_quality(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert all(r["kept"] for r in got[:300])
    assert sum(r["kept"] for r in got[300:]) <= 6
    patterns = np.array([[1, 1, 1], [0, 1, 1], [1, 2, 1], [2, 0, 1]], np.int8)
    posterior, accuracy, share = weaklabel.fit_labellers(patterns, np.array([80.0, 10, 5, 5]))
    assert posterior[0] > 0.9 and posterior[1] < 0.5 and posterior[3] < 0.5 and accuracy.shape == (3, 2) and 0.7 < share < 0.95


def slow_labels(patterns, counts, rounds):
    """The label model's EM with loops: one good class, and one bad class per labeller that must vote bad."""
    k = len(patterns[0])
    resp = []
    for p in patterns:
        n_bad = sum(v == 0 for v in p)
        own = [0.96 * (v == 0) / max(n_bad, 1) for v in p]
        resp.append([*own, 1 - sum(own)])
    for _ in range(rounds):
        chance = []
        for c in range(k + 1):
            row = []
            for j in range(k):
                prior = (0.05, 2.0) if c == k else (20.0, 0.1) if c == j else (0.5, 1.0)
                seen = [prior[v] + sum(r[c] * n for r, p, n in zip(resp, patterns, counts, strict=True) if p[j] == v) for v in (0, 1)]
                row.append([x / sum(seen) for x in seen])
            chance.append(row)
        share = [(sum(r[c] * n for r, n in zip(resp, counts, strict=True)) + 1) / (sum(counts) + k + 1) for c in range(k + 1)]
        new = []
        for p in patterns:
            odds = []
            for c in range(k + 1):
                like = share[c] * math.prod(chance[c][j][v] for j, v in enumerate(p) if v != 2)
                odds.append(like if c == k or p[c] == 0 else 0.0)
            new.append([x / sum(odds) for x in odds])
        done = max(abs(x - y) for a, b in zip(new, resp, strict=True) for x, y in zip(a, b, strict=True)) < 1e-6
        resp = new
        if done:
            break
    return [r[-1] for r in resp]


def test_labels_against_brute_force():
    rng = np.random.default_rng(5)
    for size in (1, 3, 6):
        patterns = np.unique(rng.integers(0, 3, (40, size)), axis=0).astype(np.int8)
        counts = rng.integers(1, 500, len(patterns)).astype(float)
        got, accuracy, share = weaklabel.fit_labellers(patterns, counts, 30)
        want = slow_labels(patterns.tolist(), counts.tolist(), 30)
        assert np.allclose(got, want, atol=1e-9) and share == pytest.approx(np.dot(want, counts) / counts.sum())
        for j in range(size):
            for c, weight in ((0, 1 - np.array(want)), (1, np.array(want))):
                voted, right = (weight * counts)[patterns[:, j] != 2].sum(), (weight * counts)[patterns[:, j] == c].sum()
                assert accuracy[j, c] == pytest.approx((right + 1) / (voted + 2))


def test_the_sample_is_bounded(spark):
    """Rows without an id and rows all alike are drawn one by one; a long text counts by its bytes."""
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text of a few words. " * 10).alias("text"))
    held = []
    real = weaklabel.train_scorer
    for settings, most in ((weaklabel.WeakSettings(train_rows=200), 600), (weaklabel.WeakSettings(train_bytes=30_000), 300)):
        model = weaklabel.fit(docs, settings)
        assert set(model.accuracy) == set(weaklabel.LABELLERS) and 0 <= model.share <= 1 and all(0 < x < 1 for pair in model.accuracy.values() for x in pair)
        batch = pa.RecordBatch.from_pydict({"text": ["a b c d e f g. " * 30] * 100})
        many = iter([batch] * 100)
        real(many, {}, settings)
        held.append(100 - len(list(many)))
        assert held[-1] * 100 <= max(most, 400) + 100


def test_weak_labels_on_odd_rows(spark):
    got = {(r["doc_id"], r["votes"], round(r["score"], 9)) for r in weaklabel.weak_quality(spark.createDataFrame([(i, t) for i, t, *_ in odd_rows()], DOCS)).collect()}
    assert len({(v, s) for i, v, s in got if i in (1, None)}) == 1  # equal texts are judged alike
    assert len({(v, s) for i, v, s in got if i in (5, 9)}) == 1
    assert len({(v, s) for i, v, s in got if i in (2, 3, 4)}) == 1 and all(v[0] == "b" for i, v, _ in got if i in (2, 3, 4))


# --- 5


def brute_repeats(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    ("alphabet", "n", "share", "settings"),
    [
        (["a ", "bé ", "the ", "of ", "xyz "], 150, 0.5, suffixdedup.SuffixSettings()),
        ("ab", 100, 0.3, suffixdedup.SuffixSettings(heavy_from=5, chunk_bytes=4000, block_bytes=3000, bucket_samples=50)),
        (["tion ", "er ", "on ", "x"], 200, 0.6, suffixdedup.SuffixSettings(heavy_from=3, chunk_bytes=3000)),
        (["tion ", "er ", "on ", "x"], 150, 0.6, suffixdedup.SuffixSettings(chunk_bytes=900, block_bytes=2000, held_bytes=1, most_parts=3, bucket_samples=500, reducer_bytes=1000)),
    ],
)
def test_repeats_against_brute_force(spark, alphabet, n, share, settings):
    rng = random.Random(5)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, 300))) for _ in range(20)]
    rows = [(i * 7 % 1000 + 1, "".join(rng.choice(pool)[rng.randint(0, 20) :] if rng.random() < share else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    rows += [(None, rows[3][1] + "x" * 80), (2000, None), (2001, ""), rows[1]]
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5), settings).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


@pytest.mark.parametrize("held", [1, 3000, 1 << 25])
def test_one_passage_in_every_document(spark, held):
    """Its key has a row for each chunk: of contexts at first, then of numbers, which only pass through."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(140))
    rows = [(k, f"{rng.random()} {passage[: rng.choice((60, 140))]} {rng.random()}" if k % 7 else passage) for k in rng.sample(range(500), 300)]
    settings = suffixdedup.SuffixSettings(chunk_bytes=400, block_bytes=1500, held_bytes=held, most_parts=4)
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(2), settings).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_blocks_stay_bounded(monkeypatch):
    """Rows of one key are never held together once its contexts are known."""
    rng = np.random.default_rng(7)
    context, n = bytes(rng.integers(97, 123, 60, dtype=np.uint8)), 20_000
    numbers = {"key": [5] * n, "content": [9] * n, "chunk": range(n), "entry": [0] * n, "windows": [11] * n, "anchor": [4] * n, "least": [3] * n, "most": range(n)}
    types = dict(zip(numbers, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))
    table = pa.table({"context": pa.array([context] * 200 + [None] * (n - 200), pa.binary())} | {c: pa.array(list(v), types[c]) for c, v in numbers.items()})
    held = []
    real = suffixdedup.Owners.__init__
    monkeypatch.setattr(suffixdedup.Owners, "__init__", lambda self, rows, s: held.append(rows.num_rows) or real(self, rows, s))
    got = pa.Table.from_batches(list(suffixdedup.resolve(iter(table.to_batches(100)), suffixdedup.SuffixSettings(block_bytes=20_000))))
    assert held and max(held) < 1000 and sorted(got["chunk"].to_pylist()) == list(range(4, n))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "a"])
def test_cover_ranks_order_long_strings(alphabet):
    rng = random.Random(8)
    n, length = 700, 50
    text = np.zeros(n + 2 * length + 64, np.uint8)
    text[:n] = np.frombuffer("".join(rng.choice([alphabet, alphabet[:1] * 30]) for _ in range(n))[:n].encode(), np.uint8)
    rank = suffixdedup.cover_ranks(suffixdedup._words(text), n, length)
    places = [p for p in range(n) if p % 13 in suffixdedup.COVER]
    raw = text.tobytes()
    want = sorted(places, key=lambda p: raw[p : p + 52])
    assert [raw[p : p + 52] for p in sorted(places, key=lambda p: rank[p])] == [raw[p : p + 52] for p in want]
    assert all((rank[a] == rank[b]) == (raw[a : a + 52] == raw[b : b + 52]) for a, b in zip(want, want[1:], strict=False))


@pytest.mark.parametrize("shares", [[0.5, 0.3], [0.01] * 20, []])
def test_groups_of_copies_are_joined_whole(spark, shares):
    rows, k = [], 0
    for g, share in enumerate(shares):
        for _ in range(int(share * 3000)):
            rows.append((g, 1, k * 7 % 3001, k, 0))
            k += 1
    rows += [(100 + x, 1, 5000 + x, 9000 + x, 0) for x in range(50)]
    entire = spark.createDataFrame(rows, "hi long, lo long, id long, chunk long, row int")
    first = {h: min(i for g, _, i, *_ in rows if g == h) for h, *_ in rows}
    assert sorted(r["chunk"] for r in suffixdedup._copies(entire).collect()) == sorted(c for h, _, i, c, _ in rows if i > first[h])


def test_runs_of_one_letter(spark):
    rows = [(1, "a" * 500), (2, "a" * 49), (3, "a" * 700 + "b"), (4, "ba" * 300), (5, "ab" * 26)]
    assert sorted((tuple(r) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_repeats(rows)


# --- 6


def test_anchors_meet():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    homes = simhash.home_anchors(prints)
    for k in range(300):
        for bits in range(3):
            other = int(prints[k])
            for b in rng.choice(64, bits, replace=False):
                other ^= 1 << int(b)
            _, near = simhash.near_anchors(np.array([other], np.uint64))
            assert homes[k] in near and len(set(near.tolist())) == len(near)


def slow_print(text):
    words = [w for w in re.split(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(120)]
    for _ in range(200):
        own = rng.choice(texts).split() or ["É", "two"]
        own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own * rng.randint(1, 8)))
    texts += [None, "", " \t", "ONE two", "one\x0btwo"]
    prints = [slow_print(t) for t in texts]
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    assert all(got[k + 1]["fingerprint"] == f"{p:016x}" for k, p in enumerate(prints))
    assert all(got[k + 1]["component_id"] == root(k) + 1 for k in range(len(texts)))


def test_long_chains_are_one_component(spark):
    edges = [(k, k + 1) for k in range(400)] + [(1000, 1001), (1001, 1002), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {k: 0 for k in range(1, 401)} | {1001: 1000, 1002: 1000}


# --- 7


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(7)
    alphabet = "aA bé ß'sİΣσ1²½٣ ́  \x1c\x85<|endoftext|>$日本éǅﬁ😀d'llT\n\tthe er ing"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x"]) for _ in range(1500)]
    texts += ["a" * 800, "!" * 300, "tokenization of unbelievable wordforms", ""]
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs_of(spark, texts), path, with_tokens=True).collect()}
    for k, text in enumerate(texts, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[k]["token_ids"] == ids and got[k]["decoded"] == decoded and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_added_tokens_of_any_form(tmp_path):
    """What tells a text with added tokens apart follows the file."""
    spec = json.load(open(queries.vocabulary_path()))
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    spec["added_tokens"] = [{**spec["added_tokens"][0], "id": top + k, "content": t} for k, t in enumerate(("[SEP]", "@end@"), 1)]
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w"))
    trie = bpe.TrieEncoder(path)
    ids, text = next(trie.encode_batch(["a [SEP] b@end@"]))
    assert {top + 1, top + 2} <= set(np.frombuffer(ids, "<u4").tolist()) and "[SEP]" in text and trie.added_sign == ""


def test_prefixes_are_worked_out_once():
    trie = bpe.TrieEncoder(queries.vocabulary_path())
    trie.encode_words({"international", "internationally", "internationals"})
    assert trie.nodes < 13 + 15 + 14 - 2 * 10


# --- 8


def slow_rules(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + o for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def slow_verdict(text):
    """The published limits, with sets of places instead of hashes."""
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    if slow_rules(text)[5]:
        return "base"
    total = sum(map(len, words))
    for n, percent in ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)):
        seen = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        hit = {k + o for k in range(len(words) - n + 1) if seen[tuple(words[k : k + n])] > 1 for o in range(n)}
        if 100 * sum(len(words[k]) for k in hit) > percent * total:
            return "ngrams"
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    chars = sum(len(w) for x in again for w in re.split(SPACE, x))
    return "lines" if 100 * len(again) > 30 * len(lines) or 100 * chars > 20 * total else "kept"


def test_verdicts_against_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(300):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(10, 160))]
        size, at = rng.randint(3, 14), rng.randrange(len(words))
        words[at:at] = words[:size]  # a passage found twice
        for _ in range(rng.randint(0, 30)):
            words.insert(rng.randrange(len(words)), rng.choice(["\n", "\nof the\n"]))
        texts.append(" ".join(words))
    got = [r["verdict"] for r in repetition.repetition_quality(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [slow_verdict(t) for t in texts]
    assert min(Counter(got)[x] for x in ("base", "ngrams", "lines", "kept")) > 5  # the method's own rules act beyond the base rule


def test_rules_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab ", "é ", "c\n", "##", "x\ty ", "\x0b", "of the "]) for _ in range(rng.randint(0, 120))) for _ in range(200)] + [None, "", "a b c d e f g h i j", "   "]
    got = repetition.repetition_quality(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got] == [slow_rules(t) for t in texts]
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_slices_do_not_matter():
    texts = pa.array(["a b c " * 40, None, "x\ny", "", "z " * 9])
    rules = repetition.RepetitionRules()
    whole = repetition.measure(columns.Texts(texts), rules)
    parts = [repetition.measure(columns.Texts(texts.slice(k, 1)), rules) for k in range(5)]
    assert all((whole[c] == np.concatenate([p[c] for p in parts])).all() for c in whole)


# --- 9


def slow_lines(rows, chars=20, docs=3):
    upper = {c: c + 32 for c in range(65, 91)}
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(" \t\n\x0b\x0c\r").translate(upper)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(" \t\n\x0b\x0c\r").translate(upper)) < chars or len(held[k]) < docs or max(held[k]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("repeat", [False, True])
def test_lines_against_brute_force(spark, repeat):
    rng = random.Random(9)
    pool = [f"{rng.choice(['', ' ', chr(9)])}Line number {k} é of some length{rng.choice(['', ' '])}" for k in range(30)] + ["é" * 19, "é" * 20, "short", ""]
    rows = [(k + 1, "\n".join(rng.choices(pool, k=rng.randint(0, 8)))) for k in range(80)] + [(200, None)]
    rows += rows[:10] if repeat else []
    got = linedrop.drop_lines(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == slow_lines(rows)


def test_many_shards(spark):
    counts = spark.range(5000).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"), (3 + F.col("id") % 5).alias("n"), F.col("id").alias("last"))
    folder, shards = linedrop.build_index(counts, shard_keys=300)
    assert shards == 17
    index = linedrop.Index(folder, shards, keep_bytes=20_000)
    rows = counts.collect()
    pairs = np.array([(r["hi"], r["lo"]) for r in rows], np.int64).view(np.uint64)
    many, last = index.last_document(pairs, 3)
    assert many.all() and last.tolist() == [r["last"] for r in rows]
    pairs[:, 1] += np.uint64(1)
    assert not index.last_document(pairs, 3)[0].any()


@pytest.mark.parametrize("shared", ["none", "upper", "lower"])
def test_hash_numbers_keys_without_gaps(shared):
    """Keys that share one of their halves are distinct keys still."""
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 20_000, dtype=np.uint64))
    one = np.full(len(keys), 7, np.uint64)
    hi, lo = {"none": (keys, keys[::-1]), "upper": (one, keys), "lower": (keys, one)}[shared]
    levels, slot = linedrop.build_mphf(hi, lo)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    order = np.argsort(slot)
    zero = np.zeros(len(keys), np.int64)
    shard = linedrop.Shard(np.array([len(x) for x in levels]), np.concatenate(levels), lo[order].view(np.int64), zero, zero)
    assert (shard.probe(hi, lo) == slot).all()
    assert shard.nbytes < 26 * len(keys)  # 24 of these are the three arrays


def test_a_task_reads_each_shard_once(spark, tmp_path, monkeypatch):
    counts = spark.range(3000).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"), F.lit(3).alias("n"), F.col("id").alias("last"))
    folder, shards = linedrop.build_index(counts, shard_keys=300)
    reads = []
    real = linedrop.Shard.__init__
    monkeypatch.setattr(linedrop.Shard, "__init__", lambda self, *rest: reads.append(1) or real(self, *rest))
    index = linedrop.Index(folder, shards, keep_bytes=0)
    pairs = np.array([(r["hi"], r["lo"]) for r in counts.collect()], np.int64).view(np.uint64)
    assert index.last_document(pairs, 3)[0].all() and len(reads) == shards


@pytest.mark.parametrize("window", [1, 2000, 1 << 26])
def test_windows_do_not_matter(spark, window):
    line = "this line is held by several documents"
    rows = [(k, f"own line of document number {k}\n{line}\nshort" if k % 3 else f"{line}\n{line}") for k in range(60)]
    got = linedrop.drop_lines(spark.createDataFrame(rows, DOCS).repartition(3), window_bytes=window).collect()
    assert sorted(tuple(r) for r in got) == slow_lines(rows)


# --- 10


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "", None, "<p>é</p>", "a\r\n\r\nb", "<p>é</p>", "WARC/1.1\r\n\r\n"]
    rows = [(10 - k, None if k == 2 else f"http://x/{k}?%41\r\n", h) for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = fresh_path(spark, "warc-test")
    for limit in (2_000_000, 0):  # by broadcast and by a join
        index = warc.write_archives(pages, folder, broadcast_bytes=limit, file_bytes=700)
        got = {r["page_id"]: r for r in warc.read_records(index, folder, run_bytes=300, with_payload=True).collect()}
        first = {}
        for page_id, _, h in sorted(rows):
            first.setdefault(h or "", page_id)
        for page_id, url, h in rows:
            r, payload = got[page_id], (h or "").encode()
            assert r["payload_bytes"] == len(payload) and r["payload_digest"] == warc.digest_of(payload) and r["url"] == url
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == page_id else ("revisit", first[h or ""]))
            assert r["payload"] == (payload.decode() if r["record_type"] == "response" else None)
    some = warc.read_records(index.filter("page_id in (4, 6)"), folder).collect()
    assert {r["page_id"] for r in some} == {4, 6}
    small = warc.write_archives(pages, folder, revisit_min_bytes=5)
    assert {r["page_id"] for r in small.collect() if r["record_type"] == "revisit"} == {7, 10}


# --- pipeline and entry


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    bench = prose(30)
    boiler = "This line stands in every one of the documents"
    texts = {k: f"{prose(80)}\n{boiler}\n{prose(40)}" for k in range(1, 21)}
    texts[21] = texts[3]
    texts[22] = f"{prose(30)} {bench} {prose(30)}"
    texts[23] = "123 456"
    rows = [(k, t, "en", "s", len(t), "x") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.columns, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(names) - 1:
            assert docs.columns == before
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == set(range(1, 23))
    lines = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert [k for k, r in lines.items() if boiler in r["text"]] == [21] and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert 22 not in seen[3] and seen[3] == seen[4] and set(range(4, 21)) <= seen[4]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_exact_copies_leave_one(spark):
    docs = docs_of(spark, ["some words that make a longer text for a print"] * 5 + [None, "other words altogether in this one here"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 6, 7]


def test_rows_that_share_an_id_stay_or_go_together(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    rows = [(1, text), (1, near), (2, near), (3, other), (3, text), (None, text), (None, text), (4, None), (5, "")]
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    assert Counter(left) == {1: 2, None: 2, 4: 1}


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with edits of their own: those near the hub need a pair each, the others' few that finer bits allow."""
    rng = random.Random(31)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for _ in range(400):
        own = list(base)
        for _ in range(rng.choice((1, 2, 3, 3, 4))):
            own[rng.randrange(len(own))] = f"e{rng.random()}"
        texts.append(" ".join(own))
    asked = []
    real = nearcopies._checked
    monkeypatch.setattr(nearcopies, "_checked", lambda pairs, shingles: asked.append(pairs.count()) or real(pairs, shingles))
    docs = docs_of(spark, texts)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for t in texts]
    near = {k + 1 for k, x in enumerate(sets) if k and 5 * len(x & sets[0]) >= 4 * len(x | sets[0])}
    assert 1 in left and len(near) > 200 and not near & left and len(left) > 20
    assert asked[0] < 4 * len(texts) and sum(asked) < len(texts) * (len(texts) - 1) / 2 / 15


def test_edited_copies_leave_one(spark):
    rng = random.Random(17)
    words = [f"w{k}" for k in range(3000)]
    texts, family = [], []
    for f in range(60):
        base = rng.choices(words, k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, len(own) // 40, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
            family.append(f)
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    prints, group = [slow_print(t) for t in texts], list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    far = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        apart, near = (prints[a] ^ prints[b]).bit_count(), 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        far += near and apart > 2
        if near or apart <= 2:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    assert far > 50
    docs = docs_of(spark, texts).repartition(5)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {root(k) + 1 for k in range(len(texts))}


def test_entry_without_the_corpus_operators(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name.startswith(('sheafline.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e, json\nprint(json.dumps([k for k in e.queries()]))"
    names = json.loads(subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout)
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_nothing_else_imports_the_corpus_operators():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(here, "sheafline")):
        if not folder.endswith(("llm", "__pycache__")):
            for name in files:
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "sheafline.llm" not in file.read()


def test_unicode_is_whole():
    assert unicodedata.normalize("NFC", "é") == "é" and pii.find_base("é@é.c") == []


# --- items alike but for their slots


def alone(text, items):
    """Leaks with each item in a block of its own."""
    found = set()
    for k, item in enumerate(items):
        found |= {(r, k, *rest) for r, _, *rest in decontam._leaks(columns.Texts(pa.array(text)), decontam.Block([(0, item)], decontam.LeakSettings()))}
    return found


@pytest.mark.parametrize("seed", range(6))
def test_items_alike_are_judged_as_each_alone(seed):
    rng = random.Random(seed)
    names = ["Tom", "Ann", "Bob Jones", "Eve"]

    def question(form, k):
        x, y = rng.choice(names), rng.choice(names)
        return [f"Once {x} had {k} apples and gave {k % 7} kg of them to {y} before noon, said {x}", f"There are {k} boats with {k + rng.choice([0, 1])} sails each in the small harbour of this town"][form]

    items = [question(rng.randrange(2), rng.randint(1, 12)) for _ in range(40)]
    texts = []
    for _ in range(12):
        own = [question(rng.randrange(2), rng.choice([3, 5, 500, 501])) for _ in range(rng.randint(1, 4))] + rng.sample(items, rng.randint(0, 3)) + ["nothing of the kind " * rng.randint(0, 5)]
        rng.shuffle(own)
        texts.append(". ".join(own))
    got = {(r, k, *rest) for r, k, *rest in decontam._leaks(columns.Texts(pa.array(texts)), decontam.Block(list(enumerate(items)), decontam.LeakSettings()))}
    want = alone(texts, items)
    assert len(got) > 100 and {x[:4] + x[6:] if x[4] != "literal" else x for x in got} == {x[:4] + x[6:] if x[4] != "literal" else x for x in want}
    assert {x[:5] for x in got} == {x[:5] for x in want}
    # Which of two values goes with which is decided by votes, of equal ones by value: the first item's decide for all.
    assert len(got ^ want) <= 0.2 * len(want)


def test_thousands_of_items_of_one_template_take_little_time():
    import time

    def item(k):
        return f"Tom has {k} apples and gives some of them to his friends at school today"

    block = decontam.Block([(k, item(k + 10)) for k in range(3000)], decontam.LeakSettings())
    took = []
    for copies in (200, 2000):
        text = ". ".join(item(100_000 + 7 * c) for c in range(copies)) + ". " + item(17)
        began = time.perf_counter()
        found = {k: rest for _, k, *rest in decontam._leaks(columns.Texts(pa.array([text])), block)}
        took.append(time.perf_counter() - began)
        assert len(found) == 3000 and found[7][2:4] == ["literal", ""] and found[8][2:4] == ["reparameterised", "18=100000"]
    assert took[1] < 15 and took[1] < 25 * took[0] + 1  # 150 KB; linear in the text


def test_signs_of_four_bytes_are_no_words():
    item = "how many small red apples are in the big basket now"
    texts = [item, "😀 ".join(item.split(" ")), "😀".join(f" {w} " for w in item.split()), item.replace(" ", "😀")]
    for own in ([(0, item)], [(0, texts[1])], [(0, "😀" + item + "😀")]):
        assert {r for r, *_ in decontam._leaks(columns.Texts(pa.array(texts)), decontam.Block(own, decontam.LeakSettings()))} == {0, 1, 2, 3}
    rare = "𐐀𐐁 𠮷𠮷 𐐂𐐃 𐐄𐐅 𐐆𐐇 𐐈𐐉"  # letters they are, and have capitals
    assert [r for r, *_ in decontam._leaks(columns.Texts(pa.array([rare.casefold(), "x"])), decontam.Block([(0, rare)], decontam.LeakSettings()))] == [0]


# --- dotted addresses


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("at 192[.]168[.]1[.]10 now", "192[.]168[.]1[.]10"),
        ("at 192 dot 168 dot 1 dot 10 now", "192 dot 168 dot 1 dot 10"),
        ("at 192(dot)168 (.) 1{punkt}10.", "192(dot)168 (.) 1{punkt}10"),
        ("at 192.168[.]1.10 now", "192.168[.]1.10"),
        ("one nine two dot one six eight dot one dot one", "one nine two dot one six eight dot one dot one"),
        ("at 10&#46;0&#46;0&#46;1 now", "10&#46;0&#46;0&#46;1"),
        ("at ten 10 [dot] zero [dot] zero [dot] one now", "10 [dot] zero [dot] zero [dot] one"),
        ("at １９２[.]168[.]1[.]10 now", "１９２[.]168[.]1[.]10"),
        ("192[.]168[.]1[.]999", None),
        ("chapter 3 point 2 point 1 says", None),
        ("see [1][.][2] and 5 dot 6", None),
        ("192.168.1.10", None),
    ],
)
def test_dotted_addresses(text, found):
    base, added = pii.personal_data(text)
    assert [text[a:b] for k, a, b in added if k == "ip"] == ([found] if found else []) and not [x for x in added if x[0] != "ip"]


def test_added_spans_are_those_without_gates(monkeypatch):
    """All rewritings and all detectors on every text give what the gates let through."""
    rng = random.Random(9)
    pieces = ["192", "168", "[.]", " dot ", "(dot)", "&#46;", "joe", "@", "[at]", " at ", "mail", "com", ".", "one", "two ", "nine ", "+", "4111 1111 1111 1111", "О", "0", "O", " ", "​", "é", "-", "555"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(4000)]
    gated = [pii.personal_data(t) for t in texts]
    monkeypatch.setattr(pii, "_DISGUISE_SIGN", re.compile(""))
    assert [pii.personal_data(t) for t in texts] == gated and sum(bool(x[1]) for x in gated) > 100
